"""Data layer: logs, payloads, curated tables, interaction statistics, text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.operators import normalize as N
from cadenza.operators.catalog import build_catalog
from cadenza.operators.evaluate import dataset_labels
from cadenza.operators.interactions import (
    aggregate_strengths, coverage_stats, listens_to_interactions, matrix_stats, merge_interactions,
    recent_play_strengths,
)
from cadenza.sources.payloads import playlist_artist_ids, playlist_track_ids
from registry import views as V
from registry.sql import slug, view, with_views


def _times(df):
    return df.withColumn("first_timestamp", F.unix_micros("first_timestamp")).withColumn(
        "last_timestamp", F.unix_micros("last_timestamp")
    )


def listen_interactions(spark, d):
    return _times(listens_to_interactions(V.listens(spark, d)))


def listen_merge(spark, d):
    """The log aggregated in two loads and merged: same rows as one aggregation."""
    rows = V.listens(spark, d)
    cut = F.second("ts") < 30  # most pairs have listens in both loads
    return _times(merge_interactions(listens_to_interactions(rows.where(cut)), listens_to_interactions(rows.where(~cut))))


LISTEN_SQL = """
  SELECT user_id, track_id, count(*) AS listen_count, cast(count(*) AS DOUBLE) AS interaction_strength,
         arg_min(artist_name, (ts, artist_name)) AS artist_name, arg_min(track_name, (ts, track_name)) AS track_name,
         epoch_us(min(ts)) AS first_timestamp, epoch_us(max(ts)) AS last_timestamp
  FROM v_listens GROUP BY 1, 2
"""


def strength_totals(spark, d):
    rows = V.plays(spark, d).withColumn("interaction_strength", F.col("quantity").cast("string"))
    return aggregate_strengths(rows)


def recent_strengths(spark, d):
    return recent_play_strengths(V.recent(spark, d))


def interaction_stats(spark, d):
    s = matrix_stats(V.interactions(spark, d))
    return s.withColumn("density", F.round("density", 9)).withColumn("sparsity", F.round("sparsity", 9))


def _coverage(spark, d):
    return coverage_stats(V.interactions(spark, d), V.tracks(spark, d), min_user_interactions=5)


def coverage(spark, d):
    c = _coverage(spark, d)
    return c.withColumns({f.name: F.round(f.name, 6) for f in c.schema.fields if f.dataType.typeName() == "double"})


def coverage_labels(spark, d):
    return dataset_labels(_coverage(spark, d))


view("v_per_user", "SELECT user_id, count(*) AS n FROM v_interactions GROUP BY 1")
view("v_per_track", "SELECT track_id, count(*) AS n FROM v_interactions GROUP BY 1")
view("v_coverage", """
  SELECT u.*, t.*, (SELECT count(DISTINCT track_id) FROM v_tracks) AS unique_tracks_in_catalog,
         user_count * unique_tracks_in_interactions AS possible_interactions,
         observed_interactions / cast(user_count * unique_tracks_in_interactions AS DOUBLE) AS matrix_density
  FROM (SELECT cast(sum(n) AS BIGINT) AS interaction_count, count(*) AS user_count, avg(n) AS average_interactions_per_user,
               median(n) AS median_interactions_per_user, cast(sum(n) AS BIGINT) AS observed_interactions,
               count(*) FILTER (n >= 5) AS evaluated_users,
               coalesce(avg(n - 1) FILTER (n >= 5), 0.0) AS average_train_interactions_per_evaluated_user FROM v_per_user) u,
       (SELECT count(*) AS unique_tracks_in_interactions, avg(n) AS average_users_per_track,
               median(n) AS median_users_per_track,
               avg(CASE WHEN n > 1 THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS tracks_with_more_than_one_listener_pct FROM v_per_track) t
""")
COVERAGE_SQL = """
  SELECT interaction_count, user_count, unique_tracks_in_interactions, unique_tracks_in_catalog,
         round(average_interactions_per_user, 6) AS average_interactions_per_user,
         round(median_interactions_per_user, 6) AS median_interactions_per_user,
         round(average_users_per_track, 6) AS average_users_per_track,
         round(median_users_per_track, 6) AS median_users_per_track,
         round(tracks_with_more_than_one_listener_pct, 6) AS tracks_with_more_than_one_listener_pct,
         possible_interactions, observed_interactions, round(matrix_density, 6) AS matrix_density,
         round(1 - matrix_density, 6) AS matrix_sparsity, evaluated_users,
         round(average_train_interactions_per_evaluated_user, 6) AS average_train_interactions_per_evaluated_user
  FROM v_coverage
"""


def catalog_build(spark, d):
    c = build_catalog(V.named_interactions(spark, d))
    return c.withColumns({f.name: F.round(f.name, 6) for f in c.schema.fields if f.dataType.typeName() == "double"})


CATALOG_SQL = f"""
  , i AS (SELECT x.*, p_brand AS artist_name, p_name AS track_name FROM v_interactions x JOIN part ON p_partkey = track_id),
  t AS (SELECT track_id, min(track_name) AS track_name, min(artist_name) AS artist_name, sum(interaction_strength) AS pc,
               cast(len(string_split(min(track_name), ' ')) AS DOUBLE) AS tt FROM i GROUP BY 1),
  a AS (SELECT artist_name, sum(interaction_strength) AS af, cast(count(DISTINCT track_id) AS DOUBLE) AS atc FROM i GROUP BY 1)
  SELECT track_id, track_name, artist_name, artist_name AS primary_artist_name, round(pc, 6) AS popularity_count,
         round(pc / (SELECT max(pc) FROM t), 6) AS normalized_popularity, round(af, 6) AS artist_frequency,
         round(atc, 6) AS artist_track_count, tt AS title_token_count,
         round(pc / (SELECT max(pc) FROM t) * 100.0, 6) AS popularity,
         round(pc / (SELECT max(pc) FROM t), 6) AS catalog_popularity,
         round(af / (SELECT max(af) FROM a), 6) AS catalog_artist_frequency,
         round(atc / (SELECT max(atc) FROM a), 6) AS catalog_artist_track_count,
         round(tt / (SELECT max(tt) FROM t), 6) AS catalog_title_token_count,
         'artist_' || {slug("artist_name")} AS artist_genres
  FROM t JOIN a USING (artist_name)
"""


def _audio(spark, d):
    cols = ["track_id", "danceability", "energy", "valence", "tempo", "acousticness", "instrumentalness", "loudness"]
    return V.tracks(spark, d).select(*cols, F.lit(1).alias("duration_ms"))


def _metadata(spark, d):
    p = V.table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("track_id"), F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("name"),
        F.concat(F.col("p_brand"), F.lit(", Guest")).alias("artist_names"), F.col("p_brand").alias("primary_artist_id"),
        F.col("p_retailprice").alias("popularity"),
    )


def _track_level(spark, d):
    lines = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("track_id"))
    return N.track_level(_metadata(spark, d), _audio(spark, d), lines, V.artists(spark, d))


def track_level(spark, d):
    t = _track_level(spark, d)
    return t.withColumns({f.name: F.round(f.name, 6) for f in t.schema.fields if f.dataType.typeName() == "double"})


TRACK_LEVEL_SQL = """
  SELECT track_id, trim(p_name) AS track_name, p_brand AS primary_artist_id, p_brand AS primary_artist_name,
         p_brand || ', Guest' AS artist_names,
         coalesce('folk rock, ' || lower(split_part(a.genres, ',', 1)), '') AS g1,
         p_retailprice AS popularity, round(danceability, 6) AS danceability, round(energy, 6) AS energy,
         round(loudness, 6) AS loudness, round(acousticness, 6) AS acousticness,
         round(instrumentalness, 6) AS instrumentalness, round(valence, 6) AS valence, round(tempo, 6) AS tempo,
         cast(coalesce((SELECT n FROM v_li WHERE v_li.track_id = p_partkey), 0) AS BIGINT) AS playlist_occurrences,
         coalesce(a.popularity, 0.0) AS artist_popularity, coalesce(a.followers_total, 0) AS artist_followers_total,
         coalesce(list_aggregate(list_sort(list_distinct([lower(split_part(a.genres, ',', 1)), 'folk rock'])), 'string_agg', ', '), '') AS artist_genres
  FROM part JOIN v_tracks ON track_id = p_partkey LEFT JOIN v_artists a ON a.artist_id = p_brand
"""


def artist_level(spark, d):
    a = N.artist_level(V.artists(spark, d), _track_level(spark, d))
    doubles = [f.name for f in a.schema.fields if f.dataType.typeName() == "double"]
    return a.withColumns({c: F.round(c, 5 if c == "avg_tempo" else 6) for c in doubles})


ARTIST_SQL = """
  SELECT coalesce(artist_id, p_brand) AS artist_id, coalesce(name, '') AS name,
         coalesce(list_aggregate(list_sort(list_distinct([lower(split_part(a.genres, ',', 1)), 'folk rock'])), 'string_agg', ', '), '') AS genres,
         round(coalesce(a.popularity, 0.0), 6) AS popularity, coalesce(followers_total, 0) AS followers_total,
         coalesce(track_count, 0) AS track_count, round(coalesce(ap, 0.0), 6) AS avg_track_popularity,
         round(coalesce(ad, 0.0), 6) AS avg_danceability, round(coalesce(ae, 0.0), 6) AS avg_energy,
         round(coalesce(av, 0.0), 6) AS avg_valence, round(coalesce(tp, 0.0), 5) AS avg_tempo
  FROM v_artists a FULL JOIN (
    SELECT p_brand, count(DISTINCT p_partkey) AS track_count, avg(p_retailprice) AS ap, avg(danceability) AS ad,
           avg(energy) AS ae, avg(valence) AS av, avg(tempo) AS tp
    FROM part JOIN v_tracks ON track_id = p_partkey GROUP BY 1) t ON artist_id = p_brand
"""


def track_payload(spark, d):
    """part as nested track payloads of one track each."""
    p = V.table(spark, d, "part")
    artists = F.array(
        F.struct(F.col("p_brand").alias("id"), F.col("p_brand").alias("name")),
        F.struct(F.lit("Guest").alias("id"), F.col("p_type").alias("name")),
    )
    images = F.when(F.col("p_size") > 25, F.array(F.struct(F.col("p_name").alias("url"))))
    album = F.struct(
        F.col("p_type").alias("id"), F.lower("p_type").alias("name"), F.lit("1999").alias("release_date"),
        F.col("p_size").cast("long").alias("total_tracks"), images.alias("images"),
    )
    track = F.struct(
        F.concat(F.lit(" T"), F.col("p_partkey"), F.lit(" ")).alias("id"), F.col("p_name").alias("name"), artists.alias("artists"),
        album.alias("album"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("boolean").alias("explicit"),
        F.col("p_retailprice").alias("popularity"), F.lit(None).cast("string").alias("preview_url"),
        F.lit(1).cast("long").alias("track_number"), F.lit(1).cast("long").alias("disc_number"),
        F.create_map(F.lit("page"), F.col("p_name")).alias("external_urls"),
    )
    return p.select(F.array(track, F.when(F.lit(False), track)).alias("tracks"))


def payload_tracks(spark, d):
    """Tracks as nested payload rows, flattened again."""
    return N.track_metadata(track_payload(spark, d))


PAYLOAD_TRACKS_SQL = """
  SELECT 'T' || p_partkey AS track_id, p_name AS name, p_brand AS primary_artist_id, p_brand AS primary_artist_name,
         lower(p_brand) || ', guest' AS artist_ids,
         list_aggregate(list_sort([p_brand, p_type]), 'string_agg', ', ') AS artist_names,
         p_type AS album_id, lower(p_type) AS album_name, '1999' AS album_release_date,
         cast(p_size AS BIGINT) AS album_total_tracks, CASE WHEN p_size > 25 THEN p_name ELSE '' END AS album_image_url,
         cast(0 AS BIGINT) AS duration_ms, false AS explicit, p_retailprice AS popularity, '' AS preview_url,
         cast(1 AS BIGINT) AS track_number, cast(1 AS BIGINT) AS disc_number, p_name AS track_url
  FROM part
"""


def playlist_payload(spark, d):
    """Orders as playlists: the lines of an order are its items (a handful each)."""
    li = V.table(spark, d, "lineitem")
    artist = F.struct(F.concat(F.lit("S"), F.col("l_suppkey")).alias("id"), F.lit("x").alias("name"))
    track = F.struct(
        F.concat(F.lit("T"), F.col("l_partkey")).alias("id"), F.lit("song").alias("name"), F.array(artist).alias("artists"),
        F.struct(F.lit("A").alias("id"), F.lit("B").alias("name"), F.lit("1999").alias("release_date")).alias("album"),
        F.lit(1000).cast("long").alias("duration_ms"), F.lit(False).alias("explicit"), F.col("l_tax").alias("popularity"),
    )
    item = F.struct(
        F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_tax").alias("x"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("added_at"), F.struct(F.lit("me").alias("id")).alias("added_by"),
        track.alias("track"),
    )
    return li.groupBy(F.col("l_orderkey").cast("string").alias("playlist_id")).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )


def payload_playlists(spark, d):
    rows = N.playlist_tracks(playlist_payload(spark, d))
    return rows.groupBy("playlist_id", "track_id", "track_artist_ids", "added_at", "album_name", "added_by_user_id").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.sum("track_popularity"), 6).alias("track_popularity")
    )


def playlist_ids(spark, d):
    return playlist_track_ids(playlist_payload(spark, d))


def playlist_artists(spark, d):
    return playlist_artist_ids(playlist_payload(spark, d)).select("playlist_id", "artist_id", "pos")


view("v_items", """
  SELECT cast(l_orderkey AS VARCHAR) AS playlist_id, 'T' || l_partkey AS track_id, 's' || l_suppkey AS artist_id,
         strftime(l_shipdate, '%Y-%m-%d') AS added_at, l_tax,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_tax, l_shipdate) - 1 AS pos
  FROM lineitem
""")


def text_keys(spark, d):
    """Keys of every document: the source as artist, the whole text as title."""
    t = V.table(spark, d, "documents")
    artist, title = F.col("source"), F.col("text")
    key = X.name_artist_key(F.col("doc_id"), title, artist)
    return t.select(
        "doc_id", F.md5(X.slug(title)).alias("slug_md5"), X.track_key(artist, title, "doc_").alias("track_key"),
        X.artist_token(artist).alias("artist_token"), X.token_count(title).alias("tokens"),
        F.md5(key["k1"]).alias("title_md5"), key["k2"].alias("artist_key"),
        X.looks_like_catalog_id(F.substring(F.sha1(title), 1, 22)).alias("is_id"),
        X.track_label(F.col("lang"), artist).alias("label"),
    )


_T = "lower(text)"
for _p in (
    r"\([^)]*(live|remix|edit|version|mono|stereo)[^)]*\)", r"\[[^\]]*(live|remix|edit|version|mono|stereo)[^\]]*\]",
    r"\b(live|remix|radio edit|edit|version|mono|stereo|remastered)\b", "[^a-z0-9]+",
):
    _T = f"regexp_replace({_T}, '{_p}', ' ', 'g')"
TEXT_SQL = f"""
  SELECT doc_id, md5({slug("text")}) AS slug_md5,
         'doc_' || substr(sha1({slug("source")} || '::' || {slug("text")}), 1, 16) AS track_key,
         'artist_' || {slug("source")} AS artist_token,
         len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x <> '')) AS tokens,
         md5(trim({_T})) AS title_md5, source AS artist_key, true AS is_id, lang || ' - ' || source AS label
  FROM documents
"""


def genre_lists(spark, d):
    p = V.table(spark, d, "part")
    raw = F.concat(F.col("p_type"), F.lit(",  "), F.regexp_replace("p_name", " ", "_"), F.lit(" , "), F.col("p_type"), F.lit(", "))
    loose = F.concat(F.lit("['"), F.col("p_type"), F.lit("' | '"), F.col("p_name"), F.lit("'; "), F.col("p_brand"), F.lit("/"), F.lit(" ]"))
    return p.select(
        "p_partkey", X.normalized_ids(raw).alias("ids"), X.normalized_names(raw).alias("names"),
        X.normalized_genres(raw).alias("genres"), X.first_token(raw).alias("first"),
        F.array_join(X.genre_terms(loose), "|").alias("terms"), F.array_join(X.genre_labels(raw), "|").alias("labels"),
        F.array_join(X.genre_tokens(raw), "|").alias("tokens"),
    )


_W = "replace(p_name, ' ', '_')"
GENRE_SQL = f"""
  SELECT p_partkey, list_aggregate(list_sort([lower(p_type), lower({_W})]), 'string_agg', ', ') AS ids,
         list_aggregate(list_sort([p_type, {_W}]), 'string_agg', ', ') AS names,
         list_aggregate(list_sort([lower(p_type), lower({_W})]), 'string_agg', ', ') AS genres, p_type AS first,
         p_type || '|' || p_name || '|' || p_brand AS terms, p_type || '|' || p_name AS labels,
         list_aggregate(list_sort([lower(p_type), lower({_W})]), 'string_agg', '|') AS tokens
  FROM part
"""


def missingness(spark, d):
    docs = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id", "left")
    return N.missing_ratio(docs).withColumn("missing_ratio", F.round("missing_ratio", 9))


MISSING_SQL = """
  SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS column_name,
         unnest([avg(CASE WHEN d.doc_id IS NULL THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN text IS NULL THEN 1.0::DOUBLE ELSE 0 END),
                 avg(CASE WHEN lang IS NULL THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN source IS NULL THEN 1.0::DOUBLE ELSE 0 END),
                 avg(CASE WHEN n_chars IS NULL THEN 1.0::DOUBLE ELSE 0 END), round(avg(CASE WHEN quality IS NULL THEN 1.0::DOUBLE ELSE 0 END), 9),
                 round(avg(CASE WHEN toxic IS NULL THEN 1.0::DOUBLE ELSE 0 END), 9)]) AS missing_ratio
  FROM documents d LEFT JOIN labels USING (doc_id)
"""

QUERIES = {
    "listen_interactions": listen_interactions, "listen_merge": listen_merge, "strength_totals": strength_totals,
    "recent_strengths": recent_strengths, "interaction_stats": interaction_stats, "coverage_stats": coverage,
    "coverage_labels": coverage_labels, "catalog_build": catalog_build, "track_level": track_level,
    "artist_level": artist_level, "payload_tracks": payload_tracks, "payload_playlists": payload_playlists,
    "playlist_track_ids": playlist_ids, "playlist_artist_ids": playlist_artists, "text_keys": text_keys,
    "genre_lists": genre_lists, "missing_ratio": missingness,
}
ORACLES = {
    "listen_interactions": with_views(LISTEN_SQL),
    "listen_merge": with_views(LISTEN_SQL),
    "strength_totals": with_views("SELECT user_id, track_id, sum(quantity) AS interaction_strength FROM v_plays GROUP BY 1, 2"),
    "recent_strengths": with_views("SELECT user_id, track_id, count(*) AS interaction_strength FROM v_recent GROUP BY 1, 2"),
    "interaction_stats": with_views("""
      SELECT users, tracks, interactions, round(interactions / cast(users * tracks AS DOUBLE), 9) AS density,
             round(1 - interactions / cast(users * tracks AS DOUBLE), 9) AS sparsity
      FROM (SELECT count(DISTINCT user_id) AS users, count(DISTINCT track_id) AS tracks, count(*) AS interactions FROM v_interactions)"""),
    "coverage_stats": with_views(COVERAGE_SQL),
    "coverage_labels": with_views("""
      SELECT CASE WHEN average_users_per_track >= 2 AND tracks_with_more_than_one_listener_pct >= 25 THEN 'strong' ELSE 'weak' END AS overlap,
             CASE WHEN matrix_density < 0.01 THEN 'high' ELSE 'moderate' END AS sparsity,
             CASE WHEN average_users_per_track >= 2 AND tracks_with_more_than_one_listener_pct >= 25 THEN 'has useful' ELSE 'has limited' END AS latent_factor_signal,
             CASE WHEN average_interactions_per_user >= 10 THEN 'have useful' ELSE 'have limited' END AS context_signal,
             CASE WHEN average_users_per_track >= 2 AND tracks_with_more_than_one_listener_pct >= 25 THEN 'is less likely to dominate' ELSE 'may remain competitive' END AS content_outlook
      FROM v_coverage"""),
    "catalog_build": with_views("SELECT 1 FROM v_interactions").rsplit("\nSELECT 1", 1)[0] + CATALOG_SQL,
    "track_level": with_views(TRACK_LEVEL_SQL).replace(
        "coalesce('folk rock, ' || lower(split_part(a.genres, ',', 1)), '') AS g1,\n", ""),
    "artist_level": with_views(ARTIST_SQL),
    "payload_tracks": PAYLOAD_TRACKS_SQL,
    "payload_playlists": with_views("""
      SELECT playlist_id, track_id, artist_id AS track_artist_ids, added_at, 'B' AS album_name, 'me' AS added_by_user_id,
             count(*) AS items, round(sum(l_tax), 6) AS track_popularity FROM v_items GROUP BY ALL"""),
    "playlist_track_ids": with_views("SELECT playlist_id, track_id, cast(min(pos) AS INTEGER) AS pos FROM v_items GROUP BY 1, 2"),
    "playlist_artist_ids": with_views("SELECT playlist_id, upper(artist_id) AS artist_id, cast(min(pos) AS INTEGER) AS pos FROM v_items GROUP BY 1, 2"),
    "text_keys": TEXT_SQL,
    "genre_lists": GENRE_SQL,
    "missing_ratio": MISSING_SQL,
}
