"""Per-user candidate tracks: recent plays, expansion over the catalog, duplicates, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.functions.columns import try_double, unit
from cadenza.functions.text import (
    first_non_blank, first_token, genre_terms, is_blank, looks_like_catalog_id, name_artist_key, split_list, strip,
)
from cadenza.plans.skew import salted_join, top_k

# Sizes of the expansion and defaults of missing audio columns.
RECENT_PLAYS = 20
SEEDS = 8
RECENT_ARTISTS = 5
TOP_PER_ARTIST = 6
MATCHES_PER_ARTIST = 4
MATCHES_PER_TRACK = 2
RECENT_TRACKS = 4
GENRES = 2
MAX_CANDIDATES = 80
AUDIO_DEFAULTS = {
    "danceability": 0.5, "energy": 0.5, "valence": 0.5, "tempo": 120.0, "acousticness": 0.5,
    "speechiness": 0.1, "instrumentalness": 0.0, "loudness": -10.0,
}
SOURCE_LABELS = [
    "recent artist top track", "recent artist search match", "recent track search match", "genre search match",
]


# --- recent history -------------------------------------------------------------------------------


def recent_plays(plays: DataFrame, *, limit: int = RECENT_PLAYS) -> DataFrame:
    """Newest ``limit`` plays per user; ``pos`` 0 is the newest. Pruned map-side, so hot users stay cheap."""
    ranked = top_k(plays, ["user_id"], [F.desc("played_at"), F.col("track_id")], limit)
    return ranked.withColumn("pos", F.col("rank") - 1).drop("rank")


def seed_tracks(recent: DataFrame, *, limit: int = SEEDS) -> DataFrame:
    """(user_id, track_id, seed_pos): first distinct recent tracks."""
    first = recent.groupBy("user_id", "track_id").agg(F.min("pos").alias("first_pos"))
    return top_k(first, ["user_id"], [F.col("first_pos"), F.col("track_id")], limit).select(
        "user_id", "track_id", (F.col("rank") - 1).alias("seed_pos")
    )


def distinct_recent(recent: DataFrame, values: Column, *, limit: int | None = None, name: str = "value") -> DataFrame:
    """(user_id, value, pos): distinct non-blank members of an array column, in recency order."""
    rows = recent.select("user_id", "pos", F.posexplode(values).alias("inner", "v")).where(~is_blank(F.col("v")))
    first = rows.groupBy("user_id", "v").agg(F.min(F.struct("pos", "inner")).alias("at"))
    ordered = top_k(first, ["user_id"], [F.col("at")], limit if limit is not None else 2**31 - 1)
    return ordered.select("user_id", F.col("v").alias(name), (F.col("rank") - 1).alias("value_pos"))


def recent_artists(recent: DataFrame, *, limit: int | None = None) -> DataFrame:
    return distinct_recent(recent, split_list(F.col("artist_name")), limit=limit, name="artist_name")


def recent_artist_ids(recent: DataFrame, *, limit: int | None = None, only_catalog_ids: bool = False) -> DataFrame:
    rows = recent.where(looks_like_catalog_id(F.col("primary_artist_id"))) if only_catalog_ids else recent
    return distinct_recent(rows, F.array("primary_artist_id"), limit=limit, name="primary_artist_id")


def recent_genres(recent: DataFrame, *, limit: int | None = None) -> DataFrame:
    return distinct_recent(recent, genre_terms(F.col("artist_genres")), limit=limit, name="genre")


def recent_titles(recent: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Distinct (title, first artist) pairs, case-insensitively, in recency order."""
    rows = recent.select(
        "user_id", "pos", strip(F.col("track_name")).alias("t"),
        F.coalesce(strip(F.get(F.split("artist_name", ","), F.lit(0))), F.lit("")).alias("a"),
    ).where(F.col("t") != "")
    first = rows.groupBy("user_id", F.lower("t").alias("title"), F.lower("a").alias("artist")).agg(
        F.min("pos").alias("at")
    )
    ordered = top_k(first, ["user_id"], [F.col("at")], limit if limit is not None else 2**31 - 1)
    return ordered.select("user_id", "title", "artist", (F.col("rank") - 1).alias("value_pos"))


# --- expansion ------------------------------------------------------------------------------------


def _copy_key() -> Column:
    return name_artist_key(F.col("track_id"), F.col("track_name"), first_token(F.col("artist_name")))


def _best_per_key(catalog: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Up to n most popular tracks per key, as one array row per key; each with the key of its copies."""
    ranked = top_k(catalog, keys, [F.desc("popularity"), F.col("track_id")], n)
    return ranked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "track_id", "track_name", "artist_name", _copy_key().alias("copy_key")))).alias("best")
    )


def _expand(keys: DataFrame, best: DataFrame, on: list[str], sources: dict[int, int]) -> DataFrame:
    """Candidates of one kind of key; ``sources`` maps each source to how many of the best it takes."""
    joined = salted_join(keys, best, on, spread=["user_id"], how="inner")
    takes = F.array(*[F.struct(F.lit(s).alias("source"), F.slice("best", 1, n).alias("best")) for s, n in sources.items()])
    per_source = joined.select("user_id", "value_pos", F.explode(takes).alias("t"))
    rows = per_source.select("user_id", "t.source", "value_pos", F.explode("t.best").alias("b"))
    return rows.select("user_id", "source", "value_pos", "b.rank", "b.track_id", "b.track_name", "b.artist_name", "b.copy_key")


def expand_candidates(recent: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidate rows of all four sources with their arrival order (source, value_pos, rank).

    ``catalog`` has track_id, track_name, artist_name, artist_genres, popularity. The best tracks per
    key are ranked once for the catalog, not once per user; so is ``copy_key``, under which copies collapse.
    """
    artists = recent_artists(recent, limit=RECENT_ARTISTS)
    titles = recent_titles(recent, limit=RECENT_TRACKS)
    genres = recent_genres(recent, limit=GENRES)
    by_title = catalog.select(
        "*", F.lower(strip(F.col("track_name"))).alias("title"), F.lower(first_token(F.col("artist_name"))).alias("artist")
    )
    by_genre = catalog.withColumn("genre", F.explode(genre_terms(F.col("artist_genres"))))
    # A track counts for each of its artists; recent artists are single names.
    credited = catalog.withColumn("credit", F.explode(F.array_distinct(split_list(F.col("artist_name")))))
    by_artist = _best_per_key(credited, ["credit"], max(TOP_PER_ARTIST, MATCHES_PER_ARTIST)).withColumnRenamed("credit", "artist_name")
    parts = [
        _expand(artists, by_artist, ["artist_name"], {0: TOP_PER_ARTIST, 1: MATCHES_PER_ARTIST}),
        _expand(titles, _best_per_key(by_title, ["title", "artist"], MATCHES_PER_TRACK), ["title", "artist"], {2: MATCHES_PER_TRACK}),
        _expand(genres, _best_per_key(by_genre, ["genre"], GENRES), ["genre"], {3: GENRES}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedupe_candidates(raw: DataFrame, *, limit: int = MAX_CANDIDATES) -> DataFrame:
    """(user_id, track_id, candidate_pos, candidate_sources): first arrival wins, labels of all copies kept.

    Copies share an id or a key of name and first artist (``copy_key``, worked out here if ``raw`` has none). One id
    has one key, so grouping by the key finds both. Rows are dealt once, by user: a user has at most a few dozen.
    """
    labels = F.array(*[F.lit(x) for x in SOURCE_LABELS])
    key = F.col("copy_key") if "copy_key" in raw.columns else _copy_key()
    keyed = raw.select("user_id", key.alias("key"), F.struct("source", "value_pos", "rank", "track_id").alias("at"))
    grouped = keyed.repartition("user_id").groupBy("user_id", "key").agg(
        F.min("at").alias("at"), F.array_sort(F.collect_set("at.source")).alias("sources")
    ).withColumn("track_id", F.col("at.track_id"))
    best = top_k(grouped, ["user_id"], [F.col("at")], limit)
    return best.select(
        "user_id", "track_id", (F.col("rank") - 1).alias("candidate_pos"),
        F.transform("sources", lambda s: F.get(labels, s)).alias("candidate_sources"),
    )


def candidate_catalog(tracks: DataFrame, sources: DataFrame | None = None, *, ranking_mode: str = "audio-features") -> DataFrame:
    """Catalog columns the rankers need; absent audio columns get neutral defaults.

    With ``sources`` (user_id, track_id, candidate_sources array) the result is one row per user and
    candidate, labels joined by ', ' in their order.
    """
    popularity = try_double(F.col("popularity")) / 100.0
    artist = [F.col(c).cast("string") for c in ("artist_name", "primary_artist_name", "artist_names") if c in tracks.columns]
    out = tracks.withColumns(
        {
            "artist_name": first_non_blank(*artist),
            "catalog_popularity": popularity,
            "catalog_novelty": 1.0 - popularity,
            "ranking_mode": F.lit(ranking_mode),
            **{c: F.lit(v) for c, v in AUDIO_DEFAULTS.items() if c not in tracks.columns},
        }
    )
    if sources is None:
        return out
    joined = salted_join(sources, out, "track_id", spread=["user_id"], how="inner")
    return joined.withColumn(
        "candidate_sources",
        F.when(F.size("candidate_sources") > 0, F.array_join("candidate_sources", ", ")).otherwise("catalog candidate"),
    )


def artist_pool_shares(candidates: DataFrame) -> DataFrame:
    """Adds each artist's count and share within the user's candidate pool (at most 80 rows per user)."""
    artist = F.coalesce("artist_name", F.lit(""))
    count = F.count(F.lit(1)).over(W.partitionBy("user_id", artist))
    size = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    return candidates.withColumn("candidate_artist_pool_count", count).withColumn(
        "candidate_artist_pool_share", F.col("candidate_artist_pool_count") / size
    )


def source_counts(deduped: DataFrame) -> DataFrame:
    """(user_id, source_label, candidates): unique candidates per source label."""
    rows = deduped.select("user_id", F.explode("candidate_sources").alias("source_label"))
    return rows.groupBy("user_id", "source_label").agg(F.count(F.lit(1)).alias("candidates"))


def pool_summary(raw: DataFrame, deduped: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per user: raw rows, unique candidates, removed duplicates, artists, largest artist share."""
    counts = raw.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("raw_candidates"),
        F.count(F.when(F.col("source") == 0, 1)).alias("top_track_candidates"),
        F.count(F.when(F.col("source") > 0, 1)).alias("search_candidates"),
    )
    unique = deduped.groupBy("user_id").agg(F.count(F.lit(1)).alias("unique_candidates"))
    per_artist = candidates.where(~is_blank(F.col("artist_name"))).groupBy("user_id", "artist_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    artists = per_artist.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("candidate_artists"), F.max("n").alias("max_from_one_artist")
    )
    joined = counts.join(unique, "user_id", "left").join(artists, "user_id", "left").fillna(0)
    return joined.withColumn("duplicates_removed", F.col("raw_candidates") - F.col("unique_candidates"))


# --- pools ----------------------------------------------------------------------------------------


def base_pool(catalog: DataFrame, *, size: int = 1000, k: int = 10) -> DataFrame:
    """Most popular tracks (id breaks ties); a bounded pool by definition."""
    order = [F.desc("p"), F.col("track_id")] if "popularity" in catalog.columns else [F.col("track_id")]
    p = try_double(F.col("popularity")) if "popularity" in catalog.columns else F.lit(0.0)
    best = catalog.groupBy("track_id").agg(F.max(p).alias("p"))
    return best.orderBy(*order).limit(max(size, k)).select("track_id", F.col("p").alias("popularity"))


def pool_candidates(users: DataFrame, pool: DataFrame, seen: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(user_id, track_id): pool tracks the user has not seen, plus unseen ``extra`` pairs.

    The pool (bounded) travels as one scalar array. A user's seen tracks are first cut down to the
    pool, so the set difference runs inside the row and no (user, pool) rows are shuffled.
    """
    ids = pool.agg(F.sort_array(F.collect_list("track_id")).alias("ids")).scalar()
    in_pool = seen.select("user_id", "track_id").join(pool.select("track_id"), "track_id", "left_semi")
    known = in_pool.groupBy("user_id").agg(F.collect_set("track_id").alias("known"))
    rows = users.select("user_id").distinct().join(known, "user_id", "left")
    left = F.when(F.col("known").isNull(), ids).otherwise(F.array_except(ids, F.col("known")))
    out = rows.select("user_id", F.explode(left).alias("track_id"))
    if extra is None:
        return out
    outside = extra.select("user_id", "track_id").distinct().join(pool.select("track_id"), "track_id", "left_anti")
    unseen = outside.join(seen.select("user_id", "track_id"), ["user_id", "track_id"], "left_anti")
    return out.unionByName(unseen.select("user_id", "track_id"))


def match_seeds(
    recent_vectors: DataFrame, catalog_vectors: DataFrame, size: int, *, k: int = 5, tile_rows: int = 2048
) -> DataFrame:
    """(user_id, track_id, score, rank): catalog tracks closest to the user's recency-weighted history.

    ``recent_vectors`` is (user_id, seed_pos, features); weights fall linearly from the newest and sum
    to 1. A weighted mean of cosines equals one dot product with the weighted mean of unit vectors, so
    each user costs one query vector instead of one per recent track.
    """
    from cadenza.plans.tiles import inner_products

    count = recent_vectors.groupBy("user_id").agg((F.max("seed_pos") + 1).alias("n"))
    weighted = salted_join(recent_vectors, count, "user_id", spread=["seed_pos"], how="inner").withColumn(
        "w", (F.col("n") - F.col("seed_pos")) / (F.col("n") * (F.col("n") + 1) / 2.0)
    ).withColumn("u", unit(F.col("features")))
    queries = weighted.groupBy("user_id").agg(
        F.array(*[F.sum(F.col("w") * F.col("u")[i]) for i in range(size)]).alias("u")
    )
    items = catalog_vectors.select("track_id", unit(F.col("features")).alias("u"))
    return inner_products(queries, items, query="user_id", item="track_id", vector="u", k=k, tile_rows=tile_rows)
