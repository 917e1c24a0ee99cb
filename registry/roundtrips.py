"""Sources and sinks: table data written to the shared folder in a source's format and read back through it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadenza.operators import normalize as N
from cadenza.operators.factors import factor_scores, fit_factors
from cadenza.operators.features import content_features
from cadenza.operators.interactions import ordered
from cadenza.operators.neighbours import cf_topk, item_neighbours
from cadenza.operators.similarity import cosine_topk
from cadenza.session import ensure_checkpoint_dir
from cadenza.sources import tables as S
from cadenza.sources.bundles import curate_bundle
from cadenza.sources.listens import read_listens
from cadenza.sources.payloads import read_payload
from cadenza.sources.split_json import read_split_payload
from registry import collaborative, data  # noqa: F401  (the first defines SQL views used below)
from registry import views as V
from registry.sql import with_views


def _folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _audio(spark, d):
    p = V.table(spark, d, "part")
    a = F.struct(
        F.concat(F.lit("T"), "p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("danceability"), F.lit(None).cast("double").alias("energy"),
        F.lit(1).cast("long").alias("key"), (-F.col("p_retailprice")).alias("loudness"), F.col("p_retailprice").alias("tempo"),
        F.col("p_size").cast("long").alias("duration_ms"),
    )
    return p.select(F.array(a, F.when(F.lit(False), a)).alias("audio_features"))


def audio_payload(spark, d):
    """Audio features written as JSON lines, read by schema and flattened."""
    path = _folder(spark, "audio")
    _audio(spark, d).write.json(path)
    out = N.audio_features(read_payload(spark, path, "audio_features", multi_line=False))
    return out.select("track_id", "danceability", "loudness", "tempo", "duration_ms")


def artist_payload(spark, d):
    path = _folder(spark, "artists")
    s = V.table(spark, d, "supplier")
    a = F.struct(
        F.concat(F.lit("A"), "s_suppkey").alias("id"), F.concat(F.lit(" "), "s_name", F.lit("  ")).alias("name"),
        F.when(F.col("s_nationkey") > 5, F.array(F.lit("folk"), F.concat(F.lit("n"), "s_nationkey"))).alias("genres"),
        F.struct(F.col("s_suppkey").alias("total")).alias("followers"), F.col("s_acctbal").alias("popularity"),
    )
    s.select(F.array(a).alias("artists")).write.json(path)
    out = N.artist_metadata(read_payload(spark, path, "artists", multi_line=False))
    return out.select("artist_id", "name", "genres", "popularity", "followers_total")


def _artists(spark, d):
    s = V.table(spark, d, "supplier")
    a = F.struct(
        F.concat(F.lit("Brand#"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.lit("Folk"), F.lit("rock")).alias("genres"),
        F.struct(F.col("s_suppkey").alias("total")).alias("followers"), F.col("s_acctbal").alias("popularity"),
    )
    return s.select(F.array(a).alias("artists"))


def _bundle(spark, d):
    path = _folder(spark, "bundle")
    payloads = {"tracks": data.track_payload(spark, d), "audio_features": _audio(spark, d), "artists": _artists(spark, d), "playlist": data.playlist_payload(spark, d)}
    for kind, df in payloads.items():
        df.write.json(f"{path}/{kind}")
    return curate_bundle(spark, {kind: f"{path}/{kind}" for kind in payloads}, f"{path}/tables", "20240101", multi_line=False)


def bundle_tracks(spark, d):
    """A collection bundle as files through all curated tables: its track table."""
    t = _bundle(spark, d)["track_level"]
    return t.select("track_id", "track_name", "primary_artist_id", "artist_genres", "danceability", "tempo", "playlist_occurrences", F.round("artist_popularity", 6).alias("artist_popularity"), "track_url")


def bundle_artists(spark, d):
    a = _bundle(spark, d)["artist_level"]
    return a.select("artist_id", "name", "genres", "followers_total", "track_count", F.round("avg_danceability", 6).alias("avg_danceability"), F.round("avg_tempo", 5).alias("avg_tempo"))


def split_bundle(spark, d):
    """Audio features as bundles of one JSON object on one line, each read in byte ranges by several tasks."""
    path = _folder(spark, "split")
    rows = _audio(spark, d).select(F.explode("audio_features").alias("a")).where("a IS NOT NULL")
    bundles = rows.groupBy(F.pmod(F.xxhash64("a.id"), F.lit(16)).alias("bundle")).agg(F.collect_list("a").alias("audio_features"))
    bundles.select(F.to_json(F.struct("bundle", "audio_features")).alias("value")).write.text(path)
    out = N.audio_features(read_split_payload(spark, path, "audio_features"))
    return out.select("track_id", "danceability", "loudness", "tempo", "duration_ms")


def _listens_of(spark, path):
    rows = read_listens(spark, path)
    return rows.groupBy("user_id", "track_id", "artist_name", "track_name").agg(
        F.count(F.lit(1)).alias("listens"), F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")
    )


def headerless_log(spark, d):
    """Events as a headerless six-column log; the layout is told by the first line."""
    path = _folder(spark, "log")
    raw = V.raw_log(spark, d)
    fields = F.concat_ws(
        "\t", F.concat(F.lit("user_"), "user"), "timestamp", F.lit("id"), "artist", F.lit(""), "track"
    )
    raw.select(fields).write.text(path)
    return _listens_of(spark, path)


def headered_log(spark, d):
    """Events as delimited text with a header of other names and order."""
    path = _folder(spark, "csv")
    V.raw_log(spark, d).select(F.col("timestamp").alias("Time"), F.col("track").alias("Song"), F.col("artist").alias("Artist"), F.col("user").alias("User")).write.option(
        "header", True
    ).option("sep", ";").csv(path)
    return _listens_of(spark, path)


def table_exports(spark, d):
    """The strengths in export order through a Parquet and a CSV sink."""
    path = _folder(spark, "tables")
    rows = ordered(V.interactions(spark, d).select("user_id", "track_id", "interaction_strength"))
    S.write_table(rows, f"{path}/a")
    S.write_table(spark.read.parquet(f"{path}/a"), f"{path}/b", fmt="csv")
    back = spark.read.option("header", True).schema(rows.schema).csv(f"{path}/b")
    return back.join(spark.read.parquet(f"{path}/a"), ["user_id", "track_id", "interaction_strength"], "left_semi")


def newest_run(spark, d):
    """Two runs of an evaluation; the newest one is read back, and a rerun replaces its own partition only."""
    path = _folder(spark, "runs")
    sums = V.once(V.interactions(spark, d).groupBy("user_id").agg(F.sum("interaction_strength").alias("strength"), F.count(F.lit(1)).alias("tracks")))
    for stamp, factor in (("20240101", 1.0), ("20240301", 5.0), ("20240201", 2.0), ("20240301", 3.0)):
        S.save_evaluation(sums.withColumn("strength", F.col("strength") * factor), sums.select("user_id", "tracks"), path, stamp)
    best = S.read_newest_run(spark, f"{path}/comparison").select("user_id", "strength", F.col("run_ts").cast("string").alias("run_ts"))
    return best.join(S.read_newest_run(spark, f"{path}/coverage").select("user_id", "tracks"), "user_id")


def stored_item_model(spark, d):
    """Top tracks from a saved and loaded item model."""
    path = _folder(spark, "model")
    i = V.once(V.interactions(spark, d))
    S.save_item_model(item_neighbours(i), i, path)
    near, history = S.load_item_model(spark, path)
    top = cf_topk(history, near, k=10)
    return top.select("user_id", "track_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def stored_similarities(spark, d):
    """Saved similar tracks, read back for the tracks that are in somebody's seeds."""
    path = _folder(spark, "similar")
    features, _ = content_features(V.curated(spark, d))
    S.save_similarities(cosine_topk(features, k=5), path)
    near = S.load_similarities(spark, path, V.seeds(spark, d).select("track_id"))
    return near.select("track_a", "track_b", F.round("similarity", 6).alias("similarity"))


def stored_factors(spark, d):
    """Scores of every known pair from saved factors, held against those before the round trip."""
    path = _folder(spark, "factors")
    i = V.once(V.interactions(spark, d))
    users, tracks = (V.once(f) for f in fit_factors(i))
    S.save_factors(users, tracks, path)
    after = factor_scores(*S.load_factors(spark, path), i).withColumnRenamed("score", "loaded")
    both = factor_scores(users, tracks, i).join(after, ["user_id", "track_id"], "full")
    return both.select("user_id", "track_id", (F.col("score") == F.col("loaded")).alias("same"), (F.col("loaded") != 0).alias("scored"))


def stream_recent(spark, d):
    """Newest plays kept from a stream of several micro-batches."""
    from cadenza.streaming.incremental import read_recent_plays, stream_recent_plays

    path = _folder(spark, "recent")
    plays = V.event_plays(spark, d).select("user_id", "track_id", F.col("timestamp").cast("timestamp").alias("played_at")).distinct()
    plays.repartition(4, "user_id", "played_at").write.parquet(f"{path}/in")
    source = spark.readStream.schema(plays.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream_recent_plays(source, f"{path}/table", f"{path}/log", availableNow=True).awaitTermination()
    out = read_recent_plays(spark, f"{path}/table")
    return out.select("user_id", "track_id", F.unix_micros("played_at").alias("played_at"), F.col("pos").cast("long").alias("pos"))


_LOG_SQL = """
  SELECT {user} AS user_id, track_id, artist_name, track_name, count(*) AS listens, epoch_us(min(ts)) AS "first", epoch_us(max(ts)) AS "last"
  FROM v_listens GROUP BY ALL
"""
QUERIES = {
    "audio_payload": audio_payload, "artist_payload": artist_payload, "headerless_log": headerless_log, "headered_log": headered_log,
    "table_exports": table_exports, "newest_run": newest_run, "stored_item_model": stored_item_model,
    "bundle_tracks": bundle_tracks, "bundle_artists": bundle_artists, "split_bundle": split_bundle,
    "stored_similarities": stored_similarities, "stored_factors": stored_factors, "stream_recent": stream_recent,
}
ORACLES = {
    "audio_payload": """
      SELECT 'T' || p_partkey AS track_id, p_size / 50.0::DOUBLE AS danceability, -p_retailprice AS loudness, p_retailprice AS tempo,
             cast(p_size AS BIGINT) AS duration_ms FROM part""",
    "artist_payload": """
      SELECT 'A' || s_suppkey AS artist_id, s_name AS name, CASE WHEN s_nationkey > 5 THEN 'folk, n' || s_nationkey ELSE '' END AS genres,
             s_acctbal AS popularity, s_suppkey AS followers_total FROM supplier""",
    "bundle_tracks": """
      SELECT 'T' || p_partkey AS track_id, p_name AS track_name, p_brand AS primary_artist_id, CASE WHEN s_suppkey IS NULL THEN '' ELSE 'folk, rock' END AS artist_genres,
             p_size / 50.0::DOUBLE AS danceability, p_retailprice AS tempo, cast(coalesce(n, 0) AS BIGINT) AS playlist_occurrences,
             round(coalesce(s_acctbal, 0.0), 6) AS artist_popularity, p_name AS track_url
      FROM part LEFT JOIN supplier ON 'Brand#' || s_suppkey = p_brand LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "bundle_artists": """
      SELECT coalesce('Brand#' || s_suppkey, p_brand) AS artist_id, coalesce(s_name, '') AS name, CASE WHEN s_suppkey IS NULL THEN '' ELSE 'folk, rock' END AS genres,
             coalesce(s_suppkey, 0) AS followers_total, coalesce(n, 0) AS track_count, round(coalesce(dance, 0.0), 6) AS avg_danceability, round(coalesce(tempo, 0.0), 5) AS avg_tempo
      FROM supplier FULL JOIN (SELECT p_brand, count(*) AS n, avg(p_size / 50.0::DOUBLE) AS dance, avg(p_retailprice) AS tempo FROM part GROUP BY 1) ON 'Brand#' || s_suppkey = p_brand""",
    "headerless_log": with_views(_LOG_SQL.format(user="'user_' || user_id")),
    "headered_log": with_views(_LOG_SQL.format(user="user_id")),
    "table_exports": with_views("SELECT user_id, track_id, interaction_strength FROM v_interactions"),
    "newest_run": with_views("""
      SELECT user_id, 3.0::DOUBLE * sum(interaction_strength) AS strength, '20240301' AS run_ts, count(*) AS tracks FROM v_interactions GROUP BY 1"""),
    "stored_item_model": with_views("""
      SELECT user_id, track_id, round(score, 5) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank
      FROM v_cf QUALIFY rank <= 10"""),
    "stored_similarities": with_views("""
      SELECT track_a, track_b, round(s, 6) AS similarity FROM (
        SELECT a.track_id AS track_a, b.track_id AS track_b, list_dot_product(a.u, b.u) AS s FROM v_unit a JOIN v_unit b ON a.track_id <> b.track_id
        WHERE a.track_id IN (SELECT track_id FROM v_seeds))
      QUALIFY row_number() OVER (PARTITION BY track_a ORDER BY round(s, 9) DESC, track_b) <= 5"""),
    "stored_factors": with_views("SELECT user_id, track_id, true AS same, interaction_strength > 0 AS scored FROM v_interactions"),
    "stream_recent": with_views("""
      SELECT user_id, track_id, epoch_us(ts) AS played_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, track_id) - 1 AS pos
      FROM (SELECT DISTINCT user_id, track_id, ts FROM v_event_plays) QUALIFY pos < 20"""),
}
ORACLES["split_bundle"] = ORACLES["audio_payload"]
