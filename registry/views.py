"""Roles of the benchmark tables: listening log, interactions, track catalog, artists, plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.candidates import candidate_catalog, recent_plays, seed_tracks
from cadenza.plans.skew import salted_join
from cadenza.session import written
from cadenza.sources.listens import LogColumns, clean_listens


def once(df: DataFrame) -> DataFrame:
    """Written once to the shared folder, where several branches of a query read it."""
    return written(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a raw text log: user, artist, track, timestamp."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("user"),
        F.concat(F.lit("  The "), F.col("event_type")).alias("artist"),
        F.concat(F.lit("Song No. "), F.get_json_object("props", "$.k")).alias("track"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
    )


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_listens(raw_log(spark, sf_dir), LogColumns("user", "artist", "track", "timestamp"))


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (user_id, track_id, timestamp)."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("track_id"), F.col("ts").alias("timestamp"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as plays: (user_id, track_id, played_at, quantity)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("track_id"),
        F.col("l_shipdate").alias("played_at"), F.col("l_quantity").alias("quantity"),
    )
    return li.join(o, "o_orderkey").drop("o_orderkey")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, track_id, interaction_strength, last_timestamp)."""
    return plays(spark, sf_dir).groupBy("user_id", "track_id").agg(
        F.sum("quantity").alias("interaction_strength"), F.max("played_at").alias("last_timestamp")
    )


def named_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"), F.col("p_brand").alias("artist_name"), F.col("p_name").alias("track_name")
    )
    return salted_join(interactions(spark, sf_dir), part, "track_id", spread=["user_id"], how="inner")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the track catalog, with audio-like columns from part and its order lines."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("track_id")).agg(
        F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"),
        F.sum("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"),
    )
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "track_id")
    top = li.agg(F.max("s").alias("m")).scalar()
    joined = p.join(li, "track_id", "left")
    return joined.select(
        "track_id",
        F.col("p_name").alias("track_name"),
        F.col("p_brand").alias("artist_name"),
        F.concat(F.col("p_type"), F.lit(", "), F.element_at(F.split("p_name", " "), -1)).alias("artist_genres"),
        (F.col("p_size") / 50.0).alias("danceability"),
        (F.coalesce("q", F.lit(25.0)) / 50.0).alias("energy"),
        F.least(F.coalesce("d", F.lit(0.0)) * 10.0, F.lit(1.0)).alias("valence"),
        (60.0 + F.col("p_retailprice") % 100.0).alias("tempo"),
        F.least(F.coalesce("t", F.lit(0.0)) * 12.5, F.lit(1.0)).alias("acousticness"),
        ((F.col("p_size") % 10) / 10.0).alias("instrumentalness"),
        (-F.col("p_retailprice") / 100.0).alias("loudness"),
        (F.coalesce("s", F.lit(0.0)) * 100.0 / top).alias("popularity"),
        (F.coalesce("n", F.lit(0)) * 1000).alias("duration_ms"),
        F.concat((F.lit(1950) + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("album_release_date"),
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as artist metadata; some artists have no tracks and some tracks no artist row."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.concat(F.lit("Brand#"), F.col("s_suppkey")).alias("artist_id"),
        F.col("s_name").alias("name"),
        F.concat(F.col("n_name"), F.lit(",  folk  rock, "), F.col("n_name")).alias("genres"),
        F.col("s_acctbal").alias("popularity"),
        (F.col("s_suppkey") * 10).alias("followers_total"),
    )


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 plays per user with display columns."""
    newest = recent_plays(plays(spark, sf_dir).select("user_id", "track_id", "played_at"))
    info = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("track_id"), F.col("p_name").alias("track_name"), F.col("p_brand").alias("artist_name"),
        F.concat(F.col("p_type"), F.lit(", "), F.element_at(F.split("p_name", " "), -1)).alias("artist_genres"),
    )
    return salted_join(newest, info, "track_id", spread=["user_id"], how="inner")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = recent_plays(plays(spark, sf_dir).select("user_id", "track_id", "played_at"))
    return seed_tracks(newest)


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_catalog(tracks(spark, sf_dir))
