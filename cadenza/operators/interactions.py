"""Listens to (user, track) interactions, and statistics of the interaction matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import try_double
from cadenza.functions.text import is_blank

STRENGTH = "interaction_strength"


def listens_to_interactions(listens: DataFrame) -> DataFrame:
    """Listen count, names at the first listen and first/last time per (user, track)."""
    return listens.groupBy("user_id", "track_id").agg(
        F.count(F.lit(1)).alias("listen_count"),
        F.count(F.lit(1)).cast("double").alias(STRENGTH),
        F.min_by("artist_name", F.struct("ts", "artist_name")).alias("artist_name"),
        F.min_by("track_name", F.struct("ts", "track_name")).alias("track_name"),
        F.min("ts").alias("first_timestamp"),
        F.max("ts").alias("last_timestamp"),
    )


def merge_interactions(*parts: DataFrame) -> DataFrame:
    """Merge interaction tables of separate loads; equal to aggregating all listens at once."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("user_id", "track_id").agg(
        F.sum("listen_count").alias("listen_count"),
        F.sum(STRENGTH).alias(STRENGTH),
        F.min_by("artist_name", F.struct("first_timestamp", "artist_name")).alias("artist_name"),
        F.min_by("track_name", F.struct("first_timestamp", "track_name")).alias("track_name"),
        F.min("first_timestamp").alias("first_timestamp"),
        F.max("last_timestamp").alias("last_timestamp"),
    )


def ordered(interactions: DataFrame) -> DataFrame:
    """Export order: user, strength descending, track (a range-partitioned sort)."""
    return interactions.orderBy("user_id", F.desc(STRENGTH), "track_id")


def aggregate_strengths(rows: DataFrame) -> DataFrame:
    """Sum of strengths per (user, track); rows without a strength count as 1, blank ids are dropped."""
    strength = try_double(F.col(STRENGTH)) if STRENGTH in rows.columns else F.lit(1.0)
    kept = rows.where(~is_blank(F.col("user_id").cast("string")) & ~is_blank(F.col("track_id").cast("string")))
    return kept.groupBy("user_id", "track_id").agg(F.sum(strength).alias(STRENGTH))


def recent_play_strengths(plays: DataFrame) -> DataFrame:
    """Plays counted into strengths per (user, track)."""
    return plays.groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias(STRENGTH))


def matrix_stats(interactions: DataFrame) -> DataFrame:
    """Users, tracks, stored pairs, density and sparsity of the user x track matrix (one row)."""
    counts = interactions.agg(
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("track_id").alias("tracks"),
        F.count(F.lit(1)).alias("interactions"),
    )
    cells = F.col("users") * F.col("tracks")
    density = F.when(cells > 0, F.col("interactions") / cells).otherwise(0.0)
    return counts.withColumn("density", density).withColumn("sparsity", 1.0 - F.col("density"))


def coverage_stats(interactions: DataFrame, catalog: DataFrame, *, min_user_interactions: int = 5) -> DataFrame:
    """Fifteen coverage values as one row.

    The medians are exact. Their state is a histogram of counts, and distinct counts number at most
    about sqrt(2 x interactions), so the final merge stays small.
    """
    pairs = interactions.groupBy("user_id", "track_id").agg(F.count(F.lit(1)).alias("n"))
    per_user = pairs.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    per_track = pairs.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    keep = F.col("n") >= min_user_interactions
    users = per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("interaction_count"),
        F.count(F.lit(1)).alias("user_count"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("average_interactions_per_user"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median_interactions_per_user"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("observed_interactions"),
        F.count(F.when(keep, 1)).alias("evaluated_users"),
        F.coalesce(F.avg(F.when(keep, F.col("n") - 1)), F.lit(0.0)).alias(
            "average_train_interactions_per_evaluated_user"
        ),
    )
    tracks = per_track.agg(
        F.count(F.lit(1)).alias("t"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("a"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("d"),
        F.coalesce(F.avg((F.col("n") > 1).cast("double")) * 100.0, F.lit(0.0)).alias("m"),
    )
    track_row = tracks.select(F.struct("t", "a", "d", "m")).scalar()
    in_catalog = catalog.agg(F.countDistinct("track_id").alias("n")).scalar()
    wide = users.select(
        "*",
        track_row["t"].alias("unique_tracks_in_interactions"),
        in_catalog.alias("unique_tracks_in_catalog"),
        track_row["a"].alias("average_users_per_track"),
        track_row["d"].alias("median_users_per_track"),
        track_row["m"].alias("tracks_with_more_than_one_listener_pct"),
    ).withColumn("possible_interactions", F.col("user_count") * F.col("unique_tracks_in_interactions"))
    density = F.when(
        F.col("possible_interactions") > 0, F.col("observed_interactions") / F.col("possible_interactions")
    ).otherwise(0.0)
    return wide.withColumn("matrix_density", density).withColumn("matrix_sparsity", 1.0 - F.col("matrix_density"))
