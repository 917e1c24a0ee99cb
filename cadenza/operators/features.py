"""Content features: audio columns, optional catalog columns, multi-hot genres, z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import try_double
from cadenza.functions.text import genre_tokens

# Numeric feature columns in their order.
AUDIO_COLUMNS = [
    "danceability", "energy", "valence", "tempo", "acousticness", "speechiness", "instrumentalness", "loudness",
]
CATALOG_COLUMNS = [
    "catalog_popularity", "catalog_artist_frequency", "catalog_artist_track_count", "catalog_title_token_count",
]
MAX_GENRES = 20


def top_genres(tracks: DataFrame, max_genres: int = MAX_GENRES) -> DataFrame:
    """Most frequent genre tokens by number of tracks, ties by name."""
    tokens = tracks.select(F.explode(genre_tokens(F.col("artist_genres"))).alias("genre"))
    counts = tokens.groupBy("genre").agg(F.count(F.lit(1)).alias("track_count"))
    return counts.orderBy(F.desc("track_count"), "genre").limit(max_genres)


def feature_table(tracks: DataFrame, *, max_genres: int = MAX_GENRES) -> tuple[DataFrame, list[str]]:
    """Raw numeric features per track and their names.

    Only the genre vocabulary (at most ``max_genres`` words) visits the driver.
    """
    names = [*AUDIO_COLUMNS, *[c for c in CATALOG_COLUMNS if c in tracks.columns]]
    columns = [
        (try_double(F.col(c)) if c in tracks.columns else F.lit(0.0)).alias(c) for c in names
    ]
    if "artist_genres" in tracks.columns:
        genres = [r["genre"] for r in top_genres(tracks, max_genres).collect()]
        tokens = genre_tokens(F.col("artist_genres"))
        columns += [F.array_contains(tokens, g).cast("double").alias(f"genre_{g}") for g in genres]
        names += [f"genre_{g}" for g in genres]
    return tracks.select("track_id", *columns), names


def standardize(table: DataFrame, names: list[str]) -> DataFrame:
    """(track_id, features): population z-scores as one array; a constant column divides by 1.

    A spread at rounding-noise level counts as constant: partial sums of equal values may differ in the
    last digit, and dividing by that noise would invent a signal.
    """
    stats = table.agg(
        F.struct(
            *[F.avg(f"`{n}`").alias(f"m{i}") for i, n in enumerate(names)],
            *[F.stddev_pop(f"`{n}`").alias(f"s{i}") for i, n in enumerate(names)],
        ).alias("stats")
    ).scalar()
    # Attached once: the statistics are one scalar subquery, not one per feature.
    with_stats = table.withColumn("_stats", stats)
    scaled = []
    for i, n in enumerate(names):
        mean, spread = F.col(f"_stats.m{i}"), F.col(f"_stats.s{i}")
        constant = spread <= 1e-12 * F.greatest(F.abs(mean), F.lit(1.0))
        scaled.append((F.col(f"`{n}`") - mean) / F.when(constant, 1.0).otherwise(spread))
    return with_stats.select("track_id", F.array(*scaled).alias("features"))


def content_features(tracks: DataFrame, *, max_genres: int = MAX_GENRES) -> tuple[DataFrame, list[str]]:
    """Standardized feature vector per track, with the feature names."""
    table, names = feature_table(tracks, max_genres=max_genres)
    return standardize(table, names), names
