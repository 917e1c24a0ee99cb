"""Lightweight track catalog derived from interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.columns import try_double
from cadenza.functions.text import artist_token, strip, token_count
from cadenza.plans.skew import salted_join


def _maxima(df: DataFrame, *columns: str) -> Column:
    """The columns' maxima, at least 1, as one struct of one scan."""
    top = [F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(1.0)).alias(c) for c in columns]
    return df.agg(F.struct(*top).alias("m")).scalar()


def build_catalog(interactions: DataFrame) -> DataFrame:
    """One row per track: popularity, artist frequency, title length and their max-normalised forms.

    Everything starts from one (track, artist) aggregate, so the artist totals never see the raw rows.
    """
    rows = interactions.select(
        "track_id",
        strip(F.coalesce(F.col("artist_name"), F.lit(""))).alias("artist_name"),
        strip(F.coalesce(F.col("track_name"), F.lit(""))).alias("track_name"),
        try_double(F.col("interaction_strength")).alias("s"),
    )
    pairs = rows.groupBy("track_id", "artist_name").agg(F.sum("s").alias("s"), F.min("track_name").alias("track_name"))
    tracks = pairs.groupBy("track_id").agg(
        F.min("track_name").alias("track_name"),
        F.min("artist_name").alias("artist_name"),
        F.sum("s").alias("popularity_count"),
    )
    artists = pairs.groupBy("artist_name").agg(
        F.sum("s").alias("artist_frequency"), F.count(F.lit(1)).cast("double").alias("artist_track_count")
    )
    joined = salted_join(tracks, artists, "artist_name", spread=["track_id"]).withColumn(
        "title_token_count", token_count(F.col("track_name")).cast("double")
    )
    top = _maxima(joined, "popularity_count", "artist_frequency", "artist_track_count", "title_token_count")
    popularity = F.col("popularity_count") / top["popularity_count"]
    return joined.select(
        "track_id", "track_name", "artist_name",
        F.col("artist_name").alias("primary_artist_name"),
        "popularity_count",
        popularity.alias("normalized_popularity"),
        "artist_frequency", "artist_track_count", "title_token_count",
        (popularity * 100.0).alias("popularity"),
        popularity.alias("catalog_popularity"),
        (F.col("artist_frequency") / top["artist_frequency"]).alias("catalog_artist_frequency"),
        (F.col("artist_track_count") / top["artist_track_count"]).alias("catalog_artist_track_count"),
        (F.col("title_token_count") / top["title_token_count"]).alias("catalog_title_token_count"),
        artist_token(F.col("artist_name")).alias("artist_genres"),
    )
