"""Flatten catalog payloads and curate the track and artist tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import text as X
from cadenza.plans.skew import salted_join

# Column lists of the published tables.
AUDIO_NUMBERS = [
    "danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness",
    "instrumentalness", "liveness", "valence", "tempo", "duration_ms", "time_signature",
]
TRACK_LEVEL = [
    "track_id", "track_name", "primary_artist_id", "primary_artist_name", "artist_ids", "artist_names",
    "artist_genres", "album_id", "album_name", "album_release_date", "duration_ms", "explicit", "popularity",
    "danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness", "instrumentalness",
    "liveness", "valence", "tempo", "time_signature", "playlist_occurrences", "artist_popularity",
    "artist_followers_total", "track_url", "preview_url",
]
ARTIST_LEVEL = [
    "artist_id", "name", "genres", "popularity", "followers_total", "track_count", "avg_track_popularity",
    "avg_danceability", "avg_energy", "avg_valence", "avg_tempo", "artist_url",
]
ARTIST_MEANS = {
    "popularity": "avg_track_popularity", "danceability": "avg_danceability", "energy": "avg_energy",
    "valence": "avg_valence", "tempo": "avg_tempo",
}


def clean_missing(df: DataFrame) -> DataFrame:
    """Type-aware defaults: numbers 0, booleans false, text empty."""
    fills: dict[str, object] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            fills[f.name] = 0
        elif isinstance(f.dataType, T.BooleanType):
            fills[f.name] = False
        elif isinstance(f.dataType, T.StringType):
            fills[f.name] = ""
    return df.na.fill(fills)


def normalize_metadata(df: DataFrame) -> DataFrame:
    """Trim all text; id, genre and name lists become distinct sorted lists."""
    rules = {
        "artist_ids": X.normalized_ids, "track_artist_ids": X.normalized_ids,
        "genres": X.normalized_genres, "artist_genres": X.normalized_genres,
        "artist_names": X.normalized_names, "track_artist_names": X.normalized_names,
    }

    def clean(f: T.StructField) -> Column:
        if not isinstance(f.dataType, T.StringType):
            return F.col(f.name)
        return rules.get(f.name, X.strip)(F.col(f.name)).alias(f.name)

    return df.select(*[clean(f) for f in df.schema.fields])


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def _names(artists: str, field: str) -> Column:
    return X.join_list(F.transform(F.coalesce(F.col(artists), F.array()), lambda a: a[field]))


def _link(urls: str) -> Column:
    """Public link of an item: the first entry of its url map."""
    return F.get(F.map_values(urls), F.lit(0))


def track_metadata(payload: DataFrame) -> DataFrame:
    """One row per track. The first listed artist is kept as primary, before the lists are sorted."""
    t = payload.select(F.explode("tracks").alias("t")).where(F.col("t").isNotNull())
    flat = t.select(
        F.col("t.id").alias("track_id"),
        F.col("t.name").alias("name"),
        F.get("t.artists", F.lit(0))["id"].alias("primary_artist_id"),
        F.get("t.artists", F.lit(0))["name"].alias("primary_artist_name"),
        _names("t.artists", "id").alias("artist_ids"),
        _names("t.artists", "name").alias("artist_names"),
        F.col("t.album.id").alias("album_id"),
        F.col("t.album.name").alias("album_name"),
        F.col("t.album.release_date").alias("album_release_date"),
        F.col("t.album.total_tracks").alias("album_total_tracks"),
        F.coalesce(F.get("t.album.images", F.lit(0))["url"], F.lit("")).alias("album_image_url"),
        "t.duration_ms", "t.explicit", "t.popularity", "t.preview_url", "t.track_number", "t.disc_number",
        _link("t.external_urls").alias("track_url"),
    )
    return clean_missing(normalize_metadata(flat))


def audio_features(payload: DataFrame) -> DataFrame:
    a = payload.select(F.explode("audio_features").alias("a")).where(F.col("a").isNotNull())
    flat = a.select(F.col("a.id").alias("track_id"), *[F.col(f"a.{c}").alias(c) for c in AUDIO_NUMBERS])
    return clean_missing(normalize_metadata(flat))


def artist_metadata(payload: DataFrame) -> DataFrame:
    a = payload.select(F.explode("artists").alias("a")).where(F.col("a").isNotNull())
    flat = a.select(
        F.col("a.id").alias("artist_id"), "a.name",
        F.array_join(F.coalesce("a.genres", F.array()), ", ").alias("genres"),
        "a.popularity", F.col("a.followers.total").alias("followers_total"),
        _link("a.external_urls").alias("artist_url"),
    )
    return clean_missing(normalize_metadata(flat))


def playlist_tracks(payload: DataFrame) -> DataFrame:
    """One row per playlist item; an item without a track keeps its row with empty fields."""
    i = payload.select("playlist_id", F.explode("items").alias("i"))
    flat = i.select(
        "playlist_id", "i.added_at", F.col("i.added_by.id").alias("added_by_user_id"),
        F.col("i.track.id").alias("track_id"), F.col("i.track.name").alias("track_name"),
        _names("i.track.artists", "id").alias("track_artist_ids"),
        _names("i.track.artists", "name").alias("track_artist_names"),
        F.col("i.track.popularity").alias("track_popularity"),
        F.col("i.track.duration_ms").alias("track_duration_ms"),
        F.col("i.track.explicit").alias("track_explicit"),
        F.col("i.track.album.id").alias("album_id"), F.col("i.track.album.name").alias("album_name"),
        F.col("i.track.album.release_date").alias("album_release_date"),
    )
    return clean_missing(normalize_metadata(flat))


def track_level(
    metadata: DataFrame | None,
    audio: DataFrame | None = None,
    playlists: DataFrame | None = None,
    artists: DataFrame | None = None,
) -> DataFrame:
    """Curated track table: metadata (audio when that is absent or empty) + audio + playlist counts + primary-artist summary."""
    if metadata is None and audio is None:
        raise ValueError("track_level needs track metadata or audio features")
    tracks = metadata if metadata is not None else audio
    if metadata is not None and audio is not None:
        tracks = tracks.join(audio.drop("duration_ms"), "track_id", "left")
        # A payload that is not there is an empty table; the audio features are the base then. They bring no column
        # that metadata lacks, so a catalog without durations gets none.
        rows = metadata.agg(F.count(F.lit(1)).alias("n")).scalar()
        tracks = tracks.unionByName(select_existing(audio, tracks.columns).where(rows == 0), allowMissingColumns=True)
    if "track_name" not in tracks.columns:
        tracks = tracks.withColumn("track_name", F.col("name") if "name" in tracks.columns else F.lit(""))
    for source, primary in (("artist_ids", "primary_artist_id"), ("artist_names", "primary_artist_name")):
        if primary not in tracks.columns:
            tracks = tracks.withColumn(
                primary, X.first_token(F.col(source)) if source in tracks.columns else F.lit("")
            )
    if playlists is not None:
        counts = playlists.groupBy("track_id").agg(F.count(F.lit(1)).alias("playlist_occurrences"))
        tracks = tracks.join(counts, "track_id", "left")
    if artists is not None:
        summary = artists.select(
            F.col("artist_id").alias("primary_artist_id"), F.col("genres").alias("artist_genres"),
            F.col("popularity").alias("artist_popularity"), F.col("followers_total").alias("artist_followers_total"),
        )
        # One artist may own a third of the catalog, so its tracks are spread over several tasks.
        tracks = salted_join(tracks, summary, "primary_artist_id", spread=["track_id"])
    return clean_missing(normalize_metadata(select_existing(tracks, TRACK_LEVEL)))


def artist_aggregates(tracks: DataFrame, artist: str = "primary_artist_id") -> DataFrame:
    """Distinct tracks and mean signals per artist, over the columns that exist."""
    means = [F.avg(c).alias(name) for c, name in ARTIST_MEANS.items() if c in tracks.columns]
    return tracks.groupBy(F.col(artist).alias("artist_id")).agg(
        F.countDistinct("track_id").alias("track_count"), *means
    )


def artist_level(artists: DataFrame, tracks: DataFrame) -> DataFrame:
    """Artist metadata and track aggregates, artists of either side kept (full outer join)."""
    joined = artists.join(artist_aggregates(tracks), "artist_id", "full")
    return clean_missing(normalize_metadata(select_existing(joined, ARTIST_LEVEL)))


def missing_ratio(df: DataFrame) -> DataFrame:
    """(column_name, missing_ratio) of every column, in one pass over the table."""
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return wide.unpivot([], list(df.columns), "column_name", "missing_ratio")
