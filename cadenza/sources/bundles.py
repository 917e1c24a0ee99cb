"""From one collection of payload files to the curated tables, each kept as a run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from cadenza.operators import normalize as N
from cadenza.sources.payloads import PAYLOAD_SCHEMAS, read_payload
from cadenza.sources.split_json import read_split_payload
from cadenza.sources.tables import read_run, write_run

#: Table of each payload kind, and how it is flattened.
TABLES = {
    "tracks": ("track_metadata", N.track_metadata), "audio_features": ("audio_features", N.audio_features),
    "artists": ("artist_metadata", N.artist_metadata), "playlist": ("playlist_tracks", N.playlist_tracks),
}


def curate_bundle(spark: SparkSession, paths: Mapping[str, str | None], out: str, run_ts: str, *, multi_line: bool = True) -> dict[str, DataFrame]:
    """The six curated tables of a bundle: each is written as one run below ``out`` and read back.

    ``paths`` names the file of each payload kind; a kind that is absent, or whose file is, gives an empty table.
    Tracks take their base from the audio features where there is no metadata. Files of one JSON object each
    (``multi_line``) are read in byte ranges by many tasks, but for playlists, which are small and many.
    """
    unknown = set(paths) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown payload kinds {sorted(unknown)}, known are {sorted(set(PAYLOAD_SCHEMAS) & set(TABLES))}")

    def kept(name: str, df: DataFrame) -> DataFrame:
        write_run(df, f"{out}/{name}", run_ts)
        return read_run(spark, f"{out}/{name}", run_ts, df.schema)

    def read(kind: str) -> DataFrame:
        if multi_line and kind != "playlist":
            return read_split_payload(spark, paths.get(kind), kind)
        return read_payload(spark, paths.get(kind), kind, multi_line=multi_line)

    flat = {name: kept(name, flatten(read(kind))) for kind, (name, flatten) in TABLES.items()}
    tracks = kept("track_level", N.track_level(flat["track_metadata"], flat["audio_features"], flat["playlist_tracks"], flat["artist_metadata"]))
    return {**flat, "track_level": tracks, "artist_level": kept("artist_level", N.artist_level(flat["artist_metadata"], tracks))}
