"""Nested catalog payloads (JSON): schemas, readers and id extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names and types of the public catalog payloads.
ARTIST_REF = "struct<id:string,name:string>"
TRACK = (
    "struct<id:string,name:string,"
    f"artists:array<{ARTIST_REF}>,"
    "album:struct<id:string,name:string,release_date:string,total_tracks:long,images:array<struct<url:string>>>,"
    "duration_ms:long,explicit:boolean,popularity:double,preview_url:string,track_number:long,disc_number:long,"
    "external_urls:map<string,string>>"
)
AUDIO = (
    "struct<id:string,danceability:double,energy:double,key:long,loudness:double,mode:long,speechiness:double,"
    "acousticness:double,instrumentalness:double,liveness:double,valence:double,tempo:double,duration_ms:long,"
    "time_signature:long>"
)
ARTIST = (
    "struct<id:string,name:string,genres:array<string>,followers:struct<total:long>,popularity:double,"
    "external_urls:map<string,string>>"
)
PAYLOAD_SCHEMAS = {
    "tracks": f"tracks array<{TRACK}>",
    "audio_features": f"audio_features array<{AUDIO}>",
    "artists": f"artists array<{ARTIST}>",
    "playlist": (
        f"playlist_id string, items array<struct<added_at:string,added_by:struct<id:string>,track:{TRACK}>>"
    ),
    "recent": f"user_id string, items array<struct<played_at:string,track:{TRACK}>>",
}


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def read_payload(spark: SparkSession, path: str | None, kind: str, *, multi_line: bool = True) -> DataFrame:
    """Payload files with a declared schema; a missing file gives an empty table."""
    schema = PAYLOAD_SCHEMAS[kind]
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def playlist_track_ids(playlist: DataFrame) -> DataFrame:
    """Distinct track ids of each playlist in first-seen order."""
    items = playlist.select("playlist_id", F.posexplode("items").alias("pos", "item"))
    ids = items.select("playlist_id", "pos", F.col("item.track.id").alias("track_id"))
    return ids.where(F.col("track_id") != "").groupBy("playlist_id", "track_id").agg(F.min("pos").alias("pos"))


def playlist_artist_ids(playlist: DataFrame) -> DataFrame:
    """Distinct artist ids of each playlist in first-seen order (item, then artist position)."""
    items = playlist.select("playlist_id", F.posexplode("items").alias("pos", "item"))
    artists = items.select("playlist_id", "pos", F.posexplode("item.track.artists").alias("artist_pos", "artist"))
    return (
        artists.select("playlist_id", F.col("artist.id").alias("artist_id"), F.struct("pos", "artist_pos").alias("at"))
        .where(F.col("artist_id") != "")
        .groupBy("playlist_id", "artist_id")
        .agg(F.min("at").alias("at"))
        .select("playlist_id", "artist_id", F.col("at.pos").alias("pos"), F.col("at.artist_pos").alias("artist_pos"))
    )
