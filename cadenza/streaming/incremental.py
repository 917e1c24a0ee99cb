"""Incremental interactions and recent plays on Structured Streaming.

Both results can be merged from parts: counts add up, minima and maxima combine, and the newest 20 of
a union are among the newest 20 of its parts. So every micro-batch writes only its own small aggregate,
named by the query's id and the batch's number, and a reader merges the parts. The cost of a batch
depends on the batch alone, and a batch that runs again overwrites its own part (nothing is counted
twice). A query with a new checkpoint has a new id, so it never overwrites what another one wrote.
Compaction writes a merged part and then records which parts it stands for; readers and later
compactions skip those, while streams go on adding parts to the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cadenza.operators.candidates import RECENT_PLAYS, recent_plays
from cadenza.operators.interactions import listens_to_interactions, merge_interactions

_COMPACT = "compact-"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def _live(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the parts that count, with their part's name."""
    rows = spark.read.option("basePath", f"{path}/parts").parquet(f"{path}/parts")
    rows = rows.withColumn("part", F.col("part").cast("string"))
    if not _exists(spark, f"{path}/merged"):
        return rows.where(~F.col("part").startswith(_COMPACT))
    merged = spark.read.schema("part string, target string").parquet(f"{path}/merged")
    rows = rows.join(merged.select("part").distinct(), "part", "left_anti")
    done = merged.select(F.col("target").alias("part")).distinct().withColumn("recorded", F.lit(True))
    # A merged part without a record is one that is being written or was given up.
    rows = rows.join(done, "part", "left")
    return rows.where(~F.col("part").startswith(_COMPACT) | F.col("recorded")).drop("recorded")


def _write_part(part: DataFrame, path: str, name: str) -> None:
    part.write.mode("overwrite").parquet(f"{path}/parts/part={name}")


def _part_name(batch: DataFrame, batch_id: int) -> str:
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not query:
        raise RuntimeError("the micro-batch does not tell the id of its query")
    return f"{query}-{batch_id}"


def stream_interactions(listens: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Aggregate a stream of cleaned listens into one interaction part per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_part(listens_to_interactions(batch), path, _part_name(batch, batch_id))

    return listens.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Interactions over all parts written so far; equal to aggregating all listens at once."""
    return merge_interactions(_live(spark, path).drop("part"))


def compact_interactions(spark: SparkSession, path: str) -> None:
    """Merge the parts of the table into one, to keep reads short; streams may go on meanwhile.

    The parts are named first, so a part that arrives during the merge is left for the next one. The record
    is written last and in one commit: before it the old parts count, after it the merged one does.
    """
    names = [r["part"] for r in _live(spark, path).select("part").distinct().collect()]
    if len(names) < 2:
        return
    target = f"{_COMPACT}{uuid.uuid4().hex}"
    chosen = _live(spark, path).where(F.col("part").isin(names))
    _write_part(merge_interactions(chosen.drop("part")), path, target)
    record = spark.createDataFrame([(n, target) for n in names], "part string, target string")
    record.coalesce(1).write.mode("append").parquet(f"{path}/merged")


def stream_running_counts(listens: DataFrame, *, watermark: str | None = None) -> DataFrame:
    """Running count, first and last time per (user, track) as a streaming aggregate (update mode)."""
    rows = listens.withWatermark("ts", watermark) if watermark else listens
    return rows.groupBy("user_id", "track_id").agg(
        F.count(F.lit(1)).alias("listen_count"), F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp")
    )


def bucket_counts(listens: DataFrame, *, watermark: str, bucket: str = "1 day") -> DataFrame:
    """Running count, first and last time per (user, track, time bucket), a stateful aggregate in update mode.

    State of a bucket is given up when the watermark has passed it, so it is bounded by the buckets that are
    open; rows that come later than that, and rows without a time, are not counted.
    """
    rows = listens.withWatermark("ts", watermark)
    return rows.groupBy(F.window("ts", bucket).alias("bucket"), "user_id", "track_id").agg(
        F.count(F.lit(1)).alias("listen_count"), F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp")
    )


def upsert_running_counts(listens: DataFrame, path: str, checkpoint: str, *, watermark: str, bucket: str = "1 day", **trigger) -> StreamingQuery:
    """Upsert the groups that a micro-batch changed: each is written whole under the batch's number; the newest one counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumn("bucket", F.col("bucket.start")).withColumn("version", F.lit(batch_id).cast("long"))
        _write_part(changed, path, _part_name(batch, batch_id))

    counts = bucket_counts(listens, watermark=watermark, bucket=bucket)
    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_running_counts(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, track_id, listen_count, first_timestamp, last_timestamp) over all buckets as last upserted.

    A query's state starts empty, so the rows of two queries on one table are added, the versions of one replaced.
    """
    rows = _live(spark, path).withColumn("query", F.regexp_replace("part", "-[0-9]+$", ""))
    values = F.struct("listen_count", "first_timestamp", "last_timestamp")
    newest = rows.groupBy("query", "user_id", "track_id", "bucket").agg(F.max_by(values, "version").alias("v")).select("user_id", "track_id", "v.*")
    return newest.groupBy("user_id", "track_id").agg(
        F.sum("listen_count").alias("listen_count"), F.min("first_timestamp").alias("first_timestamp"), F.max("last_timestamp").alias("last_timestamp")
    )


def stream_recent_plays(
    plays: DataFrame, path: str, checkpoint: str, *, limit: int = RECENT_PLAYS, **trigger
) -> StreamingQuery:
    """Keep each micro-batch's newest plays per user from a stream of (user_id, track_id, played_at, ...)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_part(recent_plays(batch, limit=limit).drop("pos"), path, _part_name(batch, batch_id))

    return plays.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_recent_plays(spark: SparkSession, path: str, *, limit: int = RECENT_PLAYS) -> DataFrame:
    """Newest plays per user over all parts; ties in time are broken by track id, as in the batch form."""
    return recent_plays(_live(spark, path).drop("part"), limit=limit)
