"""Plans that keep one very hot key from landing in one task."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.session import ensure_checkpoint_dir


def _splits_skew(spark: SparkSession) -> bool:
    return all(spark.conf.get(f"spark.sql.adaptive.{c}", "true") == "true" for c in ("enabled", "skewJoin.enabled"))


def salted_join(
    facts: DataFrame,
    per_key: DataFrame,
    on: str | Sequence[str],
    *,
    spread: Sequence[str],
    how: str = "left",
    salts: int = 1,
) -> DataFrame:
    """Join facts with a table that has ONE row per key; a hot key does not stay in one task.

    By default Spark splits what is hot: adaptive execution measures the shuffled partitions and cuts the
    ones above its skew thresholds, so no key is repeated that need not be. It can do so only where both
    sides come straight from a shuffle; the salt column, even with a single salt, sees to that when the keyed
    side is an aggregate by the same key. ``salts`` above 1 also spreads every key over that many tasks by the
    hash of the fact columns ``spread``; it is for sessions without adaptive execution.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if salts == 1 and not _splits_skew(facts.sparkSession):
        warnings.warn("adaptive skew joins are off: a hot key stays in one task; turn them on or give salts", stacklevel=2)
    left = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def positions_by_time(rows: DataFrame, key: str, ts: str, tie: Sequence[str], *, parts: int | None = None, position: str = "pos") -> DataFrame:
    """0-based position of each row within its key by (ts, tie), without one task per key or time.

    All rows are sorted by (key, ts, tie) in ranges of like size, so a key, and also a burst of rows at one time, is
    cut into as many ranges as it needs; equal rows may be cut too. The sorted rows are written once to the shared
    folder. Each gets its place in its range plus the rows of its key in the ranges before, a running sum
    over one small row for each key and range. Null times come first, as in an ascending sort.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    count = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).asc_nulls_first(), F.col(ts).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in tie), F.col("_even")]
    dealt = rows.withColumn("_even", F.monotonically_increasing_id()).repartitionByRange(count, *order).sortWithinPartitions(*order)
    placed = dealt.drop("_even").withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long"))).select(
        F.col(key).alias("_key"), F.col("_range").alias("_of"), "_before", "_first"
    )
    joined = placed.join(runs, placed[key].eqNullSafe(runs["_key"]) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(position, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_range", "_key", "_of", "_before", "_first")


def dense_index(ids: DataFrame, column: str, *, buckets: int = 4096, index: str = "idx") -> DataFrame:
    """Distinct values of ``column`` with an int index 0..n-1: hash buckets plus bucket offsets."""
    distinct = (
        ids.select(column).distinct().withColumn("_b", F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))
    )
    offsets = distinct.groupBy("_b").agg(F.count(F.lit(1)).alias("_rows"))
    # ``buckets`` rows at the very most, so the unpartitioned running sum is a bounded one.
    offsets = offsets.withColumn(
        "_offset",
        F.sum("_rows").over(W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
        - F.col("_rows"),
    ).select("_b", "_offset")
    numbered = distinct.withColumn("_rn", F.row_number().over(W.partitionBy("_b").orderBy(column)))
    return numbered.join(offsets, "_b").select(column, (F.col("_offset") + F.col("_rn") - 1).cast("int").alias(index))


def top_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per partition. Spark prunes to k per map task before the shuffle (group limit)."""
    if k <= 0:
        return df.withColumn(rank, F.lit(0)).limit(0)
    w = W.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
