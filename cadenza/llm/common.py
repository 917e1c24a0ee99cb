"""What the operators of this subpackage share: staged tables, byte-bounded Arrow slices, plain columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text bytes that a task holds as Python objects at a time.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a local one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``stage``, in buckets of ``key``: joins and groups by it do not move this side again."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark).rstrip('/')}/{table}").saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018 - resolved before the name goes
    spark.sql(f"DROP TABLE {table}")
    return out


def plain(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """(id, text) and no other column, so names of further columns cannot clash with an operator's own."""
    chosen = {"id": id_col, "text": text_col, **more}
    return df.select(*(df[c].alias(k) for k, c in chosen.items()))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string, to be built before a function goes to the executors."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``: the split into learning and held-out rows."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(m))


def give_back() -> None:
    """Return the memory of finished work to the machine: worker processes live on beside the JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of at most ``limit`` bytes of ``column``, or of one row where that row is longer."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        end, first, done = np.cumsum(size, dtype=np.int64), 0, 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(end, done + limit, "right")))
            yield batch.slice(first, last - first)
            first, done = last, int(end[last - 1])
