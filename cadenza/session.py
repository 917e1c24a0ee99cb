"""Session settings used by the tests, the benchmark and local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes a write's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "cadenza") -> SparkSession:
    """A local session; a cluster brings its own session and none of this applies."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's shared folder (``spark.checkpoint.dir``).

    Unset, it is an error on a cluster, where a folder of one machine is no use to the others; a local
    session, whose executors are this process, gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="cadenza-ckpt-"))


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder in compressed columns and read from there; cuts the lineage as a checkpoint does.

    A checkpoint's files hold whole rows without compression, several times as many bytes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if any(f.dataType.typeName() == "void" for f in df.schema.fields):  # Parquet has no such type
        return df.checkpoint()
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/written-{uuid.uuid4().hex}"
    # Else the shuffles behind the table stay on disk until the driver happens to collect its garbage.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
