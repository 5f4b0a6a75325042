"""Session helpers: one place for configuration and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "pressweave", cores: str = "*", shuffle_partitions: int = 8,
                driver_memory: str = "20g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="pressweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and go on from there.

    Used between rounds of a loop. Unlike ``checkpoint()`` this computes the frame once, and what is
    read back is columnar, so later steps still read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_large(df: DataFrame) -> DataFrame:
    """:func:`cut` for a table that grows with the input and is joined by key: it is never broadcast.

    Catalyst takes the size of the files for that of the table. Ids and repeated words take a few bytes a row in a file and
    ten times that in the driver, and what is exploded from them still more."""
    return cut(df).hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer partitions than cores (one small file, one row group) to all cores.

    Only for frames that are still a plain scan, before per-row work such as parsing or many patterns. Data
    laid out in many files, as on a cluster, has more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df
