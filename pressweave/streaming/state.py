"""Tables a streaming job keeps between micro-batches.

A table is a folder of parquet partitions ``batch=<id>``. A batch only reads partitions of earlier batches and
overwrites its own, so running a batch again after a failure leaves the same table.

A table that is read as "newest row of every key" can be folded: the newest rows of all batches before N become the base
version N, and later batches read that base and the batches since. The mark of a version is written after its rows, and a
batch only uses versions up to its own number, so a fold that died, or a batch that runs again, reads what it read before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def create(self) -> "BatchTable":
        """An empty first partition, so that readers always find the table, and the mark of no base."""
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(f"{self.path}/batch=-1")
        self._mark(-1)
        return self

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema + ", batch bigint").option("basePath", self.path).parquet(self.path)

    def before(self, batch: int) -> DataFrame:
        return self._read().where(F.col("batch") < batch)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self) -> DataFrame:
        return self._read().drop("batch")

    def _marks(self) -> DataFrame:
        return self.spark.read.schema("v bigint").parquet(f"{self.path}-marks")

    def version(self, batch: int | None = None) -> int:
        """The newest base version that ``batch`` may read; -1 if there is none."""
        marks = self._marks() if batch is None else self._marks().where(F.col("v") <= batch)
        return marks.agg(F.max("v")).first()[0]

    def fold(self, keys: list[str], batch: int) -> None:
        """The newest row of every key before ``batch`` as a base version; folders of earlier batches and versions are
        not read by later batches any more and may be deleted."""
        self.latest(keys, before=batch, newest=batch - 1).write.mode("overwrite").parquet(f"{self.path}-base/v={batch}")
        self._mark(batch)

    def _mark(self, version: int) -> None:
        self.spark.createDataFrame([(version,)], "v bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}-marks/n={version}")

    def latest(self, keys: list[str], before: int | None = None, newest: int | None = None) -> DataFrame:
        """The newest row of every key: an upsert read back from the change log since the last fold.

        ``newest`` bounds the base version, by default that of the batch that reads."""
        base = self.version(before if newest is None else newest)
        src = self._read() if before is None else self.before(before)
        src = src.where(F.col("batch") >= base)
        if base >= 0:
            src = src.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.path}-base/v={base}").withColumn(
                "batch", F.lit(base - 1).cast("bigint")))
        w = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
        return src.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "batch")


def run_available(stream: DataFrame, on_batch, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there in micro-batches and stop."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(on_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def parquet_stream(spark: SparkSession, folder: str, file: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of the parquet files of that name pattern in a folder."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{file}").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", file)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
