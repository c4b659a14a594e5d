"""An audit trail that is only added to, from batches and from streams.

A batch is written to a folder of its number; a batch that is replayed after a failure writes that folder again, so
nothing is in the trail twice and nothing that was written before is touched. Inside, rows lie by run, so a read of
one run's audit reads its folders alone. Rows that come later than the watermark go to a trail of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AuditTrail:
    def __init__(self, spark: SparkSession, path: str, run: str = "run_id"):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds a batch; as the function of foreachBatch, or by hand for a batch of its own number."""
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", self.run).parquet(self.path)

    def read(self, run=None) -> DataFrame:
        trail = self.spark.read.parquet(self.path)
        return trail if run is None else trail.where(F.col(self.run) == F.lit(run))


class LateRows:
    """A foreachBatch function that parts rows into those in time and those later than ``late`` behind the newest row of
    all earlier batches. What each batch saw is kept with its number, so that a replayed batch is parted as before."""

    def __init__(self, spark: SparkSession, path: str, ts: str = "ts", late: str = "2 hours"):
        self.spark, self.ts, self.late = spark, ts, late
        self.seen, self.in_time, self.side = (f"{path.rstrip('/')}/{x}" for x in ("seen", "in_time", "late"))

    def _put(self, rows: DataFrame, where: str, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(where)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        newest = None
        if batch:  # batches are numbered from 0 and every one leaves a row
            newest = spark.read.parquet(self.seen).where(F.col("batch") < batch).agg(F.max("newest")).first()[0]
        bound = F.lit(newest).cast("timestamp") - F.expr(f"interval {self.late}")
        too_late = F.coalesce(F.col(self.ts) < bound, F.lit(False))
        self._put(rows.where(~too_late), self.in_time, batch)
        self._put(rows.where(too_late), self.side, batch)
        self._put(rows.agg(F.max(F.col(self.ts).cast("timestamp")).alias("newest")), self.seen, batch)
