"""Tables that are replaced whole or by run, and whose readers never see a half-written state.

``VersionedTable`` writes each state beside the last and reads the newest whose write was committed; an old state,
of whatever columns, is set aside and not deleted. ``RunResults`` keeps the results of runs apart by folder, so that
a run that is screened again replaces its own rows and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[tuple[int, bool]]:
        """The numbers of the states there are, and whether each was committed."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("v")]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted((int(p.getName()[1:]), fs.exists(path(p, "_SUCCESS"))) for p in found)

    def replace(self, rows: DataFrame) -> int:
        """Writes a new state and gives its number. Rows may come from the state that is replaced."""
        number = max([n for n, _ in self._folders()], default=0) + 1
        rows.write.parquet(f"{self.path}/v{number:08d}")
        return number

    def versions(self) -> list[int]:
        return [n for n, whole in self._folders() if whole]

    def read(self, version: int | None = None) -> DataFrame:
        """The newest committed state, or one that was set aside."""
        number = version or max(self.versions())
        return self.spark.read.parquet(f"{self.path}/v{number:08d}")


class RunResults:
    """Rows by run_id in folders of their own: reads of a run read its folder alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def replace(self, rows: DataFrame) -> None:
        """Each run in rows gets these rows; other runs keep theirs."""
        rows.repartition("run_id", F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)
