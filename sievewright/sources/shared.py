"""Written tables in the folder that driver and executors share, and names that do not clash."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that df does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, deleted when the session ends. A temporary one only where that is unset and Spark is this one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    folder = f"{base.rstrip('/')}/sievewright-{uuid.uuid4().hex}"
    atexit.register(lambda: spark.sparkContext._jsc is not None and delete(spark, folder))
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Written:
    """A table written once: what reads it reads the same rows, and lost executors cost only their tasks.

    ``clean`` deletes it, and so does leaving a ``with`` block; a lazy result must have been read by then.
    """

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, shared_folder(df.sparkSession)
        df.write.parquet(self.path)
        self.rows = self.spark.read.schema(df.schema).parquet(self.path)

    def clean(self) -> None:
        delete(self.spark, self.path)

    def __enter__(self) -> DataFrame:
        return self.rows

    def __exit__(self, *_) -> None:
        self.clean()
