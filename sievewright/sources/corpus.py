"""A cached research corpus as a data source: two configurations of JSON rows, joined on user_id.

``spark.read.format("cached_corpus")`` takes ``path`` and ``config``. The folder holds for each configuration a folder
of the pages that were fetched, JSON files of {"rows": [{"row": {...}}]}, one after another if a file has several. A
file is a partition; the options say, in place of a factory, which reader is built. Rows with equal user_id are not
gathered by the reader but by the join. The folder is opened as files, so driver and executors must both see it, as
they see spark.checkpoint.dir; Spark's own readers serve stores that are not mounted.
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The columns of the two configurations.
SCHEMAS = {
    "resumes": "user_id string, target_role string, jobs array<struct<job_order:int,job_title:string,duration_str:string,tasks:array<string>>>",
    "summaries": "user_id string, race string, first_name string",
}


class Page(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


_space = re.compile(r"\s*")


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class CorpusReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.folder, self.config = schema.fieldNames(), _local(options["path"]), options.get("config", "resumes")

    def partitions(self):
        folder = os.path.join(self.folder, self.config)
        return [Page(os.path.join(folder, name)) for name in sorted(os.listdir(folder)) if name[0] not in "._"]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as file:
            for page in _documents(file):
                for entry in page.get("rows") or []:
                    row = entry.get("row") or {}
                    yield tuple(_shaped(n, row.get(n)) for n in self.names)


def _documents(file, step: int = 1 << 20):
    """The documents of a file, one at a time: what is held is the page at hand and what was read of the next."""
    decoder, held, wanted = json.JSONDecoder(), "", step
    while more := file.read(wanted):
        # a page longer than what is held is tried again at twice the length, so that it is scanned a few times at most
        held, at = held + more, 0
        while True:
            at = _space.match(held, at).end()
            try:
                page, at = decoder.raw_decode(held, at)
            except json.JSONDecodeError:
                break
            yield page
        held = held[at:]
        wanted = max(step, len(held))
    if held:
        decoder.raw_decode(held)


def _shaped(name: str, value):
    if name != "jobs":
        return None if value is None else str(value)
    return [(j.get("job_order"), j.get("job_title"), j.get("duration_str"), j.get("tasks")) for j in value or [] if j]


class CachedCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cached_corpus"

    def schema(self) -> str:
        config = self.options.get("config", "resumes")
        if config not in SCHEMAS:
            raise ValueError(f"no configuration {config}; there are {', '.join(SCHEMAS)}")
        return SCHEMAS[config]

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(schema, self.options)


def cached_corpus(spark: SparkSession, folder: str, config: str) -> DataFrame:
    spark.dataSource.register(CachedCorpus)
    return spark.read.format("cached_corpus").option("config", config).load(folder)


def write_pages(rows: DataFrame, folder: str, config: str, pages: int, most: int = 500) -> None:
    """Rows in the form in which pages are cached: at least ``pages`` of about equal size, and as many more as keep a page
    at some ``most`` rows, a line each, however long the table."""
    pages = max(pages, -(-rows.count() // most))
    row = F.struct(F.struct(*rows.columns).alias("row"))
    page = rows.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(pages))).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("value"))
    page.select("value").write.text(f"{folder.rstrip('/')}/{config}")


def cases(histories: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """A row per variant of a work history, for histories with at least ``least`` groups: case_id, target_role,
    variant_id, group, first_name, jobs. Of a group that names a person twice the last by name counts."""
    named = names.groupBy("user_id", F.col("race").alias("group")).agg(F.max("first_name").alias("first_name"))
    enough = named.groupBy("user_id").agg(F.count("*").alias("groups")).where(F.col("groups") >= least).select("user_id")
    joined = histories.join(enough, "user_id", "left_semi").join(named, "user_id")
    return joined.select(F.col("user_id").alias("case_id"), "target_role", F.concat_ws(":", "user_id", "group").alias("variant_id"), "group", "first_name", "jobs")
