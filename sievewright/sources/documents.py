"""Document sources: folders, archives, manifests and tables."""

from __future__ import annotations

import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of documents.
SUFFIXES = ("pdf", "doc", "docx", "odt", "rtf", "txt", "md", "html", "htm", "png", "jpg", "jpeg", "tif", "tiff")

DOCUMENT = r"^[^.].*\.(" + "|".join(SUFFIXES) + ")$"
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 4000, 25 << 20, 5 << 30


def folder(spark: SparkSession, root: str) -> DataFrame:
    """path, batch_id, filename, length and content of the files below <root>/<batch>/; any file system Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    batch = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.select("path", batch.alias("batch_id"), name.alias("filename"), "length", "content")


def is_document(filename: Column) -> Column:
    """A document's suffix, no hidden file, nothing of __MACOSX."""
    base = F.element_at(F.split(filename, "/"), -1)
    return F.rlike(F.lower(base), F.lit(DOCUMENT)) & ~F.contains(filename, F.lit("__MACOSX/"))


def _usable(archive: bytes) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]]:
    """An archive and its members that are documents."""
    z = zipfile.ZipFile(io.BytesIO(archive))
    inside = re.compile(DOCUMENT, re.IGNORECASE)
    return z, [i for i in z.infolist() if not i.is_dir() and "__MACOSX/" not in i.filename and inside.match(i.filename.rsplit("/", 1)[-1])]


def _unpacked(files: DataFrame, limit: int, batch: str) -> DataFrame:
    """(path, upto): how many members of each archive its upload has room for. Declared sizes alone are
    sorted and read once; the first member of an archive that does not fit ends that archive."""

    def declare(parts):
        for part in parts:
            rows = []
            for b, p, c in zip(*(part.column(k).to_pylist() for k in range(3))):
                try:
                    rows += [(b, p, k, i.file_size) for k, i in enumerate(_usable(c)[1])]
                except (zipfile.BadZipFile, OSError):
                    pass  # told when it is opened to be read
            columns = list(zip(*rows)) or [()] * 4
            kinds = (part.schema.field(0).type, pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[batch, "path", "k", "size"])

    def fold(parts):
        last, full, used = None, None, 0
        for part in parts:
            taken = []
            for of, path, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()):
                if of != last:
                    last, full, used = of, None, 0
                if used + n > limit:
                    full = path
                taken.append(path != full)
                used += n if taken[-1] else 0
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(taken, pa.bool_())], names=["path", "taken"])

    zips = files.where(F.endswith(F.lower("path"), F.lit(".zip")) & F.col("content").isNotNull()).select(batch, "path", "content")
    schema = T.StructType([zips.schema[0], *(T.StructField(n, t) for n, t in (("path", T.StringType()), ("k", T.IntegerType()), ("size", T.LongType())))])
    declared = zips.mapInArrow(declare, schema).repartition(batch).sortWithinPartitions(batch, "path", "k")
    return declared.mapInArrow(fold, "path string, taken boolean").groupBy("path").agg(F.count_if("taken").cast("int").alias("upto"))


def expand_archives(files: DataFrame, limit: int = 512 << 20, *, batch: str = "batch_id") -> DataFrame:
    """files(path, batch_id, content) with archives replaced by the documents in them. The limit of
    unpacked bytes is shared by the archives of a batch, in the order of their paths. What can't be read
    or has no room stays as a row with an error."""

    def members(path, content, upto):
        name = path.rsplit("/", 1)[-1]
        if not path.lower().endswith(".zip"):
            return [(name, content, None)]
        try:
            z, inside = _usable(content or b"")
        except (zipfile.BadZipFile, OSError) as why:
            return [(name, None, str(why))]
        out = []
        for k, info in enumerate(inside):
            data, error = None, None if k < (upto or 0) else "over the limit of unpacked bytes"
            try:
                data = None if error else z.read(info)
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError) as why:
                error = str(why)
            out.append((info.filename.rsplit("/", 1)[-1], data, error))
        return out

    def expand(parts):
        for part in parts:
            rows = [(p, *m) for p, c, n in zip(*(part.column(k).to_pylist() for k in range(3))) for m in members(p, c, n)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "filename", "content", "error"])

    joined = files.select("path", "content").join(_unpacked(files, limit, batch), "path", "left")
    return joined.mapInArrow(expand, "path string, filename string, content binary, error string")


def within_total(files: DataFrame, limit: int, *, batch: str = "batch_id", size: str = "length", order: str = "path") -> DataFrame:
    """files with taken: in order, each file that still fits; one that does not, or has no size, is
    passed over and later, smaller ones may fit. Names and sizes alone are sorted by batch and read
    once, with the bytes used so far as all that is kept; names are distinct within a batch."""

    def fold(parts):
        last, used = None, 0
        for part in parts:
            taken = []
            for of, n in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                if of != last:
                    last, used = of, 0
                taken.append(n is not None and used + n <= limit)
                used += n if taken[-1] else 0
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(taken, pa.bool_())], names=[batch, order, "taken"])

    listing = files.select(batch, order, size).repartition(batch).sortWithinPartitions(batch, order)
    schema = T.StructType([listing.schema[0], listing.schema[1], T.StructField("taken", T.BooleanType())])
    judged = listing.mapInArrow(fold, schema)
    return files.join(judged, [batch, order], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def manifest_problems(manifest: DataFrame, job: str = "job_id") -> DataFrame:
    """By job: files, bytes, a hash of the manifest in which order does not matter, and whether it may be
    accepted. The hash is of a sum of line hashes, so a job of any size is added up by parts."""
    named = F.col("filename").isNotNull() & F.length("filename").between(1, 255) & ~F.rlike("filename", F.lit(r"\p{Cntrl}"))
    sized = F.col("size").between(1, MAX_FILE_BYTES)
    line = F.conv(F.substring(F.sha2(F.concat_ws("\t", "filename", F.col("size").cast("string")), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return manifest.groupBy(job).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sha2(F.sum(line).cast("string"), 256).alias("manifest_hash"),
        (F.bool_and(F.coalesce(named & sized, F.lit(False))) & (F.count("*") <= MAX_FILES) & (F.sum("size") <= MAX_TOTAL_BYTES)).alias("accepted"),
    )


def replays(submissions: DataFrame, keys: list[str], *, submission: str = "job_id", manifest: str = "manifest_hash") -> DataFrame:
    """submissions with replay_of, the first submission under the same user and key (null for the first
    itself), and conflict: whether that one had another manifest. One without a key replays nothing."""
    first = submissions.groupBy(*keys).agg(F.min(F.struct(F.col(submission).alias("id"), F.col(manifest).alias("of"))).alias("_first"))
    joined = submissions.join(first, keys, "left")
    again = F.col("_first")["id"] != F.col(submission)
    differs = again & ~F.col("_first")["of"].eqNullSafe(F.col(manifest))
    return joined.withColumn("replay_of", F.when(again, F.col("_first")["id"])).withColumn("conflict", F.coalesce(differs, F.lit(False))).drop("_first")
