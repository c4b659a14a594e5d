"""From documents to profiles: deduplication, references, structuring and de-identification.

Every stage keeps what it cannot use and says why: a duplicate names its original, a document that is
too short carries an error, a profile that still leaks is failed. No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import fresh
from . import numbering

SHORTEST, LONGEST = 80, 24_000


def mark_duplicates(docs: DataFrame, *, content: str = "content", order: tuple[str, ...] = ("doc_id",), batch: str | None = None, key: str = "doc_id") -> DataFrame:
    """docs with content_hash and duplicate_of (null for the first of equal contents in a batch).

    The first of a content comes from a partial aggregation and is joined back, so a content that
    fills the corpus is in no single task.
    """
    keys = [*([batch] if batch else []), "content_hash"]
    (first_,) = fresh(docs, "first")
    hashed = docs.withColumn("content_hash", F.sha2(F.col(content), 256))
    first = hashed.groupBy(*keys).agg(F.min(F.struct(*order, F.col(key).alias(first_)))[first_].alias(first_))
    joined = hashed.join(first, keys, "left")
    return joined.withColumn("duplicate_of", F.when(F.col(first_) != F.col(key), F.col(first_))).drop(first_)


def candidate_references(pending: DataFrame, *, batch: str = "batch_id", order: tuple[str, ...] = ("created_at", "filename"), numbered: int = 0, ranges: int | None = None) -> DataFrame:
    """pending with candidate_ref: 'Candidate 1' and on, by arrival within the batch; see numbering.numbered."""
    (place,) = fresh(pending, "place")
    out = numbering.numbered(pending, [batch], list(order), into=place, ranges=ranges)
    return out.withColumn("candidate_ref", F.concat(F.lit("Candidate "), (F.col(place) + numbered).cast("string"))).drop(place)


def split_errors(docs: DataFrame, column: str = "text", longest: int = LONGEST) -> DataFrame:
    """docs with error (null if usable) and the text cut to what a pass takes."""
    length = F.length(F.trim(column))
    error = F.when(F.col(column).isNull(), "unreadable").when(length < SHORTEST, "too_short")
    return docs.withColumn("error", error).withColumn("truncated", F.coalesce(F.length(column) > longest, F.lit(False))).withColumn(column, F.substring(column, 1, longest))


def structured(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with contact details, stated years, work rights and qualification lines, read by patterns."""
    body = F.col(column)
    rights = (
        F.when(tx.matches(body, r"\b(requires?|need(s|ing)?) (visa )?sponsorship\b"), "requires_sponsorship")
        .when(tx.matches(body, r"\bpermanent resident"), "permanent_resident")
        .when(tx.matches(body, r"\bcitizen(ship)?\b"), "citizen")
        .when(tx.matches(body, r"\b(full|unrestricted) work(ing)? rights\b"), "visa_unrestricted")
        .otherwise("unknown")
    )
    lines = F.filter(F.split(body, "\n"), lambda x: tx.qualification_level(x)["level"].isNotNull())
    return docs.select(
        "*",
        F.nullif(F.regexp_extract(body, tx.EMAIL, 0), F.lit("")).alias("email"),
        F.nullif(F.regexp_extract(body, tx.PHONE, 0), F.lit("")).alias("phone"),
        F.nullif(F.trim(F.get(F.split(body, "\n"), F.lit(0))), F.lit("")).alias("full_name"),
        F.regexp_extract(body, r"(?i)(\d{1,2})\+?\s*years", 1).try_cast("double").alias("stated_years"),
        rights.alias("work_rights"),
        F.transform(lines, lambda x: F.struct(F.trim(x).alias("title"), tx.qualification_level(x)["level"].alias("aqf_level"), tx.qualification_level(x)["confidence"].alias("aqf_confidence"))).alias("qualifications"),
    )


def anonymised(profiles: DataFrame, column: str = "text") -> DataFrame:
    """Profiles without contact columns, their text scrubbed; rows that still leak are failed."""
    tokens = tx.identity_tokens(F.col("full_name"), F.col("email"), F.col("phone"))
    out = profiles.withColumn("_tokens", tokens).withColumn(column, tx.scrub(F.col(column), F.col("_tokens")))
    left = tx.leaks(F.col(column), F.col("_tokens"))
    out = out.withColumn("leaked", F.coalesce(F.size(left) > 0, F.lit(False)))
    return out.drop("_tokens", "full_name", "email", "phone")
