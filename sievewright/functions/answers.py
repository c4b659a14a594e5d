"""Model answers made into profiles: JSON read as VARIANT by a fixed shape, whatever stands in it.

An answer is text that may think aloud, fence its JSON or say something else altogether. Nothing in it is
trusted to have its type: numbers may be words, lists null, records without names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.verdicts import bound
from ..plans.fields import EMPLOYMENT_TYPES, PROFICIENCIES, SENIORITY, SKILL_CATEGORIES, WORK_RIGHTS
from . import resume as rs

#: What a word outside its enumeration is recorded as.
FALLBACKS = {"category": "other", "proficiency": None, "seniority": None, "employment_type": None, "status": "unknown"}
ALLOWED = {"category": SKILL_CATEGORIES, "proficiency": PROFICIENCIES, "seniority": SENIORITY, "employment_type": EMPLOYMENT_TYPES, "status": (*WORK_RIGHTS, "unknown")}
LISTS = ("universities", "languages", "affiliations", "certifications", "licences")


def _of(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _whole(value: Column, name: str) -> Column:
    """A whole number, cut towards zero; what is no number, or none that an int holds, is null."""
    return _of(value, name, "double").try_cast("int")


def _listed(value: Column, name: str) -> Column:
    """The members of a list; none if it is null or no list."""
    return F.coalesce(_of(value, name, "array<variant>"), F.array().cast("array<variant>"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _records(value: Column, name: str) -> Column:
    return F.filter(_listed(value, name), lambda x: F.coalesce(F.startswith(_kind(x), F.lit("OBJECT")), F.lit(False)))


def _named(value: Column, name: str, key: str) -> Column:
    return F.filter(_records(value, name), lambda x: F.trim(F.coalesce(_of(x, key), F.lit(""))) != "")


def _true(value: Column, name: str) -> Column:
    """What counts as true: true, a number but zero, and any text that is not empty."""
    inner = _of(value, name, "variant")
    said = _of(value, name)
    return F.coalesce(F.when(_kind(inner) == "STRING", said != "").when(_kind(inner) == "BOOLEAN", said == "true").otherwise(_of(value, name, "double") != 0), F.lit(False))


def _texts(value: Column, name: str) -> Column:
    """The members of a list that say something, as text."""
    said = F.transform(_listed(value, name), lambda x: F.when(_kind(x) != "VOID", F.try_variant_get(x, "$", "string")))
    return F.filter(said, lambda s: s.isNotNull() & ~s.isin("", "0", "false"))


def _coerced(value: Column, kind: str) -> Column:
    return rs.coerced(value, kind, ALLOWED[kind], FALLBACKS[kind])


def _notes(value: Column, kinds: tuple[str, ...], where: Column) -> Column:
    """What was not recognised in a record."""
    lost = [rs.coercion_note(_of(value, k), k, ALLOWED[k], "", FALLBACKS[k]) for k in kinds]
    return F.array_compact(F.array(*[F.concat(where, n) for n in lost]))


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("'"), name, F.lit("'"))


def normalised(answer: Column) -> Column:
    """The profile in an answer, or null if it holds no JSON object. Records without a name or title go, as do
    members of lists that say nothing; numbers that are none are null; a list that is null is empty; words of an
    enumeration are written as it writes them, and of those it does not know a note is left."""

    def read(v: Column) -> Column:
        skills, roles = _named(v, "skills", "name"), _records(v, "experience")
        rights = _of(v, "work_rights", "variant")
        role_name = lambda r: F.concat(F.lit("role "), _quoted(F.coalesce(F.nullif(_of(r, "title"), F.lit("")), F.lit("?"))))
        notes = F.concat(
            _texts(v, "extraction_notes"),
            F.flatten(F.transform(skills, lambda s: _notes(s, ("category", "proficiency"), F.concat(F.lit("skill "), _quoted(_of(s, "name")))))),
            F.flatten(F.transform(roles, lambda r: _notes(r, ("seniority", "employment_type"), role_name(r)))),
            _notes(rights, ("status",), F.lit("work rights")),
        )
        skill = lambda s: F.struct(_of(s, "name").alias("name"), _coerced(_of(s, "category"), "category").alias("category"), _of(s, "years", "double").alias("years"), _coerced(_of(s, "proficiency"), "proficiency").alias("proficiency"), _of(s, "evidence").alias("evidence"))
        role = lambda r: F.struct(
            *[_of(r, n).alias(n) for n in ("title", "employer", "start", "end")], _true(r, "is_current").alias("is_current"), _of(r, "months", "double").alias("months"), _of(r, "summary").alias("summary"),
            _coerced(_of(r, "seniority"), "seniority").alias("seniority"), _of(r, "industry").alias("industry"), _coerced(_of(r, "employment_type"), "employment_type").alias("employment_type"),
            _whole(r, "team_size").alias("team_size"), _texts(r, "technologies").alias("technologies"),
        )
        award = lambda q: F.struct(*[_of(q, n).alias(n) for n in ("title", "institution", "field_of_study", "country")], _whole(q, "completion_year").alias("completion_year"))
        project = lambda p: F.struct(_of(p, "name").alias("name"), _of(p, "summary").alias("summary"), _texts(p, "technologies").alias("technologies"), _of(p, "months", "double").alias("months"))
        return F.struct(
            _of(v, "summary").alias("summary"), F.transform(skills, skill).alias("skills"), F.transform(roles, role).alias("experience"), F.transform(_named(v, "qualifications", "title"), award).alias("qualifications"),
            F.struct(_coerced(_of(rights, "status"), "status").alias("status"), _of(rights, "visa_subclass").alias("visa_subclass"), _of(rights, "evidence").alias("evidence")).alias("work_rights"),
            *[_of(v, n, "double").alias(n) for n in ("total_years_experience", "management_years", "availability_weeks")], *[_whole(v, n).alias(n) for n in ("people_managed_max", "publications_count")],
            *[_texts(v, n).alias(n) for n in LISTS], F.transform(_named(v, "projects", "name"), project).alias("projects"), notes.alias("extraction_notes"),
        )

    return bound(F.try_parse_json(rs.recovered_json(answer)), lambda v: F.when(v.isNotNull(), read(v)))
