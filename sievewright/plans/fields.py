"""The vocabulary of a profile: 74 named fields and the fields of its records, as Columns.

``field("aqf") >= 7`` is a Column; ``condition("aqf", ">=", 7)`` is a Verdict with its sentence. Names
that would carry a protected attribute have no Column at all and raise with the reason. New fields
come by ``register_field``, and new kinds of records by ``register_record``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verdicts
from ..operators.verdicts import Kind, Verdict, plain_number
from .vocabulary import FORBIDDEN, LABELS, RECORD_ALIASES, RECORD_FIELDS, citations

#: Ladders and enumerations.
SENIORITY = ("intern", "graduate", "junior", "mid", "senior", "lead", "principal", "manager", "head", "director", "executive")
LEADERSHIP = ("lead", "principal", "manager", "head", "director", "executive")
SKILL_CATEGORIES = ("technical", "domain", "language", "tool", "soft", "other")
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert")
EMPLOYMENT_TYPES = ("permanent", "contract", "casual", "internship", "freelance", "volunteer", "other")
WORK_RIGHTS = ("citizen", "permanent_resident", "visa_unrestricted", "visa_restricted", "requires_sponsorship")
UNRESTRICTED = "unrestricted"  # not a status but a property of one


def _c(name: str) -> Column:
    return F.col(name)


def _known(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def _some(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def _count(array: Column) -> Column:
    return F.nullif(F.size(array), F.lit(0))


def _each(array: str, name: str) -> Column:
    return F.col(array)[name]


def _known_some(array: str, name: str) -> Column:
    return _some(_known(_each(array, name)))


def _filled(array: str, name: str) -> Column:
    return _some(F.filter(_each(array, name), lambda x: x.isNotNull() & (x != "")))


def _months() -> Column:
    return _known(_each("experience", "months"))


def _roles_where(test: Callable[[Column], Column]) -> Column:
    """How many roles pass; a role that does not say counts as no."""
    return F.when(F.size("experience") > 0, F.size(F.filter("experience", lambda r: F.coalesce(test(r), F.lit(False)))))


def _current() -> Column:
    return F.filter("experience", lambda r: r["is_current"])


def _latest(name: str) -> Column:
    return F.when(F.size(_current()) > 0, F.get(_current(), F.lit(0))[name]).otherwise(F.get(F.col("experience"), F.lit(0))[name])


def _skills(*categories: str) -> Column:
    return _some(F.transform(F.filter("skills", lambda s: s["category"].isin(*categories)), lambda s: s["name"]))


def _ladder(seniority: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, SENIORITY)), seniority), F.lit(0)) - 1


def _seniority_level() -> Column:
    return F.array_max(F.transform("experience", lambda r: _ladder(r["seniority"])))


def _distinct_without_case(items: Column) -> Column:
    empty = F.array().cast("array<string>")
    fold = F.aggregate(
        F.filter(items, lambda x: x.isNotNull() & (x != "")),
        F.struct(empty.alias("seen"), empty.alias("kept")),
        lambda acc, x: F.when(F.array_contains(acc["seen"], F.lower(x)), acc).otherwise(
            F.struct(F.array_append(acc["seen"], F.lower(x)).alias("seen"), F.array_append(acc["kept"], x).alias("kept"))
        ),
    )
    return fold["kept"]


def _technologies() -> Column:
    tools = F.transform(F.filter("skills", lambda s: s["category"].isin("tool", "technical")), lambda s: s["name"])
    return _some(_distinct_without_case(F.concat(F.flatten(_each("experience", "technologies")), F.flatten(_each("projects", "technologies")), tools)))


def _highest_qualification() -> Column:
    best = F.aggregate(
        F.filter("qualifications", lambda q: q["aqf_level"].isNotNull()),
        F.struct(F.lit(-1).alias("level"), F.lit(None).cast("string").alias("title")),
        lambda acc, q: F.when(q["aqf_level"] > acc["level"], F.struct(q["aqf_level"].cast("int").alias("level"), q["title"].alias("title"))).otherwise(acc),
    )
    return F.coalesce(best["title"], F.get(F.col("qualifications"), F.lit(0))["title"])


def _aqf() -> Column:
    return F.array_max(_each("qualifications", "aqf_level"))


def _status() -> Column:
    return F.nullif(F.col("work_rights.status"), F.lit("unknown"))


def _manages() -> Column:
    yes = (F.coalesce("management_years", F.lit(0.0)) != 0) | (F.coalesce("people_managed_max", F.lit(0)) != 0)
    yes = yes | F.exists("experience", lambda r: F.coalesce(r["seniority"].isin(*LEADERSHIP), F.lit(False)) | (F.coalesce(r["team_size"], F.lit(0)) != 0))
    return F.when(yes, True).when(F.size("experience") > 0, False)


def _true_if(array: str) -> Column:
    return F.when(F.size(array) > 0, True)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # number, list, text, enum or flag
    label: str
    build: Callable[[], Column]
    phrasing: tuple[str, str] | None = None
    values: tuple[str, ...] = ()  # what an enum may be


FIELDS: dict[str, Field] = {}


def register_field(name: str, kind: str, build: Callable[[], Column], label: str | None = None, phrasing: tuple[str, str] | None = None, values: tuple[str, ...] = ()) -> None:
    known = LABELS.get(name, (name.replace("_", " "),))
    FIELDS[name] = Field(name, kind, label or known[0], build, phrasing or (known[1:] if len(known) == 3 else None), values)


for _name, _build in {
    "years_experience": lambda: _c("total_years_experience"),
    "role_count": lambda: _count(_c("experience")),
    "current_role_count": lambda: F.when(F.size("experience") > 0, F.size(_current())),
    "total_role_months": lambda: F.when(F.size(_months()) > 0, F.aggregate(_months(), F.lit(0.0), lambda a, b: a + b)),
    "longest_role_months": lambda: F.array_max(_months()),
    "shortest_role_months": lambda: F.array_min(_months()),
    "average_role_months": lambda: F.round(F.try_divide(F.aggregate(_months(), F.lit(0.0), lambda a, b: a + b), F.size(_months())), 1),
    "current_role_months": lambda: F.get(F.filter("experience", lambda r: r["is_current"] & r["months"].isNotNull()), F.lit(0))["months"],
    "latest_role_months": lambda: _latest("months"),
    "leadership_role_count": lambda: _roles_where(lambda r: r["seniority"].isin(*LEADERSHIP)),
    "contract_role_count": lambda: _roles_where(lambda r: r["employment_type"].isin("contract", "freelance")),
    "permanent_role_count": lambda: _roles_where(lambda r: r["employment_type"] == "permanent"),
    "management_years": lambda: _c("management_years"),
    "people_managed_max": lambda: _c("people_managed_max"),
    "seniority_level": _seniority_level,
    "industry_count": lambda: _count(F.array_distinct(F.transform(_filled("experience", "industry"), F.lower))),
    "aqf": _aqf,
    "qualification_count": lambda: _count(_c("qualifications")),
    "degree_count": lambda: F.when(F.size("qualifications") > 0, F.size(F.filter("qualifications", lambda q: F.coalesce(q["aqf_level"], F.lit(0)) >= 7))),
    "publications_count": lambda: _c("publications_count"),
    "skill_count": lambda: _count(_c("skills")),
    "technical_skill_count": lambda: _count(_skills("technical", "tool")),
    "max_skill_years": lambda: F.array_max(_each("skills", "years")),
    "certification_count": lambda: _count(_c("certifications")),
    "licence_count": lambda: _count(_c("licences")),
    "language_count": lambda: _count(_c("languages")),
    "project_count": lambda: _count(_c("projects")),
    "technology_count": lambda: _count(_technologies()),
    "availability_weeks": lambda: _c("availability_weeks"),
}.items():
    register_field(_name, "number", _build)

for _name, _build in {
    "skills": lambda: _some(_each("skills", "name")),
    "technical_skills": lambda: _skills("technical"),
    "tool_skills": lambda: _skills("tool"),
    "domain_skills": lambda: _skills("domain"),
    "soft_skills": lambda: _skills("soft"),
    "language_skills": lambda: _skills("language"),
    "expert_skills": lambda: _some(F.transform(F.filter("skills", lambda s: s["proficiency"].isin("advanced", "expert")), lambda s: s["name"])),
    "skills_with_years": lambda: _some(F.transform(F.filter("skills", lambda s: s["years"].isNotNull()), lambda s: s["name"])),
    "technologies": _technologies,
    "languages": lambda: _some(_c("languages")),
    "certifications": lambda: _some(_c("certifications")),
    "licences": lambda: _some(_c("licences")),
    "role_titles": lambda: _filled("experience", "title"),
    "current_role_titles": lambda: _some(F.filter(F.transform(_current(), lambda r: r["title"]), lambda t: t.isNotNull() & (t != ""))),
    "employers": lambda: _filled("experience", "employer"),
    "industries": lambda: _filled("experience", "industry"),
    "employment_types": lambda: _known_some("experience", "employment_type"),
    "seniorities": lambda: _known_some("experience", "seniority"),
    "qualification_titles": lambda: _some(_each("qualifications", "title")),
    "fields_of_study": lambda: _filled("qualifications", "field_of_study"),
    "aqf_labels": lambda: _filled("qualifications", "aqf_label"),
    "project_names": lambda: _some(_each("projects", "name")),
    "project_technologies": lambda: _some(F.flatten(_each("projects", "technologies"))),
}.items():
    register_field(_name, "list", _build)

for _name, _build in {
    "current_role_title": lambda: F.get(F.filter(F.transform(_current(), lambda r: r["title"]), lambda t: t.isNotNull() & (t != "")), F.lit(0)),
    "latest_role_title": lambda: _latest("title"),
    "highest_qualification": _highest_qualification,
    "security_clearance": lambda: _c("security_clearance"),
}.items():
    register_field(_name, "text", _build)

for _name, (_build, _values) in {
    "work_rights": (_status, (*WORK_RIGHTS, UNRESTRICTED)),
    "highest_seniority": (lambda: F.get(F.array(*map(F.lit, SENIORITY)), _seniority_level().cast("int")), SENIORITY),
    "latest_seniority": (lambda: _latest("seniority"), SENIORITY),
    "latest_employment_type": (lambda: _latest("employment_type"), EMPLOYMENT_TYPES),
}.items():
    register_field(_name, "enum", _build, values=_values)

for _name, _build in {
    "has_current_role": lambda: F.when(F.size("experience") > 0, F.exists("experience", lambda r: r["is_current"])),
    "has_degree": lambda: _aqf() >= 7,
    "has_postgraduate": lambda: _aqf() >= 8,
    "has_masters": lambda: _aqf() >= 9,
    "has_doctorate": lambda: _aqf() >= 10,
    "has_certifications": lambda: _true_if("certifications"),
    "has_licence": lambda: _true_if("licences"),
    "has_clearance": lambda: F.when(F.col("security_clearance") != "", True),
    "has_management_experience": _manages,
    "has_projects": lambda: _true_if("projects"),
    "has_publications": lambda: _c("publications_count") > 0,
    "multilingual": lambda: F.when(F.size("languages") > 0, F.size("languages") >= 2),
    "work_rights_unrestricted": lambda: F.col("work_rights.unrestricted"),
    "requires_sponsorship": lambda: _status() == "requires_sponsorship",
}.items():
    register_field(_name, "flag", _build)

#: Other names of fields.
ALIASES = {
    "total_years_experience": "years_experience", "years": "years_experience", "experience": "years_experience", "experience_years": "years_experience",
    "years_of_experience": "years_experience", "highest_aqf": "aqf", "aqf_level": "aqf", "qualification_level": "aqf", "work_rights_status": "work_rights",
    "certs": "certifications", "skill": "skills", "language": "languages", "certification": "certifications", "licenses": "licences", "licence": "licences",
    "license": "licences", "tools": "tool_skills", "titles": "role_titles", "companies": "employers", "company": "employers", "roles": "role_titles",
    "positions": "role_titles", "degrees": "qualification_titles", "qualifications": "qualification_titles", "seniority": "highest_seniority",
    "team_size": "people_managed_max", "clearance": "security_clearance", "notice_period_weeks": "availability_weeks", "projects": "project_names",
    "tech": "technologies", "tech_stack": "technologies", "stack": "technologies",
}

class ForbiddenField(ValueError):
    """A field that would carry a protected attribute."""


class UnknownField(ValueError):
    """A name that is no field; the message names the nearest one."""


def _refuse(name: str) -> None:
    if name in FORBIDDEN:
        why, statutes, instead = FORBIDDEN[name]
        raise ForbiddenField(f"{name} may not be read by a rule: {why}. {'; '.join(citations(statutes))}. Instead: {instead}")


def _unknown(name: str, known: list[str], what: str) -> UnknownField:
    near = get_close_matches(name, known, n=1, cutoff=0.6)
    return UnknownField(f"unknown {what} {name}" + (f"; did you mean {near[0]}?" if near else ""))


def spec(name: str) -> Field:
    """The field of a name or alias."""
    name = name.strip().lower()
    found = FIELDS.get(ALIASES.get(name, name))
    if found is None:
        _refuse(name)
        raise _unknown(name, [*FIELDS, *ALIASES], "field")
    return found


def field(name: str) -> Column:
    return spec(name).build().alias(spec(name).name)


#: Operators by kind of field.
OPERATORS = {
    "number": (">=", "<=", ">", "<", "=", "!="),
    "text": ("=", "!=", "has any", "has all"),
    "enum": ("is", "in", "=", "!="),
    "flag": ("is",),
    "list": ("has any", "has all"),
}


def enum_value(value: str, f: Field) -> str:
    """The value as the enumeration writes it; others are refused with what there is."""
    plain = value.strip().lower().replace("-", "_").replace(" ", "_")
    if f.values and plain not in f.values:
        raise ValueError(f"{f.name} is one of {', '.join(f.values)}; not {value!r}")
    return plain if f.values else value


def _leaf(f: Field, column: Column, op: str, value, record: str | None = None) -> Verdict:
    if op not in OPERATORS[f.kind]:
        raise TypeError(f"{f.name} is a {f.kind}; it takes {', '.join(OPERATORS[f.kind])}")
    if f.kind == "number":
        return verdicts.number(column, op, value, f.label, record, phrasing=f.phrasing, name=f.name)
    if f.kind == "flag":
        return verdicts.flag_is(column, bool(value), f.label, record, name=f.name)
    if f.kind == "list":
        return verdicts.list_has(column, list(value), f.label, every=op == "has all", record=record, name=f.name)
    if f.kind == "text":
        if op in ("=", "!="):
            return verdicts.text_equals(column, value, f.label, negate=op == "!=", record=record, name=f.name)
        return verdicts.text_has(column, list(value), f.label, every=op == "has all", record=record, name=f.name)
    if op == "in":
        return verdicts.enum_in(column, [enum_value(v, f) for v in value], f.label, record, name=f.name)
    return verdicts.enum_is(column, enum_value(value, f), f.label, op=op, record=record, name=f.name)


def condition(name: str, op: str, value) -> Verdict:
    """A condition on a named field, with its sentence; operators that do not fit the kind raise."""
    f = spec(name)
    if f.name == "work_rights" and op in OPERATORS["enum"]:
        wanted = [enum_value(v, f) for v in (value if op == "in" else [value])]
        if UNRESTRICTED in wanted:
            status, free = f.build(), F.col("work_rights.unrestricted")
            if op == "in":
                return verdicts.unrestricted_or_in(status, free, wanted, f.label, name=f.name)
            return verdicts.unrestricted(status, free, op != "!=", f.label, name=f.name)
    return _leaf(f, f.build(), op, value)


# ---------------------------------------------------------------- records


@dataclass(frozen=True)
class Record:
    """A kind of nested record: its column, what it is called and the fields that conditions may read."""

    kind: Kind
    column: str
    fields: dict[str, Field]
    readers: dict[str, Callable[[Column], Column]]

    def field(self, name: str) -> Field:
        """A record's own field goes before a refusal, so a skill's name may be read and a role's start may not."""
        name = name.strip().lower()
        if name not in self.fields:
            _refuse(name)
            raise _unknown(name, list(self.fields), f"field of {self.kind.name}")
        return self.fields[name]


@dataclass(frozen=True)
class RecordCondition:
    """A condition on a record, before it is known which one."""

    on: Callable[[Column], Verdict]
    said: str

    def __and__(self, other: "RecordCondition") -> "RecordCondition":
        return _joined(verdicts.all_of, self, other)

    def __or__(self, other: "RecordCondition") -> "RecordCondition":
        return _joined(verdicts.any_of, self, other)

    def __invert__(self) -> "RecordCondition":
        return RecordCondition(lambda r: ~self.on(r), f"NOT ({self.said})" if " " in self.said.replace(" IS TRUE", "") and (" AND " in self.said or " OR " in self.said) else f"NOT {self.said}")


def _joined(how, one: RecordCondition, two: RecordCondition) -> RecordCondition:
    word, other = (" AND ", " OR ") if how is verdicts.all_of else (" OR ", " AND ")
    said = word.join(f"({c.said})" if other in c.said else c.said for c in (one, two))
    return RecordCondition(lambda r: how(one.on(r), two.on(r)), said)


RECORDS: dict[str, Record] = {}


def register_record(name: str, plural: str, column: str, summary: Callable[[Column], Column], fields: dict[str, tuple], *, values: dict[str, tuple[str, ...]] | None = None, stored: dict[str, str] | None = None) -> None:
    """``fields`` gives kind, label and, for numbers, phrasings; ``stored`` the struct's own names where they differ."""
    specs = {n: Field(n, f[0], f[1], lambda: F.lit(None), tuple(f[2:]) or None, (values or {}).get(n, ())) for n, f in fields.items()}

    def reader(inner: str) -> Callable[[Column], Column]:
        return lambda r: r[inner]

    RECORDS[name] = Record(Kind(name, plural, summary), column, specs, {n: reader((stored or {}).get(n, n)) for n in fields})


def _with_note(text: Column, number: Column, before: str, after: str) -> Column:
    return F.concat(text, F.coalesce(F.concat(F.lit(before), plain_number(number), F.lit(after)), F.lit("")))


register_record("skill", "skills", "skills", lambda s: _with_note(s["name"], s["years"], " (", " years)"), RECORD_FIELDS["skill"], values={"category": SKILL_CATEGORIES, "proficiency": PROFICIENCIES})
register_record(
    "role", "roles", "experience", lambda r: _with_note(F.coalesce(F.nullif(r["title"], F.lit("")), F.lit("untitled role")), r["months"], " (", " months)"), RECORD_FIELDS["role"],
    values={"seniority": SENIORITY, "employment_type": EMPLOYMENT_TYPES},
)
register_record("qualification", "qualifications", "qualifications", lambda q: _with_note(q["title"], q["aqf_level"], " (AQF ", ")"), RECORD_FIELDS["qualification"], stored={"aqf": "aqf_level"})
register_record("project", "projects", "projects", lambda p: p["name"], RECORD_FIELDS["project"])


def record(name: str) -> Record:
    name = name.strip().lower()
    found = RECORDS.get(RECORD_ALIASES.get(name, name))
    if found is None:
        raise _unknown(name, [*RECORDS, *RECORD_ALIASES], "record")
    return found


def where(of: str, name: str, op: str, value) -> RecordCondition:
    """A condition on a field of a record, to be used in any_where, count_where and aggregate_where."""
    kind = record(of)
    f = kind.field(name)
    read = kind.readers[f.name]
    return RecordCondition(lambda r: _leaf(f, read(r), op, value, kind.kind.name), _leaf(f, F.lit(None), op, value, kind.kind.name).said)


def any_where(of: str, test: RecordCondition) -> Verdict:
    """Some record passes."""
    kind = record(of)
    return verdicts.any_record(F.col(kind.column), test.on, kind.kind, test.said)


def count_where(of: str, op: str, target: float, test: RecordCondition | None = None, *, strict: bool = False) -> Verdict:
    kind = record(of)
    return verdicts.count_records(F.col(kind.column), op, target, kind.kind, where=test and test.on, said=test.said if test else "", strict=strict)


def aggregate_where(func: str, of: str, name: str, op: str, target: float, test: RecordCondition | None = None) -> Verdict:
    """SUM, MAX, MIN or AVG of a number of the records that pass."""
    kind = record(of)
    f = kind.field(name)
    if f.kind != "number":
        raise TypeError(f"{f.name} is a {f.kind}; {func} takes a number")
    return verdicts.aggregate_records(
        F.col(kind.column), func, kind.readers[f.name], op, target, kind.kind, where=test and test.on, said=test.said if test else "", name=f.name, label=f.label
    )


def vocabulary(spark: SparkSession) -> DataFrame:
    """The fields themselves as rows."""
    return spark.createDataFrame([(f.name, f.kind, f.label) for f in FIELDS.values()], "name string, kind string, label string")
