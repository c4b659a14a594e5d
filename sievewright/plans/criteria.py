"""Criteria of a ranking: what each is worth, how a profile meets it, and the breakdown of a score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.verdicts import Verdict, plain_number


@dataclass(frozen=True)
class Criterion:
    key: str
    weight: float
    verdict: Verdict | None = None  # of a preference, which decides before any model does


#: The criteria of a plan without preferences, and their weights.
DEFAULTS = (
    Criterion("required_skills", 3.0),
    Criterion("experience_depth", 2.0),
    Criterion("role_relevance", 1.5),
    Criterion("desirable_skills", 1.0),
    Criterion("qualification", 1.0),
)


def criteria_for(preferences: list[Criterion]) -> tuple[Criterion, ...]:
    """The preferences and the relevance of roles; without preferences the defaults."""
    return (*preferences, DEFAULTS[2]) if preferences else DEFAULTS


def _covered(wanted: str, held: Column) -> Column:
    """Whether one of what is held has the wanted name in its own or the other way round; blank names say nothing."""
    low = wanted.strip().lower()
    if not low:
        return F.lit(False)

    def alike(h: Column) -> Column:
        name = F.lower(F.trim(h))
        return (name != "") & (F.contains(name, F.lit(low)) | F.contains(F.lit(low), name))

    return F.coalesce(F.exists(held, alike), F.lit(False))


def skills_score(wanted: list[str], held: Column, kind: str) -> tuple[Column, Column]:
    """The share of wanted skills that are held; a half where none are wanted."""
    if not wanted:
        return F.lit(0.5), F.lit(f"No {kind} skills specified for the role.")
    hits = [_covered(w, held) for w in wanted]
    n = reduce(Column.__add__, [h.cast("int") for h in hits])
    matched = F.array_join(F.array_compact(F.array(*[F.when(h, F.lit(w)) for h, w in zip(hits, wanted)])), ", ")
    missing = F.array_join(F.array_compact(F.array(*[F.when(~h, F.lit(w)) for h, w in zip(hits, wanted)])), ", ")
    evidence = F.concat(F.lit("Holds "), n.cast("string"), F.lit(f"/{len(wanted)} {kind} skills ("), F.when(matched == "", "none").otherwise(matched), F.lit(")."))
    if kind == "required":
        evidence = F.concat(evidence, F.when(missing == "", "").otherwise(F.concat(F.lit(" Missing: "), missing, F.lit("."))))
    return n / F.lit(float(len(wanted))), evidence


def depth(years: Column, target: float) -> tuple[Column, Column]:
    """0.8 for the target and up to 0.2 for years beyond it."""
    score = F.least(F.lit(1.0), years / target) * 0.8 + F.least(F.lit(0.2), F.greatest(F.lit(0.0), (years - target) / 20.0))
    said = F.concat(plain_number(years), F.lit(" years of professional experience."))
    # least and greatest pass over nulls, so years that are not known are asked for first
    return F.when(years.isNotNull(), F.round(F.least(F.lit(1.0), score), 3)).otherwise(0.0), F.coalesce(said, F.lit("Years of professional experience not stated in the resume."))


def qualification(level: Column, target: int) -> tuple[Column, Column]:
    said = F.concat(F.lit("Highest qualification is AQF level "), level.cast("string"), F.lit("."))
    return F.when(level.isNotNull(), F.round(F.least(F.lit(1.0), level / float(target)), 3)).otherwise(0.0), F.coalesce(said, F.lit("No qualification with a recognised AQF equivalent."))


def relevance(title: str, titles: Column) -> tuple[Column, Column]:
    """The share of the role's longer words that past titles hold."""
    words = sorted({w for w in "".join(c if c.isalnum() or c == "_" else " " for c in title.lower()).split() if len(w) > 3})
    history = F.lower(F.array_join(F.coalesce(titles, F.array().cast("array<string>")), " "))
    if not words:
        return F.lit(0.5), F.lit("Insufficient role history to assess relevance.")
    hits = [F.contains(history, F.lit(w)) for w in words]
    n = reduce(Column.__add__, [h.cast("int") for h in hits])
    shown = F.array_join(F.array_compact(F.array(*[F.when(h, F.lit(w)) for h, w in zip(hits, words)])), ", ")
    said = F.concat(F.lit("Role history matches "), n.cast("string"), F.lit(f"/{len(words)} terms in the role title"), F.when(shown == "", ".").otherwise(F.concat(F.lit(" ("), shown, F.lit(")."))))
    none = F.trim(history) == ""
    return F.when(none, 0.5).otherwise(F.round(n / F.lit(float(len(words))), 3)), F.when(none, "Insufficient role history to assess relevance.").otherwise(said)


def breakdown(scored: list[tuple[Criterion, Column | None, Column | None]]) -> Column:
    """array<struct(criterion, score, weight, weighted, evidence)>: a preference that is decided scores 1
    or 0, else what was scored counts, else 0 with that stated."""
    cells = []
    for criterion, score, evidence in scored:
        value = F.coalesce(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) if score is not None else F.lit(0.0)
        said = F.coalesce(evidence, F.lit("No evidence supplied.")) if score is not None else F.lit("Not scored by the model; treated as no evidence.")
        if criterion.verdict is not None:
            v = criterion.verdict
            value = F.when(v.value, 1.0).when(~v.value, 0.0).otherwise(value)
            said = F.when(v.value.isNotNull(), v.reason).otherwise(said)
        weight = F.lit(float(criterion.weight))
        cells.append(F.struct(F.lit(criterion.key).alias("criterion"), value.alias("score"), weight.alias("weight"), (value * weight).alias("weighted"), said.alias("evidence")))
    return F.array(*cells)


def overall(parts: Column) -> Column:
    """The weighted mean of a breakdown, to four places."""
    total = F.aggregate(F.transform(parts, lambda p: p["weighted"]), F.lit(0.0), lambda a, b: a + b)
    weight = F.aggregate(F.transform(parts, lambda p: p["weight"]), F.lit(0.0), lambda a, b: a + b)
    return F.round(F.try_divide(total, weight), 4)


def rationale(parts: Column) -> Column:
    """The strongest and the weakest criterion, the first of equals, with their evidence."""
    numbered = F.transform(parts, lambda p, k: F.struct((-p["score"]).alias("s"), k.alias("k"), p["criterion"].alias("c"), p["evidence"].alias("e")))
    best = F.array_min(numbered)
    worst = F.array_min(F.transform(parts, lambda p, k: F.struct(p["score"].alias("s"), k.alias("k"), p["criterion"].alias("c"), p["evidence"].alias("e"))))
    return F.concat(F.lit("Strongest on "), best["c"], F.lit(": "), best["e"], F.lit(" Weakest on "), worst["c"], F.lit(": "), worst["e"])
