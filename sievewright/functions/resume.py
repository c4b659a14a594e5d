"""Reading resumes by patterns: plain text to the records of a profile, as Columns.

A resume is an array of lines. What opens a section or a role is told line by line, with the lines beside
it at hand; the places of those lines cut the array into slices, so no state is carried from line to line
and nothing grows while a text is read. Everything else is a pattern applied to a line or to the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.verdicts import bound
from .text import EMAIL, odd_letters, qualification_level

# Headings, and patterns of what resumes say.
SECTIONS = {
    "summary": ("summary", "profile", "professional summary", "objective", "about"),
    "experience": ("experience", "employment", "work history", "professional experience", "career"),
    "education": ("education", "qualifications", "academic"),
    "skills": ("skills", "technical skills", "technologies"),
    "languages": ("languages",),
    "affiliations": ("affiliations", "interests", "activities", "memberships", "volunteering"),
    "certifications": ("certifications", "certificates", "licences", "licenses"),
    "projects": ("projects", "personal projects", "open source", "selected projects"),
    "publications": ("publications", "papers", "patents"),
}
#: Each with letters of which some stand, in small letters, wherever the pattern matches.
SENIORITY_PATTERNS = [
    (r"\b(chief|cto|ceo|cfo|coo|vp|vice president|executive)\b", "executive", ("chief", "cto", "ceo", "cfo", "coo", "vp", "vice president", "executive")),
    (r"\bdirector\b", "director", ("director",)),
    (r"\bhead of\b|\bhead\b", "head", ("head",)),
    (r"\bmanager\b|\bmanagement\b", "manager", ("manage",)),
    (r"\bprincipal\b|\bstaff\b|\barchitect\b", "principal", ("principal", "staff", "architect")),
    (r"\blead\b|\bteam lead\b|\btech lead\b", "lead", ("lead",)),
    (r"\bsenior\b|\bsr\.?\b", "senior", ("senior", "sr")),
    (r"\bintern\b|\binternship\b", "intern", ("intern",)),
    (r"\bgraduate\b|\bgrad\b", "graduate", ("grad",)),
    (r"\bjunior\b|\bjr\.?\b|\bassociate\b|\bassistant\b", "junior", ("junior", "jr", "associate", "assistant")),
]
EMPLOYMENT_PATTERNS = [
    (r"\bintern(ship)?\b", "internship", ("intern",)),
    (r"\bcontract(or)?\b|\bfixed[- ]term\b", "contract", ("contract", "fixed")),
    (r"\bcasual\b", "casual", ("casual",)),
    (r"\bfreelanc\w*\b|\bconsultant\b", "freelance", ("freelanc", "consultant")),
    (r"\bvolunteer\w*\b", "volunteer", ("volunteer",)),
]
INDUSTRY_HINTS = {
    "banking": ("bank", "banking", "finance", "fintech", "payments"),
    "health": ("health", "hospital", "clinic", "medical", "pharma"),
    "government": ("government", "department of", "council", "public service"),
    "education": ("university", "school", "education", "tafe"),
    "retail": ("retail", "ecommerce", "e-commerce", "store"),
    "mining": ("mining", "resources", "energy", "oil", "gas"),
    "consulting": ("consulting", "consultancy", "advisory"),
    "software": ("software", "saas", "technologies", "tech", "labs", "digital", "systems"),
    "telecommunications": ("telco", "telecom", "telstra", "optus"),
}
#: These look at the first letter before they ask for the edge of a word, which is dear at every letter of a text.
TEAM_SIZE = r"(?=[tmls])\b(?:team of|managed|managing|led|leading|supervised|mentored)\s+(?:a\s+)?(?:team\s+of\s+)?(\d{1,3})\b"
TEAM_SIZE_HINTS = ("team of", "manag", "led", "leading", "supervised", "mentored")
LICENCE = r"\b(licen[cs]e|registration|registered|ahpra|forklift|white card|working with children)\b"
CLEARANCE = r"\b(baseline|nv1|nv2|positive vetting|negative vetting|security clearance)\b"
NOTICE = r"(?=[\dn])(?=\d|notice)(?:\b(\d{1,2})\s*(weeks?|months?)\s*(?:notice|notice period)\b|\bnotice(?: period)?\s*(?:of|:)?\s*(\d{1,2})\s*(weeks?|months?)\b)"
AWARD = r"\b(bachelor|master|phd|doctor|diploma|certificate|graduate|honours|honors|b\.?s?c|m\.?s?c|b\.?eng|m\.?eng|mba|llb|b\.?tech|m\.?tech|bca|mca)\b"
INSTITUTION = r"(\buniversit\w*|\binstitutes?\b|\bcollege\b|\btafe\b|\bpolytechnic\b|\bacademy\b|\bschool of\b|\bnit\b|\biit\b)"
MOBILE = r"(?=[+064])\b(?:\+?61\s?)?0?4\d{2}[\s-]?\d{3}[\s-]?\d{3}\b"
LINK = r"\b(?:linkedin\.com|github\.com|gitlab\.com)/[\w./-]+"
#: A year with the word before it; a word is tried from its first letter alone, which keeps the search linear.
DATE = r"(?<![A-Za-z])[A-Za-z]*+\s*+\b(?:19|20)\d{2}\b"
CURRENT = r"\b(present|current|now|ongoing)\b"
CURRENT_HINTS = ("present", "current", "now", "ongoing")
CLEARANCE_HINTS = ("baseline", "nv1", "nv2", "vetting", "clearance")
YEAR = r"(?=[12])\b((?:19|20)\d{2})\b"
STATED_YEARS = r"\b(\d{1,2})\+?\s*years?\b"
STATED_EXPERIENCE = r"\b(\d{1,2})\+?\s*years?\s+(?:of\s+)?(?:commercial\s+|professional\s+)?experience"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
STATES = ("QLD", "NSW", "VIC", "SA", "WA", "TAS", "NT", "ACT")
REGIONS = {
    "QLD": "Greater Brisbane / South East Queensland",
    "NSW": "Greater Sydney / New South Wales",
    "VIC": "Greater Melbourne / Victoria",
    "SA": "South Australia",
    "WA": "Western Australia",
    "TAS": "Tasmania",
    "NT": "Northern Territory",
    "ACT": "Australian Capital Territory",
}
AWARD_COUNTRIES = ("india", "china", "nigeria", "kenya", "syria", "usa", "uk")
HOME_MARKS = ("australia", "queensland", "griffith", "swinburne", "monash", "rmit")
GROUP_OF_EIGHT = (
    "university of queensland", "university of melbourne", "university of sydney", "australian national university", "monash university",
    "university of adelaide", "university of western australia", "unsw", "university of new south wales",
)
HOME_UNIVERSITIES = (
    "queensland", "griffith", "swinburne", "rmit", "deakin", "curtin", "macquarie", "la trobe", "wollongong", "newcastle", "flinders", "murdoch",
    "victoria university", "charles sturt", "james cook", "bond university", "australian",
)
PROTECTED_AFFILIATION = (
    r"\b(islamic|muslim|christian|catholic|jewish|hindu|sikh|buddhist|church|mosque|temple|women|men's|lgbt|queer|pride|disab|veteran|indigenous|aborigin"
    r"|torres strait|malayalee|chinese|indian|african|greek|italian|vietnamese|korean|labor|liberal|greens|political|union)\b"
)
PROTECTED_HINTS = tuple(PROTECTED_AFFILIATION.removeprefix(r"\b(").removesuffix(r")\b").split("|"))
PROFESSIONAL_AFFILIATION = r"\b(ieee|acm|acs\b|engineers australia|institute|professional|association of engineers|chartered|society of)\b"
SYNONYMS = {
    "proficiency": {"fluent": "advanced", "native": "expert", "proficient": "advanced", "basic": "beginner", "novice": "beginner", "working": "intermediate", "professional": "advanced", "strong": "advanced", "senior": "expert"},
    "seniority": {"sr": "senior", "jr": "junior", "staff": "principal", "architect": "principal", "vp": "executive", "chief": "executive", "c-level": "executive", "associate": "junior", "entry": "junior", "entry-level": "junior", "trainee": "intern", "apprentice": "intern"},
    "employment_type": {"full-time": "permanent", "full time": "permanent", "part-time": "permanent", "part time": "permanent", "fixed-term": "contract", "contractor": "contract", "consultant": "freelance", "intern": "internship", "temp": "casual", "temporary": "casual"},
    "category": {"programming": "technical", "software": "technical", "framework": "tool", "platform": "tool", "cloud": "tool", "database": "tool", "interpersonal": "soft", "communication": "soft", "spoken": "language", "languages": "language"},
}

_STRINGS = "array<string>"


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(f"(?iU){pattern}"))


def _group(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", group), F.lit(""))


def looked_through(text: Column) -> Column:
    """struct(lowered, odd): what is compared before a pattern is tried. What reads one text in several ways is given it once."""
    return F.struct(F.lower(text).alias("lowered"), odd_letters(text).alias("odd"))


def _may_hold(seen: Column, hints: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(seen["lowered"], F.lit(h)) for h in hints]) | seen["odd"]


def _looked_at(text: Column, body, seen: Column | None = None) -> Column:
    """body(text, seen), which may name both as often as it likes."""
    if seen is not None:
        return body(text, seen)
    return bound(F.struct(text.alias("text"), looked_through(text).alias("seen")), lambda g: body(g["text"], g["seen"]))


def _hinted(text: Column, body, seen: Column | None = None) -> Column:
    """body(text, may_hold), where may_hold(hints) tells by comparing letters alone whether a pattern that needs one of the
    hints can match: a pattern is tried only there. ``body`` may name what it is given as often as it likes."""
    return _looked_at(text, lambda t, s: body(t, lambda hints: _may_hold(s, hints)), seen)


def _held(text: Column, pattern: str, hints: tuple[str, ...], seen: Column | None = None) -> Column:
    """_has, tried where a hint stands."""
    return _hinted(text, lambda t, may_hold: F.when(may_hold(hints), _has(t, pattern)).otherwise(F.when(t.isNotNull(), False)), seen)


_Patterns = list[tuple[str, str, tuple[str, ...]]]


def _ladder(text: Column, patterns: _Patterns, seen: Column | None = None, rungs: Column | None = None) -> Column:
    """What the first pattern that matches stands for. ``rungs``, if given, are those that can match in what the text is part of."""

    def tried(t: Column, may_hold, k: int) -> Column:
        pattern, name, hints = patterns[k]
        here = may_hold(hints) if rungs is None else rungs[f"r{k}"] & may_hold(hints)
        return F.when(here, F.when(_has(t, pattern), F.lit(name)))

    found = _hinted(text, lambda t, may_hold: F.coalesce(*[tried(t, may_hold, k) for k in range(len(patterns))]), seen)
    return found if rungs is None else F.when(rungs["any"], found)


def _rungs(seen: Column, patterns: _Patterns) -> Column:
    """struct(r0, r1, ..., any): which of the patterns can match in a text."""
    each = [_may_hold(seen, hints) for _, _, hints in patterns]
    return F.struct(*[x.alias(f"r{k}") for k, x in enumerate(each)], reduce(Column.__or__, each).alias("any"))


def _filled(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull() & (x != ""))


def _some_text(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _stripped(text: Column, marks: str = r"\s.\-•") -> Column:
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(text), F.lit(w)) for w in words])


# ---------------------------------------------------------------- sections


def _upper_or_title(text: Column) -> Column:
    upper = (text == F.upper(text)) & (text != F.lower(text))
    title = ~F.rlike(text, F.lit(r"(?<!\p{L})\p{Ll}")) & ~F.rlike(text, F.lit(r"\p{L}\p{Lu}")) & F.rlike(text, F.lit(r"\p{Lu}"))
    return upper | title


def _headings() -> dict[str, str]:
    """What may stand on a line that opens a section, in capitals or with a capital at each word, by section."""
    return {w: section for section, aliases in SECTIONS.items() for alias in aliases for w in (alias.upper(), alias.title())}


def heading(line: Column) -> Column:
    """The section that a line opens, or null."""
    names = _headings()
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    longest = max(map(len, names))

    def named(x: Column) -> Column:
        return F.when(x.isin(*names), F.try_element_at(known, x))

    def bare(x: Column) -> Column:
        # nothing is taken off a longer line that has no colon at its end, and none is a heading
        return F.when(F.endswith(x, F.lit(":")), bound(F.trim(F.rtrim(x, F.lit(":"))), named)).when(F.octet_length(x) <= longest, named(x))

    return bound(F.trim(line), bare)


def _cut_at(items: Column, places: Column) -> Column:
    """The items behind each of the places, up to the next; places count from 1."""

    def parts(x: Column) -> Column:
        end = F.size(x["items"]) + 1
        return F.transform(x["at"], lambda a, k: F.slice(x["items"], a + 1, F.coalesce(F.get(x["at"], k + 1), end) - a - 1))

    return bound(F.struct(items.alias("items"), places.alias("at")), parts)


def _places(flags: Column) -> Column:
    """The places, from 1, of what is true."""
    return F.filter(F.transform(flags, lambda x, k: F.when(x, k + 1)), lambda k: k.isNotNull())


def sections(text: Column) -> Column:
    """map<section, lines>: the lines before the first heading are the header; blank lines go."""

    def by_section(d: Column) -> Column:
        opens = F.concat(F.array(F.lit("header")), F.filter(d["opens"], lambda x: x.isNotNull()))
        # a line in front stands for the heading of the header
        lines = F.concat(F.array(F.lit("")), d["lines"])
        bodies = _cut_at(lines, F.concat(F.array(F.lit(1)), F.transform(_places(F.transform(d["opens"], lambda x: x.isNotNull())), lambda k: k + 1)))
        placed = F.zip_with(opens, bodies, lambda name, body: F.struct(name.alias("section"), F.filter(body, lambda x: F.trim(x) != "").alias("lines")))

        def lines_of(p: Column, name: str) -> Column:
            return F.flatten(F.transform(F.filter(p, lambda x: x["section"] == name), lambda x: x["lines"]))

        names = ("header", *SECTIONS)
        return bound(placed, lambda p: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[lines_of(p, n) for n in names])))

    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.rtrim(x))
    return bound(lines, lambda x: bound(F.struct(x.alias("lines"), F.transform(x, heading).alias("opens")), by_section))


# ---------------------------------------------------------------- identity


def _has_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & _has(text, EMAIL)


def identity(text: Column, header: Column) -> Column:
    """struct(full_name, email, phone, suburb, state, country, links)."""

    def names(line: Column) -> Column:
        words = F.size(F.split(F.trim(line), r"\s+"))
        return ~_has_email(line) & ~F.contains(line, F.lit("|")) & words.between(2, 5) & _upper_or_title(F.trim(line))

    name = F.trim(F.get(F.filter(F.slice(header, 1, 4), names), F.lit(0)))
    full_name = bound(name, lambda n: F.when(n == F.upper(n), F.initcap(n)).otherwise(n))
    states = "|".join(STATES)
    place = F.get(F.filter(F.slice(header, 1, 6), lambda x: F.rlike(x, F.lit(rf"\b({states})\b"))), F.lit(0))

    def placed(p: Column) -> Column:
        state = F.coalesce(*[F.when(F.rlike(p, F.lit(rf"\b{s}\b")), F.lit(s)) for s in STATES])
        return bound(F.struct(F.transform(F.split(p, r"[|,]"), lambda x: F.trim(x)).alias("parts"), state.alias("state")), with_suburb)

    def with_suburb(d: Column) -> Column:
        at = F.array_position(d["parts"], d["state"])
        return F.struct(F.when(at > 1, F.get(d["parts"], (at - 2).cast("int"))).alias("suburb"), d["state"].alias("state"))

    # looked for once, as each is named several times
    where = bound(place, placed)
    return bound(where, lambda w: F.struct(
        full_name.alias("full_name"), F.when(F.contains(text, F.lit("@")), _group(text, EMAIL)).alias("email"), _group(text, MOBILE).alias("phone"),
        w["suburb"].alias("suburb"), w["state"].alias("state"), F.when(w["state"].isNotNull(), F.lit("Australia")).alias("country"),
        F.when(F.contains(text, F.lit(".com/")), F.regexp_extract_all(text, F.lit(f"({LINK})"), 1)).when(text.isNotNull(), F.array().cast(_STRINGS)).alias("links"),
    ))


# ---------------------------------------------------------------- skills, dates, roles


def _distinct(items: Column) -> Column:
    """The first of items that differ in case alone."""
    return F.filter(items, lambda x, k: F.array_position(F.transform(items, F.lower), F.lower(x)) == k + 1)


def skills(lines: Column) -> Column:
    """Records of the names that a skills section lists."""
    names = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"[,;/]|\s{2,}"), lambda x: _stripped(x))))
    good = F.filter(names, lambda n: F.length(n).between(2, 40) & ~F.lower(n).isin("and", "etc"))
    return bound(good, lambda g: F.transform(_distinct(g), lambda n: F.struct(
        n.alias("name"), F.lit("technical").alias("category"), F.lit(None).cast("double").alias("years"), F.lit(None).cast("string").alias("proficiency"), F.lit("skills section").alias("evidence"),
    )))


def date_range(text: Column, seen: Column | None = None) -> Column:
    """struct(start, end, is_current, months) of 'Mar 2022 - Present' or '2017 - 2021'; the months of a current role are not told."""

    def dated(x: Column) -> Column:
        # nine letters of a word at most, and three at least
        word = bound(F.regexp_extract(x, "^[A-Za-z]*", 0), lambda w: F.when(F.length(w) > 2, F.substring(w, F.greatest(F.length(w) - 8, F.lit(1)), F.lit(3))))
        at = F.instr(F.lit(" ".join(MONTHS)), F.lower(word))
        return F.struct(F.substring(x, F.length(x) - 3, F.lit(4)).alias("year"), F.when(at > 0, F.floor((at + 3) / 4).cast("int")).alias("month"))

    def ranged(d: Column) -> Column:
        first, last = F.get(d["dates"], F.lit(0)), F.get(d["dates"], F.size(d["dates"]) - 1)
        ended = ~d["now"] & (F.size(d["dates"]) > 1)

        def said(x: Column) -> Column:
            return F.concat(x["year"], F.coalesce(F.concat(F.lit("-"), F.lpad(x["month"].cast("string"), 2, "0")), F.lit("")))

        def place(x: Column) -> Column:
            return x["year"].cast("int") * 12 + F.coalesce(x["month"], F.lit(1))

        return F.struct(
            said(first).alias("start"), F.when(ended, said(last)).alias("end"), d["now"].alias("is_current"),
            F.when(ended, F.greatest(F.lit(0), place(last) - place(first)).cast("double")).alias("months"),
        )

    text = F.coalesce(text, F.lit(""))
    dates = F.transform(F.regexp_extract_all(text, F.lit(DATE), 0), dated)
    return bound(F.struct(dates.alias("dates"), _held(text, CURRENT, CURRENT_HINTS, seen).alias("now")), ranged)


def seniority_of(title: Column, seen: Column | None = None, rungs: Column | None = None) -> Column:
    return _ladder(title, SENIORITY_PATTERNS, seen, rungs)


def employment_type_of(text: Column, seen: Column | None = None, rungs: Column | None = None) -> Column:
    return _ladder(text, EMPLOYMENT_PATTERNS, seen, rungs)


def industry_of(employer: Column, summary: Column) -> Column:
    def named(both: Column) -> Column:
        return F.coalesce(*[F.when(reduce(Column.__or__, [F.contains(both, F.lit(w)) for w in hints]), F.lit(name)) for name, hints in INDUSTRY_HINTS.items()])

    return bound(F.lower(F.concat_ws(" ", employer, summary)), named)


def team_size_of(text: Column, seen: Column | None = None) -> Column:
    def most(t: Column, may_hold) -> Column:
        return F.when(may_hold(TEAM_SIZE_HINTS), F.array_max(F.transform(F.regexp_extract_all(t, F.lit(f"(?iU){TEAM_SIZE}"), 1), lambda n: n.cast("int"))))

    return _hinted(text, most, seen)


def _dated(line: Column, seen: Column) -> Column:
    return F.coalesce(F.rlike(line, F.lit(YEAR)) | _held(line, CURRENT, CURRENT_HINTS, seen), F.lit(False))


def experience(lines: Column) -> Column:
    """Roles: a line that is parted by a dash or a bar and carries dates, or whose next line does, opens
    one; bulleted lines are its summary. A line whose dates went to the role above it opens none.

    The letters of a section are looked through once, and those of a line once: what no line holds is tried on none."""

    def seen(lowered: Column, odd: Column) -> Column:
        return F.struct(lowered.alias("lowered"), odd.alias("odd"))

    def looked_at(x: Column, odd: Column) -> Column:
        return bound(F.lower(x), lambda low: told_of(x, low, odd))

    def told_of(x: Column, low: Column, odd: Column) -> Column:
        parted = F.contains(x, F.lit("—")) | F.contains(x, F.lit(" - ")) | F.contains(x, F.lit("|"))
        return F.struct(x.alias("line"), low.alias("low"), F.rlike(x, F.lit(r"^\s*[-•*]")).alias("bullet"), _dated(x, seen(low, odd)).alias("dated"), parted.alias("parted"))

    def with_next(flat: Column) -> Column:
        def told(x: Column, y: Column) -> Column:
            may_open = ~x["bullet"] & x["parted"] & (x["dated"] | F.coalesce(y["dated"], F.lit(False)))
            return F.struct(x["line"].alias("line"), x["low"].alias("low"), x["bullet"].alias("bullet"), x["dated"].alias("dated"), y["line"].alias("next"), y["low"].alias("next_low"), may_open.alias("opens"))

        return F.transform(flat, lambda x, k: told(x, F.get(flat, k + 1)))

    def without_taken(told: Column) -> Column:
        """The line below an undated opening is its dates and nothing else."""

        def free(x: Column, a: Column) -> Column:
            taken = F.coalesce(a["opens"] & ~a["dated"], F.lit(False))
            dates, low = F.when(x["dated"], x["line"]).otherwise(x["next"]), F.when(x["dated"], x["low"]).otherwise(x["next_low"])
            return F.struct(x["line"].alias("line"), x["low"].alias("low"), dates.alias("dates"), low.alias("dates_low"), (x["opens"] & ~taken).alias("opens"), (x["bullet"] & ~taken).alias("bullet"))

        return F.transform(told, lambda x, k: free(x, F.get(told, k - 1)))

    def cut(told: Column) -> Column:
        heads = F.filter(told, lambda x: x["opens"])
        bodies = _cut_at(told, _places(F.transform(told, lambda x: x["opens"])))

        def joined(head: Column, body: Column) -> Column:
            said = F.transform(F.filter(body, lambda x: x["bullet"]), lambda x: F.regexp_replace(F.regexp_replace(x["line"], r"^[-•* ]+", ""), r"^\s+|\s+$", ""))
            return F.struct(head["line"].alias("line"), head["low"].alias("low"), head["dates"].alias("dates"), head["dates_low"].alias("dates_low"), F.when(F.size(said) > 0, F.substring(F.array_join(said, "; "), 1, 400)).alias("summary"))

        return F.zip_with(heads, bodies, joined)

    def role(r: Column, known: Column) -> Column:
        mark = F.when(F.contains(r["line"], F.lit("—")), F.lit("—")).when(F.contains(r["line"], F.lit("|")), F.lit("|")).otherwise(F.lit(" - "))
        head = F.substring(r["line"], F.lit(1), F.instr(r["line"], mark) - 1)
        tail = F.substring(r["line"], F.instr(r["line"], mark) + F.length(mark), F.length(r["line"]))
        title, employer = _some_text(F.trim(head)), _some_text(F.trim(F.get(F.split(tail, r"[|,]"), F.lit(0))))

        def made(d: Column) -> Column:
            odd = known["odd"]
            line, title_seen, summary_seen = seen(r["low"], odd), seen(F.lower(d["title"]), odd), seen(d["summary_low"], odd)
            return F.struct(
                d["title"].alias("title"), d["employer"].alias("employer"), d["dates"]["start"].alias("start"), d["dates"]["end"].alias("end"), d["dates"]["is_current"].alias("is_current"),
                d["dates"]["months"].alias("months"), r["summary"].alias("summary"), bound(title_seen, lambda t: seniority_of(d["title"], t, known["seniority"])).alias("seniority"),
                industry_of(d["employer"], r["summary"]).alias("industry"),
                F.coalesce(employment_type_of(r["line"], line, known["employment"]), employment_type_of(r["summary"], summary_seen, known["employment"])).alias("employment_type"),
                team_size_of(r["summary"], summary_seen).alias("team_size"),
                F.array().cast(_STRINGS).alias("technologies"),
            )

        return bound(F.struct(title.alias("title"), employer.alias("employer"), date_range(r["dates"], seen(r["dates_low"], known["odd"])).alias("dates"), F.lower(r["summary"]).alias("summary_low")), made)

    def read(d: Column) -> Column:
        roles = bound(F.transform(d["lines"], lambda x: looked_at(x, d["seen"]["odd"])), lambda flat: bound(with_next(flat), lambda told: bound(without_taken(told), cut)))
        known = F.struct(d["seen"]["odd"].alias("odd"), _rungs(d["seen"], SENIORITY_PATTERNS).alias("seniority"), _rungs(d["seen"], EMPLOYMENT_PATTERNS).alias("employment"))
        return bound(known, lambda k: F.transform(roles, lambda r: role(r, k)))

    return bound(lines, lambda x: bound(F.array_join(x, "\n"), lambda t: bound(F.struct(x.alias("lines"), looked_through(t).alias("seen")), read)))


def projects(lines: Column) -> Column:
    """Ten records at most of name, summary, technologies and months."""

    def made(text: Column) -> Column:
        mark = F.when(F.contains(text, F.lit(" - ")), F.lit(" - ")).otherwise(F.lit(": "))
        at = F.instr(text, mark)
        name = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
        rest = F.when(at > 0, F.trim(F.substring(text, at + F.length(mark), F.length(text)))).otherwise(F.lit(""))
        tools = F.slice(F.filter(F.transform(F.split(rest, "[,/]"), lambda x: F.trim(x)), lambda t: F.length(t).between(2, 30)), 1, 8)
        return F.struct(
            F.substring(F.trim(name), 1, 80).alias("name"), _some_text(F.substring(rest, 1, 200)).alias("summary"), tools.alias("technologies"), F.lit(None).cast("double").alias("months")
        )

    texts = F.filter(F.transform(lines, lambda x: _stripped(x, r"\s.\-•*")), lambda t: F.length(t) >= 4)
    return F.slice(F.transform(texts, made), 1, 10)


# ---------------------------------------------------------------- awards


def qualifications(lines: Column) -> Column:
    """Awards with institution (on the line or the next), year, country and level."""
    following = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string")))
    listed = F.zip_with(F.transform(lines, lambda x: _stripped(x)), following, lambda x, y: F.struct(
        x.alias("text"), F.when(_has(F.coalesce(y, F.lit("")), INSTITUTION), F.concat(x, F.lit(", "), F.trim(y))).otherwise(x).alias("context"),
    ))

    def made(x: Column) -> Column:
        parts = _filled(F.transform(F.split(x["context"], r"[,|]"), lambda x: F.trim(x)))
        years = F.regexp_extract_all(x["context"], F.lit(YEAR), 1)

        def award(p: Column) -> Column:
            title = F.coalesce(F.get(p["parts"], F.lit(0)), x["text"])
            place = F.get(F.filter(p["parts"], lambda q: _has(q, INSTITUTION)), F.lit(0))
            abroad = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(p["parts"], lambda q: F.lower(q).isin(*AWARD_COUNTRIES))), -1)
            home = F.when(place.isNotNull() & ~F.contains(F.lower(x["context"]), F.lit("australia")) & _contains_any(place, HOME_MARKS), F.lit("Australia"))
            return bound(bound(title, qualification_level), lambda level: F.struct(
                title.alias("title"), place.alias("institution"), F.lit(None).cast("string").alias("field_of_study"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), years), -1).cast("int").alias("completion_year"),
                F.coalesce(abroad, home).alias("country"), level["level"].alias("aqf_level"), level_label(level["level"]).alias("aqf_label"), level["confidence"].alias("aqf_confidence"),
            ))

        return bound(F.struct(parts.alias("parts")), award)

    return F.transform(F.filter(listed, lambda x: _has(x["text"], AWARD)), made)


#: Names of the levels.
LEVEL_LABELS = (
    "Certificate I", "Certificate II", "Certificate III", "Certificate IV", "Diploma", "Advanced Diploma / Associate Degree", "Bachelor Degree",
    "Bachelor Honours Degree / Graduate Certificate / Graduate Diploma", "Masters Degree", "Doctoral Degree",
)


def level_label(level: Column) -> Column:
    return F.get(F.array(*map(F.lit, LEVEL_LABELS)), level - 1)


def universities(lines: Column) -> Column:
    """The distinct parts of education lines that name an institution."""
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(_stripped(x), r"[,|]"), lambda x: F.trim(x))))
    return F.array_distinct(F.filter(parts, lambda p: _has(p, INSTITUTION)))


def institution_tier(name: Column) -> Column:
    return (
        F.when(_contains_any(name, GROUP_OF_EIGHT), "Australian university (Group of Eight)")
        .when(_contains_any(name, ("tafe", "polytechnic")), "Australian TAFE / VET provider")
        .when(_contains_any(name, HOME_UNIVERSITIES), "Australian university")
        .otherwise("Overseas university")
    )


def region_of(state: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair]), state), state)


def protected(text: Column) -> Column:
    """Whether a text names what reveals a protected attribute."""
    return _held(text, PROTECTED_AFFILIATION, PROTECTED_HINTS)


def affiliation_kind(text: Column) -> Column:
    return F.when(protected(text), "protected").when(_has(text, PROFESSIONAL_AFFILIATION), "professional").otherwise("other")


# ---------------------------------------------------------------- the rest


def _sentence_with(text: Column, seen: Column, word: str) -> Column:
    """The first sentence that holds a word of small ASCII letters, in any case; lines end sentences too."""
    at = F.instr(seen["lowered"], F.lit(word))
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at, F.length(text))
    plain = F.concat(F.substring_index(F.substring_index(before, "\n", -1), ".", -1), F.substring_index(F.substring_index(after, "\n", 1), ".", 1))
    # with odd letters the places of letters may differ once they are small; a sentence is tried from its start alone
    return F.when(seen["odd"], _group(text, rf"(?:^|[.\n])([^.\n]*{word}[^.\n]*)", 1)).otherwise(F.when(at > 0, plain))


def _said(text: Column, seen: Column, pattern: str) -> Column:
    """_has, by comparing letters alone where a pattern is words of small ASCII letters and the text has no odd ones."""
    if not all(c in "abcdefghijklmnopqrstuvwxyz |" for c in pattern):
        return _has(text, pattern)
    return F.when(seen["odd"], _has(text, pattern)).otherwise(reduce(Column.__or__, [F.contains(seen["lowered"], F.lit(w)) for w in pattern.split("|")]))


def work_rights(text: Column, seen: Column | None = None) -> Column:
    """struct(status, visa_subclass, unrestricted, evidence); evidence is the sentence that says so."""
    unknown = F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("visa_subclass"), F.lit(None).cast("boolean").alias("unrestricted"), F.lit(None).cast("string").alias("evidence"))

    def told(body: Column, seen: Column) -> Column:
        subclass = F.when(_may_hold(seen, ("subclass",)), _group(body, r"subclass\s*(\d{3})", 1))
        ladder = [
            ("australian citizen|citizen of australia|citizenship", ("citizen",), "citizen", True, False, "citizen"),
            (r"permanent resident|\bpr\b holder", ("permanent resident", "pr holder"), "permanent_resident", True, False, "permanent resident"),
            ("sponsorship", ("sponsorship",), "requires_sponsorship", False, True, "sponsor"),
            ("full work rights|unrestricted work rights|bridging visa", ("work rights", "bridging visa"), "visa_unrestricted", True, True, "work rights"),
            (None, ("subclass",), "visa_restricted", False, True, "subclass"),
        ]
        out = None
        for pattern, hints, status, free, with_visa, word in ladder:
            visa = subclass if with_visa else F.lit(None).cast("string")
            evidence = F.trim(_sentence_with(body, seen, word))
            made = F.struct(F.lit(status).alias("status"), visa.alias("visa_subclass"), F.lit(free).alias("unrestricted"), evidence.alias("evidence"))
            test = F.when(_may_hold(seen, hints), _said(body, seen, pattern) if pattern else subclass.isNotNull())
            out = F.when(test, made) if out is None else out.when(test, made)
        return out.otherwise(unknown)

    return _looked_at(text, told, seen)


def years_of_experience(text: Column, summary: Column, roles: Column, seen: Column | None = None) -> Column:
    """What the summary states, what the text states, the roles' months if all are told, or the span of years."""
    known = F.filter(F.transform(roles, lambda r: r["months"]), lambda m: m.isNotNull() & (m != 0))
    total = F.round(F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / 12, 1)
    years = F.transform(F.regexp_extract_all(text, F.lit(YEAR), 1), lambda y: y.cast("int"))
    span = bound(years, lambda y: F.when(F.size(y) >= 2, (F.array_max(y) - F.array_min(y)).cast("double")))
    return F.coalesce(
        _group(summary, STATED_YEARS, 1).cast("double"), _hinted(text, lambda t, may_hold: F.when(may_hold(("year",)), _group(t, STATED_EXPERIENCE, 1)), seen).cast("double"), F.when((F.size(known) > 0) & (F.size(known) == F.size(roles)), total), span
    )


def notice_weeks(text: Column, seen: Column | None = None) -> Column:
    said = _hinted(text, lambda t, may_hold: F.when(may_hold(("notice",)), _group(t, NOTICE)), seen)

    def weeks(x: Column) -> Column:
        amount = F.coalesce(_group(x, NOTICE, 1), _group(x, NOTICE, 3)).cast("double")
        unit = F.lower(F.coalesce(_group(x, NOTICE, 2), _group(x, NOTICE, 4)))
        return F.when(F.startswith(unit, F.lit("month")), amount * 4).otherwise(amount)

    return bound(said, weeks)


def clearance(text: Column, seen: Column | None = None) -> Column:
    return F.initcap(_hinted(text, lambda t, may_hold: F.when(may_hold(CLEARANCE_HINTS), _group(t, CLEARANCE, 1)), seen))


def listed(lines: Column, marks: str = "[,;]") -> Column:
    return _filled(F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, marks), lambda x: _stripped(x)))))


def coerced(value: Column, kind: str, allowed: tuple[str, ...], fallback: str | None = None) -> Column:
    """The value as the enumeration writes it, by its synonyms if need be, else the fallback."""
    low = F.lower(F.trim(value))
    snake, kebab = F.regexp_replace(low, r"[\s\-]+", "_"), F.regexp_replace(low, r"[\s_]+", "-")
    names = SYNONYMS.get(kind, {})
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    found = F.coalesce(F.when(snake.isin(*allowed), snake), F.when(low.isin(*allowed), low), *[F.try_element_at(known, x) for x in (low, kebab, snake)])
    return F.when(value.isNull(), F.lit(fallback if fallback == "unknown" else None)).otherwise(F.coalesce(found, F.lit(fallback)))


def coercion_note(value: Column, kind: str, allowed: tuple[str, ...], where: str, fallback: str | None = None) -> Column:
    """Null, or what was not recognised and what stands for it."""
    lost = value.isNotNull() & coerced(value, kind, allowed).isNull()
    shown = "None" if fallback is None else f"'{fallback}'"
    return F.when(lost, F.concat(F.lit(f"{where}: {kind} '"), F.trim(value), F.lit(f"' is not a recognised value; recorded as {shown}.")))


def recovered_json(answer: Column) -> Column:
    """The object in an answer that may think aloud, fence it or talk around it; null if there is none."""
    plain = F.regexp_replace(answer, r"(?is)<think>.*?</think>", "")
    fenced = F.nullif(F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), F.lit(""))
    tries = [_stripped(x, r"\s") for x in (plain, fenced, braces)]
    return F.coalesce(*[F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), t) for t in tries])


def rendered(name: Column, jobs: Column, *, institution: Column | None = None, suburb: Column | None = None, qualification: str = "Bachelor of Science") -> Column:
    """A plain-text resume of jobs, an array of struct(job_order, job_title, duration_str, tasks)."""
    handle = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z]+", "."), r"^\.+|\.+$", "")
    contact = F.concat(handle, F.lit("@email.com | 0400 000 000"))
    if suburb is not None:
        contact = F.concat(contact, F.coalesce(F.concat(F.lit(" | "), suburb, F.lit(", QLD")), F.lit("")))

    def job(j: Column) -> Column:
        title = F.coalesce(F.nullif(j["job_title"], F.lit("")), F.lit("Role"))
        first = F.concat(title, F.coalesce(F.concat(F.lit(" — "), F.nullif(j["duration_str"], F.lit(""))), F.lit("")))
        return F.concat(F.array(first), F.transform(_filled(F.slice(j["tasks"], 1, 5)), lambda t: F.concat(F.lit("- "), t)), F.array(F.lit("")))

    parts = [F.array(F.upper(name), contact, F.lit(""), F.lit("EXPERIENCE")), F.flatten(F.transform(F.array_sort(jobs), job))]
    if institution is not None:
        empty = F.array().cast(_STRINGS)
        parts.append(F.when(institution.isNotNull(), F.array(F.lit("EDUCATION"), F.lit(qualification), institution, F.lit(""))).otherwise(empty))
    return F.regexp_replace(F.array_join(F.concat(*parts), "\n"), r"^\s+|\s+$", "")
