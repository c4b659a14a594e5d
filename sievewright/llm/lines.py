"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling.

Texts are sequences of line ids. A suffix's rank at depth k is the place at which suffixes with its
first k lines stand among all; ranks at depth 2k come from the pair of a suffix's rank and that of the
suffix k lines on. Suffixes with equal ranks at depth k are an interval whose longest common prefix has
k lines or more: a run that occurs more than once. Only suffixes in such intervals go on, and doubling
ends when no interval is left. Of each interval the first occurrence, by document id and place, stays.

A suffix is followed to the deepest interval in which it is not the first occurrence. The longest run
that it shares with an earlier place then has between k and 2k lines, and its last k lines are such a
suffix too, so the runs of k lines from these places cover together all later copies of maximal runs,
however long; where they touch they are made one, and the lines of later copies go.

A run counts if it has ``min_lines`` lines, or if it has ``min_words`` words (parted by white space),
be it on one line. Blank and trivially short lines are thus removed with a run that counts, never
alone; without ``min_words`` only lines are counted. Runs of fewer than ``min_lines`` lines are told
apart by their exact number of lines.

DataFrame operations only. Lines are counted by partial aggregation and met again by joins that AQE
can split, ranks are formed within ranges, so a line that fills the corpus is in no single task, and
texts are read and cut in time linear in their lines.

Defined results: a null text has no lines and stays null; lines are parted by ``\\n`` and an empty line
is a line; overlapping runs are removed together; rows that agree in id and text are one document;
equal texts under different ids are copies; extra columns are carried through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh
from .mix import WORD

MIN_LINES = 3
MIN_WORDS = 5
MAX_BROADCAST_SPANS = 500_000
RANGES = 10  # ranks of a hot interval's followers are formed in 2**RANGES ranges


def _first_ranks(classes: DataFrame) -> DataFrame:
    """(a, b, r) from classes(a, b, n): r is the number of lines before the class in the order of ids.

    Bins of the leading 16 bits are summed up, 65,536 rows at most, and classes are ranked within
    their bin.
    """
    binned = classes.withColumn("bin", F.shiftright("a", 48))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("bin").agg(F.sum("n").alias("s")).select("bin", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bin").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(F.broadcast(bins), "bin").select("a", "b", (F.col("offset") + F.col("inner")).alias("r"))


def _next_ranks(classes: DataFrame, shift: int) -> DataFrame:
    """classes(r, r2, n, ...) with new, the rank within the interval of r in the order of r2.

    Followers of one interval are summed up by range of r2 and ranked within their range.
    """
    binned = classes.withColumn("bin", F.shiftright("r2", shift))
    before = Window.partitionBy("r").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("r", "bin").agg(F.sum("n").alias("s")).select("r", "bin", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("r", "bin").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return ranked.join(bins, ["r", "bin"]).withColumn("new", F.col("r") + F.col("offset") + F.col("inner")).drop("bin", "offset", "inner")


def _rank_ahead(lines: int) -> Column:
    """The rank so many lines on, null where that suffix is in no interval."""
    return F.first("r").over(Window.partitionBy("d").orderBy("line").rangeBetween(lines, lines))


def _lines_needed(said: Column, min_lines: int, min_words: int) -> Column:
    """For each of the lines the least number of lines that a run from there must have to count."""
    words = F.transform(said, lambda line: F.regexp_count(line, F.lit(WORD)))
    sums = [words]
    for n in range(2, min_lines):
        sums.append(F.zip_with(sums[-1], F.slice(words, n, F.size(said)), lambda x, y: x + F.coalesce(y, F.lit(0))))
    needed = F.transform(said, lambda _: F.lit(min_lines))
    for n in range(min_lines - 1, 0, -1):
        needed = F.zip_with(sums[n - 1], needed, lambda w, more: F.when(w >= min_words, n).otherwise(more))
    return needed


def _place() -> Column:
    return F.struct("d", "line")


def _span(n: int) -> tuple[Column, Column, Column]:
    return F.col("d"), F.col("line").alias("a"), (F.col("line") + n).alias("b")


def _runs_of(suffixes: DataFrame, depth: int, n: int) -> DataFrame:
    """(d, a, b): the later copies of runs of exactly n lines, depth < n < 2 depth, that count by their words."""
    pairs = suffixes.withColumn("r2", _rank_ahead(n - depth)).where((F.col("need") <= n) & F.col("r2").isNotNull())
    intervals = pairs.groupBy("r", "r2").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    return pairs.join(intervals.select("r", "r2", "first"), ["r", "r2"]).where(_place() > F.col("first")).select(*_span(n))


def _merged(spans: DataFrame) -> DataFrame:
    """(d, removed) from spans(d, a, b): by document the spans in order, those that touch made one."""
    order = Window.partitionBy("d").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("opens", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    runs = numbered.groupBy("d", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("removed"))


def repeated_lines(docs: DataFrame, scratch: Scratch, *, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS) -> DataFrame:
    """(d, removed) for docs(d, text): the spans (a, b) of line numbers, from 0, that stand in a later
    copy of a run of at least ``min_lines`` lines or ``min_words`` words."""
    said = F.split("text", "\n")
    need = F.transform(said, lambda _: F.lit(min_lines)) if min_words is None else _lines_needed(said, min_lines, min_words)
    both = F.zip_with(said, need, lambda x, y: F.struct(x.alias("said"), y.alias("need")))
    lines = docs.where("text is not null").select("d", F.posexplode(both).alias("line", "at"))
    lines = scratch.save(lines.select("d", "line", F.xxhash64("at.said").alias("a"), F.xxhash64("at.said", F.lit(1)).alias("b"), "at.need"), "lines")
    shift = max(0, lines.count().bit_length() - RANGES)
    classes = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(_place()).alias("first")).where("n > 1")
    first = classes.select("a", "b", "first").join(_first_ranks(classes.drop("first")), ["a", "b"])
    suffixes = lines.join(first, ["a", "b"]).select("d", "line", "r", (_place() > F.col("first")).alias("later"), "need")
    suffixes = scratch.save(suffixes, "depth-1")
    depth, gone = 1, []
    while not suffixes.isEmpty():
        pairs = scratch.save(suffixes.withColumn("r2", _rank_ahead(depth)), f"pairs-{depth}")
        followed = pairs.where("r2 is not null").groupBy("r", "r2").agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
        followed = _next_ranks(followed.where("n > 1"), shift).select("r", "r2", "new", "first")
        step = pairs.join(followed, ["r", "r2"], "left").select(
            "d", "line", "later", "need", F.col("new").alias("r"), F.coalesce(_place() > F.col("first"), F.lit(False)).alias("deeper")
        )
        step = scratch.save(step, f"step-{depth}")
        counts = F.lit(True) if depth >= min_lines else F.col("need") <= depth
        gone.append(step.where(F.col("later") & ~F.col("deeper") & counts).select(*_span(depth)))
        for n in range(depth + 1, min(2 * depth, min_lines + 1)):
            gone.append(scratch.save(_runs_of(suffixes, depth, n), f"runs-{n}"))
        scratch.drop(f"pairs-{depth}")
        suffixes, depth = step.where("r is not null").select("d", "line", "r", F.col("deeper").alias("later"), "need"), 2 * depth
    if not gone:
        gone = [suffixes.select(*_span(1))]
    out = scratch.save(_merged(reduce(DataFrame.unionByName, gone)), "removed")
    scratch.drop("lines", "depth-1", *(f"step-{1 << k}" for k in range(depth.bit_length())), *(f"runs-{n}" for n in range(2, min_lines + 1)))
    return out


def _stays(removed: Column, n_lines: Column) -> Column:
    """For each line whether it stays, from the spans that go, as an array."""
    ends = F.concat(F.array(F.lit(0)), F.transform(removed, lambda s: s.b))
    starts = F.concat(F.transform(removed, lambda s: s.a), F.array(n_lines))
    kept = F.zip_with(ends, starts, lambda a, b: F.array_repeat(F.lit(True), b - a))
    cut = F.concat(F.transform(removed, lambda s: F.array_repeat(F.lit(False), s.b - s.a)), F.array(F.array().cast("array<boolean>")))
    return F.flatten(F.zip_with(kept, cut, lambda x, y: F.concat(x, y)))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with the lines of later copies cut out of the text; with ``report`` also n_lines,
    n_removed and n_runs (maximal removed runs)."""
    scratch = Scratch(docs.sparkSession, "lines")
    key, of, gone, kept = fresh(docs, "ld_key", "ld_of", "ld_removed", "ld_kept")
    document = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    removed = repeated_lines(docs.select(document.alias("d"), F.col(text).alias("text")), scratch, min_lines=min_lines, min_words=min_words)
    few = (removed.agg(F.sum(F.size("removed"))).first()[0] or 0) <= MAX_BROADCAST_SPANS
    removed = removed.select(F.col("d").alias(of), F.col("removed").alias(gone))
    joined = docs.withColumn(key, document).join(F.broadcast(removed) if few else removed, F.col(key) == F.col(of), "left")
    parts = F.split(text, "\n")
    left = F.filter(F.zip_with(parts, _stays(F.col(gone), F.size(parts)), lambda line, stays: F.when(stays, line)), lambda line: line.isNotNull())
    joined = joined.withColumn(kept, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    columns = [F.col(kept).alias(text) if c == text else F.col(c) for c in docs.columns]
    if report:
        n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")
        n_removed = F.aggregate(F.col(gone), F.lit(0), lambda n, s: n + s.b - s.a)
        columns += [n_lines.alias("n_lines"), F.coalesce(n_removed, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_runs")]
    return joined.select(*columns)


def query(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _sql_runs(n: int) -> str:
    """Later copies of windows of n lines, which is all that later copies of longer runs consist of."""
    said, words = ", ".join(f"s{k}" for k in range(n)), " + ".join(f"w{k}" for k in range(n))
    counts = "" if n == MIN_LINES else f" AND {words} >= {MIN_WORDS}"
    return f"SELECT doc_id, line, {n} AS lines, row_number() OVER (PARTITION BY {said} ORDER BY doc_id, line) AS nth FROM w WHERE line + {n} <= n{counts}"


SQL = rf"""
WITH l AS (SELECT doc_id, i - 1 AS line, s[i] AS said, len(regexp_extract_all(s[i], '{WORD}')) AS words, len(s) AS n FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, line, n, {", ".join(f"lead(said, {k}) OVER (PARTITION BY doc_id ORDER BY line) AS s{k}, lead(words, {k}) OVER (PARTITION BY doc_id ORDER BY line) AS w{k}" for k in range(MIN_LINES))} FROM l),
f AS ({" UNION ALL ".join(map(_sql_runs, range(1, MIN_LINES + 1)))}),
g AS (SELECT DISTINCT doc_id, unnest(range(line, line + lines)) AS line FROM f WHERE nth > 1),
m AS (SELECT l.doc_id, l.line, l.said, g.line IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line), false) AS starts FROM m),
c AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_runs, string_agg(said, chr(10) ORDER BY line) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN c ON documents.doc_id = c.doc_id
"""
