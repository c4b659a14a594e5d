"""Documents: intake, text functions and bias reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.layout import reading_order
from ..plans import batches, bias, ingest, screening
from ..plans.fields import vocabulary
from ..sources import documents as sources
from ..sources.candidates import table
from .registry import query


@query(
    "WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents), f AS (SELECT content_hash, min(doc_id) AS first FROM h GROUP BY 1) "
    "SELECT doc_id, h.content_hash, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM h LEFT JOIN f ON h.content_hash = f.content_hash"
)
def q_exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ingest.mark_duplicates(docs, content="text").select("doc_id", "content_hash", "duplicate_of")


@query("SELECT doc_id, 'Candidate ' || row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS candidate_ref FROM documents")
def q_candidate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ingest.candidate_references(docs, batch="source", order=("n_chars", "doc_id")).select("doc_id", "candidate_ref")


@query(
    "SELECT doc_id, CASE WHEN text IS NULL THEN 'unreadable' WHEN length(trim(text, ' ')) < 80 THEN 'too_short' END AS error, coalesce(length(text) > 24000, false) AS truncated, sha256(substr(text, 1, 24000)) AS taken FROM documents"
)
def q_split_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are kept as rows; the cut at 24,000 characters is that of the structuring pass."""
    return ingest.split_errors(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "error", "truncated", F.sha2("text", 256).alias("taken"))


@query(
    "SELECT source AS job_id, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, sha256(CAST(sum(CAST('0x' || substr(sha256(doc_id || '.txt' || chr(9) || n_chars), 1, 12) AS BIGINT)) AS VARCHAR)) AS manifest_hash, "
    "bool_and(n_chars BETWEEN 1 AND 26214400) AND count(*) <= 4000 AND sum(n_chars) <= 5368709120 AS accepted FROM documents GROUP BY source"
)
def q_manifest_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    listed = docs.select(F.col("source").alias("job_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.col("n_chars").alias("size"))
    return sources.manifest_problems(listed)


LIMIT = 60_000

_LISTED = "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents"


@query(
    f"WITH RECURSIVE l AS ({_LISTED}), f AS (SELECT source, doc_id, k, n_chars <= {LIMIT} AS taken, CASE WHEN n_chars <= {LIMIT} THEN n_chars ELSE 0 END AS used FROM l WHERE k = 1 "
    f"UNION ALL SELECT l.source, l.doc_id, l.k, used + n_chars <= {LIMIT}, used + CASE WHEN used + n_chars <= {LIMIT} THEN n_chars ELSE 0 END FROM f JOIN l ON l.source = f.source AND l.k = f.k + 1) SELECT doc_id, taken FROM f"
)
def q_within_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents of a source's upload fit, in order; the running limit is the feature."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sources.within_total(docs, LIMIT, batch="source", size="n_chars", order="doc_id").select("doc_id", "taken")


@query(
    "SELECT o_orderkey, nullif(min(o_orderkey) OVER w, o_orderkey) AS replay_of, first_value(o_orderstatus) OVER (w ORDER BY o_orderkey) <> o_orderstatus AS conflict FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)"
)
def q_replayed_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are submissions, their customer the user, their priority the key and their status the manifest."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    found = sources.replays(orders, ["o_custkey", "o_orderpriority"], submission="o_orderkey", manifest="o_orderstatus")
    return found.select("o_orderkey", "replay_of", "conflict")


@query(
    "SELECT l_orderkey AS page, l_linenumber AS line, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber <> 1, l_linenumber % 2, l_linenumber) AS INTEGER) AS place FROM lineitem"
)
def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a page: its first line a heading over two columns, even lines in the left one, odd ones in the right."""
    line = F.col("l_linenumber")
    left = F.when(line == 1, 0).otherwise((line % 2) * 300)
    top = F.when(line == 1, 0).otherwise(line * 15 + 40)
    box = F.array(*[c.cast("double") for c in (left, top, F.when(line == 1, 500).otherwise(left + 200), top + 10)])
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(line.alias("line"), box.alias("box")))).alias("lines"))
    ordered = pages.select("l_orderkey", "lines", reading_order(F.transform("lines", lambda x: x["box"])).alias("found"))
    placed = ordered.select("l_orderkey", "lines", F.posexplode("found").alias("place", "at"))
    return placed.select(F.col("l_orderkey").alias("page"), F.get("lines", F.col("at"))["line"].alias("line"), (F.col("place") + 1).alias("place"))


# ---------------------------------------------------------------- text functions


def _found(text: str, pattern: str) -> str:
    """The pattern in the SQL dialect, which has no look-ahead: what it excludes is taken out first."""
    quoted = pattern.replace("'", "''")
    if "(?! up to \\d)" in quoted:
        excluded = "(?i)must be able to (stand|lift) up to \\d"
        return f"regexp_matches(regexp_replace({text}, '{excluded}', '', 'g'), '(?i){quoted.replace('(?! up to \\d)', '')}')"
    return f"regexp_matches({text}, '(?i){quoted}')"


def _risks(text: str, level: str) -> str:
    return " + ".join(f"CAST({_found(text, p)} AS BIGINT)" for _, risk, p in tx.RISK_PATTERNS if risk == level)


_RISK = "SELECT {key}, high + review AS findings, CASE WHEN high > 0 THEN 'high' WHEN review > 0 THEN 'review' ELSE 'none' END AS risk FROM (SELECT {key}, {high} AS high, {review} AS review FROM {table})"


def _risk_sql(key: str, of: str) -> str:
    return _RISK.format(key=key, table=of, high=_risks("text", "high"), review=_risks("text", "review"))


@query(_risk_sql("doc_id", "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"))
def q_risk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = screening.wording_risks(docs, "text")
    return found.select("doc_id", F.size("findings").cast("long").alias("findings"), "risk")


#: Wordings of rules, in part risky.
WORDINGS = (
    "Must be a native English speaker",
    "Five years of Python",
    "Has to fit our culture",
    "Recent graduates preferred",
    "Local experience is required",
    "Able to lift; must be able to lift up to 20 kg",
    "Must be able to lift",
    "No career gaps, please",
    "Worked at a leading consultancy",
    "Holds a forklift licence",
    "Young and energetic",
    "Citizens only",
)
_WORDINGS = "(SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDINGS) + "]) AS text)"


@query(_risk_sql("text", _WORDINGS))
def q_risk_level_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    wordings = spark.createDataFrame([(w,) for w in WORDINGS], "text string")
    return screening.wording_risks(wordings, "text").select("text", F.size("findings").cast("long").alias("findings"), "risk")


@query("SELECT r.risk, count(*) AS patterns FROM (VALUES " + ", ".join(f"('{risk}')" for _, risk, _ in tx.RISK_PATTERNS) + ") AS r(risk) GROUP BY r.risk")
def q_risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.risk_table(spark).groupBy("risk").agg(F.count("*").alias("patterns"))


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{tx.EMAIL}', '[redacted]', 'g'), '{tx.PHONE}', '[redacted]', 'g')) AS redacted FROM documents")
def q_email_phone_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("text", tx.EMAIL, "[redacted]"), tx.PHONE, "[redacted]")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("redacted"))


@query()
def q_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-identified documents: what is left of the text and whether it still identifies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a file of one row group is one task, and every text is much work
    docs = ingest.structured(docs.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"))
    return ingest.anonymised(docs).select("doc_id", F.length("text").alias("chars"), "leaked")


@query(
    f"SELECT doc_id, nullif(regexp_extract(text, '{tx.EMAIL}', 0), '') AS email, TRY_CAST(nullif(regexp_extract(text, '(?i)(\\d{{1,2}})\\+?\\s*years', 1), '') AS DOUBLE) AS stated_years FROM documents"
)
def q_structured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ingest.structured(docs).select("doc_id", "email", "stated_years")


_TURNS = "SELECT conv_id || '-' || turn AS rule_id, coalesce(text, '') AS text FROM conversations WHERE role = 'user'"
_FOUND = " UNION ALL ".join(f"SELECT rule_id, text, '{name}' AS id, '{risk}' AS risk FROM t WHERE {_found('text', p)}" for name, risk, p in tx.RISK_PATTERNS)


def wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in conversations, as wordings of rules and questions."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("rule_id"), F.coalesce("text", F.lit("")).alias("wording"))


@query(
    f"WITH t AS ({_TURNS}), f AS ({_FOUND}), h AS (SELECT rule_id, text, bool_or(risk = 'high') AS high FROM f GROUP BY ALL) "
    "SELECT t.rule_id, CASE WHEN high THEN 'rule_risky' ELSE 'rule_applicable' END AS event, CASE WHEN high THEN 'high' WHEN high IS NULL THEN 'none' ELSE 'review' END AS detail FROM t LEFT JOIN h ON h.rule_id = t.rule_id AND h.text = t.text UNION ALL SELECT rule_id, 'rule_risk_flagged', id FROM f"
)
def q_wording_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compile trail of every wording that users gave."""
    return batches.rule_trail(wordings(spark, sf_dir), F.lit(None).cast("timestamp")).select("rule_id", "event", "detail")


@query(
    f"WITH t AS ({_TURNS}), f AS ({_FOUND}), h AS (SELECT rule_id, text, count(DISTINCT id) AS n, bool_or(risk = 'high') AS high FROM f GROUP BY ALL) "
    "SELECT t.rule_id, coalesce(n, 0)::INTEGER AS findings, CASE WHEN high THEN 'rejected' WHEN n > 0 THEN 'warned' ELSE 'open' END AS gate FROM t LEFT JOIN h ON h.rule_id = t.rule_id AND h.text = t.text"
)
def q_query_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions are put, put with a warning, or refused for their wording."""
    return batches.gate(wordings(spark, sf_dir)).select("rule_id", F.size("findings").alias("findings"), "gate")


@query(
    "SELECT doc_id, CASE WHEN text IS NULL THEN 'manual_review' WHEN length(trim(text, ' ')) < 80 THEN 'manual_review' ELSE 'ready' END AS status FROM documents"
)
def q_routed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cannot be read goes to a person and is never rejected."""
    return batches.routed(ingest.split_errors(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "status")


#: Titles of qualifications and of things that are none.
TITLES = ("Doctor of Philosophy", "Master of IT", "Graduate Certificate in Data", "Bachelor of Science (Honours)", "B.Sc", "Advanced Diploma of Nursing", "Certificate IV in Training", "Certificate of Completion", "Diploma of Art", "Forklift licence", "")


def _levels(title: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({title}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN {level}" for p, level, _ in tx.LEVEL_PATTERNS)
    return f"CASE WHEN trim(coalesce({title}, '')) = '' THEN NULL WHEN regexp_matches({title}, '(?i){tx.NOT_AN_AWARD}') THEN NULL {cases} END"


@query(f"SELECT title, CAST({_levels('title')} AS INTEGER) AS level, coalesce({_levels('title')} >= 7, false) AS enough FROM (SELECT unnest([{', '.join(repr(t) for t in TITLES)}]) AS title UNION ALL SELECT DISTINCT p_type || ' ' || p_name FROM part)")
def q_level_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("title")).distinct()
    titles = spark.createDataFrame([(t,) for t in TITLES], "title string").unionByName(parts)
    level = tx.qualification_level(F.col("title"))["level"]
    return titles.select("title", level.alias("level"), tx.meets_level(level, 7).alias("enough"))


@query()
def q_sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of sentences; their pattern looks behind, which the SQL dialect does not."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("n_sentences"))


_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_EVIDENCE = f"lower(trim(regexp_replace(translate(text, '\"''\\', ''), '{_SPACE}', ' ', 'g'), ' '))"


@query(f"SELECT conv_id, turn, sha256({_EVIDENCE}) AS normal, coalesce(contains({_EVIDENCE}, 'the'), false) AS found FROM conversations")
def q_evidence_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn without text holds no evidence."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.sha2(tx.evidence_normal(F.col("text")), 256).alias("normal"), tx.evidence_found(F.lit("'The'"), F.col("text")).alias("found"))


@query("SELECT p_partkey, round(levenshtein(p_name, p_type) / length(p_name), 4) AS error_rate FROM part")
def q_edit_distance_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(tx.error_rate(F.col("p_name"), F.col("p_type")), 4).alias("error_rate"))


_HTML = reduce(
    lambda c, s: f"regexp_replace({c}, '{s[0]}', '{s[1]}', 'g')",
    [("(?is)<script\\b.*?</script>|<style\\b.*?</style>", " "), ("(?s)<!--.*?-->", " "), ("<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), (_SPACE, " ")],
    "html",
)


@query(f"SELECT page_id, sha256(trim({_HTML}, ' ')) AS text_sha256 FROM pages")
def q_html_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(tx.html_text(F.col("html")), 256).alias("text_sha256"))


@query("SELECT o_orderkey, greatest(0, 2001 * 12 + 1 - (year(o_orderdate) * 12 + month(o_orderdate)))::INTEGER AS months FROM orders")
def q_months_between_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", tx.months_between_marks(F.date_format("o_orderdate", "yyyy-MM"), F.lit("2001")).alias("months"))


@query("SELECT kind, n FROM (VALUES ('number', 29), ('list', 23), ('text', 4), ('enum', 4), ('flag', 14)) AS v(kind, n)")
def q_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark).groupBy("kind").agg(F.count("*").cast("int").alias("n"))


# ---------------------------------------------------------------- bias


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: the language is the group, the source the case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("group"), F.col("source").alias("case_id"), "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", F.col("quality").cast("double"))


_JUDGED = "WITH j AS (SELECT lang AS grp, source AS case_id, quality, n_chars, toxic FROM labels JOIN documents USING (doc_id))"


@query(f"{_JUDGED} SELECT grp AS \"group\", round(avg(quality), 4) AS mean, round(stddev_samp(quality), 4) AS stdev, count(*) AS n FROM j GROUP BY grp")
def q_group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = bias.group_statistics(judged(spark, sf_dir))
    return stats.select("group", F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"), "n")


_MEANS = ", m AS (SELECT grp, avg(quality) AS mean FROM j GROUP BY grp)"


@query(f"{_JUDGED}{_MEANS} SELECT round(max(mean) - min(mean), 4) AS gap, (SELECT grp FROM m ORDER BY mean DESC, grp LIMIT 1) AS highest, (SELECT grp FROM m ORDER BY mean, grp LIMIT 1) AS lowest FROM m")
def q_group_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = bias.group_gap(bias.group_statistics(judged(spark, sf_dir)))
    return gap.withColumn("gap", F.round("gap", 4))


@query(
    f"{_JUDGED}, m AS (SELECT case_id, grp, avg(quality) AS mean FROM j GROUP BY 1, 2), s AS (SELECT case_id, max(mean) - min(mean) AS spread FROM m GROUP BY case_id HAVING count(*) > 1) "
    "SELECT round(avg(spread), 4) AS mean_spread, round(max(spread), 4) AS max_spread, count(*) AS cases FROM s"
)
def q_within_case_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = bias.within_case_spread(judged(spark, sf_dir))
    return spread.select(F.round("mean_spread", 4).alias("mean_spread"), F.round("max_spread", 4).alias("max_spread"), "cases")


@query(
    f"{_JUDGED}, a AS (SELECT quality AS arm, grp, avg(n_chars) AS mean FROM j GROUP BY 1, 2), g AS (SELECT arm, max(mean) - min(mean) AS gap FROM a GROUP BY arm), "
    "b AS (SELECT max(gap) FILTER (WHERE arm = 0) AS gap_before, max(gap) FILTER (WHERE arm = 1) AS gap_after FROM g) "
    "SELECT round(gap_before, 4) AS gap_before, round(gap_after, 4) AS gap_after, round(gap_before - gap_after, 4) AS reduction, CASE WHEN gap_before <> 0 THEN round((gap_before - gap_after) * 100 / gap_before, 4) END AS reduction_pct FROM b"
)
def q_gap_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = judged(spark, sf_dir).select(F.col("quality").cast("string").alias("arm"), "group", F.col("n_chars").cast("double").alias("score"))
    gaps = bias.group_gap(bias.group_statistics(arms, by=("arm",)), by=("arm",))
    out = bias.gap_reduction(gaps, "0", "1")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query(
    f"{_JUDGED}, s AS (SELECT CAST(quality AS VARCHAR) AS arm, grp, CASE WHEN toxic = 1 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS score FROM j), "
    "m AS (SELECT arm, grp, avg(score) AS mean, count(*) AS n FROM s WHERE score IS NOT NULL GROUP BY 1, 2), "
    "c AS (SELECT arm, count(score) AS scored, count(*) - count(score) AS failed FROM s GROUP BY arm), "
    "t AS (SELECT arm, string_agg(printf('    %-3s n=%3d mean=%.4f', grp, n, mean), chr(10) ORDER BY mean DESC, grp) AS lines, max(mean) - min(mean) AS gap, first(grp ORDER BY mean DESC, grp) AS highest, first(grp ORDER BY mean, grp) AS lowest FROM m GROUP BY arm) "
    "SELECT arm, scored, failed, round(gap, 4) AS gap, concat_ws(chr(10), printf('[%s] scored=%d failed=%d', arm, scored, failed), lines, printf('    group gap = %.4f (%s - %s)', gap, highest, lowest)) AS report FROM c LEFT JOIN t USING (arm)"
)
def q_bias_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms by quality; a toxic document's scoring has failed."""
    arms = judged(spark, sf_dir).select(F.col("quality").cast("string").alias("arm"), "group", F.when(F.coalesce(F.col("toxic") != 1, F.lit(True)), F.col("n_chars").cast("double")).alias("score"))
    return bias.arm_reports(arms).withColumn("gap", F.round("gap", 4))


@query("SELECT r_name AS case_id, n_name AS \"group\", c_mktsegment AS context FROM region, nation, (SELECT DISTINCT c_mktsegment FROM customer)")
def q_counterfactual_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three dimensions of a few rows each."""
    cases = table(spark, sf_dir, "region").select(F.col("r_name").alias("case_id"))
    groups = table(spark, sf_dir, "nation").select(F.col("n_name").alias("group"))
    contexts = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("context")).distinct()
    return bias.counterfactuals(cases, groups, contexts)
