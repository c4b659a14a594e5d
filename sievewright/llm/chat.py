"""Chat formatting: turns to marked text, and one training example per assistant turn.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Texts and roles may hold anything: a
backslash and each control string of this and other common templates is replaced by a backslash
and a letter, so no control string is left inside a turn, and the replacement can be undone.
Prefix-target expansion makes one example of every assistant turn: all turns before it are its
context and only its own text is trainable.

A formatted conversation is one row per turn with offsets, an example first a prefix of it by reference;
``render_examples`` writes its text out, and the query reads context and reply from that text.

Defined results: a null text or role is empty; turns come by number (null first), then by role
and text; repeated rows are repeated turns; null is a conversation id of its own; extra columns
are not carried, because an example stands for several rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TARGET_ROLE = "assistant"

#: The escape character comes first, then control strings and their codes.
ESCAPES = (
    ("\\", "\\b"),
    ("<|", "\\l"),
    ("</s>", "\\e"),
    ("<s>", "\\s"),
    ("[INST]", "\\i"),
    ("[/INST]", "\\j"),
    ("<<SYS>>", "\\y"),
    ("<</SYS>>", "\\z"),
)
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, table=ESCAPES) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), table, text)


def unescape(text: Column, table=ESCAPES) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(table), text)


def format_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: conv_id, position (from 1), piece (the formatted turn), piece_start (in
    code points, from 0, in the formatted conversation), and loss_start and loss_end within the
    piece (null for turns that are not trained on)."""
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape(F.col("role"), ROLE_ESCAPES), F.lit("\n"))
    pieces = turns.withColumn("head", head).withColumn("piece", F.concat("head", escape(F.col("text")), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    length = F.length("piece").cast("long")
    target = F.col("role") == TARGET_ROLE
    return pieces.select(
        "conv_id",
        F.row_number().over(order).alias("position"),
        "piece",
        (F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("piece_start"),
        F.when(target, F.length("head").cast("long")).alias("loss_start"),
        F.when(target, length - len(END)).alias("loss_end"),
    )


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """A row per assistant turn: the example is the first ``example_chars`` code points of the
    formatted conversation, trained on from ``loss_start`` to ``loss_end``."""
    return turns.where("loss_start is not null").select(
        "conv_id", F.col("position").alias("target"),
        (F.col("piece_start") + F.length("piece")).alias("example_chars"),
        (F.col("piece_start") + F.col("loss_start")).alias("loss_start"),
        (F.col("piece_start") + F.col("loss_end")).alias("loss_end"),
    )


def render_examples(turns: DataFrame, **more: Column) -> DataFrame:
    """The examples written out: conv_id, target, text (all turns before the reply and the reply), loss_start, loss_end, and
    columns ``more`` over those of the offsets."""
    parts = F.sort_array(F.collect_list(F.struct("position", "piece")))
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x.piece), "").alias("formatted"))
    examples = prefix_target_examples(turns).withColumns(more).withColumnRenamed("conv_id", "of")
    joined = examples.join(whole, F.col("of").eqNullSafe(F.col("conv_id")))
    text = F.substring(F.col("formatted"), F.lit(1), F.col("example_chars").cast("int"))
    return joined.select("conv_id", "target", text.alias("text"), "loss_start", "loss_end", *more)


def digest(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns and, for what is trained on and its context, from the
    texts of the rendered examples: a reply is what stands under its example's mask, its context what stands before. What
    an example has as context beyond that of the example before, end to end, is the context of the last example without
    the replies in it; only this and the reply leave the task that renders an example."""
    body = F.substring(F.col("piece"), F.lit(len(START) + 1), F.length("piece") - len(START) - len(END))
    role = F.substring_index("body", "\n", 1)
    content = F.substring(F.col("body"), F.length(role) + 2, F.length("body"))
    said = F.concat(unescape(role, ROLE_ESCAPES), F.lit("\n"), unescape(content), F.lit("\n"))
    back = turns.withColumn("body", body).select("conv_id", "position", F.length("piece").cast("long").alias("chars"), said.alias("said"))

    def joined(parts: Column, field: str) -> Column:
        return F.array_join(F.transform(parts, lambda x: x[field]), "")

    spoken = back.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("position", "said"))).alias("parts"))
    spoken = spoken.select("conv_id", "n_turns", F.sha2(joined(F.col("parts"), "said"), 256).alias("turns_sha256"), "formatted_chars")

    def cut(begin: Column, end: Column) -> Column:
        return F.substring(F.col("text"), (begin + 1).cast("int"), (end - begin).cast("int"))

    earlier = F.coalesce(F.lag("loss_end").over(Window.partitionBy("conv_id").orderBy("target")), F.lit(0))
    examples = render_examples(turns, known_end=earlier).select(
        F.col("conv_id").alias("of"), "target", F.length(cut(F.lit(0), F.col("loss_start"))).cast("long").alias("context_chars"),
        unescape(cut(F.col("loss_start"), F.col("loss_end"))).alias("loss"), cut(F.col("known_end"), F.col("loss_start")).alias("context"),
    )
    trained = examples.groupBy("of").agg(F.count("*").alias("n_examples"), F.sum("context_chars").alias("context_chars"), F.sort_array(F.collect_list(F.struct("target", "loss", "context"))).alias("parts"))
    trained = trained.select("of", "n_examples", "context_chars", *[joined(F.col("parts"), n).alias(n) for n in ("loss", "context")])
    trained = trained.select("of", "n_examples", "context_chars", F.length("loss").cast("long").alias("loss_chars"), *[F.sha2(n, 256).alias(f"{n}_sha256") for n in ("loss", "context")])
    out, nothing = spoken.join(trained, F.col("conv_id").eqNullSafe(F.col("of")), "left"), F.sha2(F.lit(""), 256)
    return out.select(
        "conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).alias("loss_chars"), F.coalesce("loss_sha256", nothing).alias("loss_sha256"), "formatted_chars",
        F.coalesce("n_examples", F.lit(0)).alias("n_examples"), F.coalesce("context_chars", F.lit(0)).alias("context_chars"), F.coalesce("context_sha256", nothing).alias("context_sha256"),
    )


def _sql_escape(column: str, table) -> str:
    for old, new in table:
        column = f"replace({column}, " + ("chr(10)" if old == "\n" else f"'{old}'") + f", '{new}')"
    return column


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '{START}' || {_sql_escape('role', ROLE_ESCAPES)} || chr(10) AS head, {_sql_escape('text', ESCAPES)} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
p AS (SELECT *, length(head) + length(body) + {len(END)} AS chars, coalesce(sum(length(head) + length(body) + {len(END)}) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins,
  max(k) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (WHERE role = 'assistant')::BIGINT AS n_examples, CAST(coalesce(sum(begins) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS context_chars,
sha256(coalesce(string_agg(head || CASE WHEN role = 'assistant' THEN '' ELSE body END || CASE WHEN k < last THEN '{END[:-1]}' || chr(10) ELSE '' END, '' ORDER BY k) FILTER (WHERE k <= last), '')) AS context_sha256
FROM p GROUP BY conv_id
"""
