"""The numbered queries over the whole tables of a folder, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embeddings, langid, lines, minhash, mix, negatives, phrases, shard, suffixes, toxicity
from .common import Scratch, read

#: Fixed value: the conversation that the chat query adds to the table.
EXTRA_TURNS = "select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_turns(turns.unionByName(spark.sql(EXTRA_TURNS))))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_slots(read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mix.word_count("text").alias("size"))
    return mix.mix_counts(Scratch(spark, "mix").save(sized, "sized"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.query(read(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.query(read(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.frequent_phrases(read(spark, sf_dir, "documents")))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.with_noise(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_chat_format, op3_shard, op4_language, op5_toxicity, op6_mix, op7_minhash, op8_suffixes, op9_lines, op10_embeddings, op11_phrases, op12_negatives, op13_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.SQL, "op2_chat_format": chat.SQL, "op6_mix": mix.SQL, "op7_minhash": minhash.SQL, "op8_suffixes": suffixes.SQL, "op9_lines": lines.SQL, "op10_embeddings": embeddings.SQL, "op11_phrases": phrases.SQL, "op12_negatives": negatives.SQL}
