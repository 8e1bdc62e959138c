"""The numbered operators as named queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsetrail.llm import oracles
from pulsetrail.llm.common import documents, importable

#: folder of the public vocabularies; a parameter of every operator that needs one
TOKENIZERS = os.environ.get("TOKENIZERS_DIR") or os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))
WORD_BPE = f"{TOKENIZERS}/word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op2_quality_rules": oracles.quality_rules(), "op4_substring_dedup": oracles.substring_dedup(),
                      "op11_phrase_collocations": oracles.collocations()}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(fn)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = call
    return call


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.packing import pack

    return pack(documents(spark, sf_dir), WORD_BPE)


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.tokens import round_trip

    return round_trip(documents(spark, sf_dir), WORD_BPE)


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.suffix_dedup import remove_copies

    return remove_copies(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.substring_dedup import remove_passages

    return remove_passages(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.quality import judge

    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.suffix_tree import score

    return score(documents(spark, sf_dir))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.toxicity import rate

    return rate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.language import identify

    return identify(documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.neighbours import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.phrases import collocations

    return collocations(documents(spark, sf_dir))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.spelling import variants

    return variants(documents(spark, sf_dir))


@query
def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsetrail.llm.votes import vote

    return vote(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
