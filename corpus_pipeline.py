"""A training corpus from raw documents: five stages, each over all that the one before has kept.

Toxic documents go, then those that fail the quality rules, then all but one of each near-duplicate
group, then later copies of long byte strings; what is left is packed into sequences. Every stage
but the last returns the columns of ``documents``; ``run`` writes each result to the shared folder
and reads it back, so a lost executor costs at most a stage.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulsetrail.llm.common import documents, importable, stored
from pulsetrail.llm.packing import pack
from pulsetrail.llm.quality import judge
from pulsetrail.llm.queries import WORD_BPE
from pulsetrail.llm.simhash import firsts
from pulsetrail.llm.suffix_dedup import remove_copies
from pulsetrail.llm.toxicity import rate

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: no SQL: learned scores and packing aren't expressible
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier takes for toxic (operator 6)."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rate(docs, labels, carry=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail the base rules or their group's thresholds (operator 2)."""
    importable(spark)
    return judge(docs, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group (operator 7); texts of null ids are documents of their own."""
    importable(spark)
    return firsts(docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of strings of 100 bytes (operator 3).

    Removal is by bytes: what is left of a character that was cut is dropped. A text of which
    nothing is left goes; null and empty texts stay as they are.
    """
    importable(spark)
    cut = remove_copies(docs, carry=("lang", "source"))
    text = F.when(F.col("n_removed") == 0, F.decode("kept", "UTF-8")).otherwise(whole_characters("kept"))
    return (cut.where("n_removed = 0 or n_removed < n_bytes").withColumn("text", text)
            .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS))


@F.pandas_udf(T.StringType())
def whole_characters(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of 4096 tokens (operator 1)."""
    importable(spark)
    return pack(docs, WORD_BPE)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, in order."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
