"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns to the shared folder and gives it to the next. All stages
but the last return the columns of ``documents``.

Rows of any shape pass: null and empty texts have no language and go at the
first stage (alone, the stages after it keep them, and the mixture, which
takes tokens, does not); repeated rows are judged alike; an empty table stays
empty; texts are read whole; columns other than those of ``documents`` go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, line_dedup, minhash, mixing
from tidemark.llm.common import discard, settle, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose best language has a mean probability under a half."""
    judged = langid.identify(docs, columns=COLUMNS)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= 0.5)).select(COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, and with them documents all of whose lines stand elsewhere."""
    kept = line_dedup.dedup_lines(docs, drop_emptied=True, spare_driver=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8) the document with the smallest id stays."""
    return minhash.keep_one(docs, percent=80).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark passages go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the target weights of domains, languages and sources; ``n_copies`` says how often."""
    mixed = mixing.mix(docs, levels=mixing.LEVELS, weights=mixing.WEIGHTS, share=0.5, max_epochs=2, seed=1)
    return mixed.where("mix_copies > 0").select(*COLUMNS, F.col("mix_domain").alias("domain"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("n_copies"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixture),
]

#: The trained network and MinHash candidates have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
