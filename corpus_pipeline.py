"""The training-data pipeline: each stage works on all rows that its predecessor kept.

In every stage null and empty texts have no words, null ids, languages and sources are values of their own (an id
before all others), repeated rows are judged alike, other columns stay as they are whatever their names, texts may
be of any length, and an empty table gives an empty table.  Each stage says what it does with such rows.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vozlake
from vozlake.llm import copies, decontaminate, raking, secrets, simhash, toxicity
from vozlake.llm.common import materialize
from vozlake.llm.queries import read

# Functions travel to the Python workers by value, so executors need no install.
cloudpickle.register_pickle_by_value(vozlake)

#: Share of the remaining tokens that the mixture draws.
MIXED_SHARE = 0.8


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labelled ones among ``docs``.

    Texts without words get the score of no evidence, rows without an id have no label; both are judged like others."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    op4's tree links fingerprints (of 5-word shingles) at 2 or fewer differing bits.  They are tighter than a
    similarity, so pairs of a Jaccard similarity of 0.8 or more, found by minimum hashes and decided by the whole
    shingle sets, are linked as well; groups are the components of both kinds of links.
    Texts without words are one group; of repeated rows one stays, of one id with two texts both do."""
    return copies.deduplicate(docs, linked=simhash.groups(docs, shingle=copies.SHINGLE))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go; texts without words stay."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and lengths follow where there are any; every row stays, null texts stay null."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources and languages are evened out; with the probability of each.

    Repeated rows are drawn together; texts without words are drawn with the plain share."""
    return raking.sample(docs, share=MIXED_SHARE)


STAGES = [
    ("toxicity", without_toxic),
    ("near-duplicates", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scan", without_secrets),
    ("source mixing", mixed),
]
#: Trained and drawn stages can't be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents, each result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, "pipeline")
    return docs
