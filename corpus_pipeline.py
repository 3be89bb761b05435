"""The corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage takes what the one before kept, as Parquet. Language ID rejects documents that are ``und``; the quality
classifier those it scores below KEEP; of each group of near-duplicates, found by SimHash and min-hash bands and verified, one
document stays; the last stage packs all that is left.

Odd input, in every stage but the last: the columns of documents come out as they went in, whatever their names; null texts and
texts without a letter have no language and go in the first stage; repeated rows are judged each, and of equal texts one row
stays; rows that share a key are each judged by their own text; rows with a null key are scored like others and stay in the
near-duplicates stage, as no key can name them; ties go to the smaller key; very long texts are read whole; no rows, no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import langid, packing, quality, shingles
from quarryline.llm.common import settled
from quarryline.llm.queries import vocabulary

KEEP = 0.5
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language."""
    name = _fresh(docs, "langid")
    found = langid.identify(docs, docs.where(langid.not_held_out(docs["doc_id"])), vocabulary("piece_bpe_32k.model"), name=name)
    return found.where(found[name]["lang_pred"] != "und").select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of quality KEEP or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = _fresh(docs, "quality_score")
    scored = quality.classify(docs, docs, labels.where(langid.not_held_out(labels["doc_id"])), name=name)
    return scored.where(scored[name] >= KEEP).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8 or more."""
    return shingles.keep_one(docs, words=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences that hold to the sources' proportions."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("languages", languages), ("quality", good), ("near_duplicates", distinct), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage stored on the way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(functools.partial(stage, spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
