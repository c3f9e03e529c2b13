"""The corpus pipeline: STAGES in order, each reading what the one before it kept.

Language identification drops what it rejects, of each group of near copies (five-word similarity
0.8 or more) one document stays, substring removal cuts passages that an earlier document has, mixing takes each source's
documents as often as its target weight asks, and packing lays the pieces of what was taken into
sequences. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrovia.llm.language import with_known_language
from ferrovia.llm.mixing import mix
from ferrovia.llm.near_copies import without_near_copies
from ferrovia.llm.packing import pack
from ferrovia.llm.substring_dedup import without_repeats
from ferrovia.llm.workspace import stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Models, fingerprints and seeded draws have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
