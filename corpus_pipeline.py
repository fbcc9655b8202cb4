"""The corpus pipeline: quality, near duplicates, repeated strings, benchmark items, packing.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps, as it leaves them; the last returns the
packed pieces. What a stage returns is written as Parquet and read again as the documents of the next.

What holds for every stage: an empty table gives an empty one; equal rows are rows like others, unless the stage says more;
columns other than doc_id and text are passed on as they are, whatever their names, but for n_chars, which follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import kept, table
from lodestone.llm.decontamination import decontaminated
from lodestone.llm.minhash import one_of_each
from lodestone.llm.packing import pack
from lodestone.llm.quality import scored, train
from lodestone.llm.suffixes import without_repeats

#: Scores under this are rejected.
QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labels doesn't reject. A null text is judged as an empty one, equal
    texts alike; texts of any length are read whole."""
    name = "__lodestone_quality"  # no column of docs
    return scored(docs, train(docs, table(spark, sf_dir, "labels")), name).where(F.col(name) >= QUALITY).drop(name)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their sets of five-word shingles, the smallest by
    doc_id and hash of the text. Null texts and such without words are linked with nothing and stay; of rows that are equal
    in doc_id and text one stays."""
    return one_of_each(docs, words=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that start at two places or more. A text may become empty.
    A null text stays null; equal texts of that length are repeats of each other and lose all that they share."""
    return without_repeats(docs, 200)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts have none and stay; equal texts stay or go
    together; without benchmark items all stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids and places in sequences of at most 2048 ids. A null or empty text is one
    piece of the end id; equal rows are packed one by one."""
    return pack(docs, 2048, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_dedup", minhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No stage but the last returns rows that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
