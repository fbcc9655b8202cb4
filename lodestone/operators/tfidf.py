"""Posting lists (id, term, w) of word 1- and 2-grams, weighted by damped term frequency and inverse document frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import words

#: The text that each blocker compares.
BLOCKER_TEXTS = {
    "name": lambda: F.col("name_core"),
    "combined": lambda: F.concat_ws(" ", "name_norm", "address_norm"),
}


def blocker_text(blocker: str) -> Column:
    if blocker not in BLOCKER_TEXTS:
        raise ValueError(f"unknown blocker: {blocker}")
    return BLOCKER_TEXTS[blocker]()


def terms(text: Column) -> Column:
    """Words and pairs of neighbouring words, with repeats."""
    tok = words(text)
    few = F.greatest(F.size(tok) - 1, F.lit(0))
    return F.concat(tok, F.zip_with(F.slice(tok, 1, few), F.slice(tok, 2, few), lambda x, y: F.concat_ws(" ", x, y)))


def term_counts(df: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """(keys, term, tf) of each row's text."""
    return df.select(*keys, F.explode(terms(text)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame, group: list[str]) -> DataFrame:
    """(group, term, df): rows with the term."""
    return counts.groupBy(*group, "term").agg(F.count("*").alias("df"))


def weighted(counts: DataFrame, idf: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """(keys, term, w) of unit length over the terms that idf (group, term, idf) has. Rows without such a term have none."""
    w = counts.join(idf, [*group, "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return w.withColumn("w", F.col("w") / norm).select(*keys, "term", "w")


def frequencies(targets: DataFrame, blocker: str) -> DataFrame:
    """(source, term, df, n): in how many of the n targets of a source the term is."""
    t = term_counts(targets.withColumnRenamed("entity_id", "tgt_id"), blocker_text(blocker), ["tgt_id", "source"])
    return document_frequencies(t, ["source"]).join(F.broadcast(targets.groupBy("source").agg(F.count("*").alias("n"))), "source")


def tfidf(s1: DataFrame, targets: DataFrame, blocker: str, max_df: int = 2000, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Posting lists of S1, (s1_id, source, term, w), and of the targets, (tgt_id, source, term, w).

    Document frequencies are the targets' of each source, whatever their country; terms of more than max_df targets go
    before any join, which bounds what a term can match. given: the frequencies (source, term, df, n) to be taken instead,
    where targets are a part of more; a term that they lack doesn't count.
    """
    text = blocker_text(blocker)
    t = term_counts(targets.withColumnRenamed("entity_id", "tgt_id"), text, ["tgt_id", "source"])
    n = targets.groupBy("source").agg(F.count("*").alias("n"))
    freq = document_frequencies(t, ["source"])
    if given is not None:
        n, freq = given.select("source", "n").distinct(), given.select("source", "term", "df")
    freq = freq.where(F.col("df") <= max_df)
    idf = freq.join(F.broadcast(n), "source").select("source", "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    q = term_counts(s1.withColumnRenamed("entity_id", "s1_id"), text, ["s1_id"])
    own = q.join(idf, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("s1_id", "source")))
    return own.withColumn("w", F.col("w") / norm).select("s1_id", "source", "term", "w"), weighted(t, idf, ["source"], ["tgt_id", "source"])
