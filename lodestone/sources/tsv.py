"""Tab-separated files without quoting: every value is text as it stands, and a missing value is ''."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.normalize import SOURCE_COLUMNS


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file in any store that Spark reaches."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, '' where a field is empty. FileNotFoundError where there is no such file."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    head = spark.read.text(path).limit(1).collect()
    names = head[0][0].split("\t") if head else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(sep="\t", header=True, quote="", enforceSchema=False).schema(schema).csv(path).na.fill("")


def read_source_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A source; ValueError where a required column is missing. Other columns stay."""
    df = read_tsv(spark, path)
    missing = [c for c in SOURCE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path)


def write_id_lists(lists: DataFrame, path: str, column: str) -> None:
    """(entity_id, ids) as one file of the columns source1_entity_id and `column`, in the order of lists, without quoting.

    Rows are written by the executors; the one part file is then moved to path.
    """
    spark = lists.sparkSession
    part = f"{path}.parts"
    out = lists.select(F.col("entity_id").alias("source1_entity_id"), F.col("ids").alias(column))
    out.coalesce(1).write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", escapeQuotes=False).csv(part)
    p, fs = _fs(spark, part)
    target, _ = _fs(spark, path)
    found = fs.globStatus(_fs(spark, f"{part}/part-*")[0])
    fs.delete(target, False)
    fs.rename(found[0].getPath(), target)
    fs.delete(p, True)


def write_matching_results(lists: DataFrame, path: str) -> None:
    write_id_lists(lists, path, "matched_entity_ids")


def write_candidate_pairs(lists: DataFrame, path: str) -> None:
    write_id_lists(lists, path, "candidate_entity_ids")


def write_empty_submission(s1: DataFrame, matching: str, candidates: str) -> None:
    """Both files with an empty list for every S1 record, by id."""
    lists = s1.select("entity_id", F.lit("").alias("ids")).orderBy("entity_id")
    write_matching_results(lists, matching)
    write_candidate_pairs(lists, candidates)


def write_error_dump(errors: DataFrame, path: str) -> None:
    """Errors as tab-separated rows; tabs in values are escaped by a backslash."""
    spark = errors.sparkSession
    escaped = errors.select(*(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\\\t])", r"\\$1").alias(c) for c in errors.columns))
    escaped.coalesce(1).write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="", escapeQuotes=False).csv(f"{path}.parts")
    p, fs = _fs(spark, f"{path}.parts")
    found = fs.globStatus(_fs(spark, f"{path}.parts/part-*")[0])
    fs.delete(_fs(spark, path)[0], False)
    fs.rename(found[0].getPath(), _fs(spark, path)[0])
    fs.delete(p, True)
