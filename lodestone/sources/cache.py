"""A Parquet cache of normalized sources."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions import dictionaries, text
from lodestone.operators import normalize
from lodestone.operators.normalize import normalize_records
from lodestone.sources.tsv import _fs, read_source_tsv


def cache_key(spark: SparkSession, path: str) -> str:
    """Changes with the file's path, size or time and with the code of normalization."""
    p, fs = _fs(spark, path)
    status = fs.getFileStatus(p)
    h = hashlib.sha1(f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}".encode())
    for module in (text, dictionaries, normalize):
        h.update(Path(module.__file__).read_bytes())
    return h.hexdigest()


def load_source(spark: SparkSession, path: str, cache_dir: str | None = None) -> DataFrame:
    """The normalized records of a source file, from the cache where it is fresh."""
    if cache_dir is None:
        return normalize_records(read_source_tsv(spark, path))
    at = f"{cache_dir}/{cache_key(spark, path)}"
    done, fs = _fs(spark, f"{at}/_SUCCESS")
    if not fs.exists(done):
        normalize_records(read_source_tsv(spark, path)).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
