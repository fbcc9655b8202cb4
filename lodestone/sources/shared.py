"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import contextlib
import functools
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, one in the warehouse, which all
    executors reach too."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lodestone").rstrip("/")


_scopes = threading.local()


def settled(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is kept as a table before it returns, so that the tables it kept on the way can go at once."""

    @functools.wraps(f)
    def run(*args, **more) -> DataFrame:
        stack = _scopes.__dict__.setdefault("stack", [])
        stack.append([])
        try:
            out = f(*args, **more)
        except BaseException:
            stack.pop()
            raise
        mine = stack.pop()
        out = kept(out)
        fs = None
        for at in mine:
            path = out.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            fs = fs or path.getFileSystem(out.sparkSession.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)
        return out

    return run


#: Bytes of an Arrow batch between Spark and Python, on either side of it.
BATCH = 4 << 20


@contextlib.contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """Within this, shuffle files go as soon as the action that made them ends, else they stay until the driver collects its
    garbage; and Arrow batches hold few rows, as rows may be long. A batch size that the user set is left."""
    shuffles, batches = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {x: spark.conf.get(x) for x in (shuffles, batches)}
    spark.conf.set(shuffles, "true")
    if before[batches] in ("67108864b", "64MB", "64m"):  # Spark's default
        spark.conf.set(batches, str(BATCH))
    try:
        yield
    finally:
        for x, y in before.items():
            spark.conf.set(x, y)


def kept(df: DataFrame, by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: later plans start at these files. They go
    when the application ends, or with the settled() function that they are kept in. by: columns that get a folder for each
    of their values, and come last; codec: another compression than the session's."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"
    at = f"{top}/{uuid.uuid4().hex}"
    with sparing(spark):
        df.write.parquet(at, partitionBy=by, compression=codec)
    if _scopes.__dict__.get("stack"):
        _scopes.stack[-1].append(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of tables made by kept(); nothing may read them later."""
    for df in frames:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
