"""Records that arrive over time, linked batch by batch against the S1 records at hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.blocking import generate_candidates
from lodestone.operators.normalize import normalize_records
from lodestone.operators.tfidf import frequencies
from lodestone.sources.shared import kept


def normalized_stream(raw: DataFrame) -> DataFrame:
    """A stream of normalized records; the projection of the batch, without state."""
    return normalize_records(raw)


def candidates_of_batches(targets: DataFrame, s1: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, k: int = 10, max_df: int = 2000, once: bool = True, reference: DataFrame | None = None) -> StreamingQuery:
    """Starts a query that gives sink the candidate pairs of each batch of normalized target records (with `source`).

    Term frequencies are those of reference, normalized targets of the same sources, counted once, so that a pair's score
    doesn't depend on how records are dealt to batches; without reference they are those of the batch. A sink that writes
    by batch number is written exactly once.
    """
    given = None if reference is None else {b: kept(frequencies(reference, b)) for b in ("name", "combined")}

    def each(batch: DataFrame, number: int) -> None:
        sink(generate_candidates(s1, batch, k, max_df, given=given), number)

    writer = targets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
