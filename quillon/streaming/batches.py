"""The operators over a stream of documents.

Each document is judged by itself, so a micro-batch can be judged like a table. Windows over positions
in a text are not event-time windows and cannot run on a stream directly; they run in foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.functions import text as tx
from quillon.operators.parse import Parsed, parse


def each_batch(stream: DataFrame, analyse: Callable[[Parsed], DataFrame], out: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Writes analyse(parsed documents) of every micro-batch to ``out`` as parquet, in a folder of the batch.

    A batch that runs again overwrites its own folder, so each document's rows are there once."""

    def run(batch: DataFrame, number: int) -> None:
        analyse(parse(batch, **options)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_counts(stream: DataFrame, patterns: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stream with a count per pattern: no state, no shuffle, straight on the stream."""
    t = tx.prepared(F.col(text))
    return stream.select(key, F.size(tx.words(t)).alias("n_words"), *[tx.count(t, p).alias(k) for k, p in patterns.items()])


def windowed_rates(stream: DataFrame, at: str, late: str = "1 day", length: str = "1 hour", text: str = "text") -> DataFrame:
    """Documents and words per event-time window, late ones up to ``late``."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, length))
    return w.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(tx.words(tx.prepared(F.col(text))))).alias("words"))
