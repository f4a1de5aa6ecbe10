"""Newest-first buffers over streams: the newest log lines and news items,
true after every batch.

The buffer is a table of at most n rows in the folder ``root``.  A batch takes
the buffer that the batch before it left, adds its own rows and keeps the
newest n of both: every task keeps its first n rows, and only these meet.
Batches write to two slots in turn, so the state stays bounded, and a batch
that is replayed after a failure finds the buffer it started from untouched
and replaces its own slot.

The order has to tell all rows apart for the buffer to equal the batch query
over everything that has landed; rows of equal rank are alike otherwise.  Late
rows need no watermark: they enter if they are among the newest.  An empty
stream leaves an empty buffer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..operators import logs, news

BATCH = "_batch"            # the batch that wrote a row of a slot
SLOTS = 2


def _slot(spark: SparkSession, root: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """The buffer that batch ``batch_id`` left (no rows before the first)."""
    schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    path = f"{root.rstrip('/')}/slot={batch_id % SLOTS}"
    try:
        return spark.read.schema(schema).parquet(path).where(F.col(BATCH) == batch_id).drop(BATCH)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":       # no such batch yet; anything else is an error
            raise
        return spark.createDataFrame([], schema).drop(BATCH)


def buffer_batch(batch: DataFrame, batch_id: int, root: str, newest: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch: the buffer of the batch before and the new rows, cut by ``newest``."""
    held = _slot(batch.sparkSession, root, batch_id - 1, batch.schema)
    (newest(held.unionByName(batch)).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
     .write.mode("overwrite").parquet(f"{root.rstrip('/')}/slot={batch_id % SLOTS}"))


def read_buffer(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of the latest batch, in no order.  To be read between batches:
    a batch under way replaces the older slot."""
    stamped = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        rows = spark.read.schema(stamped).option("recursiveFileLookup", True).parquet(root)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.where(F.col(BATCH) == rows.agg(F.max(BATCH)).scalar()).drop(BATCH)


def keep_newest(stream: DataFrame, root: str, checkpoint: str, newest: Callable[[DataFrame], DataFrame],
                available_now: bool = True):
    """Start the stream that keeps ``newest`` of all rows seen; returns the StreamingQuery."""
    writer = (stream.writeStream.foreachBatch(lambda df, bid: buffer_batch(df, bid, root, newest))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_recent_logs(records: DataFrame, root: str, checkpoint: str, n: int = C.LOG_BUFFER, ts: str = "timestamp",
                       ordinal: str | None = None, available_now: bool = True):
    """The newest ``n`` records at INFO or above of a stream of log records."""
    return keep_newest(records, root, checkpoint, lambda df: logs.recent_logs(df, n, ts, ordinal), available_now)


def stream_latest_news(items: DataFrame, root: str, checkpoint: str, sources=None, n: int = C.NEWS_LIMIT,
                       available_now: bool = True):
    """The newest ``n`` items of a stream of normalised items, optionally of some sources."""
    return keep_newest(items, root, checkpoint, lambda df: news.latest_news(df, sources, n), available_now)
