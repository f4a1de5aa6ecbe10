"""Structured Streaming jobs: supplier uploads and news feeds.

``stream_suppliers``: CSV files landing in a folder (read by their own headers)
-> clean -> quality gate per file (one upload) -> rows of accepted files scored, rejected files and
their failure rows written to quarantine.  Writes go to a ``batch_id=<n>``
folder with overwrite, so a replayed batch (after a failure) replaces its
own output instead of duplicating it.

``stream_news``: feed files (XML items) landing in a folder -> normalised
items, keyword filter (stateless), optionally de-duplicated by URL within
a watermark -> appended to a parquet sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..operators import cleanse, news, quality, scoring
from ..scenario import Scenario
from ..sources.csv import FILE, header_failures, parse_uploads, upload_lines
from ..sources.feeds import RSS_SCHEMA, normalise_items

SUPPLIER_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in C.SUPPLIER_COLUMNS])


def _batch_path(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch_id}"


def supplier_batch(df: DataFrame, batch_id: int, scenario: Scenario, as_of: str, sinks: dict,
                   spend_max_value: float | None = None, header_cases: DataFrame | None = None) -> None:
    """One micro-batch: clean, gate every file by itself (``FILE``; without
    that column the batch is one upload), score the accepted rows.  Files with
    ``header_cases`` are rejected for these, whatever their rows hold.

    The financial normaliser is the max of the accepted rows unless a stored
    ``spend_max_value`` is passed, so scores of different batches are
    only comparable with a fixed normaliser."""
    if FILE not in df.columns:
        df = df.withColumn(FILE, F.lit(""))
    cleaned = cleanse.clean_suppliers(df).persist()
    try:
        if header_cases is None:
            header_cases = cleaned.select(FILE, F.lit("").alias("supplier_id"), F.lit("").alias("column"),
                                          F.lit("").alias("check"), F.lit("").alias("failure_case")).limit(0)
        mislabelled = header_cases.select(FILE).distinct()
        judged = cleaned.join(mislabelled, FILE, "left_anti")
        bad = quality.failing_groups(judged, FILE).unionByName(mislabelled).distinct().persist()
        rejected = cleaned.join(bad, FILE, "left_semi")
        accepted = cleaned.join(bad, FILE, "left_anti").drop(FILE)
        if not bad.isEmpty():
            cases = quality.group_failures(judged.join(bad, FILE, "left_semi"), FILE).unionByName(header_cases)
            cases.withColumn("batch_id", F.lit(batch_id)).write.mode(
                "overwrite").parquet(_batch_path(sinks["failures"], batch_id))
            rejected.write.mode("overwrite").parquet(_batch_path(sinks["rejected"], batch_id))
        if not accepted.isEmpty():
            accepted.write.mode("overwrite").parquet(_batch_path(sinks["accepted"], batch_id))
            scored = scoring.score(accepted, scenario, as_of, spend_max_value=spend_max_value)
            scored.write.mode("overwrite").parquet(_batch_path(sinks["scored"], batch_id))
        bad.unpersist()
    finally:
        cleaned.unpersist()


def upload_batch(lines: DataFrame, batch_id: int, scenario: Scenario, as_of: str, sinks: dict,
                 spend_max_value: float | None = None) -> None:
    """One micro-batch of landed lines: every file's columns are taken by its
    own header, and a header without a column, or with one more, is a verdict
    on that file alone."""
    lines = lines.persist()
    try:
        rows, headers = parse_uploads(lines, C.SUPPLIER_COLUMNS)
        supplier_batch(rows, batch_id, scenario, as_of, sinks, spend_max_value, header_failures(headers, C.SUPPLIER_COLUMNS))
    finally:
        lines.unpersist()


def stream_suppliers(spark: SparkSession, source_dir: str, sinks: dict, checkpoint: str,
                     scenario: Scenario | None = None, as_of: str = "2001-12-31",
                     available_now: bool = True, spend_max_value: float | None = None,
                     max_files_per_trigger: int | None = None, spend_max_path: str | None = None):
    """Start the upload stream; returns the StreamingQuery.  With
    ``spend_max_path`` every batch is scored against that stored normaliser."""
    scenario = scenario or Scenario()
    if spend_max_path and spend_max_value is None:
        spend_max_value = scoring.load_spend_max(spark, spend_max_path)
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = upload_lines(reader, source_dir)
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: upload_batch(df, bid, scenario, as_of, sinks, spend_max_value))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()


def news_stream_frame(spark: SparkSession, source_dir: str, keywords=None, row_tag: str = "item",
                      schema: T.StructType = RSS_SCHEMA, dedup_watermark: str | None = None
                      ) -> DataFrame:
    """Streaming DataFrame of normalised, keyword-filtered items.  The feed
    name is the ``source`` element when the files carry one, else the file
    name."""
    raw = (spark.readStream.format("xml").option("rowTag", row_tag)
           .option("mode", "DROPMALFORMED").schema(schema).load(source_dir))
    if "source" not in schema.fieldNames():
        name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
        raw = raw.withColumn("source", F.url_decode(name))
    items = news.keyword_filter(normalise_items(raw), keywords)
    if dedup_watermark:
        items = (items.withWatermark("published", dedup_watermark)
                 .dropDuplicatesWithinWatermark(["url"]))
    return items


def stream_news(spark: SparkSession, source_dir: str, sink: str, checkpoint: str, keywords=None,
                schema: T.StructType = RSS_SCHEMA, available_now: bool = True,
                dedup_watermark: str | None = None):
    items = news_stream_frame(spark, source_dir, keywords, schema=schema,
                              dedup_watermark=dedup_watermark)
    writer = (items.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="60 seconds")
    return writer.start()
