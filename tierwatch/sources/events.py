"""Hourly weather observations and application log records derived from
the events table (deterministic functions of each event's columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cache import column_cache
from .tables import supplier_code

# FIXED VALUES of the derivation (shared with the SQL oracle).
EVENT_WEATHER_CODE = {"view": 0, "click": 61, "error": 95, "purchase": 3, "signup": 100}
ERROR_STATUS = (500, 502, 503, 504, 401, 403, 429)
ERROR_MESSAGES = (
    "upstream said 429, slow down",
    "daily quota used up",
    "no answer: timeout after 30 s",
    "schema check: validation failed for 3 rows",
    "request refused: unauthorized",
    "disk is full on node 7",
)
EVENT_LEVEL = {"error": "ERROR", "signup": "WARNING", "click": "DEBUG"}


def _k():
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def weather_observations(events: DataFrame) -> DataFrame:
    """location_id = user, one observation per event: wind = value (null on
    every 97th event), precipitation and temperature from the event id,
    weather code from the event type."""
    return events.select(*_observation_columns())


@column_cache
def _observation_columns() -> tuple:
    eid = F.col("event_id")
    code_map = F.create_map(*[F.lit(x) for kv in EVENT_WEATHER_CODE.items() for x in kv])
    return (
        F.col("user_id").alias("location_id"),
        eid,
        F.col("ts").alias("hour"),
        F.when(eid % 97 != 0, F.col("value")).alias("wind"),
        ((eid * 37) % 101).cast("double").alias("precip"),
        (((eid * 13) % 60) - 10).cast("double").alias("temp"),
        F.element_at(code_map, F.col("event_type")).cast("int").alias("code"),
    )


def log_records(events: DataFrame) -> DataFrame:
    """timestamp, level, message, module, function, line, status, extra."""
    return events.select(*_log_columns())


@column_cache
def _log_columns() -> tuple:
    eid, et = F.col("event_id"), F.col("event_type")
    is_err = et == "error"
    status = F.element_at(F.array(*[F.lit(s) for s in ERROR_STATUS]),
                          (eid % len(ERROR_STATUS) + 1).cast("int"))
    message = F.element_at(F.array(*[F.lit(m) for m in ERROR_MESSAGES]),
                           (eid % len(ERROR_MESSAGES) + 1).cast("int"))
    level = F.coalesce(F.element_at(
        F.create_map(*[F.lit(x) for kv in EVENT_LEVEL.items() for x in kv]), et), F.lit("INFO"))
    extra = F.create_map(
        F.lit("request_id"), eid.cast("string"),
        F.lit("supplier_id"), supplier_code(F.col("user_id")),
        F.lit("batch_id"), F.when(eid % 3 == 0, F.concat(F.lit("B"), F.floor(eid / 100).cast("string"))),
        F.lit("event_type"), et,
        F.lit("k"), _k().cast("string"))
    return (
        eid,
        F.col("ts").cast("timestamp").alias("timestamp"),
        level.alias("level"),
        F.when(is_err, message).otherwise(F.concat(et, F.lit(" event "), F.col("props"))).alias("message"),
        F.lit("events").alias("module"),
        et.alias("function"),
        _k().alias("line"),
        F.when(is_err, status).alias("status"),
        extra.alias("extra"),
    )
