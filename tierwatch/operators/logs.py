"""Application log tables: normalisation, display lines, recency, and error
categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.errors import classify_error
from .ranking import top_n


def normalise_logs(df: DataFrame, extra: str = "extra") -> DataFrame:
    """Pop request_id, supplier_id and batch_id out of the ``extra`` map."""
    e = F.col(extra)
    keys = F.array(*[F.lit(k) for k in C.LOG_ID_KEYS])
    ids = [F.element_at(e, F.lit(k)).alias(k) for k in C.LOG_ID_KEYS]
    rest = F.map_filter(e, lambda k, v: ~F.array_contains(keys, k))
    others = [c for c in df.columns if c != extra and c not in C.LOG_ID_KEYS]
    return df.select(*others, *ids, rest.alias(extra))


def _pad_level(level: Column) -> Column:
    """Left-aligned to 8 characters, never cut (rpad would truncate)."""
    return F.when(F.char_length(level) < C.LOG_LEVEL_WIDTH,
                  F.rpad(level, C.LOG_LEVEL_WIDTH, " ")).otherwise(level)


def format_logs(df: DataFrame, ts: str = "timestamp", extra: str = "extra") -> DataFrame:
    """``HH:MM:SS | LEVEL    | message | k=v k=v`` of the raw records at INFO
    or above: every extra is shown, a null value as None (no extra part when
    the map is empty)."""
    df = df.where(F.col("level").isin(*C.LOG_LEVELS_SHOWN))
    pairs = F.array_join(F.transform(F.map_entries(F.col(extra)), lambda x: F.concat(
        x["key"], F.lit("="), F.coalesce(x["value"], F.lit("None")))), " ")
    extra_part = F.nullif(F.coalesce(pairs, F.lit("")), F.lit(""))
    line = F.concat_ws(" | ", F.date_format(F.col(ts), "HH:mm:ss"), _pad_level(F.col("level")),
                       F.col("message"), extra_part)
    return df.withColumn("line", line)


def recent_logs(df: DataFrame, n: int = C.LOG_BUFFER, ts: str = "timestamp",
                ordinal: str | None = None) -> DataFrame:
    """The newest ``n`` records at INFO or above, newest first."""
    df = df.where(F.col("level").isin(*C.LOG_LEVELS_SHOWN))
    order = [F.col(ts).desc_nulls_last()]
    if ordinal:
        order.append(F.col(ordinal).desc_nulls_last())
    return top_n(df, order, n, ordered=True)


def with_category(df: DataFrame, status: str | None = "status", message: str = "message") -> DataFrame:
    st = F.col(status) if status and status in df.columns else None
    return df.withColumn("category", classify_error(st, F.col(message)))


def error_categories(df: DataFrame, status: str | None = "status", message: str = "message") -> DataFrame:
    """Rows per error category (partial aggregation; five groups)."""
    return (with_category(df, status, message).groupBy("category")
            .agg(F.count(F.lit(1)).alias("n")))
