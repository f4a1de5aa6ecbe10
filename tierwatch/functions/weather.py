"""Shipping-risk rule and the weather-code lookup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from .cache import column_cache


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@column_cache
def shipping_risk(wind, precip) -> Column:
    """SEVERE / HIGH / MODERATE / LOW from wind km/h and precipitation %."""
    w, p = _c(wind), _c(precip)
    out = None
    for level, wind_min, precip_min in C.SHIPPING_RISK:
        cond = (w >= wind_min) | (p >= precip_min)
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit(C.SHIPPING_RISK_DEFAULT))


def condition_table(spark: SparkSession) -> DataFrame:
    """28-row weather-code dimension (fixed size, safe to broadcast)."""
    schema = T.StructType([
        T.StructField("code", T.IntegerType(), False),
        T.StructField("condition", T.StringType(), False),
    ])
    return spark.createDataFrame(sorted(C.WEATHER_CONDITIONS.items()), schema)
