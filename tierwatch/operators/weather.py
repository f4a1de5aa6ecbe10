"""Worst-wind hour per location and its shipping risk.

Two input shapes:

* landed forecast payloads (one JSON document per location with four
  parallel, possibly ragged hourly arrays) -> ``worst_hour_arrays``: pure
  array functions on one row, no shuffle;
* hourly observations as rows -> ``worst_hour``: a ``max_by`` aggregate per
  location (partial aggregation, so a location with a huge share of rows
  costs one value per task before the shuffle).

Both pick the first hour with the maximum wind; missing values take the
fixed defaults (wind 0, precipitation 0, temperature 20, code 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.weather import condition_table, shipping_risk

D = C.WEATHER_DEFAULTS

HOURLY_SCHEMA = T.StructType([
    T.StructField("hourly", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m", T.ArrayType(T.DoubleType())),
        T.StructField("windspeed_10m", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation_probability", T.ArrayType(T.DoubleType())),
        T.StructField("weathercode", T.ArrayType(T.IntegerType())),
    ])),
])


def parse_weather(df: DataFrame, json_col: str = "payload") -> DataFrame:
    """Landed forecast JSON -> ``hourly`` struct of arrays (missing -> null)."""
    return df.withColumn("_w", F.from_json(F.col(json_col), HOURLY_SCHEMA)).select(
        *[c for c in df.columns if c != json_col], F.col("_w.hourly").alias("hourly"))


def _or_default(arr: Column, default, dtype: str) -> Column:
    """Missing or empty array -> [default]."""
    lit = F.array(F.lit(default).cast(dtype))
    return F.when(F.coalesce(F.size(arr), F.lit(-1)) <= 0, lit).otherwise(arr)


def worst_hour_arrays(df: DataFrame, hourly: str = "hourly") -> DataFrame:
    """Report of the first worst-wind hour from four ragged arrays."""
    h = F.col(hourly)
    wind = _or_default(h["windspeed_10m"], D["wind"], "double")
    precip = _or_default(h["precipitation_probability"], D["precip"], "double")
    temp = _or_default(h["temperature_2m"], D["temp"], "double")
    code = _or_default(h["weathercode"], D["code"], "int")
    # arrays_zip pads the shorter arrays with nulls -> defaults below.
    zipped = F.arrays_zip(wind.alias("w"), precip.alias("p"), temp.alias("t"), code.alias("c"))
    indexed = F.transform(zipped, lambda x, i: F.struct(
        F.coalesce(x["w"], F.lit(D["wind"])).alias("wind"),
        (-i).alias("neg_index"),
        F.coalesce(x["p"], F.lit(D["precip"])).alias("precip"),
        F.coalesce(x["t"], F.lit(D["temp"])).alias("temp"),
        F.coalesce(x["c"], F.lit(D["code"])).alias("code")))
    best = F.array_max(indexed)
    out = df.withColumn("_best", best)
    return _report(out.select(
        *[c for c in df.columns if c != hourly],
        (-F.col("_best.neg_index")).alias("hour_index"),
        F.col("_best.temp").alias("temperature_c"),
        F.col("_best.wind").alias("wind_kmh"),
        F.col("_best.precip").alias("precip_prob_pct"),
        F.col("_best.code").alias("weather_code")))


def worst_hour(obs: DataFrame, key: str, hour: str, wind: str, precip: str, temp: str,
               code: str, tie: str | None = None) -> DataFrame:
    """Per ``key``: the observation with the highest wind, earliest hour
    first on ties (then the smallest ``tie`` value)."""
    w = F.coalesce(F.col(wind).cast("double"), F.lit(D["wind"]))
    order = [w.alias("w"), (-F.unix_micros(F.col(hour).cast("timestamp"))).alias("h")]
    if tie:
        order.append((-F.col(tie)).alias("t"))
    payload = F.struct(
        F.col(hour).alias("hour"),
        F.coalesce(F.col(temp).cast("double"), F.lit(D["temp"])).alias("temperature_c"),
        w.alias("wind_kmh"),
        F.coalesce(F.col(precip).cast("double"), F.lit(D["precip"])).alias("precip_prob_pct"),
        F.coalesce(F.col(code).cast("int"), F.lit(D["code"])).alias("weather_code"))
    best = obs.groupBy(key).agg(F.max_by(payload, F.struct(*order)).alias("b"))
    return _report(best.select(key, "b.*"))


def _report(df: DataFrame) -> DataFrame:
    """Attach condition text (28-row fixed table, broadcast) and risk level."""
    cond = F.broadcast(condition_table(df.sparkSession))
    out = df.join(cond, df["weather_code"] == cond["code"], "left").drop("code")
    return out.withColumn("condition", F.coalesce(F.col("condition"), F.lit(C.CONDITION_UNKNOWN))) \
              .withColumn("risk_level", shipping_risk("wind_kmh", "precip_prob_pct"))
