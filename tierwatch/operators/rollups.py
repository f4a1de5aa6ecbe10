"""Portfolio rollups over a scored table: KPIs, region averages, band
histogram, ledger, top-k and the spend-vs-risk matrix.

All aggregates are partial (map-side) aggregates followed by a tiny
exchange; region and band have a handful of values, so we never
repartition by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.bands import band_rank, risk_band
from .ranking import top_n

RISK = "composite_risk"


def kpis(scored: DataFrame) -> DataFrame:
    """One row: supplier count, mean composite (0.0 when empty), counts at
    or above 0.70 and 0.85 (critical rows are in both counts)."""
    r = F.col(RISK)
    return scored.agg(
        F.count(F.lit(1)).alias("total_suppliers"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("avg_risk"),
        F.count_if(r >= C.HIGH_RISK).alias("high_risk_count"),
        F.count_if(r >= C.CRITICAL_RISK).alias("critical_count"),
    )


def region_rollup(scored: DataFrame) -> DataFrame:
    """Mean composite and supplier count per region, riskiest first; the
    band of the mean gives the bar colour."""
    agg = scored.groupBy("region").agg(
        F.avg(RISK).alias("avg_risk"),
        F.count("supplier_id").alias("supplier_count"))
    return (agg.withColumn("band", risk_band("avg_risk"))
            .orderBy(F.col("avg_risk").desc(), F.col("region").asc_nulls_last()))


def band_counts(scored: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Rows per band, CRITICAL first.  With ``keep_empty`` the four bands
    are always present (zero counts kept)."""
    counts = scored.groupBy(risk_band(RISK).alias("band")).agg(
        F.count(F.lit(1)).alias("n"))
    if keep_empty:
        spark = scored.sparkSession
        bands = spark.createDataFrame([(b,) for b in C.BAND_ORDER],
                                      T.StructType([T.StructField("band", T.StringType(), False)]))
        counts = (F.broadcast(bands).join(counts, "band", "left")
                  .select("band", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))
    return counts.withColumn("band_order", band_rank("band")).orderBy("band_order")


def ledger(scored: DataFrame) -> DataFrame:
    """Full ledger, riskiest first (a distributed range sort)."""
    return scored.orderBy(F.col(RISK).desc(), F.col("supplier_id").asc_nulls_last()).select(
        "supplier_id", "supplier_name", "region", "tier", RISK, "annual_spend_usd")


def top_risks(scored: DataFrame, n: int = C.TOP_RISKS) -> DataFrame:
    """Top-n by composite with band (per-task top-n, then a merge).
    Without a composite column, the first n rows by id."""
    if RISK not in scored.columns:
        return top_n(scored, [F.col("supplier_id").asc_nulls_last()], n, ordered=True)
    top = top_n(scored, [F.col(RISK).desc(), F.col("supplier_id").asc_nulls_last()], n, ordered=True)
    return top.select("supplier_id", "supplier_name", RISK, "region",
                      risk_band(RISK).alias("band"))


def risk_matrix(scored: DataFrame) -> DataFrame:
    """Scatter input: log10 spend (where > 0) vs composite, by region,
    sized by tier."""
    spend = F.col("annual_spend_usd")
    return scored.select(
        "supplier_id", "supplier_name", "region", "tier", "annual_spend_usd", RISK,
        F.when(spend > 0, F.log10(spend)).alias("log_spend"))


def sample_rows(df: DataFrame, n: int = 500, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by an explicit order (a demo/preview sample);
    a bounded top-k, merged from per-task top-k lists."""
    keys = order or ["supplier_id"]
    return top_n(df, [F.col(k).asc_nulls_last() for k in keys], n, ordered=True)
