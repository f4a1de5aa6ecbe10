"""Read the given parquet tables and derive the supplier-risk views from them.

The test tables are a TPC-H style star schema; the supplier-risk operators
need a supplier table with the nine supplier columns.  ``supplier_facts``
derives one row per supplier (spend aggregated from lineitem) and
``line_exposures`` one row per lineitem, so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cache import column_cache


# FIXED VALUES of the derivation (shared with the SQL oracle).
AUDIT_EPOCH = "1998-01-01"
AUDIT_SPAN_DAYS = 1460
AS_OF = "2001-12-31"          # scoring date for supplier_facts
LINES_AS_OF = "1999-06-30"    # scoring date for line_exposures


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` under ``sf_dir``, listed anew on every call (a
    table may grow within a session)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_code(k: Column) -> Column:
    """SUP- and the key with at least six digits (longer keys stay whole)."""
    return F.when(k.isNotNull(), F.format_string("SUP-%06d", k))


def _supplier_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation + region names.  No hint: the planner broadcasts them from
    their file statistics (and AQE from runtime statistics) when they are
    under spark.sql.autoBroadcastJoinThreshold, else it shuffles."""
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")


def _region_label() -> Column:
    return (F.when(F.col("r_name") == "ASIA", F.lit("APAC"))
            .when((F.col("r_name") == "AMERICA") & (F.col("n_nationkey") % 2 == 0), F.lit("NA"))
            .when(F.col("r_name") == "AMERICA", F.lit("LATAM"))
            .otherwise(F.lit("EMEA")))


def supplier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-supplier attributes except spend: s_suppkey + 8 supplier columns."""
    sup = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    sup = sup.join(_supplier_geo(spark, sf_dir),
                   F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return sup.select(*_profile_columns())


@column_cache
def _profile_columns() -> tuple:
    k = F.col("s_suppkey")
    audit = F.date_format(
        F.date_add(F.lit(AUDIT_EPOCH).cast("date"), ((k * 37) % AUDIT_SPAN_DAYS).cast("int")),
        "yyyy-MM-dd")
    return (
        k,
        supplier_code(k).alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        ((k * 37 + F.col("s_nationkey") * 11) % 128 / F.lit(128.0)).alias("risk_score"),
        (F.lit(65.0) - F.col("s_nationkey") * 4 - k % 16 / F.lit(8.0)).alias("latitude"),
        (F.col("s_nationkey") * 12 + k % 64 / F.lit(8.0) - F.lit(140.0)).alias("longitude"),
        _region_label().alias("region"),
        ((F.floor(k / 7) % 4) + 1).cast("bigint").alias("tier"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(audit).alias("last_audit_date"),
    )


def supplier_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact per-supplier spend: decimal sum (order-independent), partial
    aggregation before the shuffle on l_suppkey."""
    li = load(spark, sf_dir, "lineitem")
    line = (F.col("l_extendedprice").cast("decimal(15,2)")
            * (F.lit(1.0) - F.col("l_discount")).cast("decimal(15,2)"))
    return (li.groupBy("l_suppkey")
            .agg(F.sum(line).cast("decimal(28,4)").alias("spend_dec")))


def supplier_facts(spark: SparkSession, sf_dir: str, keep_key: bool = False) -> DataFrame:
    """One row per supplier with the nine supplier columns (plus s_suppkey
    when ``keep_key``)."""
    prof = supplier_profile(spark, sf_dir)
    spend = supplier_spend(spark, sf_dir)
    k = F.col("s_suppkey")
    scale = F.pow(F.lit(10.0), -(k % 6)).cast("decimal(6,5)")
    spend_usd = F.round(F.coalesce(F.col("spend_dec"), F.lit(0).cast("decimal(28,4)")) * scale, 2)
    out = prof.join(spend, k == F.col("l_suppkey"), "left")
    return out.select(
        *(["s_suppkey"] if keep_key else []),
        "supplier_id", "supplier_name", "risk_score", "latitude", "longitude",
        "region", "tier", spend_usd.cast("double").alias("annual_spend_usd"),
        "last_audit_date")


def line_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem: the supplier's attributes (null where the table
    lacks it), the line's spend and ship date as the audit date.  The join on
    l_suppkey is skew-prone (one supplier may own a large share of lines);
    AQE splits hot partitions and broadcasts the profile side when its
    runtime size allows."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("annual_spend_usd"),
        F.col("l_shipdate").cast("date").alias("last_audit_date"))
    prof = supplier_profile(spark, sf_dir).drop("last_audit_date")
    return li.join(prof, F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("s_suppkey")


def sanctions_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, entity_name, list_source derived from supplier: every 5th
    supplier on OFAC, every 15th also on EU (fan-out), every 35th also on a
    list without a source name."""
    k = F.col("s_suppkey")
    parts = [(5, F.lit("OFAC")), (15, F.lit("EU")), (35, F.lit(None).cast("string"))]
    entries = F.array_compact(F.array(*[
        F.when(k % mod == 0, F.struct(src.alias("list_source"))) for mod, src in parts]))
    return load(spark, sf_dir, "supplier").select(
        supplier_code(k).alias("entity_id"), F.col("s_name").alias("entity_name"), F.inline(entries))
