"""Deterministic dirty and faulty variants of the supplier views.

They exercise cleansing and the quality gate on data Spark derives from the
given tables: each row's decoration or fault is a fixed function of its
integer key, so the SQL oracle can build the identical input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cache import column_cache
from .tables import supplier_code

NBSP = "\u00a0"
EM_SPACE = "\u2003"
TAB = "\t"


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _tail(c: Column, start: int) -> Column:
    return F.substring(c, start, 1 << 30)


def dirty_text(df: DataFrame, key: str) -> DataFrame:
    """All nine supplier columns as messy text: padding (ASCII, NBSP, EM
    SPACE, tab), inner spaces, null tokens, Java numeric suffixes and
    fractional tiers."""
    return df.select(*_dirty_columns(key))


@column_cache
def _dirty_columns(key: str) -> tuple:
    k = F.col(key)
    sid, name, region = _s("supplier_id"), _s("supplier_name"), _s("region")
    risk, lat, lon = _s("risk_score"), _s("latitude"), _s("longitude")
    tier, spend, audit = _s("tier"), _s("annual_spend_usd"), _s("last_audit_date")
    return (
        k.alias(key),
        F.when(k % 5 == 0, F.concat(F.lit("  "), sid, F.lit(" ")))
         .when(k % 5 == 1, F.concat(F.substring(sid, 1, 4), F.lit(" "), _tail(sid, 5)))
         .when(k % 5 == 2, F.concat(F.lit(NBSP), sid))
         .otherwise(sid).alias("supplier_id"),
        F.when(k % 9 == 0, F.lit("N/A"))
         .when(k % 4 == 0, F.concat(F.lit(" "), name, F.lit(EM_SPACE)))
         .when(k % 4 == 2, F.lit("N U L L"))
         .otherwise(name).alias("supplier_name"),
        F.when(k % 6 == 0, F.concat(F.lit(" "), risk, F.lit(" ")))
         .when(k % 6 == 1, F.concat(F.substring(risk, 1, 1), F.lit(" "), _tail(risk, 2)))
         .when(k % 6 == 2, F.concat(risk, F.lit("d")))
         .when(k % 6 == 3, F.lit("N/A"))
         .otherwise(risk).alias("risk_score"),
        F.when(k % 7 == 0, F.concat(lat, F.lit("e0")))
         .when(k % 7 == 1, F.lit(""))
         .otherwise(lat).alias("latitude"),
        F.when(k % 8 == 0, F.concat(F.lit("+"), lon))
         .otherwise(lon).alias("longitude"),
        F.when(k % 10 == 1, F.concat(F.substring(region, 1, 2), F.lit(" "), _tail(region, 3)))
         .when(k % 10 == 2, F.lit("N U L L"))
         .when(k % 10 == 3, F.lit("NULL"))
         .when(k % 3 == 0, F.concat(F.lit("  "), region, F.lit(TAB)))
         .otherwise(region).alias("region"),
        F.when(k % 5 == 3, F.concat(tier, F.lit(".0")))
         .when(k % 5 == 4, F.concat(F.lit(" "), tier))
         .otherwise(tier).alias("tier"),
        F.when(k % 4 == 3, F.concat(F.substring(spend, 1, 1), F.lit(" "), _tail(spend, 2)))
         .otherwise(spend).alias("annual_spend_usd"),
        F.when(k % 11 == 0, F.lit("null"))
         .when(k % 3 == 1, F.concat(F.lit(" "), audit, F.lit(" ")))
         .when(k % 3 == 2, F.replace(audit, F.lit("-"), F.lit(" - ")))
         .otherwise(audit).alias("last_audit_date"),
    )


def faulty_facts(df: DataFrame, key: str) -> DataFrame:
    """Supplier facts with rule violations injected by key: duplicate ids,
    empty names, out-of-range and missing numbers, unknown regions, bad
    tiers, negative spend and malformed audit dates."""
    return df.select(*_faulty_columns(key))


@column_cache
def _faulty_columns(key: str) -> tuple:
    k = F.col(key)
    prev_id = supplier_code(k - 1)
    return (
        k.alias(key),
        F.when(k % 19 == 7, prev_id).otherwise(F.col("supplier_id")).alias("supplier_id"),
        F.when(k % 29 == 3, F.lit("")).otherwise(F.col("supplier_name")).alias("supplier_name"),
        F.when(k % 17 == 5, F.col("risk_score") + F.lit(1.5))
         .when(k % 23 == 11, F.lit(None).cast("double"))
         .otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(k % 31 == 2, F.col("latitude") + F.lit(200.0))
         .otherwise(F.col("latitude")).alias("latitude"),
        F.when(k % 37 == 9, F.lit(float("nan")))
         .otherwise(F.col("longitude")).alias("longitude"),
        F.when(k % 13 == 4, F.lit("MARS"))
         .when(k % 41 == 6, F.lit(None).cast("string"))
         .otherwise(F.col("region")).alias("region"),
        F.when(k % 11 == 10, F.lit(5).cast("bigint"))
         .otherwise(F.col("tier")).alias("tier"),
        F.when(k % 43 == 12, -(k % 1000).cast("double") - F.lit(0.5))
         .otherwise(F.col("annual_spend_usd")).alias("annual_spend_usd"),
        F.when(k % 7 == 3, F.replace(F.col("last_audit_date"), F.lit("-"), F.lit("/")))
         .when(k % 47 == 20, F.lit("2025-02-30"))
         .otherwise(F.col("last_audit_date")).alias("last_audit_date"),
    )


# Component short names used as narrative key risks (in component order).
RISK_NAMES = ("base", "financial", "operational", "geopolitical", "audit_staleness")


def narratives_from_scored(scored: DataFrame, key: str) -> DataFrame:
    """Stand-in model output, one narrative per scored supplier plus a later
    second one for every 13th: some without an echoed id (resolved by name),
    some with an unknown id and name (UNKNOWN), and contract breaches
    (unknown level, four key risks, confidence above 1)."""
    from ..functions.bands import risk_band
    k = F.col(key)
    key_risks = F.array_compact(F.array(*[
        F.when(F.round(F.col(f"component_{n}"), 6) >= 0.5, F.lit(n)) for n in RISK_NAMES]))
    base = scored.select(
        k.alias(key),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
         .when(k % 11 == 0, F.concat(F.lit("SUP-X"), k.cast("string")))
         .otherwise(F.col("supplier_id")).alias("supplier_id"),
        F.when((k % 11 == 0) & (k % 2 == 0), F.concat(F.lit("Ghost "), k.cast("string")))
         .otherwise(F.col("supplier_name")).alias("supplier_name"),
        F.when(k % 23 == 0, F.lit("SEVERE"))
         .otherwise(risk_band("composite_risk")).alias("overall_risk"),
        key_risks.alias("key_risks"),
        F.concat(F.lit("Review "), F.col("supplier_name")).alias("recommendation"),
        F.when(k % 29 == 0, F.lit(1.2))
         .otherwise(F.round(F.col("composite_risk"), 3)).alias("confidence"),
        (k * 2).alias("ordinal"),
    )
    first = F.struct("recommendation", "confidence", "ordinal")
    later = F.struct(F.concat(F.lit("Escalate "), F.col("supplier_name")).alias("recommendation"),
                     F.round(F.col("confidence") / 2, 3).alias("confidence"),
                     (F.col("ordinal") + 1).alias("ordinal"))
    both = F.array_compact(F.array(first, F.when(k % 13 == 0, later)))
    return base.select(key, "supplier_id", "supplier_name", "overall_risk", "key_risks", F.inline(both))
