"""Five-part weighted supplier risk score.

Plan shape: the only non-local step is the global max of log1p(spend)
used to normalise the financial component.  It is a scalar subquery: a
one-row aggregate (partial max per task, one-row exchange) evaluated once
and inlined into the projection as a value -- no join, and never an
unpartitioned window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.cache import column_cache
from ..scenario import Scenario
from .ranking import global_rank

_MAX_COL = "_log_spend_max"


def _filled(col: str) -> Column:
    """double; null and NaN -> 0.0"""
    return F.coalesce(F.nanvl(F.col(col).cast("double"), F.lit(0.0)), F.lit(0.0))


def base_component() -> Column:
    return _filled("risk_score")


def log_spend() -> Column:
    # log1p is null for x <= -1 in Spark; coalesce maps that to 0 below.
    return F.log1p(_filled("annual_spend_usd"))


def financial_component(max_col: Column) -> Column:
    ratio = F.try_divide(log_spend(), max_col)
    return F.coalesce(F.nanvl(ratio, F.lit(0.0)), F.lit(0.0))


def operational_component() -> Column:
    tier = F.coalesce(F.col("tier").cast("double"), F.lit(C.NULL_TIER))
    return F.lit(1.0) - (tier - F.lit(1.0)) / F.lit(3.0)


def geopolitical_component() -> Column:
    r = F.col("region")
    out = None
    for name, value in C.GEO_RISK.items():
        out = (F.when(r == name, F.lit(value)) if out is None
               else out.when(r == name, F.lit(value)))
    return out.otherwise(F.lit(C.GEO_RISK_DEFAULT)).cast("double")


def audit_component(as_of, is_date: bool = False) -> Column:
    """Linear staleness clip((as_of - audit)/730, 0, 1); unparsable -> 1.  A
    date column is taken as it is."""
    audit = F.col("last_audit_date")
    if not is_date:
        audit = F.try_to_date(audit.cast("string"), "yyyy-MM-dd")
    age = F.datediff(F.lit(str(as_of)).cast("date"), audit).cast("double")
    # greatest/least skip nulls, so the null case is decided first.
    clipped = F.least(F.greatest(age / F.lit(C.STALENESS_DAYS), F.lit(0.0)), F.lit(1.0))
    return F.when(age.isNull(), F.lit(1.0)).otherwise(clipped)


def spend_max(df: DataFrame) -> DataFrame:
    """One-row frame holding max(log1p(spend)) over the whole input.

    log1p is monotonic, so this is log1p(max(spend)): the partial
    aggregates only compare numbers (log1p runs once, on the result)."""
    return df.agg(F.log1p(F.max(_filled("annual_spend_usd"))).alias(_MAX_COL))


@column_cache
def _plain_components(as_of: str, is_date: bool) -> tuple:
    """The four components that need no global value."""
    return (
        base_component().alias(C.COMPONENTS[0]),
        operational_component().alias(C.COMPONENTS[2]),
        geopolitical_component().alias(C.COMPONENTS[3]),
        audit_component(as_of, is_date).alias(C.COMPONENTS[4]),
    )


def with_components(df: DataFrame, as_of, spend_max_value: float | None = None) -> DataFrame:
    """Add the five component columns.  The financial normaliser is the max
    of log1p(spend) over the *whole* input (before any filter) unless
    ``spend_max_value`` (that value from a stored snapshot, see
    ``store_spend_max`` / ``load_spend_max``) is given."""
    if spend_max_value is None:
        max_col = spend_max(df).scalar()      # scalar subquery over the whole input
    else:
        max_col = F.lit(float(spend_max_value))
    base, op, geo, audit = _plain_components(str(as_of), dict(df.dtypes).get("last_audit_date") == "date")
    fin = financial_component(max_col).alias(C.COMPONENTS[1])
    return df.select("*", base, fin, op, geo, audit)


@column_cache
def composite(weights) -> Column:
    """sum(w_i * c_i) folded left to right from 0.0, clipped to [0, 1]."""
    total = reduce(lambda acc, wc: acc + F.lit(float(wc[0])) * F.col(wc[1]),
                   zip(weights, C.COMPONENTS), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def score(df: DataFrame, scenario: Scenario, as_of, apply_filters: bool = True,
          spend_max_value: float | None = None) -> DataFrame:
    """Input columns + five components + composite_risk.

    The threshold filter is inclusive and only applied with
    ``apply_filters``; the region filter always applies when the scenario
    lists regions (an empty list means no region filter)."""
    out = with_components(df, as_of, spend_max_value)
    out = out.withColumn("composite_risk", composite(scenario.weights))
    if apply_filters:
        out = out.filter(F.col("composite_risk").between(
            float(scenario.min_risk_threshold), float(scenario.max_risk_threshold)))
    if scenario.regions:
        out = out.filter(F.col("region").isin(*scenario.regions))
    return out


def sweep(df: DataFrame, as_of, weightings=None, key: str = "supplier_id") -> DataFrame:
    """Composite under several weight presets at once: components are
    computed once, then each row is repeated once per preset by exploding
    a literal array of the (fixed) preset weights -- a generator, no join."""
    comps = with_components(df, as_of)
    presets = _preset_array(tuple(weightings or C.WEIGHTS))
    expanded = comps.select(key, *C.COMPONENTS, F.inline(presets))
    return expanded.select("weighting", key, *C.COMPONENTS, _sweep_composite())


@column_cache
def _preset_array(names: tuple) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("weighting"),
                 *[F.lit(float(w)).alias(f"w_{c.removeprefix('component_')}")
                   for w, c in zip(C.WEIGHTS[n], C.COMPONENTS)])
        for n in names])


@column_cache
def _sweep_composite() -> Column:
    total = reduce(
        lambda acc, c: acc + F.col(f"w_{c.removeprefix('component_')}") * F.col(c),
        C.COMPONENTS, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("composite_risk")


def rank_by_scenario(swept: DataFrame, key: str = "supplier_id") -> DataFrame:
    """Rank per weighting: composite desc, then id asc (1 = riskiest).

    Uses a distributed range-partitioned rank rather than a window
    partitioned by weighting, which would put a whole preset into one task."""
    return global_rank(swept.select("weighting", key, "composite_risk"), ["weighting"],
                       [F.col("composite_risk").desc(), F.col(key).asc_nulls_last()],
                       "scenario_rank")


def store_spend_max(df: DataFrame, path: str) -> str:
    """Write the normaliser of ``df`` (one row) as a snapshot table, so later
    batches (e.g. stream micro-batches) can be scored on the same scale."""
    spend_max(df).write.mode("overwrite").parquet(path)
    return path


def load_spend_max(spark, path: str) -> float | None:
    """Read a stored normaliser snapshot (one value)."""
    row = spark.read.parquet(path).first()
    return None if row is None or row[0] is None else float(row[0])
