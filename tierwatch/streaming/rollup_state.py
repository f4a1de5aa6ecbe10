"""Rollups over growing uploads without scanning earlier ones again.

A row's composite is ``A + B / L``: A the weighted parts that its own values
give, B the weighted logarithm of its spend, L the largest logarithm of all
spends, which every new upload may raise.  So a row is at or above a bound b
as long as L does not pass its crossing point ``B / (b - A)``.  Per upload,
scenario, region and bound, the state counts rows by their crossing point in
steps of 1 / STEPS and sums A and B; beside it lie the rows themselves, sorted
by step.  For any L, every step above L counts whole, every step below not at
all, and only the rows in the step around L are read (the filter reaches the
files, whose row groups hold a range of steps each) and scored as
``operators.scoring`` does: exact counts from a small part of the rows.

``add`` writes the state of one or more uploads, named by their contents, so
that adding one again replaces equal folders; the maxima come last and make
it count.  ``load`` merges all uploads or those listed.  Inputs are accepted
uploads: their components lie between 0 and 1, so the clip of the composite
never acts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bands import band_rank, risk_band
from ..operators.scoring import composite, log_spend, with_components
from ..scenario import Scenario
from .incremental import scenario_key

#: Steps of the crossing points in one unit of log spend; the last holds all beyond it.
STEPS, LAST = 8, 8 * 64
#: Crossing steps of rows that are above for every L, and of rows too close to their bound to tell.
ALWAYS, CLOSE = LAST + 1, -1
_NEAR, _EDGE = 1e-7, 1e-6
_KEYS = ["upload", "scenario", "region", "bound"]
_FIXED = [c for i, c in enumerate(C.COMPONENTS) if i != 1]


def bounds(scenario: Scenario) -> list[tuple[float, bool]]:
    """(value, inclusive): the scenario's lower threshold, the bands within it,
    and what lies above the upper threshold."""
    low = float(scenario.min_risk_threshold)
    return [(low, True), *((max(low, float(b)), True) for _, b in sorted(C.BANDS, key=lambda x: x[1])),
            (float(scenario.max_risk_threshold), False)]


def _name(scenario: Scenario, as_of) -> str:
    return f"{scenario_key(scenario)}-{as_of}"


def _crossing(fixed: Column, spend: Column, value: Column) -> Column:
    step = F.floor(F.least(spend / (value - fixed) * STEPS, F.lit(float(LAST))))
    return (F.when(F.abs(fixed - value) <= _NEAR, CLOSE).when(fixed > value, ALWAYS)
            .when(spend > 0, step).cast("int"))


def add(uploads: DataFrame, upload: str, scenario: Scenario, as_of, path: str) -> None:
    """State of the uploads named by the column ``upload``, under ``path``:
    maxima, counts and rows by step."""
    weights = scenario.weights
    # the normaliser is not known yet: log spends take the financial part's place
    rows = with_components(uploads, as_of, 1.0).withColumn("log_spend", log_spend()).select(
        F.col(upload).cast("string").alias("upload"), F.lit(_name(scenario, as_of)).alias("scenario"), "region", "log_spend", *_FIXED)
    spend = F.lit(float(weights[1])) * F.coalesce(F.col("log_spend"), F.lit(0.0))
    fixed = sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, C.COMPONENTS) if c in _FIXED), F.lit(0.0))
    tops = rows.groupBy("upload", "scenario").agg(F.max("log_spend").alias("log_max"))
    if scenario.regions:
        rows = rows.where(F.col("region").isin(*scenario.regions))
    listed = F.array(*[F.struct(F.lit(i).alias("bound"), F.lit(v).alias("value")) for i, (v, _) in enumerate(bounds(scenario))])
    placed = (rows.withColumns({"fixed": fixed, "spend": spend}).select("*", F.inline(listed))
              .withColumn("step", _crossing(F.col("fixed"), F.col("spend"), F.col("value"))).where("step is not null"))
    counts = placed.groupBy(*_KEYS, "step").agg(F.count(F.lit(1)).alias("n"), F.sum("fixed").alias("fixed"), F.sum("spend").alias("spend"))
    _write(counts, f"{path}/counts", ["scenario", "upload"])
    detail = placed.where(F.col("step") != ALWAYS).select(*_KEYS, "step", "log_spend", "fixed", "spend", *_FIXED)
    _write(detail.hint("rebalance", "upload").sortWithinPartitions("upload", "step"), f"{path}/rows", ["scenario", "upload"])
    _write(tops, f"{path}/maxima", ["scenario", "upload"])


def _write(df: DataFrame, path: str, folders: list[str]) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path))


def _read(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[kind]).parquet(f"{path}/{kind}").where(F.col("scenario") == name)


_SCHEMAS = {
    "maxima": "log_max double, scenario string, upload string",
    "counts": "region string, bound int, step int, n bigint, fixed double, spend double, scenario string, upload string",
    "rows": ("region string, bound int, log_spend double, fixed double, spend double, "
             + ", ".join(f"{c} double" for c in _FIXED) + ", step int, scenario string, upload string"),
}


def load(spark: SparkSession, path: str, scenario: Scenario, as_of, uploads: list[str] | None = None) -> DataFrame:
    """(region, n, risk_sum, at_least_<i> for each bound): the merged rollup
    of all uploads, or of those listed."""
    name = _name(scenario, as_of)
    tops = _read(spark, path, "maxima", name)
    if uploads is not None:
        tops = tops.where(F.col("upload").isin(*uploads))
    # this one value decides which row groups the scan reads
    top = float(tops.agg(F.max("log_max")).first()[0] or 0.0)
    low, high = (min(int((top + e) * STEPS // 1), LAST) for e in (-_EDGE, _EDGE))
    scale = F.lit(1.0 / top if top > 0 else 0.0)
    whole = _read(spark, path, "counts", name).where(F.col("step") > high)
    around = _read(spark, path, "rows", name).where(F.col("step").isin(CLOSE, *range(low, high + 1)))
    whole, around = (x.join(tops.select("upload"), "upload", "left_semi") for x in (whole, around))
    ratio = F.coalesce(F.nanvl(F.try_divide(F.col("log_spend"), F.lit(top)), F.lit(0.0)), F.lit(0.0))
    risk = composite(scenario.weights)
    above = F.lit(False)
    for i, (value, inclusive) in enumerate(bounds(scenario)):
        above = above | ((F.col("bound") == i) & ((risk >= value) if inclusive else (risk > value)))
    near = around.withColumn(C.COMPONENTS[1], ratio).where(above).withColumn("n", F.lit(1))
    cols = ["region", "bound", "n", "fixed", "spend"]
    sums = [F.sum("n").alias("n"), F.sum(F.col("fixed") + F.col("spend") * scale).alias("risk")]
    total = whole.select(*cols).unionByName(near.select(*cols)).groupBy("region", "bound").agg(*sums)
    last = len(bounds(scenario)) - 1
    at = lambda i, c: F.coalesce(F.max(F.when(F.col("bound") == i, F.col(c))), F.lit(0))
    beyond = at(last, "n")
    least = [F.greatest(at(i, "n") - beyond, F.lit(0)) for i in range(last)]
    out = total.groupBy("region").agg((at(0, "n") - beyond).alias("n"), (at(0, "risk") - at(last, "risk")).alias("risk_sum"),
                                      *[c.alias(f"at_least_{i}") for i, c in enumerate(least)])
    return out.where("n > 0")


def kpis(rollup: DataFrame) -> DataFrame:
    """As ``operators.rollups.kpis``."""
    bands = [float(b) for _, b in sorted(C.BANDS, key=lambda x: x[1])]
    count = lambda b: F.coalesce(F.sum(f"at_least_{1 + bands.index(b)}"), F.lit(0))
    return rollup.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_suppliers"),
                      F.coalesce(F.try_divide(F.sum("risk_sum"), F.sum("n")), F.lit(0.0)).alias("avg_risk"),
                      count(C.HIGH_RISK).alias("high_risk_count"), count(C.CRITICAL_RISK).alias("critical_count"))


def region_rollup(rollup: DataFrame) -> DataFrame:
    """As ``operators.rollups.region_rollup``."""
    return rollup.select("region", (F.col("risk_sum") / F.col("n")).alias("avg_risk"), F.col("n").alias("supplier_count")).withColumn(
        "band", risk_band("avg_risk")).orderBy(F.col("avg_risk").desc(), F.col("region").asc_nulls_last())


def band_counts(rollup: DataFrame) -> DataFrame:
    """As ``operators.rollups.band_counts``."""
    names = [n for n, _ in sorted(C.BANDS, key=lambda x: x[1])]
    least = [F.col("n"), *[F.col(f"at_least_{1 + i}") for i in range(len(names))], F.lit(0)]
    within = [("LOW", least[0] - least[1]), *((n, least[i + 1] - least[i + 2]) for i, n in enumerate(names))]
    summed = rollup.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in within])
    listed = F.array(*[F.struct(F.lit(n).alias("band"), F.col(n).alias("n")) for n, _ in within])
    return summed.select(F.inline(listed)).withColumn("band_order", band_rank("band")).orderBy("band_order")
