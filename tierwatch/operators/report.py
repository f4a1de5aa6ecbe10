"""Report content as tidy tables: KPI texts, region table, top-10 rows with
latin-1 safe text, and the top narratives.  Layout (PDF/HTML) is not
built; these tables are what a renderer consumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bands import risk_band
from ..functions.text import fold_text
from . import rollups
from .narrative import top_narratives


def kpi_table(scored: DataFrame) -> DataFrame:
    """KPIs with their display text: thousands separators and 3 decimals."""
    k = rollups.kpis(scored)
    return k.select(
        F.format_number(F.col("total_suppliers"), 0).alias("total_suppliers_text"),
        F.format_string("%.3f", F.col("avg_risk")).alias("avg_risk_text"),
        F.format_number(F.col("high_risk_count"), 0).alias("high_risk_text"),
        F.format_number(F.col("critical_count"), 0).alias("critical_text"))


def top_table(scored: DataFrame, n: int = C.TOP_RISKS) -> DataFrame:
    """Top-n rows as report cells: cut to 22/40/16 characters, then folded
    to latin-1; risk with 3 decimals and its band."""
    from ..session import ship_package
    ship_package(scored.sparkSession)          # text folding runs on the workers
    top = rollups.top_risks(scored, n)
    return top.select(
        fold_text("supplier_id", C.REPORT_ID_WIDTH).alias("entity_id"),
        fold_text("supplier_name", C.REPORT_NAME_WIDTH).alias("name"),
        F.format_string("%.3f", F.col("composite_risk")).alias("risk"),
        risk_band("composite_risk").alias("band"),
        fold_text("region", C.REPORT_REGION_WIDTH).alias("region"),
        F.col("composite_risk"))


def report_tables(scored: DataFrame, attributed_narratives: DataFrame | None = None) -> dict:
    """Named DataFrames for one report; write each with any sink."""
    out = {
        "kpis": kpi_table(scored),
        "regions": rollups.region_rollup(scored),
        "top": top_table(scored),
    }
    if attributed_narratives is not None:
        out["narratives"] = top_narratives(attributed_narratives)
    return out
