"""Map-ready payloads: capped, escaped points with colour and radius; the
map centre; and the three-column cluster payload.

The cap keeps a deterministic top-N (riskiest first), see ``ranking.top_n_by_score``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bands import fill_risk, risk_display, risk_radius, risk_rgb
from ..functions.text import html_escape
from ..scenario import Scenario
from .ranking import top_n, top_n_by_score

FEW = 10_000        # rows that every task may send to the last one


def risk_column(df: DataFrame) -> str:
    return "composite_risk" if "composite_risk" in df.columns else "risk_score"


def map_points(scored: DataFrame, scenario: Scenario | None = None,
               tie_keys: tuple[str, ...] = ("supplier_id",)) -> DataFrame:
    scenario = scenario or Scenario()
    rc = risk_column(scored)
    # Only the columns the payload needs travel through the cap.
    needed = [c for c in dict.fromkeys([rc, *tie_keys, "supplier_id", "supplier_name", "region",
                                        "latitude", "longitude"]) if c in scored.columns]
    ties = [F.col(k).asc_nulls_last() for k in tie_keys]
    n = int(scenario.max_map_points)
    slim = scored.select(*needed)
    capped = (top_n(slim, [F.col(rc).desc_nulls_last(), *ties], n) if n <= FEW
              else top_n_by_score(slim, rc, ties, n))
    risk = fill_risk(rc)
    name = (F.col("supplier_name").cast("string") if "supplier_name" in scored.columns
            else F.lit(None).cast("string"))
    region = (F.col("region").cast("string") if "region" in scored.columns
              else F.lit(None).cast("string"))
    return capped.select(
        *[F.col(k) for k in tie_keys if k != "supplier_id"],
        html_escape(F.coalesce(F.col("supplier_id").cast("string"),
                               F.lit(C.DEFAULT_ENTITY_ID))).alias("supplier_id"),
        html_escape(F.coalesce(name, F.lit(C.DEFAULT_ENTITY_NAME))).alias("supplier_name"),
        html_escape(F.coalesce(region, F.lit(C.DEFAULT_REGION))).alias("region"),
        "latitude", "longitude",
        risk_display(risk).alias("risk_display"),
        risk_rgb(F.col(rc).cast("double")).alias("risk_rgb"),      # raw: NaN is above every band
        risk_radius(risk).alias("risk_radius"),
    )


def map_center(points: DataFrame) -> DataFrame:
    """Mean latitude/longitude of the (capped) points; 0.0 when empty."""
    return points.agg(
        F.coalesce(F.avg("latitude"), F.lit(0.0)).alias("center_latitude"),
        F.coalesce(F.avg("longitude"), F.lit(0.0)).alias("center_longitude"))


def with_popup(scored: DataFrame) -> DataFrame:
    """popup_text = escaped name + rounded risk, for the cluster payload."""
    risk = fill_risk(risk_column(scored))
    return scored.withColumn("popup_text", F.concat(
        html_escape(F.coalesce(F.col("supplier_name").cast("string"),
                               F.lit(C.DEFAULT_ENTITY_NAME))),
        F.lit(" ("), risk_display(risk), F.lit(")")))


def cluster_payload(df: DataFrame) -> DataFrame:
    """Exactly latitude, longitude, popup_text, in that order."""
    return df.select("latitude", "longitude", "popup_text")
