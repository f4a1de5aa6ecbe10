"""Risk band, colour, radius and display columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .cache import column_cache


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@column_cache
def risk_band(col) -> Column:
    """CRITICAL >= .85, HIGH >= .70, MEDIUM >= .40, else (null too) LOW."""
    c = _c(col)
    out = None
    for name, lower in C.BANDS:
        out = (F.when(c >= lower, F.lit(name)) if out is None
               else out.when(c >= lower, F.lit(name)))
    return out.otherwise(F.lit("LOW"))


@column_cache
def band_rank(col) -> Column:
    """0 for CRITICAL ... 3 for LOW (display order)."""
    c = _c(col)
    out = None
    for i, name in enumerate(C.BAND_ORDER):
        out = F.when(c == name, F.lit(i)) if out is None else out.when(c == name, F.lit(i))
    return out


@column_cache
def risk_rgb(col) -> Column:
    """[r, g, b, 210] of the band of ``col``."""
    c = _c(col)

    def rgba(name):
        r, g, b = C.RISK_RGB[name]
        return F.array(*(F.lit(v) for v in (r, g, b, C.RGB_ALPHA)))

    out = None
    for name, lower in C.BANDS:
        out = (F.when(c >= lower, rgba(name)) if out is None
               else out.when(c >= lower, rgba(name)))
    return out.otherwise(rgba("LOW"))


@column_cache
def fill_risk(col) -> Column:
    """null / NaN -> 0.0."""
    return F.coalesce(F.nanvl(_c(col).cast("double"), F.lit(0.0)), F.lit(0.0))


@column_cache
def risk_radius(col) -> Column:
    return F.lit(C.RADIUS_BASE) + _c(col) * F.lit(C.RADIUS_SCALE)


@column_cache
def risk_display(col) -> Column:
    """Risk rounded half-even to 3 places, as text."""
    return F.bround(_c(col), 3).cast("string")
