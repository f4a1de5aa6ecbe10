"""Supplier cleansing: tolerant repair and casting of all-string input.

Order matters and is kept per column: trim -> null tokens -> remove inner
whitespace (id, region, audit date only) -> cast.  So ``"N U L L"`` in the
region becomes the text ``NULL`` (the null-token step has already run).
Numeric columns skip trimming and null tokens: their whitespace is removed
and anything that is not plain decimal text becomes null.
Columns missing from the input are skipped; unknown columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.cache import column_cache
from ..functions.text import null_tokens, strip_inner_ws, to_number, trim_ws

DEFAULT_TYPES = {
    "supplier_id": "string",
    "supplier_name": "string",
    "risk_score": "double",
    "latitude": "double",
    "longitude": "double",
    "region": "string",
    "tier": "bigint",
    "annual_spend_usd": "double",
    "last_audit_date": "string",
}


@column_cache
def clean_column(name: str, final_type: str = "string") -> Column:
    c = F.col(name).cast("string")
    if name in C.STRING_COLUMNS:
        c = null_tokens(trim_ws(c))
        if name in C.DESPACE_COLUMNS:
            c = strip_inner_ws(c)
        if final_type != "string":
            c = c.try_cast(final_type)
        return c.alias(name)
    if name in C.DOUBLE_COLUMNS:
        return to_number(c, "double").alias(name)
    if name in C.INT_COLUMNS:
        return to_number(c, "bigint").alias(name)
    return F.col(name)


def clean_suppliers(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """One projection; only the four string columns honour a type override
    (numeric targets are fixed)."""
    types = {**DEFAULT_TYPES, **(overrides or {})}
    return df.select(*[
        clean_column(c, types.get(c, "string")) if c in DEFAULT_TYPES else F.col(c)
        for c in df.columns])
