"""Error categorisation over (status, message) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .cache import column_cache


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


@column_cache
def classify_error(status, message) -> Column:
    """Typed status first, then ordered substring rules on the lower-cased
    message; everything else is CAT_FALLBACK."""
    st = _c(status) if status is not None else F.lit(None).cast("int")
    msg = F.lower(F.coalesce(_c(message).cast("string"), F.lit("")))
    out = None
    for cat, codes in C.STATUS_CATEGORIES:
        cond = st.isin(*codes)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    for cat, words in C.MESSAGE_CATEGORIES:
        cond = None
        for w in words:
            hit = msg.contains(w)
            cond = hit if cond is None else (cond | hit)
        out = out.when(cond, F.lit(cat))
    return out.otherwise(F.lit(C.CAT_FALLBACK))


@column_cache
def is_retryable(status) -> Column:
    return F.coalesce(_c(status).isin(*C.RETRYABLE_STATUS), F.lit(False))
