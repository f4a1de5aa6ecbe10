"""News item filtering, recency order and the digest text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import estimate_tokens
from .chunking import chunk
from .ranking import global_rank, top_n


def parse_keywords(keywords) -> list[str]:
    """Comma list (or sequence) -> trimmed, lower-cased, non-blank words."""
    if keywords is None:
        return []
    parts = keywords.split(",") if isinstance(keywords, str) else list(keywords)
    return [p.strip().lower() for p in parts if p and p.strip()]


def _haystack() -> Column:
    return F.lower(F.concat_ws(" ", F.col("title"), F.coalesce(F.col("summary"), F.lit(""))))


def keyword_match(keywords) -> Column | None:
    """One JVM expression for any number of words: the text is built once a
    row and tested against a literal array."""
    words = parse_keywords(keywords)
    if not words:
        return None
    listed = F.array(*[F.lit(w) for w in words])
    return F.transform(F.array(_haystack()),
                       lambda hay: F.exists(listed, lambda w: F.contains(hay, w)))[0]


def keyword_filter(items: DataFrame, keywords) -> DataFrame:
    """Keep items whose lower-cased ``title + ' ' + summary`` contains any
    keyword literally; no keywords = no filter."""
    cond = keyword_match(keywords)
    return items if cond is None else items.where(cond)


def source_filter(items: DataFrame, sources=None) -> DataFrame:
    """No (or an empty) source list keeps every source."""
    return items.where(F.col("source").isin(*sources)) if sources else items


def recency_order() -> list[Column]:
    return [F.col("published").desc_nulls_last(), F.col("url").asc_nulls_last(),
            F.col("title").asc_nulls_last()]


def latest_news(items: DataFrame, sources=None, n: int = C.NEWS_LIMIT) -> DataFrame:
    """Newest first, optionally restricted to sources, first ``n``."""
    return top_n(source_filter(items, sources), recency_order(), n, ordered=True)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with offset; fractional seconds only when present."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    frac = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(frac)


def digest_line() -> Column:
    return F.concat(F.lit("- ["), F.col("source"), F.lit("] "), F.col("title"),
                    F.lit(" ("), iso_utc(F.col("published")), F.lit("): "),
                    F.coalesce(F.col("summary"), F.lit("")))


def digest_batches(items: DataFrame, budget: int = C.MAX_INPUT_TOKENS, tie: str = "doc_id") -> DataFrame:
    """Digest text and prompt over all items, newest first: one row per
    token-budget batch, every item in exactly one (a single value can't hold
    any number of items, a batch is bounded by the budget or one item)."""
    order = [*recency_order(), F.col(tie).asc_nulls_last()]
    keys = dict.fromkeys(["published", "url", "title", tie])
    lines = items.select(*keys, digest_line().alias("line"))
    ranked = global_rank(lines, [], order, "_rank").select("_rank", "line")
    sized = ranked.withColumn("_all", F.lit(0)).withColumn("_tokens", estimate_tokens("line"))
    batches = chunk(sized, "_all", "_rank", "_tokens", budget, name="batch")
    text = F.array_join(F.array_sort(F.collect_list(F.struct("_rank", "line"))).getField("line"), "\n")
    out = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"), text.alias("digest"))
    return out.withColumn("prompt", F.concat(F.lit(C.DIGEST_PROMPT_HEAD), F.col("digest"), F.lit("\n")))
