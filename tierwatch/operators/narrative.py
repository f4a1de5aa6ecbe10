"""Narrative batching and bookkeeping around an external text model.

The model call itself is outside Spark; what is built here is the data work
around it: which rows are sent (``narrative_input``), token estimates,
token-budget batches and prompt text (``prompt_batches``), attribution of
returned narratives to suppliers (``attribute``), their contract checks
(``narrative_contract``) and the severity ranking (``top_narratives``).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import estimate_tokens, row_json
from . import chunking
from .ranking import top_n
from .quality import Check, Contract


def narrative_input(scored: DataFrame, n: int = 10, order: str = "supplier_id") -> DataFrame:
    """The rows handed to the model: the first ``n`` in input order (an
    explicit ordinal column, since DataFrames carry no order)."""
    return top_n(scored, [F.col(order).asc_nulls_last()], n, ordered=True)


def row_tokens(df: DataFrame, cols: list[str] | None = None) -> Column:
    """Token estimate of a row rendered as JSON."""
    return estimate_tokens(row_json(df, cols))


def chunk_rows(df: DataFrame, key: str, order: str, tokens: str,
               budget: int = C.MAX_INPUT_TOKENS) -> DataFrame:
    """Greedy token-budget batches per key (see ``operators.chunking``)."""
    return chunking.chunk(df, key, order, tokens, budget)


def prompt_batches(chunked: DataFrame, key: str, order: str, tokens: str,
                   payload_cols: list[str]) -> DataFrame:
    """One prompt per (key, chunk): the fixed template followed by the
    chunk's rows as a JSON array in order.  A chunk is bounded by the token
    budget (or is one oversized row), so the group is bounded."""
    row = F.struct(F.col(order).alias("_o"), row_json(chunked, payload_cols).alias("r"))
    agg = chunked.groupBy(key, "chunk_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(tokens).alias("chunk_tokens"),
        F.min(order).alias("first_" + order),
        F.max(order).alias("last_" + order),
        F.array_sort(F.collect_list(row)).alias("_rows"))
    return agg.select(
        key, "chunk_id", "n_rows", "chunk_tokens", "first_" + order, "last_" + order,
        F.concat(F.lit(C.NARRATIVE_PROMPT), F.lit("["),
                 F.array_join(F.col("_rows").getField("r"), ", "), F.lit("]\n")).alias("prompt"))


def attribute(narratives: DataFrame, suppliers: DataFrame, ordinal: str = "ordinal",
              supplier_ordinal: str | None = None) -> DataFrame:
    """Key each narrative by supplier id: the echoed id when it is a known
    supplier, else the id of the (last) supplier with that name, else
    UNKNOWN; a later narrative for the same id replaces an earlier one."""
    valid = suppliers.select(F.col("supplier_id").alias("_vid")).where(
        F.col("_vid").isNotNull()).distinct()
    so = F.col(supplier_ordinal) if supplier_ordinal else F.col("supplier_id")
    names = (suppliers.where(F.col("supplier_name").isNotNull())
             .groupBy(F.col("supplier_name").alias("_name"))
             .agg(F.max_by("supplier_id", so).alias("_nid")))
    n = (narratives.join(valid, narratives["supplier_id"] == valid["_vid"], "left")
         .join(names, narratives["supplier_name"] == names["_name"], "left"))
    resolved = F.coalesce(F.col("_vid"), F.col("_nid"), F.lit(C.UNKNOWN_SUPPLIER))
    fields = [c for c in narratives.columns if c != ordinal]
    best = n.groupBy(resolved.alias("resolved_id")).agg(
        F.max_by(F.struct(*[F.col(c) for c in fields]), F.col(ordinal)).alias("n"))
    return best.select("resolved_id", "n.*")


def severity_rank(col: str = "overall_risk") -> Column:
    c = F.col(col)
    out = None
    for name, rank in C.SEVERITY_RANK.items():
        out = F.when(c == name, F.lit(rank)) if out is None else out.when(c == name, F.lit(rank))
    return out.otherwise(F.lit(C.SEVERITY_OTHER))


def top_narratives(attributed: DataFrame, n: int = C.TOP_NARRATIVES) -> DataFrame:
    """CRITICAL, HIGH, MEDIUM, LOW, other; higher confidence first."""
    ranked = attributed.withColumn("severity_rank", severity_rank())
    return top_n(ranked, [F.col("severity_rank").asc(), F.col("confidence").desc_nulls_last(),
                          F.col("resolved_id").asc_nulls_last()], n, ordered=True)


@lru_cache(maxsize=None)
def narrative_contract() -> Contract:
    """Model-output contract: level enum, at most three key risks,
    confidence in [0, 1], a supplier name."""
    return Contract(
        dtypes={"supplier_name": "string", "overall_risk": "string",
                "key_risks": "array<string>", "confidence": "double"},
        nullable=set(), strict=False, key="supplier_id",
        checks=(
            Check("overall_risk", "isin(LOW, MEDIUM, HIGH, CRITICAL)",
                  lambda: F.col("overall_risk").isin(*C.NARRATIVE_LEVELS)),
            Check("key_risks", f"max_length({C.MAX_KEY_RISKS})",
                  lambda: F.size("key_risks") <= C.MAX_KEY_RISKS),
            Check("confidence", "in_range(0.0, 1.0)",
                  lambda: F.col("confidence").between(0.0, 1.0)),
        ))


@lru_cache(maxsize=None)
def digest_contract() -> Contract:
    """News digest contract: at most five disruptions, confidence in [0, 1]."""
    return Contract(
        dtypes={"headline_synthesis": "string", "top_disruptions": "array<string>",
                "supply_chain_impact": "string", "confidence": "double"},
        nullable=set(), strict=False, key=None,
        checks=(
            Check("top_disruptions", f"max_length({C.MAX_DISRUPTIONS})",
                  lambda: F.size("top_disruptions") <= C.MAX_DISRUPTIONS),
            Check("confidence", "in_range(0.0, 1.0)",
                  lambda: F.col("confidence").between(0.0, 1.0)),
        ))


def labelled(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Picker entries keyed ``id · name``; for a duplicate label the last
    row (by ``ordinal``) wins."""
    label = F.concat_ws(" · ", F.col("supplier_id").cast("string"),
                        F.col("supplier_name").cast("string"))
    o = F.col(ordinal) if ordinal else F.lit(0)
    cols = [c for c in df.columns]
    return (df.withColumn("label", label).groupBy("label")
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), o).alias("r"))
            .select("label", "r.*"))
