"""Sanctions screening: LEFT equi-join of suppliers to sanctions lists.

Every supplier row is kept.  An entity on several lists fans out to one
row per list (plain left join); ``one_row_per_supplier`` folds the lists
into one sorted, comma-joined source string first.  AQE picks the join from
runtime sizes; sorting the whole result is optional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_LIST = "NONE"


def screen(suppliers: DataFrame, sanctions: DataFrame, one_row_per_supplier: bool = False,
           key: str = "supplier_id", ordered: bool = False) -> DataFrame:
    x = sanctions.select(F.col("entity_id").alias("_entity_id"),
                         F.col("list_source").alias("_list_source"))
    if one_row_per_supplier:
        x = x.groupBy("_entity_id").agg(
            F.nullif(F.array_join(F.array_sort(F.collect_set("_list_source")), ","),
                     F.lit("")).alias("_list_source"))
    joined = suppliers.join(x, F.col(key) == F.col("_entity_id"), "left")
    out = joined.select(
        *[F.col(c) for c in suppliers.columns],
        F.col("_entity_id").isNotNull().alias("is_sanctioned"),
        F.coalesce(F.col("_list_source"), F.lit(NO_LIST)).alias("sanctions_list_source"))
    return out.orderBy(F.col(key).asc_nulls_last()) if ordered else out
