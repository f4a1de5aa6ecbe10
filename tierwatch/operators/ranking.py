"""Distributed dense row numbering within a few large groups.

``Window.partitionBy(group).orderBy(...)`` moves a whole group into one
task.  For groups that are large by design (a weight preset covers every
supplier) we instead range-partition on (group, order keys), number rows
inside each partition, and add the row counts of earlier partitions:

1. range-partition + sort within partitions (balanced even when one
   group holds most rows, because the order keys split it);
2. ``monotonically_increasing_id`` = partition index << 33 | local index;
3. checkpoint (reliable, in the cluster's checkpoint folder) so the
   numbering is fixed before it is read twice and survives lost executors;
4. per (partition, group) counts -> running offsets over the small counts
   table -> joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, group_cols: list[str], order_cols: list, name: str,
                num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in group_cols] + list(order_cols)
    ordered = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
               .withColumn("_mid", F.monotonically_increasing_id()))
    ordered = ordered.checkpoint(eager=True)
    ordered = (ordered.withColumn("_pid", F.shiftright("_mid", 33))
               .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    counts = ordered.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_loc").alias("_first"))
    # The counts table has at most (#partitions + #groups) rows.
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid", *group_cols, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_pid") == F.col("_o__pid")
    for g in group_cols:                    # a null group is a group too
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    offsets = offsets.withColumnsRenamed({c: f"_o_{c}" for c in ["_pid", *group_cols]})
    # One offset row per (partition, group): at most partitions + groups rows.
    joined = ordered.join(F.broadcast(offsets), same).drop(*[f"_o_{c}" for c in ["_pid", *group_cols]])
    rank = (F.col("_before") + (F.col("_loc") - F.col("_first")) + F.lit(1)).cast("bigint")
    return joined.withColumn(name, rank).drop("_mid", "_pid", "_loc", "_first", "_before")


def top_n(df: DataFrame, order: list, n: int, ordered: bool = False) -> DataFrame:
    """Exact first ``n`` rows of ``df`` under ``order``: Spark's own top-k
    (each task keeps its first n rows).  ``ordered`` is kept for callers that
    rely on the order of the result, which a top-k always has."""
    return df.orderBy(*order).limit(n)


HISTOGRAM = 4096


def top_n_by_score(df: DataFrame, score: str, ties: list, n: int) -> DataFrame:
    """Exact first ``n`` rows by ``score`` (a double, falling, nulls last, NaN
    first) and ``ties``, for an n that may be large.

    Scores are counted in bins of [0, 1] (what lies beyond, NaN and null have
    bins of their own); the bin that holds the n-th row is a scalar subquery,
    and only rows from that bin on are sorted: about n rows in all reach the
    last task, not n of every task.  No job runs while the query is built."""
    x = F.col(score)
    bin_of = (F.when(x.isNull(), F.lit(-2)).when(F.isnan(x), F.lit(HISTOGRAM + 1))
              .otherwise(F.floor(F.least(F.greatest(x, F.lit(-1.0 / HISTOGRAM)), F.lit(1.0)) * HISTOGRAM))).cast("int")
    counts = df.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))          # <= HISTOGRAM + 4 rows
    upto = counts.select("bin", F.sum("n").over(Window.orderBy(F.desc("bin"))).alias("upto"))
    last = upto.where(F.col("upto") >= n).agg(F.coalesce(F.max("bin"), F.lit(-2))).scalar()
    return df.where(bin_of >= last).orderBy(x.desc_nulls_last(), *ties).limit(n)
