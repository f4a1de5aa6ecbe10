"""Quality rules: robust multivariate outliers, in DataFrame functions.

Base statistics of a text are counted inside its own row.  Texts that pass the
base rules are judged per language and source by a minimum-covariance-
determinant estimate of their transformed statistics:

    start     median and median deviation, by which rows get a first distance
    subset    the share ``SUBSET`` of a group with the smallest distances; its
              mean and covariance give new distances (a concentration step),
              ``STEPS`` times, from two starts; the smaller determinant wins
    scale     the covariance is scaled so that the median distance is that of
              a normal sample, and floored so that nearly constant statistics
              do not reject by noise
    verdict   rows beyond ``CUTOFF`` (squared distance) are rejected

A group with under ``MIN_GROUP`` rows has no estimate of its own and takes the
one over all rows.  All means, covariances and quantiles are built-in
aggregates with partial sums, so a source with a third of all rows is no
larger than its partial states.

Defined results: null or blank text has no words and fails the base rules;
null language or source is a group of its own; equal rows are judged equal; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANKS = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
SUBSET, STEPS, MIN_GROUP = 0.75, 3, 60
CUTOFF = 60.0                 # squared distance in 4 dimensions; a normal row exceeds it once in 3e11
STATS = ("s_words", "s_length", "s_symbols", "s_lines")
FLOORS = (0.35, 0.06, 0.02, 0.11)      # smallest standard deviation of each statistic
_MEDIAN_CHI2 = 3.3567         # of 4 degrees of freedom


# ------------------------------------------------------ statistics of a row

def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted with their positions, so equal ones are neighbours; the
    positions of repeated ones, sorted, cover 3 words each, less overlaps."""
    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))

        def repeated(s: Column) -> Column:
            def kept(i: Column) -> Column:
                g = F.get(s, i)["g"]
                return (g == F.get(s, i - 1)["g"]) | (g == F.get(s, i + 1)["g"])
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(kept(i), F.lit(False)))
            return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

        def cover(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
        return _let(F.sort_array(windows), lambda s: _let(repeated(s), cover))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(words, count)).cast("bigint")


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counted statistics of every row."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("_t", BLANKS), lambda x: x != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    d = docs.select("doc_id", "lang", "source", text.alias("_t")).withColumn("_w", words).withColumn("_l", lines)
    blanks = F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))
    d = d.select("doc_id", "lang", "source", F.size("_w").cast("bigint").alias("n_words"),
                 blanks.cast("bigint").alias("word_chars"),
                 (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
                 F.size("_l").alias("n_lines"), repeat_words(F.col("_w")).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def transformed(d: DataFrame) -> DataFrame:
    """Statistics on scales where ordinary texts are about normal: log words,
    log word length, and square roots of the symbol and repeated line shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return (d.withColumn("s_words", F.log(n.cast("double")))
            .withColumn("s_length", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
            .withColumn("s_symbols", F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))))
            .withColumn("s_lines", F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))))


# ----------------------------------------------------------- the estimates

_P = len(STATS)


def _entry(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def _minor(rows: list[int], cols: list[int]) -> Column:
    """Determinant of a part of the covariance, by expansion."""
    if len(rows) == 1:
        return F.col(_entry(rows[0], cols[0]))
    out = F.lit(0.0)
    for k, c in enumerate(cols):
        term = F.col(_entry(rows[0], c)) * _minor(rows[1:], cols[:k] + cols[k + 1:])
        out = out + term if k % 2 == 0 else out - term
    return out


def _with_inverse(est: DataFrame) -> DataFrame:
    """Adds det and the entries v<i><j> of the inverse covariance."""
    every = list(range(_P))
    est = est.withColumn("det", _minor(every, every))
    for i in range(_P):
        for j in range(i, _P):
            sign = 1.0 if (i + j) % 2 == 0 else -1.0
            m = _minor([k for k in every if k != j], [k for k in every if k != i])
            est = est.withColumn(f"v{i}{j}", F.lit(sign) * m / F.col("det"))
    return est


def _distance() -> Column:
    out = F.lit(0.0)
    for i in range(_P):
        for j in range(i, _P):
            x = (F.col(STATS[i]) - F.col(f"m{i}")) * (F.col(STATS[j]) - F.col(f"m{j}")) * F.col(f"v{i}{j}")
            out = out + (x if i == j else 2 * x)
    return out


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and floored covariance of every group and start."""
    aggs = [F.avg(s).alias(f"m{i}") for i, s in enumerate(STATS)]
    aggs += [F.covar_pop(STATS[i], STATS[j]).alias(_entry(i, j)) for i in range(_P) for j in range(i, _P)]
    est = rows.groupBy("grp", "start").agg(*aggs)
    for i, floor in enumerate(FLOORS):
        est = est.withColumn(_entry(i, i), F.col(_entry(i, i)) + F.lit(floor * floor))
    return _with_inverse(est)


def _measured(rows: DataFrame, est: DataFrame) -> DataFrame:
    keep = ["grp", "start", *[f"m{i}" for i in range(_P)], *[f"v{i}{j}" for i in range(_P) for j in range(i, _P)]]
    return rows.join(est.select(*keep), ["grp", "start"]).select(*rows.columns, _distance().alias("d2"))


def estimates(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """One row per group: m<i>, v<i><j> and ``scale`` (rows need grp and STATS)."""
    centre = rows.groupBy("grp").agg(*[F.percentile_approx(s, 0.5, 1000).alias(f"q{i}") for i, s in enumerate(STATS)])
    wide = rows.join(centre, "grp")
    spread = wide.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(s) - F.col(f"q{i}")), 0.5, 1000).alias(f"w{i}")
                                       for i, s in enumerate(STATS)])
    wide = wide.join(spread, "grp")
    unit = [(F.col(s) - F.col(f"q{i}")) / (1.4826 * F.col(f"w{i}") + F.lit(FLOORS[i])) for i, s in enumerate(STATS)]
    square = sum((u * u for u in unit[1:]), unit[0] * unit[0])      # start 0: Euclid
    furthest = F.greatest(*[F.abs(u) for u in unit])                # start 1: the worst statistic
    both = F.explode(F.array(F.struct(F.lit(0).alias("start"), square.alias("d2")),
                             F.struct(F.lit(1).alias("start"), furthest.alias("d2"))))
    now = cut(wide.select("grp", *STATS, both.alias("b")).select("grp", *STATS, "b.start", "b.d2"), "stats")
    base = now.drop("d2")
    for _ in range(steps):
        limit = now.groupBy("grp", "start").agg(F.percentile_approx("d2", subset, 1000).alias("limit"))
        inner = now.join(limit, ["grp", "start"]).where(F.col("d2") <= F.col("limit"))
        est = cut(_moments(inner), "estimate")
        now = _measured(base, est)
    size = now.groupBy("grp", "start").agg(F.percentile_approx("d2", 0.5, 1000).alias("mid"))
    best = est.join(size, ["grp", "start"])
    names = [c for c in best.columns if c not in ("grp",)]
    return (best.groupBy("grp").agg(F.min_by(F.struct(*names), F.struct("det", "start")).alias("e"))
            .select("grp", "e.*").withColumn("scale", F.greatest(F.col("mid") / _MEDIAN_CHI2, F.lit(1.0))))


def judged(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """Every row with its statistics, base_failed, distance and kept."""
    d = cut(transformed(base_statistics(docs)), "statistics")
    good = d.where(~F.col("base_failed")).select(
        F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                 F.col("lang").isNull().alias("no_lang"), F.col("source").isNull().alias("no_source")).alias("own"), *STATS)
    large = good.groupBy("own").count().where(F.col("count") >= min_group).select("own")
    grouped = good.join(large, "own").select(F.to_json("own").alias("grp"), *STATS)
    est = cut(estimates(grouped.unionByName(good.select(F.lit("all").alias("grp"), *STATS))), "estimates")
    return _verdict(d, est, cutoff)


def _verdict(d: DataFrame, est: DataFrame, cutoff: float) -> DataFrame:
    own = F.to_json(F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                             F.col("lang").isNull().alias("no_lang"), F.col("source").isNull().alias("no_source")))
    keep = ["grp", "scale", *[f"m{i}" for i in range(_P)], *[f"v{i}{j}" for i in range(_P) for j in range(i, _P)]]
    known = est.select("grp").withColumn("has", F.lit(True))
    d = d.withColumn("own", own).join(known.withColumnRenamed("grp", "own"), "own", "left")
    d = d.withColumn("grp", F.when(F.col("has"), F.col("own")).otherwise(F.lit("all"))).drop("own", "has")
    d = d.join(est.select(*keep), "grp", "left").withColumn("distance", _distance() / F.col("scale"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
