"""Line dedup with levelled sorted runs of line hashes.

The index is a list of levels; a level holds sorted runs of (line hash ->
smallest document).  Documents arrive in batches of ascending ids.  The line
hashes of a batch are merge-anti-joined with all runs; what is new becomes a
run of level 0.  When a level holds ``fanout`` runs they are compacted into
one run of the next level, so a batch meets a logarithmic number of runs.
Runs hold distinct keys, so a line of a third of all documents is one entry.

A line loses its place when the index owns it for a smaller document.

Defined results: null text is one empty line; keys shorter than ``min_chars``
always stay; equal ids count as one document; a null id sorts before all
others; repeated rows are each rewritten; an empty table gives no rows.  A key
is told apart by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)
_RUN = "h1 bigint, h2 bigint, owner bigint"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased."""
    key = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


class LineIndex:
    """Levelled runs in a shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]

    def keys(self) -> DataFrame | None:
        """All entries (h1, h2, owner); keys are distinct across runs."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.schema(_RUN).parquet(*paths) if paths else None

    def _write(self, level: int, run: DataFrame) -> None:
        path = shared_path(self.spark, f"run{level}")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, batch: DataFrame) -> None:
        """``batch`` (h1, h2, doc) of ids above all earlier batches."""
        fresh = batch.groupBy("h1", "h2").agg(F.min("doc").alias("owner"))
        known = self.keys()
        if known is not None:
            fresh = fresh.join(known.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self._write(0, fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            runs = self.spark.read.schema(_RUN).parquet(*self.levels[level])
            self.levels[level] = []
            self._write(level + 1, runs.repartition("h1"))
            level += 1


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    got = docs.agg(F.percentile_approx("_doc", shares, 1000).alias("b")).first()["b"]
    return sorted(set(got or []))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                        fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` rewritten, plus n_lines and n_dropped (columns of
    these two names are replaced; names starting with an underscore are ours)."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    src = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)))
    src = src.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_row", F.xxhash64("_text"))
    batch = F.lit(0)
    for b in _bounds(src, batches):
        batch = batch + (F.col("_doc") > b).cast("int")
    lines = (src.select(F.col("_doc").alias("doc"), F.col("_row").alias("row"), batch.alias("batch"),
                        F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
             .withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
             .select("doc", "row", "batch", "pos", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit("line"), "key").alias("h2")))
    path = shared_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc bigint, row bigint, pos int, h1 bigint, h2 bigint, batch int").parquet(path)
    index = LineIndex(spark, fanout)
    for b in range(batches):
        index.add(lines.where(F.col("batch") == b).select("h1", "h2", "doc"))
    owners = index.keys().withColumnsRenamed({"h1": "o1", "h2": "o2"})
    gone = (lines.join(owners, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2"))
                       & (F.col("owner") < F.col("doc")))
            .groupBy(F.col("doc").alias("_gdoc"), F.col("row").alias("_grow")).agg(F.collect_set("pos").alias("_gone")))
    joined = src.join(gone, (F.col("_doc") == F.col("_gdoc")) & (F.col("_row") == F.col("_grow")), "left")
    split = F.split("_text", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
        F.transform(F.array(F.struct(split.alias("l"), stays.alias("k"))),
                    lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n"))[0])
    return joined.select(*[kept.alias("text") if c == "text" else F.col(c) for c in docs.columns],
                         F.size(split).cast("bigint").alias("n_lines"),
                         F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"))


def digests(docs: DataFrame) -> DataFrame:
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
