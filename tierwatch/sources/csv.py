"""CSV sources: supplier uploads and sanctions lists, read as text by header.

No schema inference: every column arrives as a string named by its header,
cleansing and casting happen in ``operators.cleanse``.  With
``enforceSchema=False`` Spark checks every file's header against the first
one and fails on a reordered header instead of silently swapping columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "_upload"              # the landed file a row came from


def _reader(spark: SparkSession, multi_line: bool):
    return (spark.read.option("header", True)
            .option("enforceSchema", False)
            .option("inferSchema", False)
            .option("multiLine", multi_line)
            .option("mode", "PERMISSIVE"))


def read_suppliers(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Supplier CSV(s) as all-string columns.

    ``path`` may be a file, a folder, a glob or a list of them when all files
    share one header.  ``multi_line`` allows quoted newlines but makes each
    file unsplittable, so it is off by default.
    """
    return _reader(spark, multi_line).csv(path)


def read_by_header(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """Files whose headers differ: one scan per file, combined by column
    name (missing columns become null).  For many files use ``parse_uploads``."""
    frames = [_reader(spark, multi_line).csv(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_sanctions(spark: SparkSession, path) -> DataFrame:
    """Sanctions list ``entity_id, entity_name, list_source`` (strings; ids
    are never converted to numbers)."""
    return _reader(spark, False).csv(path)


def upload_lines(reader, path) -> DataFrame:
    """(value, FILE, start, row): the lines of landed files, from
    ``spark.read`` or ``spark.readStream``; ``start`` is the place of a line's
    part of its file, ``row`` its number in the order of the part."""
    return reader.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("start"))


def parse_uploads(lines: DataFrame, columns) -> tuple[DataFrame, DataFrame]:
    """(rows, headers) of ``upload_lines``: ``rows`` holds FILE and the named
    ``columns`` as text, each taken by its file's own header (null where that
    lacks it); ``headers`` holds FILE and the header's ``names``.

    Any number of files with any headers is one scan: a file's header is the
    first line of its first part, joined to its lines by file."""
    lines = lines.where(F.length("value") > 0).withColumn("row", F.monotonically_increasing_id())
    first = lines.where("start = 0").groupBy(FILE).agg(F.min_by("value", "row").alias("header"), F.min("row").alias("head"))
    names = F.transform(F.split(F.ltrim("header", F.lit("\ufeff")), ","), lambda x: F.regexp_replace(x, r'^\s*"?|"?\s*$', ""))
    headers = first.select(FILE, "head", names.alias("names"))
    width = headers.agg(F.max(F.size("names"))).first()[0] or 1             # one number
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    body = lines.join(headers, FILE).where(F.col("row") != F.col("head")).select(FILE, "names", fields.alias("f"))
    cells = F.array(*[F.col(f"f.c{i}") for i in range(width)])
    rows = body.select(FILE, *[F.get(cells, (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c) for c in columns])
    return rows, headers.select(FILE, "names")


def header_failures(headers: DataFrame, columns) -> DataFrame:
    """(FILE, supplier_id, column, check, failure_case): columns that a file's
    header lacks or has beyond ``columns``."""
    want = F.array(*[F.lit(c) for c in columns])
    def of(check, names):
        return F.transform(names, lambda c: F.struct(c.alias("column"), F.lit(check).alias("check"), c.alias("failure_case")))
    both = F.concat(of("column_in_dataframe", F.array_except(want, "names")), of("column_in_schema", F.array_except("names", want)))
    return headers.select(FILE, F.lit(None).cast("string").alias("supplier_id"), F.inline(both))
