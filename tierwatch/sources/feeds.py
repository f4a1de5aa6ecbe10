"""News feed source: landed RSS/Atom files read with Spark's XML reader.

A broken file contributes nothing and a half-broken one keeps its good
items (``DROPMALFORMED``); the feed name comes from the file name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

RSS_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("description", T.StringType()),
])
# Atom entries: the link is an attribute, the dates are ISO 8601.
ATOM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StructType([T.StructField("_href", T.StringType())])),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("summary", T.StringType()),
])
ITEM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("published", T.TimestampType(), False),
    T.StructField("summary", T.StringType(), True),
])

# RFC 822 without the weekday (Spark's parser rejects EEE); zone names need
# ``z``, numeric offsets ``xx``.  ISO 8601 (Atom) is tried last.
_RFC822 = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm z",
           "d MMM yyyy HH:mm xx")


def _landed(spark: SparkSession, path) -> list[str]:
    """Those of the paths that name a file (each by itself through Spark's own
    file reader, which fails as soon as one path of a list is missing)."""
    found = []
    for p in [path] if isinstance(path, str) else path:
        try:
            spark.read.format("binaryFile").load(p)
            found.append(p)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def _entries(spark: SparkSession, path, row_tag: str, schema: T.StructType) -> DataFrame:
    """Entries of the landed files with a ``source`` column taken from the
    file name."""
    landed = _landed(spark, path)
    if not landed:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("source", T.StringType())]))
    raw = (spark.read.format("xml").option("rowTag", row_tag)
           .option("mode", "DROPMALFORMED").schema(schema).load(landed))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return raw.withColumn("source", F.url_decode(name))


def read_feed(spark: SparkSession, path, row_tag: str = "item") -> DataFrame:
    """Raw entries of landed feed files with a ``source`` column taken from
    the file name (``Supply Chain Dive.xml`` -> ``Supply Chain Dive``).  A
    source that never landed contributes nothing, the others theirs."""
    return _entries(spark, path, row_tag, RSS_SCHEMA)


def read_atom(spark: SparkSession, path) -> DataFrame:
    """Atom feed files, mapped onto the RSS entry columns (link from its
    href attribute, published -> pubDate, summary -> description); a source
    that never landed contributes nothing, the others theirs."""
    return _entries(spark, path, "entry", ATOM_SCHEMA).select(
        "title", F.col("link._href").alias("link"), F.col("published").alias("pubDate"),
        "updated", F.col("summary").alias("description"), "source")


def parse_published(col) -> Column:
    c = F.regexp_replace(F.trim(col), r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(c, F.lit(p)) for p in _RFC822]
    tries.append(F.try_to_timestamp(F.trim(col)))
    return F.coalesce(*tries)


def feed_url(source: Column) -> Column:
    """Known feed name -> its URL; an unknown name is used as the URL."""
    m = F.create_map(*[F.lit(x) for kv in C.FEED_SOURCES.items() for x in kv])
    return F.coalesce(F.element_at(m, source), source)


def normalise_items(raw: DataFrame, published: Column | None = None,
                    updated: Column | None = None) -> DataFrame:
    """Entries -> (title, url, source, published, summary): empty title ->
    Untitled, no link -> feed URL, no date -> updated -> epoch 0, empty
    summary -> null.  Extra columns are kept."""
    pub = published if published is not None else parse_published(F.col("pubDate"))
    upd = updated if updated is not None else parse_published(F.col("updated"))
    keep = [c for c in raw.columns
            if c not in ("title", "link", "pubDate", "updated", "description", "source",
                         "url", "published", "summary")]
    return raw.select(
        *keep,
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(C.UNTITLED)).alias("title"),
        F.coalesce(F.nullif(F.col("link"), F.lit("")), feed_url(F.col("source"))).alias("url"),
        F.col("source"),
        F.coalesce(pub, upd, F.timestamp_seconds(F.lit(0))).alias("published"),
        F.nullif(F.col("description"), F.lit("")).alias("summary"),
    )


def items_from_documents(docs: DataFrame) -> DataFrame:
    """News items derived from the documents table: first line as title,
    whole text as summary, ``doc_id`` hours after the epoch as the date
    (every 50th document undated)."""
    raw = docs.select(
        "doc_id",
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("link"),
        F.col("source"),
        F.col("text").alias("description"),
    )
    pub = F.when(F.col("doc_id") % 50 != 7, F.timestamp_seconds(F.col("doc_id") * 3600))
    return normalise_items(raw.withColumn("pubDate", F.lit(None).cast("string"))
                           .withColumn("updated", F.lit(None).cast("string")),
                           published=pub, updated=F.lit(None).cast("timestamp"))
