"""Incremental work: content-hash change detection, result keys and
freshness, as ledger tables instead of session dictionaries.

* ``file_hashes`` / ``new_files``: SHA-256 of every landed file
  (``binaryFile``, large files block by block), anti-joined with a ledger of
  hashes already processed;
* ``pending``: work keys not yet in a done-ledger (left anti join);
* ``stale``: never fetched, or older than the TTL (strictly greater).
"""

from __future__ import annotations

import hashlib
import json
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..scenario import Scenario

LEDGER_SCHEMA = T.StructType([
    T.StructField("content_sha256", T.StringType(), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("registered_at", T.TimestampType(), True),
])


WHOLE = 64 << 20            # bytes; larger files are never one value
BLOCK = 4 << 20


def _block_hashes(batches):
    """SHA-256 of the files of each batch, read in blocks."""
    from pyarrow import fs
    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            store, at = fs.FileSystem.from_uri(quote(path, safe=":/@"))      # paths come unescaped
            digest = hashlib.sha256()
            with store.open_input_stream(at) as f:
                while block := f.read(BLOCK):
                    digest.update(block)
            out.append(digest.hexdigest())
        yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "content_sha256"])


def file_hashes(spark: SparkSession, path: str, glob: str | None = None, whole: int = WHOLE) -> DataFrame:
    """(path, length, modificationTime, content_sha256) of landed files.

    Files of up to ``whole`` bytes are hashed as values inside the JVM; larger
    ones, of any size, in blocks of BLOCK bytes, so a task holds one block and
    no file is read twice.  Blocks are read through Arrow's file systems (local
    and mounted folders, HDFS, object stores); for a store only Spark can
    read, set ``whole`` to what one value may hold (2 GB at most).  Empty files
    are not listed: Spark's scan passes over them."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    about = ["path", "length", "modificationTime"]
    # the length filter reaches the scan: contents of the others aren't read
    values = files.where(F.col("length") <= whole).select(*about, F.sha2(F.col("content"), 256).alias("content_sha256"))
    blocks = files.where(F.col("length") > whole).select(*about).mapInArrow(
        _block_hashes, "path string, length bigint, modificationTime timestamp, content_sha256 string")
    return values.unionByName(blocks)


def new_files(hashes: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Files whose content hash is not in the ledger (re-uploads of the same
    bytes under any name are not new)."""
    if ledger is None:
        return hashes
    return hashes.join(ledger.select("content_sha256").distinct(), "content_sha256", "left_anti")


def register(new: DataFrame, ledger_path: str) -> None:
    """Append newly seen hashes to the ledger table (parquet)."""
    (new.select("content_sha256", "path", F.current_timestamp().alias("registered_at"))
     .write.mode("append").parquet(ledger_path))


def read_ledger(spark: SparkSession, ledger_path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":       # no ledger yet; anything else is an error
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items whose keys are not yet done."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def scenario_key(scenario: Scenario) -> str:
    """Stable text key of a scenario (part of the scoring result key)."""
    payload = json.dumps(scenario.__dict__, sort_keys=True, default=list)
    return hashlib.sha256(payload.encode()).hexdigest()[:16]


def result_keys(upload_hash: Column, scenario: Scenario | None = None,
                supplier_id: Column | None = None) -> list[Column]:
    """(upload, scenario) keys scoring and text; (upload, supplier) keys
    weather.  Validation is keyed by the upload alone, so a scenario change
    redoes scoring but not validation."""
    keys = [upload_hash.alias("upload_sha256")]
    if scenario is not None:
        keys.append(F.lit(scenario_key(scenario)).alias("scenario_key"))
    if supplier_id is not None:
        keys.append(supplier_id.alias("supplier_id"))
    return keys


def stale(last: Column, now: Column, ttl_seconds: int = C.NEWS_TTL_SECONDS) -> Column:
    """True when never fetched or ``now - last`` exceeds the TTL
    (microsecond precision: 900.5 s is stale at TTL 900)."""
    # timestamp_diff is exact and type-aware: wall-clock (ntz) inputs are not
    # shifted through the session time zone (no DST hour gained or lost).
    age = F.timestamp_diff("MICROSECOND", last, now)
    return F.coalesce(age > F.lit(int(ttl_seconds) * 1_000_000), F.lit(True))
