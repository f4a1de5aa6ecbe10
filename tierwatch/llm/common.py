"""Helpers shared by the text operators: shared-folder tables, byte arrays,
hashes of ragged strings and small compressed payloads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwatch.session import ensure_checkpoint_dir

U64 = np.uint64
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- Spark side

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's checkpoint folder (never machine-local
    on a cluster: ``spark.checkpoint.dir`` is read from the session)."""
    return f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there, so a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Partition count of hand-placed shuffles: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 5000) -> None:
    """Bound the Arrow batches handed to Python, in rows and in bytes: whole
    texts and packed values may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def texts(df: DataFrame, *extra: str) -> DataFrame:
    """(doc_id, text) and the named extra columns; null text becomes empty."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


# -------------------------------------------------------------- worker side

def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, handing freed memory back to the system at its
    end: Spark keeps a worker for further tasks, of further steps too, and what
    one task had for a moment would else count against all of them."""
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            pa.system_memory_pool().release_unused()
    return tidied


def flat_strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)
    off = off[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    if len(off) == 0:
        off = np.zeros(1, np.int64)
    data = arr.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection) of an unsigned array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def position_keys(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers for positions 0..n-1, the same on every worker."""
    step = (np.arange(n, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    return mix(step + U64((seed * 0xD1342543DE82EF95) & _MASK)) | U64(1)


def hash_ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                seed: int = 0) -> np.ndarray:
    """Multilinear 64-bit hash of each run ``values[start:start+length]``
    (order and length count; runs are non-overlapping or not)."""
    return _hash_runs(values[ragged_index(starts, lengths)] if len(starts) else values, lengths, seed)


def _hash_runs(values: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """``hash_ragged`` of runs that follow each other."""
    out = np.zeros(len(lengths), U64)
    total = int(lengths.sum())
    if total:
        first = np.cumsum(lengths) - lengths
        small = np.int32 if total < 1 << 31 else np.int64
        pos = np.arange(total, dtype=small)
        pos -= np.repeat(first.astype(small), lengths)
        part = values.astype(U64)
        part += U64(1)
        part *= position_keys(int(lengths.max()), seed)[pos]
        full = lengths > 0
        out[full] = np.add.reduceat(part, first[full])
    return mix(out + lengths.astype(U64) * U64(0xA0761D6478BD642F) + U64(seed + 1))


def hash_strings(arr: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of every string of an Arrow array, in bounded slices."""
    out = np.empty(len(arr), U64)
    step = 1 << 15
    for at in range(0, len(arr), step):
        flat, off = flat_strings(arr.slice(at, step))
        out[at:at + step] = _hash_runs(flat, np.diff(off), seed)
    return out


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [start, start+length)."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def block_name(*parts: np.ndarray) -> int:
    """A signed 64-bit name of a block of documents, from its own contents."""
    name = U64(0)
    with np.errstate(over="ignore"):
        for k, p in enumerate(parts):
            spot = position_keys(len(p), 101 + k)
            name = name + (mix(np.asarray(p).astype(U64) + U64(k + 1)) * spot).sum(dtype=U64) + U64(len(p))
    return int(np.asarray(name, U64).view(np.int64))


_IPC = pa.ipc.IpcWriteOptions(compression="zstd")


def pack(batch: pa.RecordBatch) -> bytes:
    """A record batch as one compressed binary value (few large shuffle rows
    instead of millions of small ones)."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as r:
        return r.read_next_batch()


def by_size(batches: Iterable[pa.RecordBatch], column: str,
            limit: int) -> Iterator[pa.RecordBatch]:
    """Regroup record batches so that each holds about ``limit`` bytes of
    ``column`` (a single longer row stays whole)."""
    held, size = [], 0
    for b in batches:
        if b.num_rows == 0:
            continue
        flat, off = flat_strings(b.column(column))
        at = 0
        while at < b.num_rows:
            room = limit - size
            stop = int(np.searchsorted(off, off[at] + room, "right")) - 1
            stop = max(min(stop, b.num_rows), at + (0 if held else 1))
            if stop > at:
                held.append(b.slice(at, stop - at))
                size += int(off[stop] - off[at])
                at = stop
            if at < b.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
