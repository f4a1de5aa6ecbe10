"""Distinct-word shuffle: compute something once per distinct word of a
corpus and bring it back to every position.

    block   a bounded run of documents (one Arrow batch of a partition)
    scan 1  each block sends its distinct words, packed per word bucket
    encode  a bucket holds all blocks' requests for its words: every distinct
            word is encoded once and the answer returns to the asking blocks
    scan 2  each block sends its documents as positions into its word list
    meet    answers and positions of a block meet; texts are reassembled

Shuffled are word lists and small codes, never texts, and no value holds more
than one block.  A frequent word is asked for once per block, so it is never
a hot key.  Both scans read the same source; a block is named by the hash of
its own rows, and a block whose answers are incomplete raises instead of
giving wrong text (an executor lost in between only causes re-reads).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_name, hash_strings, pack, shuffle_width, small_batches, tidy, unpack

_REQUEST = "bucket int, block bigint, payload binary"
_ANSWER = "block bigint, kind int, part int, size bigint, payload binary"
_FLUSH = 16 << 20
_PART = 1 << 20           # bytes of a block that are cut into words at a time
BLOCK_ROWS = 5000         # documents in a block, unless Arrow's own limit in bytes comes first

Encode = Callable[[pa.Array], pa.Array]
Split = Callable[[pa.Array], pa.Array]
Finish = Callable[[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _coded(batch: pa.RecordBatch, buckets: int, split: Split | None):
    """Documents without words, counts per document, codes, word list in
    bucket order, bucket bounds and the block's name."""
    column = batch.column("words")
    step = max(1, len(column) * _PART // max(1, column.nbytes))
    counts, indices, found = [], [], []
    for at in range(0, len(column), step):
        words = column.slice(at, step)
        if split is not None:
            words = split(words)
        counts.append(np.diff(words.offsets.to_numpy()))
        part = words.flatten().dictionary_encode()
        indices.append(part.indices.to_numpy(zero_copy_only=False))
        found.append(part.dictionary)
    counts, sizes = np.concatenate(counts), [len(f) for f in found]
    merged = pa.concat_arrays(found).dictionary_encode()
    vocab = merged.dictionary
    hashes = hash_strings(vocab)
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((hashes, bucket))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    code = np.split(rank[merged.indices.to_numpy(zero_copy_only=False)], np.cumsum(sizes)[:-1])
    codes = np.concatenate([c[i] for c, i in zip(code, indices)])
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    docs = batch.drop_columns(["words"])
    ids = docs.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    return docs, counts, codes, vocab.take(pa.array(order)), bounds, block_name(ids, counts, hashes[order])


def _requests(buckets: int, split: Split | None):
    def requests(batch):
        _, _, _, vocab, bounds, block = _coded(batch, buckets, split)
        rows = [(b, block, pack(pa.record_batch([vocab.slice(bounds[b], bounds[b + 1] - bounds[b])], ["w"])))
                for b in range(buckets) if bounds[b + 1] > bounds[b]]
        bucket, names, payload = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(names, pa.int64()),
                                pa.array(payload, pa.binary())], ["bucket", "block", "payload"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield requests(batch)            # of its own, so that no block's words wait for the next block
    return run


def _answers(make_encode: Callable[[], Encode]):
    def run(batches):
        encode = make_encode()
        asked, held, size = [], [], 0

        def flush():
            coded = pa.concat_arrays(held).dictionary_encode()
            held.clear()
            values = encode(coded.dictionary)
            at = 0
            for bucket, block, n in asked:
                mine = values.take(coded.indices.slice(at, n))
                at += n
                payload = pack(pa.record_batch([mine], ["v"]))
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([0], pa.int32()),
                                       pa.array([bucket], pa.int32()), pa.array([n], pa.int64()),
                                       pa.array([payload], pa.binary())],
                                      ["block", "kind", "part", "size", "payload"])
            asked.clear()

        for batch in batches:
            payloads = batch.column("payload")
            for i, (bucket, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "block")))):
                held.append(unpack(payloads[i].as_py()).column(0))
                asked.append((bucket, block, len(held[-1])))
                size += held[-1].nbytes
                if size >= _FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
    return run


def _positions(buckets: int, split: Split | None):
    def positions(batch):
        docs, counts, codes, vocab, _, block = _coded(batch, buckets, split)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        blob = pack(docs.append_column("codes", pa.ListArray.from_arrays(offsets, pa.array(codes))))
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([1], pa.int32()),
                                pa.array([0], pa.int32()), pa.array([len(vocab)], pa.int64()),
                                pa.array([blob], pa.binary())],
                               ["block", "kind", "part", "size", "payload"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield positions(batch)
    return run


def _meet(finish: Finish):
    def run(batches):
        block, values = None, {}

        def meeting(payload, size):
            parts = [unpack(p).column(0) for p in values.values()]
            if sum(map(len, parts)) != size:
                raise RuntimeError("a block's documents and word answers do not belong together")
            table = pa.concat_arrays(parts) if parts else None
            del parts
            docs = unpack(payload)
            codes = docs.column("codes")
            yield from finish(docs.drop_columns(["codes"]), table, codes.offsets.to_numpy(), codes.values.to_numpy())

        for batch in batches:
            payloads = batch.column("payload")           # one at a time becomes an object of its own
            for i, (name, kind, part, size) in enumerate(zip(*(batch.column(c).to_pylist()
                                                               for c in ("block", "kind", "part", "size")))):
                if name != block:
                    block, values = name, {}
                if kind == 0:
                    values.setdefault(part, payloads[i].as_py())      # equal blocks ask twice
                else:
                    yield from meeting(payloads[i].as_py(), size)
    return run


def map_words(docs: DataFrame, words: Column, make_encode: Callable[[], Encode],
              finish: Finish, schema: str, split: Split | None = None) -> DataFrame:
    """``words`` (array<string>, or a string that ``split`` cuts in the worker)
    evaluated over ``docs``; only doc_id travels with the positions; ``make_encode()`` builds, once per task, the function
    from distinct words to an aligned Arrow array; ``finish(rows, values,
    offsets, codes)`` yields result batches, where document i's words have
    the values ``values[codes[offsets[i]:offsets[i+1]]]`` (``values`` is None
    for a block without words).  Rows may repeat; no row is lost."""
    spark = docs.sparkSession
    n = shuffle_width(spark)
    small_batches(spark, BLOCK_ROWS)
    src = docs.select("doc_id", words.alias("words"))
    asked = src.mapInArrow(tidy(_requests(n, split)), _REQUEST).repartition(n, "bucket")
    answered = asked.mapInArrow(tidy(_answers(make_encode)), _ANSWER)
    placed = src.mapInArrow(tidy(_positions(n, split)), _ANSWER)
    return (answered.unionByName(placed).repartition(n, "block")
            .sortWithinPartitions("block", "kind", "part")
            .mapInArrow(tidy(_meet(finish)), schema))
