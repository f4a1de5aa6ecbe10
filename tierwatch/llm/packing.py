"""Packing tokenised documents into fixed windows by minimum bin slack.

1. Every document is tokenised (distinct-word shuffle) and its ids, closed by
   an end id, are cut into windows of ``capacity`` ids and one rest.
2. The pieces are counted by length: a multiset of at most ``capacity``
   distinct values, whatever the corpus size.
3. Minimum bin slack on that multiset: the longest piece left is seeded, a
   bitset subset-sum over the lengths left (with their counts) finds the sum
   closest to the free space, and the counts are backtracked.  The window
   pattern is used as often as the counts allow, so the work depends on the
   number of distinct lengths only.
4. Pieces are numbered within their length (in salted parts, so that a length
   shared by a third of all pieces is not one task) and looked up in the plan.

Defined results: null or empty text is one piece holding the end id; repeated
rows are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import join_ids
from .common import cut, shuffle_width, texts
from .wordmap import map_words

CAPACITY = 4096
END_ID = 2


# ------------------------------------------------------------- tokenisation

def _word_encoder(path: str):
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)

        def encode(words: pa.Array) -> pa.Array:
            sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for at in range(0, len(words), 4_000):
                ids = [e.ids for e in tokenizer.encode_batch_fast(words.slice(at, 4_000).to_pylist(),
                                                                  add_special_tokens=False)]     # ids only, no offsets
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                sizes.append(n)
                flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())))
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat)))
        return encode
    return make


def _pieces(capacity: int, end_id: int):
    tail = np.array([end_id], np.int32)

    def finish(rows, values, offsets, codes):
        ids = rows.column("doc_id")
        for a, b, docs in join_ids(rows, values, offsets, codes, tail):
            off = docs.buffers()[1]
            total = np.diff(np.frombuffer(off, np.int32, b - a + 1).astype(np.int64)) // 4
            many = -(-total // capacity)
            doc = np.repeat(np.arange(b - a), many)
            first = np.cumsum(many) - many
            start = (np.arange(int(many.sum())) - np.repeat(first, many)) * capacity
            length = np.minimum(total[doc] - start, capacity)
            bounds = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
            cutup = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.tobytes()),
                                                                  docs.buffers()[2]])
            yield pa.record_batch([ids.slice(a, b - a).take(pa.array(doc)), pa.array(start), pa.array(length),
                                   pa.array(total[doc]), cutup],
                                  ["doc_id", "start", "length", "doc_tokens", "ids"])
    return finish


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): windows of each document's
    ids; ids as little-endian unsigned 32-bit.  The tokenizer drops white
    space and never merges across it, so blank-separated words are encoded."""
    return map_words(texts(docs), F.col("text"), _word_encoder(path), _pieces(capacity, end_id),
                     "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary",
                     split=pc.ascii_split_whitespace)


# ---------------------------------------------------------------- the plan

def _closest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """Counts per length whose sum is the largest possible within ``room``."""
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for size in lengths:                      # longest first: short pieces stay for later windows
        have = min(left[size], room // size)
        if not have:
            continue
        before, part = reach, 1
        while have:
            take = min(part, have)
            reach |= (reach << (take * size)) & full
            have -= take
            part *= 2
        steps.append((size, before))
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for size, before in reversed(steps):
        k = 0
        while not before >> (at - k * size) & 1:
            k += 1
        if k:
            used[size] = k
            at -= k * size
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, first_window, per_window, base):
    pieces of ``length`` ranked in [rank_from, rank_to) go ``per_window`` at a
    time into consecutive windows, the first at offset ``base``."""
    left = {k: v for k, v in counts.items() if v}
    given = dict.fromkeys(left, 0)
    lengths = sorted(left, reverse=True)
    rows, window = [], 0
    while lengths:
        pattern = {lengths[0]: 1}
        left[lengths[0]] -= 1
        for size, k in _closest(lengths, left, capacity - lengths[0]).items():
            pattern[size] = pattern.get(size, 0) + k
        left[lengths[0]] += 1
        times = min(left[size] // k for size, k in pattern.items())
        base = 0
        for size, k in pattern.items():
            rows.append((size, given[size], given[size] + times * k, window, k, base))
            given[size] += times * k
            left[size] -= times * k
            base += size * k
        window += times
        lengths = [size for size in lengths if left[size]]
    return rows


_PLAN = "p_length bigint, rank_from bigint, rank_to bigint, first_window bigint, per_window bigint, base bigint"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, start, length <= capacity, any further columns)
    plus sequence_id and offset.  The plan holds a few rows per distinct
    length (at most ``capacity`` of them), so broadcasting it is bounded by
    the capacity, not by the corpus."""
    spark = pieces.sparkSession
    pieces = cut(pieces, "pieces")
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shuffle_width(spark))))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}   # <= capacity rows
    plan = spark.createDataFrame(plan_windows(counts, capacity) or [], _PLAN)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    ranked = (salted.withColumn("_row", F.row_number().over(place) - 1)
              .join(base, ["length", "_salt"])
              .withColumn("_rank", F.col("_row") + F.col("_before")))
    slot = F.col("_rank") - F.col("rank_from")
    return (ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length"))
                        & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
            .select(*pieces.columns,
                    (F.col("first_window") + F.floor(slot / F.col("per_window"))).cast("bigint").alias("sequence_id"),
                    (F.col("base") + F.pmod(slot, F.col("per_window")) * F.col("length")).cast("bigint").alias("offset")))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset."""
    pieces = tokenised_pieces(docs, path, capacity, end_id).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(pieces, capacity)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces): the packed id windows themselves; a group
    holds at most ``capacity`` ids by construction."""
    where = placed.select("doc_id", "start", "sequence_id", "offset")
    held = (pieces.select("doc_id", "start", "ids").join(where, ["doc_id", "start"])
            .groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")))
    joined = F.aggregate(F.col("p"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return held.select("sequence_id", joined.alias("ids"), F.size("p").alias("n_pieces"))
