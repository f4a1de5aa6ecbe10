"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases by deterministic coin tossing: every
symbol gets a label from the lowest bit in which it differs from its left
neighbour; after a few rounds labels are below 8 and their local maxima begin
phrases.  A phrase's name hashes its symbols, and the names are parsed again,
level by level.  Where phrases begin depends on a bounded neighbourhood only,
so equal substrings get the same interior names at any offset.

The fingerprint is a one-permutation min-hash of a text's phrase names on the
levels from ``FIRST_LEVEL`` up: ``BINS`` bins of 16 bits, as hexadecimal text.
Likeness is the share of equal bins among the bins that either side fills.

Defined results: equal texts have equal fingerprints; null text is empty; an
empty text has an empty fingerprint (all zero), like another empty one (1.0)
and unlike any other (0.0); a single document is its own next; equal ids are
ordered by text; a null id sorts first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, position_keys, shuffle_width, small_batches

BINS = 64
FIRST_LEVEL, LEVELS = 2, 4
_SLICE = 1 << 20
_U = np.uint64
_NO_ID = -(1 << 63)


def _toss(labels: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One round: twice the lowest bit differing from the left, plus that bit
    (a text's first symbol has its own complement to the left)."""
    left = np.empty_like(labels)
    left[1:] = labels[:-1]
    left[heads] = ~labels[heads]
    diff = labels ^ left
    low = diff & (~diff + labels.dtype.type(1))
    spot = np.bitwise_count(low - labels.dtype.type(1))
    bit = (labels & low) != 0
    return (2 * spot + bit).astype(np.uint8)


def _parse(names: np.ndarray, heads: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names one level up, and where each text's phrases begin.
    ``heads`` are the positions of the texts' first symbols."""
    fresh = np.empty(len(names), bool)
    np.not_equal(names[1:], names[:-1], out=fresh[1:])
    fresh[heads] = True
    at = np.flatnonzero(fresh)
    labels, run = names[at], np.diff(at, append=len(names))
    heads = np.searchsorted(at, heads)
    names = labels.astype(_U)
    long = np.flatnonzero(run > 1)             # a run of one symbol is a symbol of its own
    names[long] = mix(names[long] + run[long].astype(_U) * _U(0x9E3779B97F4A7C15))
    for _ in range(4):
        labels = _toss(labels, heads)
    begin = np.zeros(len(names), bool)         # an inner local maximum begins a phrase
    begin[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    begin[np.maximum(heads, 1) - 1] = False    # a text's last symbol has no right neighbour
    begin[heads] = True
    starts = np.flatnonzero(begin)
    lengths = np.diff(starts, append=len(names))
    spot = np.arange(len(names), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
    part = (names + _U(1)) * position_keys(int(lengths.max()), level)[spot]
    out = np.add.reduceat(part, starts) + lengths.astype(_U) * _U(0xA0761D6478BD642F)
    return mix(out), np.searchsorted(starts, heads)


def sketches(texts: list[bytes]) -> np.ndarray:
    """(n, BINS) 16-bit values; 0 marks an empty bin."""
    out = np.zeros((len(texts), BINS), np.uint16)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    filled = np.flatnonzero(sizes)
    at = 0
    while at < len(filled):
        ends = np.cumsum(sizes[filled[at:]])
        stop = at + max(int(np.searchsorted(ends, _SLICE, "right")), 1)
        docs = filled[at:stop]
        names = np.frombuffer(b"".join([texts[i] for i in docs]), np.uint8)
        heads, found = ends[:stop - at] - sizes[docs], []
        for level in range(1, LEVELS + 1):
            names, heads = _parse(names, heads, level)
            if level >= FIRST_LEVEL:
                found.append((names, np.repeat(docs, np.diff(heads, append=len(names)))))
        names = np.concatenate([n for n, _ in found])
        slot = np.concatenate([d for _, d in found]) * BINS + (names % _U(BINS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], mix(names[order])
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        low = np.minimum.reduceat(value, first)
        out.reshape(-1)[slot[first]] = (mix(low) % _U(65535)).astype(np.uint16) + 1
        at = stop
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins, row by row."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def as_text(sketch: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(sketch.astype(">u2")).tobytes().hex()
    width = BINS * 4
    offsets = pa.py_buffer((np.arange(len(sketch) + 1) * width).astype(np.int32).tobytes())
    return pa.StringArray.from_buffers(len(sketch), offsets, pa.py_buffer(data.encode()))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of whole texts; no shuffle."""
    def run(batches):
        for b in batches:
            texts = [t.encode() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), as_text(sketches(texts))], ["doc_id", "fingerprint"])
    return (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .mapInArrow(run, "doc_id bigint, fingerprint string"))


# ------------------------------------------------- a document and its next

_OUT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _neighbours(batches):
    carry = None
    for batch in batches:
        if carry is not None:
            batch = pa.concat_batches([carry, batch])
        carry = batch.slice(batch.num_rows - 1)
        texts, parts = batch.column("text").to_pylist(), batch.column("part").to_numpy()
        copies = batch.column("copy").to_numpy()
        at = 0
        while at < len(texts) - 1:                 # bounded slices of consecutive documents
            stop, size = at, 0
            while stop < len(texts) - 1 and (size < 2 * _SLICE or stop == at):
                size += len(texts[stop])
                stop += 1
            here = np.arange(at, stop)
            pair = here[(parts[here] == parts[here + 1]) & (copies[here] == 0)]
            if len(pair):
                changed = [edited(texts[i], texts[i + 1]).encode() for i in pair]
                own = sketches([t.encode() for t in texts[at:stop + 1]])
                a, b, new = own[pair - at], own[pair - at + 1], sketches(changed)
                yield pa.record_batch([
                    batch.column("doc_id").take(pa.array(pair)),
                    pa.array([len(texts[i]) for i in pair], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in changed]),
                    as_text(a), as_text(new), pa.array(likeness(a, new)), pa.array(likeness(a, b))],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                     "near_edited", "near_next"])
            at = stop


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and the next document by id.

    Documents are dealt into id ranges; the first document of a range also
    goes to the end of the range before it (the very first to the last), so
    each range knows all its successors and texts are shuffled once.  The
    bounds and range heads are one value per shuffle partition."""
    width = shuffle_width(docs.sparkSession)
    small_batches(docs.sparkSession)
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                      F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("sort_id"))
    shares = [i / width for i in range(1, width)]
    cuts = (src.agg(F.percentile_approx("sort_id", shares, 10000).alias("b")).first()["b"] or []) if shares else []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda b: b < F.col("sort_id")))
    src = src.withColumn("part", part)
    heads = sorted(tuple(r) for r in src.groupBy("part").agg(F.min("sort_id")).collect())    # <= width rows
    if not heads:
        return src.sparkSession.createDataFrame([], _OUT)
    before = F.map_from_arrays(F.array(*[F.lit(h).cast("bigint") for _, h in heads]),
                               F.array(*[F.lit(heads[i - 1][0]) for i in range(len(heads))]))
    copy = F.try_element_at(before, F.col("sort_id"))
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("copy"))
    also = F.struct(copy.alias("part"), F.lit(1).alias("copy"))
    dealt = (src.withColumn("to", F.explode(F.filter(F.array(own, also), lambda s: s["part"].isNotNull())))
             .select("doc_id", "text", "sort_id", "to.part", "to.copy"))
    return (dealt.repartition(max(width, 1), "part").sortWithinPartitions("part", "copy", "sort_id", "text")
            .select("doc_id", "text", "part", "copy").mapInArrow(_neighbours, _OUT))
