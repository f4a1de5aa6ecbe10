"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

A text is cut into pre-tokens by the vocabulary's public pattern (in the JVM,
Unicode classes); merges never cross a pre-token, so each distinct pre-token
of the corpus is encoded once and its ids are joined back and reassembled by
position (``wordmap``).  Decoding looks every id up in the token-byte table.

Defined results: null or empty text gives no ids; repeated rows give repeated
rows; bytes of a decoded text equal the text's UTF-8; an id outside the
vocabulary raises.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_strings, ragged_index, texts
from .wordmap import map_words

_SLICE = 1 << 18        # ids assembled at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (a fixed public vocabulary)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encoder(path: str, pattern: str):
    def make():
        import tiktoken
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=pattern,
                                mergeable_ranks=read_ranks(path), special_tokens={})
        one = enc.encode_ordinary

        def encode(words: pa.Array) -> pa.Array:
            ids = [one(w) for w in words.to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for w in ids for i in w), np.int32, int(sizes.sum()))
            return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(flat))
        return encode
    return make


def doc_slices(sizes: np.ndarray, limit: int):
    """Document ranges whose summed sizes stay near ``limit``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(int(np.searchsorted(ends, base + limit, "right")), at + 1)
        yield at, stop
        at = stop


def join_ids(rows, values, offsets, codes, tail: np.ndarray):
    """Per document the little-endian unsigned ids of its words, in order,
    followed by ``tail``; yields (first row, stop row, binary array)."""
    if values is None:
        starts = lens = np.zeros(0, np.int64)
        flat = np.zeros(0, np.int32)
    else:
        off = values.offsets.to_numpy().astype(np.int64)
        starts, lens, flat = off[:-1], np.diff(off), values.values.to_numpy()
    for first, last in doc_slices(np.diff(offsets), _SLICE):      # by words, then by their ids
        words = codes[offsets[first]:offsets[last]]
        upto = np.concatenate(([0], np.cumsum(lens[words])))
        at = offsets[first:last + 1] - offsets[first]
        sizes = upto[at[1:]] - upto[at[:-1]]
        for a, b in doc_slices(sizes, _SLICE):
            c = words[at[a]:at[b]]
            ids = flat[ragged_index(starts[c], lens[c])]
            bounds = np.concatenate(([0], np.cumsum(sizes[a:b])))
            if len(tail):
                ids = np.insert(ids, np.repeat(bounds[1:], len(tail)), np.tile(tail, b - a))
                bounds = bounds + len(tail) * np.arange(b - a + 1)
            data = ids.astype("<u4").tobytes()
            off = pa.py_buffer((bounds * 4).astype(np.int32).tobytes())
            yield first + a, first + b, pa.Array.from_buffers(pa.binary(), b - a, [None, off, pa.py_buffer(data)])


def _finish(rows, values, offsets, codes):
    for a, b, ids in join_ids(rows, values, offsets, codes, np.zeros(0, np.int32)):
        yield pa.record_batch([rows.column("doc_id").slice(a, b - a), ids], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers."""
    words = F.regexp_extract_all(F.col("text"), F.lit("(?U)" + pattern), F.lit(0))
    return map_words(texts(docs), words, _encoder(path, pattern), _finish, "doc_id bigint, ids binary")


@lru_cache(maxsize=4)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths): the bytes of every id, once per worker."""
    ranks = read_ranks(path)
    lens = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lens[i] = len(token)
    starts = np.cumsum(lens) - lens
    flat = np.zeros(int(lens.sum()), np.uint8)
    for token, i in ranks.items():
        flat[starts[i]:starts[i] + len(token)] = np.frombuffer(token, np.uint8)
    return flat, starts, lens


def _decode(path: str):
    def run(batches):
        flat, starts, lens = token_table(path)
        size = len(lens)
        for batch in batches:
            raw, off = flat_strings(batch.column("ids"))
            for a, b in doc_slices(np.diff(off), 4 * _SLICE):
                ids = raw[off[a]:off[b]].view("<u4").astype(np.int64)
                if len(ids) and (int(ids.max()) >= size or not lens[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                upto = np.concatenate(([0], np.cumsum(lens[ids])))
                bounds = upto[(off[a:b + 1] - off[a]) // 4].astype(np.int32)
                data = flat[ragged_index(starts[ids], lens[ids])]
                text = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds.tobytes()),
                                                                  pa.py_buffer(data.tobytes())])
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), batch.column("ids").slice(a, b - a),
                                       text], ["doc_id", "ids", "decoded"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the token bytes of every id, concatenated.
    The token-byte table has one row per vocabulary entry and is read from
    ``path`` on every task; ids never leave their row."""
    return (encoded.select("doc_id", F.coalesce(F.col("ids"), F.lit(b"")).alias("ids"))
            .mapInArrow(_decode(path), "doc_id bigint, ids binary, decoded binary"))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digest row per document of its ids and of the decoded bytes.  Decoding
    follows encoding in the same Python worker (one worker a task)."""
    def finish(rows, values, offsets, codes):
        return _decode(path)(_finish(rows, values, offsets, codes))
    words = F.regexp_extract_all(F.col("text"), F.lit("(?U)" + pattern), F.lit(0))
    both = map_words(texts(docs), words, _encoder(path, pattern), finish, "doc_id bigint, ids binary, decoded binary")
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
