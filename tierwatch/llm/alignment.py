"""Cross-tokenizer alignment: which ids of a byte-level BPE (A) and of a
SentencePiece BPE (B) cover the same bytes, and how many documents hold each
pair of ids linked.

    units     " " + text is cut before blanks that follow a visible character.
              No token of A or B crosses such a place, so a unit's tokens,
              groups and links are its own; each distinct unit of a block of
              documents is aligned once
    first     each block sends its distinct pairs with their number of
    pass      documents, dealt to BUCKETS by the A id
    hashing   a bucket's distinct pairs get a minimal perfect hash function and
              the keys in the order of their numbers
    counts    a leaf adds the counts of LEAF blocks into one dense vector
              indexed by the hash; the leaves' vectors are added in a tree of
              FAN branches (verified keys: a pair outside the function raises)
    second    the documents are aligned again; their blocks look the counts up
    pass      by the hash, verify the keys, and sum them over units and texts

A bucket holds at most (A ids / BUCKETS) x (B ids) pairs whatever the corpus,
about 200 x 32,000; nothing is broadcast.  A frequent pair is sent once per
block, never once per occurrence.  Both passes read the same source; a block
is named by its contents and raises if its answers are not complete, so
``docs`` should be files, or a table written by ``common.cut``.

Defined results: null and empty texts, and texts that one tokenizer does not
give back byte for byte, have no tokens: zeros and an empty groups column.
Repeated rows count as documents each and keep their rows; rows without doc_id
count too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (block_name, by_size, cut, flat_strings, hash_strings, mix, pack, ragged_index, shuffle_width,
                     small_batches, texts, unpack)
from .mphash import PerfectHash

BUCKETS = 256
LEAF = 64            # blocks that one dense vector of counts adds up
FAN = 16
BLOCK = 8 << 20      # bytes of text in a block (one longer text is a block)
_BLANK_MARK = "▁"
_OLD_LETTERS = "\u0250"       # below it all tables of letters and blanks agree

_ASKED = "bucket int, block bigint, payload binary"
_SIDE = "block bigint, kind int, part int, size bigint, payload binary, units binary"


# ------------------------------------------------------------------ the units

def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def cut_units(raw: np.ndarray, off: np.ndarray, whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts, each text with a blank before it, and the number of
    units before each text.  Empty texts have none.  ``whole``: a text is a unit."""
    size = np.diff(off)
    some = size > 0
    at = np.concatenate(([0], np.cumsum(size + some)))
    flat = np.full(at[-1], 32, np.uint8)
    keep = np.ones(at[-1], bool)
    keep[at[:-1][some]] = False
    flat[keep] = raw
    if whole:
        starts = at[:-1][some]
    else:
        blank = np.flatnonzero(flat == 32)
        blank = blank[blank >= 3]
        b1, b2, b3 = flat[blank - 1], flat[blank - 2], flat[blank - 3]
        # characters that some table calls white space; too many only make longer units
        white = ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
                 | (b3 == 0xE1) & ((b2 == 0x9A) | (b2 == 0xA0))
                 | (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))
                 | (b3 == 0xE3) & (b2 == 0x80))
        seen = (b1 > 32) & (b1 < 127) | (b1 >= 128) & ~white
        starts = _distinct(np.concatenate((blank[seen], at[:-1][some])))
    bounds = np.append(starts, at[-1])
    units = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()),
                                                             pa.py_buffer(flat.tobytes())])
    return units, np.searchsorted(starts, at)


def _spelled_bytes() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible characters
    stand for themselves, the other bytes follow from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Spellings:
    """Byte strings by id, as one flat array."""

    def __init__(self, by_id: list[bytes]):
        self.length = np.array([len(x) for x in by_id], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ragged_index(self.start[ids], self.length[ids])]


def _ranked(path: str):
    """Encoder by ranks with the vocabulary of a byte-level file, several times
    faster, or None where the file's merges aren't in the order of their ids."""
    import json

    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre, bpe = model.get("pre_tokenizer") or {}, model["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe.get("merges", ())]
    made = [bpe["vocab"].get(x + y) for x, y in pairs]
    plain = not model.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or None in made or made != sorted(made):
        return None
    spelled = _spelled_bytes()
    special = {t["content"] for t in model.get("added_tokens", ())}
    ranks = {bytes(spelled[c] for c in t): i for t, i in bpe["vocab"].items() if t not in special}
    return tiktoken.Encoding("by ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Aligned:
    """The alignment of distinct units: counts, links and group texts of each."""

    def __init__(self, n_a, n_b, n_groups, links, link_off, text, text_off, good):
        self.n_a, self.n_b, self.n_groups, self.good = n_a, n_b, n_groups, good
        self.links, self.link_off = links, link_off
        self.text, self.text_off = text, text_off

    def group_texts(self) -> list[bytes]:
        text = self.text.tobytes()
        return [text[a:b - 1] for a, b in zip(self.text_off[:-1].tolist(), self.text_off[1:].tolist())]


class Aligner:
    """Both tokenizers on one worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # one task, one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True                  # their strings are plain text
        self.quick = _ranked(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelled = _spelled_bytes()
        entries = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            entries[i] = bytes(spelled.get(c, 0) for c in token)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.a_bytes = _Spellings(entries)
        self.b_bytes = _Spellings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else
                                   p.replace(_BLANK_MARK, " ").encode() for i, p in enumerate(pieces)])
        self.digits = _Spellings([str(i).encode() for i in range(max(len(entries), n))])
        self.blank = self.b.piece_to_id(_BLANK_MARK)
        # a piece with a blank after another character may cross units
        self.crosses = any(_BLANK_MARK in p.lstrip(_BLANK_MARK) for i, p in enumerate(pieces)
                           if not self.b.is_control(i) and not self.b.is_unknown(i))

    def units(self, raw: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        return cut_units(raw, off, self.crosses)

    def _encode(self, strings: list[str]) -> tuple[list, list]:
        a = [self.quick(s) if self.quick and (s.isascii() or max(s) < _OLD_LETTERS) else None for s in strings]
        rest = [i for i, ids in enumerate(a) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([strings[i] for i in rest], add_special_tokens=False)):
            a[i] = e.ids
        b = self.b.encode([s[1:] for s in strings], num_threads=1)        # B adds the blank
        return a, [ids if s != " " else [self.blank] for s, ids in zip(strings, b)]

    def _tokens(self, units: pa.Array):
        return tuple(x for ids in self._encode(units.to_pylist()) for x in (
            np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))))

    def align(self, units: pa.Array, spelled: bool = True) -> Aligned:
        """Of all ``units``; ``spelled``: with the group texts, else for the links only."""
        a, n_a, b, n_b = self._tokens(units)
        flat, off = flat_strings(units)
        size = np.diff(off)

        def kept(ids, count, table):
            """Which units come back byte for byte."""
            upto = np.concatenate(([0], np.cumsum(count)))
            total = np.concatenate(([0], np.cumsum(table.length[ids])))[upto]
            same = np.diff(total) == size
            mine = ids[np.repeat(same, count)]
            got, want = table.of(mine), flat[np.repeat(same, size)]
            wrong = np.concatenate(([0], np.cumsum(got != want)))
            ends = np.concatenate(([0], np.cumsum(size[same])))
            same[same] = np.diff(wrong[ends]) == 0
            return same
        good = kept(a, n_a, self.a_bytes) & kept(b, n_b, self.b_bytes)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b, size = n_a * good, n_b * good, size * good
        end_a, end_b, end = np.cumsum(self.a_bytes.length[a]), np.cumsum(self.b_bytes.length[b]), np.cumsum(size)
        # a piece of text between two neighbouring ends lies in one A and one B token: a link
        ends = _distinct(np.concatenate((end_a, end_b)))
        links = (a[np.searchsorted(end_a, ends)] << 32) | b[np.searchsorted(end_b, ends)]
        link_off = np.concatenate(([0], np.searchsorted(ends, end, "right")))
        if not spelled:
            return Aligned(n_a, n_b, None, links, link_off, None, None, good)
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        n_groups = np.diff(np.concatenate(([0], np.searchsorted(both, end, "right"))))
        # group texts: A ids, then B ids of a group, each with the sign that follows it
        in_a, in_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        ids = np.empty(len(a) + len(b), np.int64)
        sign = np.full(len(ids), ord(","), np.uint8)
        at_a = np.arange(len(a)) + np.searchsorted(in_b, in_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(in_a, in_b, "right")
        ids[at_a], ids[at_b] = a, b
        if len(ids):
            sign[at_a[both[in_a] == end_a]] = ord("|")
            sign[at_b[both[in_b] == end_b]] = ord(";")
        long = self.digits.length[ids]
        stop = np.cumsum(long + 1)
        text = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
        text[stop - 1] = sign
        text[ragged_index(stop - 1 - long, long)] = self.digits.of(ids)
        text_off = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        return Aligned(n_a, n_b, n_groups, links, link_off, text, text_off, good)


# ------------------------------------------------------------------ the blocks

class _Block:
    """A block of documents, aligned: its distinct pairs in bucket order."""

    def __init__(self, batch: pa.RecordBatch, aligner: Aligner, spelled: bool = True):
        self.doc_id = batch.column("doc_id")
        units, upto = aligner.units(*flat_strings(batch.column("text")))
        coded = units.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.aligned = aligner.align(coded.dictionary, spelled)
        count = np.diff(upto)
        doc = np.repeat(np.arange(len(count)), count)
        bad = np.zeros(len(count), bool)
        bad[doc[~self.aligned.good[self.codes]]] = True           # one bad unit: the text has no tokens
        self.codes, self.doc = self.codes[~bad[doc]], doc[~bad[doc]]
        self.off = np.concatenate(([0], np.cumsum(count * ~bad)))
        ids = self.doc_id.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        self.name = block_name(ids, self.off, self.codes, hash_strings(coded.dictionary))
        pairs = _distinct(self.aligned.links)
        self.link = np.searchsorted(pairs, self.aligned.links)
        bucket = (mix(pairs >> 32) % np.uint64(BUCKETS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.link = rank[self.link]
        self.pairs = pairs[order]
        self.bounds = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def documents(self) -> np.ndarray:
        """Number of the block's documents that hold each pair."""
        n = max(len(self.aligned.n_a), 1)
        held = _distinct(self.doc * n + self.codes)               # (document, unit) once
        doc, unit = held // n, held % n
        off = self.aligned.link_off
        size = off[unit + 1] - off[unit]
        pair = self.link[ragged_index(off[unit], size)]
        m = max(len(self.pairs), 1)
        return np.bincount(_distinct(np.repeat(doc, size) * m + pair) % m, minlength=len(self.pairs))

    def total(self, of_unit: np.ndarray) -> np.ndarray:
        """Sum of a number of each unit over every document."""
        return _sums(of_unit[self.codes], self.off)


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[off])


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """Loaded once in a Python worker, whatever its number of tasks."""
    return Aligner(a_path, b_path)


def _requests(a_path: str, b_path: str):
    def run(batches):
        aligner = _aligner(a_path, b_path)
        for batch in by_size(batches, "text", BLOCK):
            block = _Block(batch, aligner, spelled=False)
            number, b = block.documents(), block.bounds
            rows = [(i, pack(pa.record_batch([block.pairs[b[i]:b[i + 1]], number[b[i]:b[i + 1]]], ["pair", "n"])))
                    for i in range(BUCKETS) if b[i + 1] > b[i]]
            for at in range(0, len(rows), 64):
                bucket, payload = zip(*rows[at:at + 64])
                yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array([block.name] * len(bucket), pa.int64()),
                                       pa.array(payload, pa.binary())], ["bucket", "block", "payload"])
    return run


def _texts_and_codes(a_path: str, b_path: str, groups: str):
    import hashlib

    def run(batches):
        aligner = _aligner(a_path, b_path)
        for batch in by_size(batches, "text", BLOCK):
            block = _Block(batch, aligner)
            al, off = block.aligned, block.off.tolist()
            spelled, codes = al.group_texts(), block.codes.tolist()
            said = [b";".join([spelled[c] for c in codes[i:j]]) for i, j in zip(off[:-1], off[1:])]
            if groups == "sha256":
                said = [hashlib.sha256(s).hexdigest() if s else "" for s in said]
            else:
                said = [s.decode() for s in said]
            lists = pa.ListArray.from_arrays(pa.array(block.off, pa.int32()), pa.array(block.codes, pa.int32()))
            docs = pa.record_batch([block.doc_id, block.total(al.n_a), block.total(al.n_b), block.total(al.n_groups),
                                    block.total(np.diff(al.link_off)), pa.array(said, pa.string()), lists],
                                   ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "codes"])
            links = pa.ListArray.from_arrays(pa.array(al.link_off, pa.int32()), pa.array(block.link, pa.int32()))
            yield pa.record_batch([pa.array([block.name], pa.int64()), pa.array([1], pa.int32()), pa.array([0], pa.int32()),
                                   pa.array([len(block.pairs)], pa.int64()), pa.array([pack(docs)], pa.binary()),
                                   pa.array([pack(pa.record_batch([links], ["links"]))], pa.binary())],
                                  ["block", "kind", "part", "size", "payload", "units"])
    return run


# ------------------------------------------------- hashing, counts and answers

def _rows(batches, *names):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _functions(batches):
    """(bucket, hash, keys): the function of a bucket's distinct pairs."""
    def emit(bucket, keys):
        hashed = PerfectHash.build(keys)
        placed = np.empty_like(keys)
        placed[hashed.numbers(keys)] = keys
        return pa.record_batch([pa.array([bucket], pa.int32()), pa.array([hashed.to_bytes()], pa.binary()),
                                pa.array([placed.tobytes()], pa.binary())], ["bucket", "hash", "keys"])
    now, keys, more, size = None, np.zeros(0, np.int64), [], 0
    for bucket, payload in _rows(batches, "bucket", "payload"):
        if bucket != now:
            if now is not None:
                yield emit(now, np.unique(np.concatenate([keys, *more])))
            now, keys, more, size = bucket, np.zeros(0, np.int64), [], 0
        more.append(unpack(payload).column("pair").to_numpy())
        size += len(more[-1])
        if size > max(len(keys), 1 << 18):                  # never more than twice the distinct keys, or so
            keys, more, size = np.unique(np.concatenate([keys, *more])), [], 0
    if now is not None:
        yield emit(now, np.unique(np.concatenate([keys, *more])))


def _numbers(hashed: PerfectHash, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    at = hashed.numbers(pairs)
    if len(pairs) and (at.min() < 0 or (keys[at] != pairs).any()):
        raise RuntimeError("a pair of ids is missing from its hash function")
    return at


def _leaf_vectors(batches):
    """(bucket, node, counts): dense counts of a leaf's blocks, by hash number."""
    def emit(at, total):
        return pa.record_batch([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()),
                                pa.array([pack(pa.record_batch([total], ["n"]))], pa.binary())], ["bucket", "node", "counts"])
    now, total = None, None
    for bucket, leaf, kind, blob, keys in _rows(batches, "bucket", "leaf", "kind", "payload", "keys"):
        if (bucket, leaf) != now:
            if now is not None:
                yield emit(now, total)
            now = bucket, leaf
        if kind == 0:
            hashed, names = PerfectHash.from_bytes(blob), np.frombuffer(keys, np.int64)
            total = np.zeros(len(names), np.int64)
        else:
            asked = unpack(blob)
            total[_numbers(hashed, names, asked.column("pair").to_numpy())] += asked.column("n").to_numpy()
    if now is not None:
        yield emit(now, total)


def _added(batches):
    now, total = None, None

    def emit():
        return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()),
                                pa.array([pack(pa.record_batch([total], ["n"]))], pa.binary())], ["bucket", "node", "counts"])
    for bucket, node, blob in _rows(batches, "bucket", "node", "counts"):
        part = unpack(blob).column("n").to_numpy()
        if (bucket, node) != now:
            if now is not None:
                yield emit()
            now, total = (bucket, node), part.copy()
        else:
            total += part
    if now is not None:
        yield emit()


def _looked_up(batches):
    """(block, kind 0, part = bucket, ...): count of each asked pair, and
    whether no pair of its A id has a higher one."""
    for bucket, block, kind, blob, keys, counts in _rows(batches, "bucket", "block", "kind", "payload", "keys", "counts"):
        if kind == 0:
            hashed, names = PerfectHash.from_bytes(blob), np.frombuffer(keys, np.int64)
            total = unpack(counts).column("n").to_numpy()
            ids, of = np.unique(names >> 32, return_inverse=True)      # all pairs of an A id are in one bucket
            top = np.zeros(len(ids), np.int64)
            np.maximum.at(top, of, total)
            best = total == top[of]
            continue
        at = _numbers(hashed, names, unpack(blob).column("pair").to_numpy())
        answer = pack(pa.record_batch([total[at], pa.array(best[at])], ["n", "best"]))
        yield pa.record_batch([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([bucket], pa.int32()),
                               pa.array([len(at)], pa.int64()), pa.array([answer], pa.binary()), pa.array([b""], pa.binary())],
                              ["block", "kind", "part", "size", "payload", "units"])


def _meet(batches):
    block, parts = None, {}
    for name, kind, part, size, payload, units in _rows(batches, "block", "kind", "part", "size", "payload", "units"):
        if name != block:
            block, parts = name, {}
        if kind == 0:
            parts.setdefault(part, payload)                # equal blocks ask twice
            continue
        got = [unpack(p) for p in parts.values()]
        if sum(p.num_rows for p in got) != size:
            raise RuntimeError("a block's documents and answers do not belong together")
        number = np.concatenate([p.column("n").to_numpy() for p in got] or [np.zeros(0, np.int64)])
        best = np.concatenate([p.column("best").to_numpy(zero_copy_only=False) for p in got] or [np.zeros(0, bool)])
        links = unpack(units).column("links")
        off, link = links.offsets.to_numpy(), links.values.to_numpy()
        docs = unpack(payload)
        codes = docs.column("codes")
        each = [_sums(_sums(x[link].astype(np.int64), off)[codes.values.to_numpy()], codes.offsets.to_numpy())
                for x in (best, number)]
        yield pa.record_batch([*(docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *each,
                               docs.column("groups")],
                              ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def _dealt(rows: DataFrame, tables: DataFrame, width: int) -> DataFrame:
    """Each bucket's table before the rows of every leaf that asks for it."""
    wanted = rows.select("bucket", "leaf").distinct().join(tables, "bucket").withColumn("kind", F.lit(0))
    return (wanted.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
            .repartition(width, "bucket", "leaf").sortWithinPartitions("bucket", "leaf", "kind"))


def count_pairs(asked: DataFrame) -> DataFrame:
    """(bucket, payload, keys, counts): hash function, keys and dense document
    counts of each bucket, from the requests of all blocks (with their leaf)."""
    width = shuffle_width(asked.sparkSession)
    functions = cut(asked.select("bucket", "payload").repartition(width, "bucket").sortWithinPartitions("bucket")
                    .mapInArrow(_functions, "bucket int, hash binary, keys binary"), "pair-hash")
    functions = functions.withColumnRenamed("hash", "payload")
    counted = (_dealt(asked, functions, width).select("bucket", "leaf", "kind", "payload", "keys")
               .mapInArrow(_leaf_vectors, "bucket int, node bigint, counts binary"))
    leaves = asked.agg(F.max("leaf")).first()[0] or 0
    while leaves:
        leaves //= FAN
        counted = (counted.withColumn("node", F.floor(F.col("node") / FAN)).repartition(width, "bucket", "node")
                   .sortWithinPartitions("bucket", "node").mapInArrow(_added, "bucket int, node bigint, counts binary"))
    return cut(functions.join(counted.select("bucket", "counts"), "bucket"), "pair-counts")


def requests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(bucket, block, payload, leaf): distinct pairs of every block."""
    asked = cut(texts(docs).mapInArrow(_requests(a_path, b_path), _ASKED), "pairs")
    leaves = asked.select("block").distinct().count() // LEAF + 1
    return asked.withColumn("leaf", F.pmod("block", F.lit(leaves)))


def pair_table(counts: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs) of ``count_pairs``."""
    def run(batches):
        for keys, blob in _rows(batches, "keys", "counts"):
            pair = np.frombuffer(keys, np.int64)
            yield pa.record_batch([pair >> 32, pair & 0xFFFFFFFF, unpack(blob).column("n")], ["a_id", "b_id", "n_docs"])
    return counts.select("keys", "counts").mapInArrow(run, "a_id bigint, b_id bigint, n_docs bigint")


def align(docs: DataFrame, a_path: str, b_path: str, groups: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): groups
    is ``a1,a2|b1;a3|b2,b3``, or with ``groups="sha256"`` its hex digest."""
    small_batches(docs.sparkSession, 2000)
    width = shuffle_width(docs.sparkSession)
    asked = requests(docs, a_path, b_path)
    answers = (_dealt(asked, count_pairs(asked), width)
               .select("bucket", "block", "kind", "payload", "keys", "counts").mapInArrow(_looked_up, _SIDE))
    again = texts(docs).mapInArrow(_texts_and_codes(a_path, b_path, groups), _SIDE)
    return (answers.unionByName(again).repartition(width, "block").sortWithinPartitions("block", "kind", "part")
            .mapInArrow(_meet, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
                               "count_sum bigint, groups string"))
