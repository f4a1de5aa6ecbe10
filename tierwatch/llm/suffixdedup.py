"""Dedup of repeated byte strings: intervals of a Burrows-Wheeler transform,
extended backwards breadth-first up to the minimum length.

Every byte covered by a string of ``MIN_LENGTH`` bytes that also starts in a
document with a smaller id is removed.

A suffix order of a whole corpus is no distributed object, so equal strings
are first brought together.  Each string of 50 bytes has one anchor, the
20-byte gram with the smallest hash in it; equal strings have equal anchors at
equal places.  The strings of one anchor occurrence are consecutive and form
one context of at most 80 bytes.

    scan 1    blocks of documents send their anchor hashes, sorted, by range
    shared    a range answers each block which of them occur twice or more, and
              which more than ``HOT`` times
    scan 2    block texts (compressed) meet the answers; contexts of shared
              anchors are sent on by anchor.  Of equal contexts in a block only
              the smallest document's go, the others are settled at once, so a
              passage of a third of all documents is one context per block
    hot       an anchor of more than ``HOT`` occurrences (a phrase of many
              documents in different surroundings) has no range of its own: its
              strings of 50 bytes go on by their own hash, each once per block
              and document, and the smallest document of each is known at once
    suffixes  all different contexts of an anchor range form one text; its
              suffixes are ordered, and intervals of the transform are extended
              backwards by one byte per round.  Round l finds every boundary
              between neighbours with a common prefix of l bytes; after round
              ``MIN_LENGTH`` - 1 the rows between boundaries are the strings of
              50 bytes that are equal.  The smallest document of each is known
    scan 3    block texts meet the removed strings and are cut

Texts move compressed and only to their own block; nothing is sampled.

Defined results: null or empty text has no bytes; rows of equal doc_id are one
document here (they do not remove each other's strings); a null doc_id sorts
before all others; texts under 50 bytes lose nothing; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_name, by_size, flat_strings, hash_ragged, mix, pack, ragged_index, shuffle_width, small_batches, tidy, unpack

MIN_LENGTH = 50
GRAM = 20
_W = MIN_LENGTH - GRAM + 1              # grams in a string
_BLOCK = 6 << 20
_STEP = 1 << 16
_HASHED = 1 << 13
_TEXT = 256 << 10                       # bytes of contexts in one transform
HOT = 4096                              # occurrences of an anchor whose contexts may meet in one transform
_STRINGS = 1 << 20                      # strings of hot anchors held at once
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_TO_RANGE = "bucket int, block bigint, kind int, payload binary"
_TO_BLOCK = "block bigint, kind int, part int, payload binary"
_NO_ID = -(1 << 63)


# -------------------------------------------------------------- the anchors

def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the gram at every position that has one."""
    one = mix(raw.astype(_U) + _U(1)) if len(raw) < 256 else _BYTE[raw]
    p = [_U(pow(int(_BASE), k, 1 << 64)) for k in (1, 2, 4, 8)]
    two = one[:-1] * p[0] + one[1:]
    four = two[:-2] * p[1] + two[2:]
    eight = four[:-4] * p[2] + four[4:]
    sixteen = eight[:-8] * p[3] + eight[8:]
    return mix(sixteen[:len(raw) - GRAM + 1] * p[2] + four[16:16 + len(raw) - GRAM + 1])


_BYTE = mix(np.arange(256, dtype=_U) + _U(1))


def _windows(raw: np.ndarray, last: np.ndarray):
    """(anchor hash, first start, number of starts) of the strings starting
    where ``last`` (one flag per position) allows."""
    n = len(raw) - MIN_LENGTH + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = _gram_hashes(raw)
    spot = np.arange(len(gram), dtype=_U)
    least = (gram >> _U(20) << _U(20)) | spot           # smallest hash, then leftmost
    size = 1
    while size * 2 <= _W:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = _W - size
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    at = (least[:n] & _U((1 << 20) - 1)).astype(np.int64)
    starts = np.flatnonzero(last[:n])
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = at[starts]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    return gram[at[new]] >> _U(16), starts[new], np.diff(new, append=len(at))


def anchors(raw: np.ndarray, off: np.ndarray):
    """(hash, first start, number of starts) of all anchor occurrences of the
    texts raw[off[i]:off[i+1]], in order; starts are positions in ``raw``."""
    ok = np.ones(len(raw), bool)
    for k in range(1, MIN_LENGTH):
        ends = off[1:] - k
        ok[ends[ends >= 0]] = False
    short = np.flatnonzero(np.diff(off) < MIN_LENGTH)
    ok[ragged_index(off[short], np.diff(off)[short])] = False
    # a short text's end must not hide starts of the text before it: those lie in that text's last bytes anyway
    out = [[], [], []]
    for a in range(0, max(len(raw) - MIN_LENGTH + 1, 0), _STEP):
        h, s, c = _windows(raw[a:a + _STEP + MIN_LENGTH - 1], ok[a:a + _STEP])
        for held, x in zip(out, (h, s + a, c)):
            held.append(x)
    if not out[0]:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in out)


def _ranges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of equal ranges of 48-bit hashes in a sorted array."""
    step = (1 << 48) // buckets + 1
    return np.searchsorted(hashes, np.arange(buckets + 1, dtype=_U) * _U(step))


def _blocks(batches):
    """(name, docs, raw bytes, offsets) of bounded blocks of whole texts."""
    for docs in by_size(batches, "text", _BLOCK):
        raw, off = flat_strings(docs.column("text"))
        ids = docs.column("sort_id").to_numpy()
        yield block_name(ids, np.diff(off), np.array([zlib.crc32(raw)])), docs, raw, off


def _rows(schema: tuple[str, ...], *columns):
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "part": pa.int32(), "block": pa.int64(), "payload": pa.binary()}
    return pa.record_batch([pa.array(c, kinds[n]) for n, c in zip(schema, columns)], list(schema))


def _ask(buckets: int):
    def run(batches):
        for name, _, raw, off in _blocks(batches):
            h, times = np.unique(anchors(raw, off)[0], return_counts=True)
            bounds = _ranges(h, buckets)
            for b in range(buckets):
                x = slice(bounds[b], bounds[b + 1])
                if bounds[b + 1] > bounds[b]:
                    steps = np.diff(h[x], prepend=_U(0))
                    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)   # 48 bits
                    many = times[x] > 1
                    blob = pack(pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in
                                                 (planes, np.packbits(many), times[x][many].astype(np.uint32))], ["h", "m", "c"]))
                    yield _rows(("bucket", "block", "kind", "payload"), [b], [name], [0], [blob])
    return run


def _shared(hot: int):
    """Answers, per range: one bit for each hash that a block asked for, and
    one more for each if any of them is hot."""
    def answer(bucket, held):
        hashes, times = [], []
        for _, blob in held:
            p = unpack(blob)
            planes = np.frombuffer(p.column("h")[0].as_py(), np.uint8).reshape(6, -1)
            steps = np.zeros((planes.shape[1], 8), np.uint8)
            steps[:, :6] = planes.T
            hashes.append(np.cumsum(steps.view(_U).ravel(), dtype=_U))
            count = np.ones(planes.shape[1], np.uint32)
            many = np.unpackbits(np.frombuffer(p.column("m")[0].as_py(), np.uint8), count=len(count)) > 0
            count[many] = np.frombuffer(p.column("c")[0].as_py(), np.uint32)
            times.append(count)
        every, times = np.concatenate(hashes), np.concatenate(times)
        order = np.argsort(every, kind="stable")
        first = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
        total = np.add.reduceat(times[order], first, dtype=np.int64)
        size = np.diff(first, append=len(every))
        flag, above = np.empty(len(every), bool), np.empty(len(every), bool)
        flag[order] = np.repeat(total > 1, size)
        above[order] = np.repeat(total > hot, size)
        at = 0
        for (block, _), h in zip(held, hashes):
            x = slice(at, at + len(h))
            bits = np.packbits(flag[x]).tobytes()
            if above[x].any():
                bits += np.packbits(above[x]).tobytes()
            at += len(h)
            yield _rows(("block", "kind", "part", "payload"), [block], [0], [bucket], [bits])

    def run(batches):
        yield from _by_bucket(batches, answer)
    return run


def _by_bucket(batches, work):
    """Run ``work(bucket, [(block, payload)])`` over rows sorted by bucket;
    equal blocks ask once."""
    now, held = None, {}
    for batch in batches:
        payloads = batch.column("payload")
        for i, (b, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "block")))):
            if b != now and held:
                yield from work(now, list(held.items()))
                held = {}
            now = b
            held[block] = payloads[i].as_py()
    if held:
        yield from work(now, list(held.items()))


def _texts(batches):
    for name, docs, _, _ in _blocks(batches):
        yield _rows(("block", "kind", "part", "payload"), [name], [1], [0], [pack(docs)])


def _meetings(batches):
    """(answers by part, docs, raw, offsets, block) per block."""
    now, parts = None, {}
    for batch in batches:
        payloads = batch.column("payload")
        for i, (block, kind, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "part")))):
            if block != now:
                now, parts = block, {}
            if kind == 0:
                parts.setdefault(part, []).append(payloads[i].as_py())
            else:
                docs = unpack(payloads[i].as_py())
                yield parts, docs, *flat_strings(docs.column("text")), block
                del docs


# ------------------------------------------------------------- the contexts

def _send_contexts(buckets: int):
    def send(parts, docs, raw, off, block):
        h, start, count = anchors(raw, off)
        every = np.unique(h)
        bounds = _ranges(every, buckets)
        flag, hot = np.zeros(len(every), bool), np.zeros(len(every), bool)
        for b in range(buckets):
            size = bounds[b + 1] - bounds[b]
            if size:
                if len(parts.get(b, ())) == 0:
                    raise RuntimeError("a block's texts and its answers do not belong together")
                bits, wide = np.frombuffer(parts[b][0], np.uint8), (size + 7) // 8
                flag[bounds[b]:bounds[b + 1]] = np.unpackbits(bits[:wide], count=size)
                if len(bits) > wide:
                    hot[bounds[b]:bounds[b + 1]] = np.unpackbits(bits[wide:], count=size)
        spot = np.searchsorted(every, h)
        take = flag[spot]
        h, start, count, hot = h[take], start[take], count[take], hot[spot][take]
        if not len(h):
            return
        length = count + MIN_LENGTH - 1
        doc = np.searchsorted(off, start, "right") - 1
        ids = docs.column("sort_id").to_numpy()[doc]
        name = np.empty(len(h), _U)
        for a in range(0, len(h), _HASHED):
            x = slice(a, a + _HASHED)
            name[x] = hash_ragged(raw, start[x], length[x], 7)
        order = np.lexsort((ids, name, h))
        oh, on, oi = h[order], name[order], ids[order]
        new = np.append(True, (oh[1:] != oh[:-1]) | (on[1:] != on[:-1]))
        least = oi[np.flatnonzero(new)][np.cumsum(new) - 1]
        own = oi == least                       # the smallest document of each context in this block
        gone = order[~own]
        if len(gone):
            blob = pack(pa.record_batch([pa.array(start[gone]), pa.array(np.full(len(gone), (1 << 31) - 1, np.int64)
                                         & ((np.int64(1) << count[gone]) - 1))], ["start", "mask"]))
            yield _rows(("bucket", "block", "kind", "payload"), [0], [block], [1], [blob])
        order = order[own]
        some = order[hot[order]]
        if len(some):
            yield from _send_strings(raw, block, start[some], count[some], ids[some], buckets)
        order = order[~hot[order]]
        bounds = _ranges(h[order], buckets)
        for b in range(buckets):
            x = order[bounds[b]:bounds[b + 1]]
            if not len(x):
                continue
            data = raw[ragged_index(start[x], length[x])].tobytes()
            ends = np.concatenate(([0], np.cumsum(length[x]))).astype(np.int32)
            context = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            blob = pack(pa.record_batch([pa.array(h[x].view(np.int64)), pa.array(name[x].view(np.int64)),
                                         pa.array(ids[x]), pa.array(start[x]), context],
                                        ["h", "name", "id", "start", "context"]))
            yield _rows(("bucket", "block", "kind", "payload"), [b], [block], [0], [blob])

    def run(batches):
        for meeting in _meetings(batches):
            yield from send(*meeting)            # of its own, so that no block's arrays wait for the next block
    return run


def _strings(raw: np.ndarray, start: np.ndarray, count: np.ndarray, lowest: int, highest: int, ranges: int):
    """(96 bits of hash as two arrays, first byte, occurrence) of the strings
    of 50 bytes in contexts, as far as their range is in [lowest, highest)."""
    out = [[], [], [], []]
    for a in range(0, len(start), _HASHED):
        s, c = start[a:a + _HASHED], count[a:a + _HASHED]
        length = c + MIN_LENGTH - 1
        gram = _gram_hashes(raw[ragged_index(s, length)])
        at = ragged_index(np.cumsum(length) - length, c)
        # three grams cover a string
        x, y, z = gram[at], gram[at + GRAM], gram[at + MIN_LENGTH - GRAM]
        name = mix(x * _BASE + mix(y) * (_BASE + _U(2)) + mix(z + _U(7)))
        to = _string_range(name, ranges)
        take = np.flatnonzero((to >= lowest) & (to < highest))
        more = mix(mix(x + _U(3)) * _BASE + mix(y + _U(5)) + z * (_BASE + _U(4)))[take] >> _U(32)
        for held, v in zip(out, (name[take], more.astype(np.uint32), ragged_index(s, c)[take],
                                 np.repeat(np.arange(a, a + len(s)), c)[take])):
            held.append(v)
    return tuple(np.concatenate(v) for v in out)


def _string_range(name: np.ndarray, ranges: int) -> np.ndarray:
    return ((name >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _send_strings(raw, block, start, count, ids, buckets):
    """The strings of a block's hot anchors by their hash: of each the rows of
    its smallest document here, the others are settled at once.  Ranges of
    strings follow those of anchors."""
    ranges = -(-buckets // 4)
    turns = min(int(count.sum()) // _STRINGS + 1, ranges)
    edges = np.arange(turns + 1) * ranges // turns
    for lowest, highest in zip(edges[:-1], edges[1:]):
        name, more, first, of = _strings(raw, start, count, lowest, highest, ranges)
        if not len(name):
            continue
        sid = ids[of]
        order = np.lexsort((first, sid, more, name))
        on, om, oi = name[order], more[order], sid[order]
        new = np.append(True, (on[1:] != on[:-1]) | (om[1:] != om[:-1]))
        own = oi == oi[np.flatnonzero(new)][np.cumsum(new) - 1]
        gone = first[order[~own]]
        if len(gone):
            blob = pack(pa.record_batch([pa.array(gone), pa.array(np.ones(len(gone), np.int64))], ["start", "mask"]))
            yield _rows(("bucket", "block", "kind", "payload"), [0], [block], [1], [blob])
        order = order[own]
        bounds = np.searchsorted(_string_range(name[order], ranges), np.arange(lowest, highest + 1))
        for b, a, z in zip(range(lowest, highest), bounds[:-1], bounds[1:]):
            x = order[a:z]
            if len(x):
                blob = pack(pa.record_batch([pa.array(name[x].view(np.int64)), pa.array(more[x]), pa.array(sid[x]),
                                             pa.array(first[x])], ["name", "more", "id", "start"]))
                yield _rows(("bucket", "block", "kind", "payload"), [buckets + b], [block], [0], [blob])


def _settle_strings(bucket, held):
    """Which strings of hot anchors start in a smaller document."""
    parts = [unpack(p) for _, p in held]
    name, more, ids, start = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("name", "more", "id", "start"))
    order = np.lexsort((ids, more, name))
    new = np.append(True, (name[order][1:] != name[order][:-1]) | (more[order][1:] != more[order][:-1]))
    gone = np.empty(len(name), bool)
    gone[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    at = 0
    for (block, _), p in zip(held, parts):
        some = start[at:at + p.num_rows][gone[at:at + p.num_rows]]
        at += p.num_rows
        if len(some):
            blob = pack(pa.record_batch([pa.array(some), pa.array(np.ones(len(some), np.int64))], ["start", "mask"]))
            yield _rows(("block", "kind", "part", "payload"), [block], [0], [bucket], [blob])


# ------------------------------------------- the transform and its intervals

def suffix_order(text: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Suffixes by their first 64 symbols; ``room`` is the distance to the
    end of a suffix's own string (symbols beyond don't count)."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8))).astype(_U)
    key = np.zeros(n, _U)
    for k in range(8):
        key = (key << _U(8)) | np.where(room > k, padded[k:k + n], _U(0))
    h = 8
    while True:
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order][1:] != key[order][:-1])
        if h >= 64 or h >= int(room.max(initial=0)):
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        rank += 1
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(room > h)
        after[inside] = rank[inside + h]
        key = rank.astype(_U) * _U(n + 2) + after.astype(_U)
        h *= 2


def equal_strings(text: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each row): rows of one class start with the
    same ``length`` symbols, where that many lie in their string.

    Breadth-first: the queue holds intervals of rows that start with a common
    string of l symbols.  Each is extended by every symbol that precedes its
    rows; the row after an extended interval differs after l symbols.  If that
    was not known yet, the extended interval joins the queue of round l + 1."""
    n = len(text)
    order = suffix_order(text, room)
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    before = np.full(n, -1, np.int64)           # row of the suffix one symbol longer, within its string
    inner = np.flatnonzero(order > 0)
    inner = inner[room[order[inner] - 1] > 1]
    before[inner] = row[order[inner] - 1]
    lead = text[order]
    known = np.zeros(n + 1, bool)               # is the common prefix of rows i-1 and i shorter than the round?
    known[0] = known[n] = True
    # round 0: the intervals of single symbols
    edge = np.flatnonzero(np.append(True, lead[1:] != lead[:-1]))
    low, high = edge, np.append(edge[1:], n)    # high is one past the last row
    known[high] = True
    owner = np.full(n, -1, np.int64)
    for _ in range(1, length):
        size = high - low
        rows = ragged_index(low, size)
        to = before[rows]
        some = np.flatnonzero(to >= 0)
        if not len(some):
            break
        owner[to[some]] = np.repeat(np.arange(len(low)), size)[some]
        at = np.sort(to[some])
        new = np.append(True, (owner[at][1:] != owner[at][:-1]) | (lead[at][1:] != lead[at][:-1]) | (at[1:] != at[:-1] + 1))
        first = np.flatnonzero(new)
        low, high = at[first], at[np.append(first[1:], len(at)) - 1] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
        if not len(low):
            break
    return order, np.cumsum(known[:n]) - 1


def _settle(batches, buckets: int):
    """Which strings of each asked context start in a smaller document."""
    def work(bucket, held):
        if bucket >= buckets:
            yield from _settle_strings(bucket, held)
            return
        parts = [unpack(p) for _, p in held]
        sizes = [p.num_rows for p in parts]
        h, name, ids, start = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("h", "name", "id", "start"))
        contexts = pa.concat_arrays([p.column("context") for p in parts])
        # equal contexts once, with their smallest document
        order = np.lexsort((ids, name, h))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (name[order][1:] != name[order][:-1]))
        kind = np.empty(len(h), np.int64)
        kind[order] = np.cumsum(new) - 1
        pick = order[new]
        raw, off = flat_strings(contexts.take(pa.array(pick)))
        length, least = np.diff(off), ids[pick]
        # the contexts of anchors with one context only are equal or nothing; the others form the text
        alone = np.append(True, h[pick][1:] != h[pick][:-1])
        alone &= np.append(h[pick][1:] != h[pick][:-1], True)
        windows = length - MIN_LENGTH + 1
        base = np.cumsum(windows) - windows
        best = np.repeat(least, windows)
        mixed = np.flatnonzero(~alone)
        # anchors are independent: bounded runs of them form one text each
        for a, b in _anchor_runs(h[pick][mixed], length[mixed]):
            some = mixed[a:b]
            text = raw[ragged_index(off[some], length[some])]
            which = np.repeat(np.arange(len(some)), length[some])
            place = np.arange(len(text)) - np.repeat(np.cumsum(length[some]) - length[some], length[some])
            room = length[some][which] - place
            rows, group = equal_strings(text, room, MIN_LENGTH)
            full = room[rows] >= MIN_LENGTH
            rows, group = rows[full], group[full]
            low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group, least[some][which[rows]])
            best[base[some][which[rows]] + place[rows]] = low[group]
        at = 0
        for (block, _), size in zip(held, sizes):
            k, mine = kind[at:at + size], ids[at:at + size]
            spots = ragged_index(base[k], windows[k])
            hit = (best[spots] < np.repeat(mine, windows[k])).astype(np.int64)
            bit = np.arange(len(spots)) - np.repeat(np.cumsum(windows[k]) - windows[k], windows[k])
            mask = np.add.reduceat(hit << bit, np.cumsum(windows[k]) - windows[k])
            some = np.flatnonzero(mask)
            if len(some):
                blob = pack(pa.record_batch([pa.array(start[at:at + size][some]), pa.array(mask[some])], ["start", "mask"]))
                yield _rows(("block", "kind", "part", "payload"), [block], [0], [bucket], [blob])
            at += size

    def asked():
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            settled = batch.filter(pa.array(kind == 1))
            if settled.num_rows:
                yield "settled", settled
            yield "asked", batch.filter(pa.array(kind == 0))

    done = []

    def only():
        for what, batch in asked():
            if what == "settled":
                done.append(batch)
            else:
                yield batch
    for out in _by_bucket(only(), work):
        yield from _passed(done)
        yield out
    yield from _passed(done)


def _passed(done):
    while done:
        b = done.pop()
        part = pa.array(np.full(b.num_rows, -1), pa.int32())
        yield pa.record_batch([b.column("block"), pa.array(np.zeros(b.num_rows), pa.int32()), part, b.column("payload")],
                              ["block", "kind", "part", "payload"])


def _anchor_runs(h: np.ndarray, length: np.ndarray, limit: int = _TEXT):
    """Runs of whole anchors whose contexts hold about ``limit`` bytes."""
    if not len(h):
        return
    ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    upto = np.cumsum(length)
    at = 0
    while at < len(h):
        base = upto[at - 1] if at else 0
        stop = ends[min(np.searchsorted(upto[ends - 1], base + limit, "right"), len(ends) - 1)]
        stop = max(int(stop), int(ends[np.searchsorted(ends, at, "right")]))
        yield at, stop
        at = stop


# ------------------------------------------------------------------ the cut

def _whole_characters(kept: pa.Array) -> pa.Array:
    """The bytes as text; a character that was cut in part is left out."""
    try:
        out = kept.cast(pa.string())
        out.validate(full=True)
        return out
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())


def _cut_texts(batches):
    for batch in _cut(batches):
        at = batch.schema.get_field_index("kept")
        yield batch.set_column(at, "kept", _whole_characters(batch.column("kept")))


def _without(parts, docs, raw, off, _) -> pa.RecordBatch:
    cover = np.zeros(len(raw) + 1, np.int32)
    for payloads in parts.values():
        for blob in payloads:
            p = unpack(blob)
            start, mask = p.column("start").to_numpy(), p.column("mask").to_numpy()
            one = mask == 1                     # single strings
            np.add.at(cover, start[one], 1)
            np.add.at(cover, start[one] + MIN_LENGTH, -1)
            start, mask = start[~one], mask[~one]
            bits = (mask[:, None] >> np.arange(_W)) & 1 == 1
            first = bits.copy()
            first[:, 1:] &= ~bits[:, :-1]
            last = bits.copy()
            last[:, :-1] &= ~bits[:, 1:]
            s, k = np.nonzero(first)
            np.add.at(cover, start[s] + k, 1)
            s, k = np.nonzero(last)
            np.add.at(cover, start[s] + k + MIN_LENGTH, -1)
    np.cumsum(cover, out=cover)
    gone = cover[:-1] > 0
    del cover
    filled = np.flatnonzero(np.diff(off) > 0)
    heads = off[filled]
    removed, spans = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1, np.int64)
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    begin[heads] = gone[heads]
    if len(heads):
        removed[filled] = np.add.reduceat(gone, heads, dtype=np.int64)
        spans[filled] = np.add.reduceat(begin, heads, dtype=np.int64)
    del begin
    ends = np.concatenate(([0], np.cumsum(np.diff(off) - removed))).astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(removed), [None, pa.py_buffer(ends.tobytes()),
                                                             pa.py_buffer(raw[~gone].tobytes())])
    return pa.record_batch([*(docs.column(c) for c in docs.schema.names if c not in ("sort_id", "text")),
                            pa.array(np.diff(off)), pa.array(removed), pa.array(spans), kept],
                           [*(c for c in docs.schema.names if c not in ("sort_id", "text")),
                            "n_bytes", "n_removed", "n_spans", "kept"])


def _cut(batches):
    for meeting in _meetings(batches):
        yield _without(*meeting)


def remove_repeats(docs: DataFrame, *carry: str, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, the ``carry`` columns, n_bytes, n_removed, n_spans, kept):
    ``kept`` are the remaining bytes, n_spans the maximal removed runs.
    ``as_text`` gives ``kept`` as a string, without characters cut in part;
    ``hot`` changes the way of an anchor's strings and never results."""
    width = shuffle_width(docs.sparkSession)
    small_batches(docs.sparkSession, 2000)
    buckets = 8 * width
    src = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text"),
                      F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("sort_id"))
    bare = src.select("text", "sort_id")

    def to_range(df):
        return df.repartition(width, "bucket").sortWithinPartitions("bucket", "block")

    def meet(answers, texts):
        return answers.unionByName(texts).repartition(width, "block").sortWithinPartitions("block", "kind", "part")
    flags = to_range(bare.mapInArrow(tidy(_ask(buckets)), _TO_RANGE)).mapInArrow(tidy(_shared(hot)), _TO_BLOCK)
    asked = meet(flags, bare.mapInArrow(tidy(_texts), _TO_BLOCK)).mapInArrow(tidy(_send_contexts(buckets)), _TO_RANGE)
    spans = to_range(asked).mapInArrow(tidy(lambda batches: _settle(batches, buckets)), _TO_BLOCK)
    kinds = dict(src.dtypes)
    out = ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)]
                    + ["n_bytes bigint", "n_removed bigint", "n_spans bigint", f"kept {'string' if as_text else 'binary'}"])
    return meet(spans, src.mapInArrow(tidy(_texts), _TO_BLOCK)).mapInArrow(tidy(_cut_texts if as_text else _cut), out)


def digests(docs: DataFrame) -> DataFrame:
    kept = remove_repeats(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
