"""Exact Jaccard self-join of word shingle sets, as link components.

    sets      distinct w-word shingles of every text, as sorted 64-bit hashes,
              with a parity bitmap of them
    prefixes  two sets of similarity t share one of the first n - ceil(t n) + 1
              shingles of any common order; shingles frequent in a bounded
              sample come last in it (the order changes speed, never results)
    groups    sets that share a prefix shingle, sorted by size
              (groups of equal members, as a shared passage makes, count once)
    parents   each set first meets its nearest smaller and the smallest fitting
              member of its groups, which collapses families of near copies and
              settles groups of up to three
    tiles     what is still apart in a group is cut into size-banded tiles;
              only pairs of different components leave a tile pair: at first
              the nearest for each two components, then all that are left
    bitmaps   differing parity bits bound the symmetric difference from below,
              i.e. the overlap from above: pairs that can't link end here
    exact     the others are intersected as sorted arrays

No pair inside one component needs a second proof, so a family of m near
copies costs about m comparisons; no link between different components is
lost.  Equal sets are one node.  Bitmaps have a power-of-two width that grows
with the set and are folded to the narrower one of a pair.

Defined results: null or blank text has the empty set, links with nothing and
is its own component; fewer than w words give one shingle; repeated rows keep
their rows; a row without doc_id takes no part in links; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, cut, flat_strings, mix, pack, position_keys, shuffle_width, small_batches, texts, tidy, unpack
from .graph import stars

WORDS, PERCENT = 5, 80
SAMPLE_DOCS = 8000          # of which shingles in at least SAMPLE_HITS documents count as frequent
SAMPLE_HITS = 4
FREQUENT = 50_000
TILE = 512
WIDE = 4                    # bits a member of the second bitmaps
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SLICE = 4 << 20


# ---------------------------------------------------------------- the sets

def _word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words before each document."""
    text = np.empty(len(raw) + len(off) - 1, np.uint8)      # one blank after every document
    shift = np.arange(len(off) - 1)
    text[off[1:] + shift] = 32
    keep = np.ones(len(text), bool)
    keep[off[1:] + shift] = False
    text[keep] = _LOWER[raw]
    inside = ~_BLANK[text]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(off), np.int64)
    lengths = ends - starts
    letters = text[inside].astype(_U) + _U(1)
    first = np.cumsum(lengths) - lengths
    spot = np.arange(len(letters), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    letters *= position_keys(int(lengths.max()), 17)[spot]
    words = mix(np.add.reduceat(letters, first) + lengths.astype(_U))
    return words, np.searchsorted(starts, np.concatenate(([0], off[1:] + shift)))


def shingle_sets(raw: np.ndarray, off: np.ndarray, w: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words, upto = _word_hashes(raw, off)
    keys = position_keys(w, 29)
    total = np.zeros(max(len(words) - w + 1, 0), _U)
    for k in range(w):
        total += words[k:k + len(total)] * keys[k]
    total = mix(total)
    out = []
    for a, b in zip(upto[:-1], upto[1:]):
        if b - a >= w:
            out.append(np.unique(total[a:b - w + 1]))
        elif b > a:
            out.append(mix((words[a:b] * keys[:b - a]).sum(dtype=_U)[None] + _U(int(b - a))))
        else:
            out.append(np.zeros(0, _U))
    return out


def _each(batches, w):
    """(doc ids, sets) in bounded slices of whole documents."""
    for b in by_size(batches, "text", _SLICE):
        raw, off = flat_strings(b.column("text"))
        yield b.column("doc_id"), shingle_sets(raw, off, w)


def set_name(s: np.ndarray) -> int:
    """64-bit name of a set; the order-free sum of mixed members."""
    return int(mix(mix(s).sum(dtype=_U)[None] + _U(len(s)))[0].astype(np.int64))


def needed(n, percent: int):
    """Smallest overlap of a set of n with any set of similarity >= percent."""
    return -(-n * percent // 100)


def _u64(a) -> pa.Array:
    return pa.array(np.asarray(a, _U).view(np.int64))


def set_table(docs: DataFrame, w: int, percent: int, frequent: np.ndarray, *carry: str) -> DataFrame:
    """(doc_id, n, set_id, bits, prefix, the ``carry`` strings): prefix holds the hashes by which a
    set meets others, in an order that puts ``frequent`` ones last."""
    def prefix(s: np.ndarray) -> bytes:
        late = np.zeros(len(s), bool)
        if len(frequent):                                       # sorted: a binary search for each member
            late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        ordered = np.concatenate((s[~late], s[late])) if late.any() else s
        return ordered[:len(s) - needed(len(s), percent) + 1 if len(s) else 0].tobytes()

    def run(batches):
        for b in batches:
            at = 0
            for ids, sets in _each([b], w):
                yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()),
                                       pa.array([set_name(s) for s in sets], pa.int64()),
                                       pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                                       pa.array([prefix(s) for s in sets], pa.binary()),
                                       *(b.column(c).slice(at, len(ids)) for c in carry)],
                                      ["doc_id", "n", "set_id", "bits", "prefix", *carry])
                at += len(ids)
    return texts(docs, *carry).mapInArrow(tidy(run), ", ".join(["doc_id bigint, n bigint, set_id bigint, bits binary, prefix binary",
                                                          *(f"`{c}` string" for c in carry)]))


def frequent_shingles(docs: DataFrame, w: int = WORDS) -> np.ndarray:
    """Shingles met often in a bounded sample (only orders the prefixes)."""
    step = max(docs.count() // SAMPLE_DOCS, 1)

    def run(batches):
        for _, sets in _each(batches, w):
            yield pa.record_batch([_u64(np.concatenate(sets))], ["s"])
    sample = texts(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0))
    rows = (sample.mapInArrow(tidy(run), "s bigint").groupBy("s").count().where(F.col("count") >= SAMPLE_HITS)
            .orderBy(F.desc("count"), "s").limit(FREQUENT).select("s").collect())       # <= FREQUENT values
    return np.sort(np.array([r[0] for r in rows], np.int64).view(_U))


# --------------------------------------------------- prefix groups of sets

def _postings(buckets: int):
    def run(batches):
        for batch in batches:
            names, first = np.unique(batch.column("set_id").to_numpy(), return_index=True)
            prefixes = batch.column("prefix").take(pa.array(first))
            raw, off = flat_strings(prefixes)
            if not len(raw):
                continue
            key, each = raw.view(_U), np.diff(off) // 8
            name = np.repeat(names, each)
            size = np.repeat(batch.column("n").to_numpy()[first].astype(np.int32), each)
            bucket = (mix(key) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.unique(bucket):
                at = order[bounds[b]:bounds[b + 1]]
                blob = pack(pa.record_batch([_u64(key[at]), pa.array(name[at]), pa.array(size[at])], ["k", "s", "n"]))
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])
    return run


def _groups(batches):
    """Rows of the shingles that at least two different sets share."""
    def shared(blobs):
        parts = [unpack(x) for x in blobs]
        k, s, n = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("k", "s", "n"))
        order = np.lexsort((s, k))
        k, s, n = k[order], s[order], n[order]
        new = np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))
        k, s, n = k[new], s[new], n[new]
        same = k[1:] == k[:-1]
        keep = np.append(False, same) | np.append(same, False)
        return pa.record_batch([pa.array(k[keep]), pa.array(s[keep]), pa.array(n[keep].astype(np.int64))],
                               ["shingle", "set_id", "n"])
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if bucket != now and held:
                yield shared(held)
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield shared(held)


def prefix_groups(sets: DataFrame) -> DataFrame:
    """(shingle, set_id, n): sets that share a prefix shingle with another."""
    width = shuffle_width(sets.sparkSession)
    dealt = sets.select("set_id", "n", "prefix").mapInArrow(tidy(_postings(4 * width)), "bucket int, blob binary")
    return (dealt.repartition(width, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(tidy(_groups), "shingle bigint, set_id bigint, n bigint"))


def distinct_groups(groups: DataFrame) -> DataFrame:
    """One group of each member list, with its number of ``members`` and of
    the shingles that had it (``times``); lists are told apart by 128 bits."""
    name = groups.groupBy("shingle").agg(
        F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"),
        F.count("*").alias("members"))
    once = name.groupBy("x", "y", "members").agg(F.min("shingle").alias("shingle"), F.count("*").alias("times"))
    return groups.join(once.select("shingle", "members", "times"), "shingle")


# ------------------------------------------------------- exact comparison

def _linked(percent: int, carry: tuple = ()):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([*(batch.column(c) for c in ("a", "b", *carry)), pa.array(keep, pa.bool_())],
                                  ["a", "b", *carry, "linked"])
    return run


def exact(pairs: DataFrame, arrays: DataFrame, percent: int, *carry: str) -> DataFrame:
    """(a, b, the bigint columns ``carry``, linked) of set pairs, by sorted-array intersection."""
    x = arrays.select(F.col("set_id").alias("a"), F.col("members").alias("x"))
    y = arrays.select(F.col("set_id").alias("b"), F.col("members").alias("y"))
    return (pairs.select("a", "b", *carry).join(x, "a").join(y, "b").select("a", "b", *carry, "x", "y")
            .mapInArrow(tidy(_linked(percent, carry)), "a bigint, b bigint, " + "".join(f"{c} bigint, " for c in carry) + "linked boolean"))


# ------------------------------------------------------ tiles with bitmaps

def bitmap(members: np.ndarray, each: int = 1) -> np.ndarray:
    """Parity bits of hashed members; ``each`` to twice as many bits a member,
    at least 64.  With one, sets of a similarity of 0.6 already differ in more
    bits than a link allows; with four, those of 0.78 do."""
    bits = 64
    while bits < each * len(members):
        bits *= 2
    flags = np.bincount((mix(members) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").view(_U)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    while b.shape[-1] > words:
        b = b[..., :b.shape[-1] // 2] ^ b[..., b.shape[-1] // 2:]
    return b


def may_link(n: np.ndarray, m: int, apart: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of sizes n and m, ``apart`` or more members different, link?
    overlap <= (n + m - apart) / 2, union = n + m - overlap."""
    total = n + m
    return (100 * (total - apart) >= percent * (total + apart)) & (
        100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _open_pairs(percent: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y, n, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")))):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                width = min(len(x), len(y))
                apart = int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum())
                keep[i] = may_link(np.int64(n), m, np.int64(apart), percent)
            some = batch.filter(pa.array(keep))
            yield pa.record_batch([some.column("a"), some.column("b")], ["a", "b"])
    return run


def open_pairs(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps (set_id, n, bits) can't rule out."""
    x = bitmaps.select(F.col("set_id").alias("a"), "n", F.col("bits").alias("x"))
    y = bitmaps.select(F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(tidy(_open_pairs(percent)), "a bigint, b bigint")


def _tile_pairs(percent: int, nearest: bool):
    """Pairs of a tile pair that may link and are not in one component, with
    their components; of each pair of components only the ``nearest``, or all."""
    def pairs(rows):
        left = [r for r in rows if r[3] == 0]
        right = [r for r in rows if r[3] == 1] or left
        by_width: dict[int, list] = {}
        for r in right:
            by_width.setdefault(len(r[6]) // 8, []).append(r)
        out = {}
        for words, many in by_width.items():
            maps = np.frombuffer(b"".join(r[6] for r in many), _U).reshape(len(many), words)
            size, root, name = (np.array([r[i] for r in many], np.int64) for i in (4, 5, 7))
            folded = {words: maps}
            for r in left:
                own = np.frombuffer(r[6], _U)
                width = min(words, len(own))
                if width not in folded:
                    folded[width] = fold(maps, width)
                apart = np.bitwise_count(folded[width] ^ fold(own, width)).sum(axis=1, dtype=np.int64)
                may = np.flatnonzero(may_link(size, r[4], apart, percent) & (root != r[5]))
                if nearest and len(may):                      # of each other component the nearest set
                    may = may[np.lexsort((name[may], apart[may], root[may]))]
                    may = may[np.append(True, root[may][1:] != root[may][:-1])]
                for n, other, d in zip(name[may].tolist(), root[may].tolist(), apart[may].tolist()):
                    a, b = ((r[7], r[5]), (n, other)) if r[7] < n else ((n, other), (r[7], r[5]))
                    key = (min(r[5], other), max(r[5], other)) if nearest else (a[0], b[0])
                    out[key] = min(out.get(key, (d, *a, *b)), (d, *a, *b))
        return list(out.values())

    def run(batches):
        now, rows = None, []

        def emit():
            got = pairs(rows)
            if got:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*got)], ["apart", "a", "ra", "b", "rb"])
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shingle", "i", "j", "side", "n", "root", "bits", "set_id"))):
                if r[:3] != now:
                    if rows:
                        yield from emit()
                    now, rows = r[:3], []
                rows.append(r)
        if rows:
            yield from emit()
    return run


def _in_band(groups: DataFrame, percent: int) -> DataFrame:
    """The rows that may have a partner: a set of another component, near
    enough in size to link, is in their group.

    Sizes fall into classes so wide that sets that link are in the same or in
    neighbouring ones; classes are taken in pairs, once from the even and once
    from the odd ones on, so that any two neighbours are a pair."""
    width = max(float(np.log(100 / percent)), 1e-6) * (1 + 1e-9)      # rounding never parts two neighbours
    size = F.floor(F.log("n") / width)
    apart = F.lit(False)
    groups = groups.repartition("shingle")       # both windows are served by one shuffle
    for k in (0, 1):
        band = Window.partitionBy("shingle", F.floor((size + k) / 2))
        apart = apart | (F.min("root").over(band) != F.max("root").over(band))
    return groups.withColumn("_apart", apart).where("_apart").drop("_apart")


def tile_candidates(groups: DataFrame, bitmaps: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Distinct pairs (a, b), with their components (ra, rb), of ``groups``
    (shingle, set_id, n, root) that the bitmaps can't rule out; ``nearest``
    gives one for each pair of components, the likeliest.  A group is cut into
    tiles of TILE sets by size; a tile meets the tiles whose sizes may match."""
    place = Window.partitionBy("shingle").orderBy("n", "set_id")
    g = groups.repartition("shingle").withColumn(      # numbers, spans and their join follow from one shuffle
        "tile", F.floor((F.row_number().over(place) - 1) / TILE).cast("int"))
    span = g.groupBy("shingle", "tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = span.select("shingle", F.col("tile").alias("i"), F.col("high").alias("top"))
    right = span.select("shingle", F.col("tile").alias("j"), F.col("low").alias("bottom"))
    met = left.join(right, "shingle").where((F.col("i") <= F.col("j"))
                                            & (100 * F.col("top") >= percent * F.col("bottom"))).select("shingle", "i", "j")
    first, second = F.struct(F.col("i").alias("tile"), F.lit(0).alias("side")), F.struct(F.col("j").alias("tile"), F.lit(1).alias("side"))
    sides = met.select("shingle", "i", "j", F.inline(F.when(F.col("i") < F.col("j"), F.array(first, second)).otherwise(F.array(first))))
    dealt = g.join(sides, ["shingle", "tile"]).join(bitmaps.select("set_id", "bits"), "set_id")      # bitmaps move last, and once
    width = shuffle_width(groups.sparkSession)
    met = (dealt.select("shingle", "i", "j", "side", "n", "root", "bits", "set_id")
           .repartition(width, "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "side")
           .mapInArrow(tidy(_tile_pairs(percent, nearest)), "apart bigint, a bigint, ra bigint, b bigint, rb bigint"))
    if not nearest:
        return met.select("a", "b", "ra", "rb").distinct()
    best = met.groupBy(F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high")).agg(
        F.min(F.struct("apart", "a", "b", "ra", "rb")).alias("m"))
    return best.select("m.a", "m.b", "m.ra", "m.rb")


# ---------------------------------------------------------------- the join

def _rooted(groups: DataFrame, roots: DataFrame) -> DataFrame:
    columns = [c for c in groups.columns if c != "root"]
    return (groups.select(*columns).join(roots, F.col("set_id") == F.col("node"), "left")
            .select(*columns, F.coalesce("root", "set_id").alias("root")))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root; a node without a row is its own root) after links (a, b) between components."""
    links = cut(links, "links")
    if links.isEmpty():
        return roots
    joined = stars(links).select(F.col("node").alias("was"), F.col("root").alias("now"))
    moved = roots.join(joined, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    alone = joined.join(roots, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("root"))
    return cut(moved.unionByName(alone), "roots")


def _rooted_pairs(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their present components ra and rb."""
    for end in "ab":
        now = roots.select(F.col("node").alias(end), F.col("root").alias("now"))
        pairs = pairs.drop(f"r{end}").join(now, end, "left").withColumn(f"r{end}", F.coalesce("now", end)).drop("now")
    return pairs


def _parents(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the smallest set within the size band and with the
    next smaller one of its groups."""
    scale = 1_000_000
    g = groups.withColumn("size", (F.log("n") * scale).cast("bigint"))
    order = Window.partitionBy("shingle").orderBy("size")
    band = order.rangeBetween(int(np.log(percent / 100) * scale) - 2, 0)      # rounding never narrows it
    near = g.withColumn("mate", F.array(F.first("set_id").over(band), F.lag("set_id").over(order)))
    near = near.select("set_id", F.explode("mate").alias("mate")).where("mate is not null and mate <> set_id")
    return near.select(F.greatest("set_id", "mate").alias("a"), F.least("set_id", "mate").alias("b")).distinct()


FILTER_BITS = 1 << 23       # of the filter of documents whose arrays are wanted: 1 MB, whatever the corpus


def _chosen_arrays(docs: DataFrame, chosen: DataFrame, w: int, form=np.ndarray.tobytes) -> DataFrame:
    """(set_id, members) of the documents ``chosen`` (set_id, doc_id); ``form``
    makes the bytes of a set.  A bit per hashed id, of fixed size, skips most
    other documents before the join."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    at = chosen.select((spot + 1).alias("p"))       # positions count from 1
    parts = at.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()     # <= FILTER_BITS / 32768 rows
    flags = np.zeros(FILTER_BITS // 8, np.uint8)
    for b, m in parts:
        flags[(b - 1) * 4096:b * 4096] = np.frombuffer(m, np.uint8)

    def run(batches):
        def wanted():
            for b in batches:
                p = b.column("p").to_numpy()
                yield b.filter(pa.array((flags[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1))
        for ids, sets in _each(wanted(), w):
            yield pa.record_batch([ids, pa.array([set_name(s) for s in sets], pa.int64()),
                                   pa.array([form(s) for s in sets], pa.binary())], ["doc_id", "set_id", "members"])
    rows = texts(docs).withColumn("p", spot).mapInArrow(tidy(run), "doc_id bigint, set_id bigint, members binary")
    return rows.join(chosen, ["set_id", "doc_id"]).dropDuplicates(["set_id", "doc_id"]).select("set_id", "members")


def _ends(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """The distinct values of two columns, in one scan."""
    return pairs.select(F.explode(F.array(a, b)).alias(name)).distinct()


def _proved(pairs: DataFrame, docs: DataFrame, reps: DataFrame, w: int, percent: int, *carry: str) -> DataFrame:
    """``pairs`` compared exactly; arrays exist for their sets only."""
    ends = _ends(pairs, "a", "b", "set_id")
    chosen = cut(reps.join(ends, "set_id").select("set_id", "doc_id"), "chosen")
    return cut(exact(pairs, _chosen_arrays(docs, chosen, w), percent, *carry), "tested")


def _joined(pairs: DataFrame, tested: DataFrame, roots: DataFrame, docs: DataFrame, reps: DataFrame, w: int,
            percent: int) -> tuple[DataFrame, DataFrame]:
    """Components after the links among ``pairs`` (a, b, ra, rb), and all pairs tested."""
    fresh = cut(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
    proved = _proved(fresh, docs, reps, w, percent, "ra", "rb")
    links = proved.where("linked").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return _merged(roots, links), tested.select("a", "b").unionByName(proved.select("a", "b"))


def link_components(docs: DataFrame, w: int = WORDS, percent: int = PERCENT, *carry: str) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id
    reachable by links of at least ``percent`` % Jaccard similarity.  With
    ``carry`` (string columns), these and the component's own name, root."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    small_batches(docs.sparkSession)
    named = docs.where("doc_id is not null")
    sets = cut(set_table(docs, w, percent, frequent_shingles(named, w), *carry), "sets")
    linkable = sets.where("doc_id is not null")
    groups = cut(distinct_groups(cut(prefix_groups(linkable), "postings")), "groups")
    reps = cut(linkable.join(groups.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")), "reps")
    near = cut(open_pairs(_parents(groups, percent), reps, percent), "near")
    tested = _proved(near, named, reps, w, percent)
    roots = stars(tested.where("linked"))
    # one pair for each two components first, then whatever is left of those that were refuted
    open_groups = cut(_in_band(_rooted(groups.where("members > 3"), roots), percent), "open")
    first = cut(tile_candidates(open_groups, reps, percent, nearest=True), "nearest")
    roots, tested = _joined(first, tested, roots, named, reps, w, percent)
    apart = _ends(_rooted_pairs(first, roots).where("ra <> rb"), "ra", "rb", "root")      # refuted: still two components
    open_groups = cut(_in_band(_rooted(open_groups, roots).join(apart, "root", "left_semi"), percent), "open")
    members = cut(reps.join(open_groups.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "doc_id"), "wide")
    wide = _chosen_arrays(named, members, w, lambda s: bitmap(s, WIDE).tobytes()).withColumnRenamed("members", "bits")
    roots, _ = _joined(cut(tile_candidates(open_groups, wide, percent), "rest"), tested, roots, named, reps, w, percent)
    roots = roots.withColumnRenamed("root", "r")
    rooted = sets.join(roots, F.col("set_id") == F.col("node"), "left").select(
        "doc_id", "n", F.coalesce("r", "set_id").alias("root"), *carry)
    whole = F.col("doc_id").isNotNull() & (F.col("n") > 0)       # the others are alone: no hot key of theirs in the join
    least = rooted.where(whole).groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = rooted.where(whole).join(least, "root").select("doc_id", "n", "root", "least", *carry)
    alone = rooted.where(~whole).select("doc_id", "n", "root", F.col("doc_id").alias("least"), *carry)
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), *(("root", *carry) if carry else ()))
