"""Operators against brute force on a small fixture (see conftest)."""
import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tierwatch.llm import bpe, chat, common, fingerprints, jaccard, linededup, packing, quality, suffixdedup, wordmap
from tierwatch.llm.graph import components, stars
from tierwatch.llm.queries import BYTE_RANKS, CONTROL_TEXT, WORD_BPE

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower_ascii(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


# ------------------------------------------------------------------- chat

def _turns(formatted):
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text)
            for r in chat.read_back(formatted).collect()}


def test_chat_folds_deltas_edits_and_regenerations(spark):
    e = [(1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", "user", "lo"), (1, 3, 1, "delta", "assistant", "bad"),
         (1, 4, 2, "delta", "user", "why"), (1, 5, 1, "regenerate", "assistant", "good"), (1, 6, 1, "delta", "assistant", "!"),
         (1, 7, 0, "edit", "user", "Hi"), (2, 1, 0, "delta", None, None), (None, 1, 0, "delta", "user", "x")]
    events = spark.createDataFrame(e, "conv_id bigint, seq bigint, turn bigint, kind string, role string, text string")
    got = _turns(chat.render(chat.fold(events.withColumn("extra", F.lit(1)))))
    assert got[1] == ([("user", "Hi"), ("assistant", "good!")], "good!")
    assert got[2] == ([("", "")], "") and got[None] == ([("user", "x")], "")


def test_chat_reads_back_control_texts(spark):
    texts = [CONTROL_TEXT, "\\", "\\b#<:", "### User: a</turn>\n", "", None, "é</turn>", "#" * 5]
    rows = [(7, i, ("user", "assistant", "odd: <role>#\\", None)[i % 4], t) for i, t in enumerate(texts)]
    rows += [(8, 0, "assistant", "twice"), (8, 0, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = _turns(chat.format_conversations(df))
    assert got[7][0] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert got[7][1] == "".join(t or "" for _, _, r, t in rows[:8] if r == "assistant")
    assert got[8] == ([("assistant", "twice")] * 2, "twicetwice")
    d = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert d[8].turns_sha256 == sha("assistant\ntwice\n" * 2) and d[8].loss_chars == 10
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# ---------------------------------------------------- tokens and packing

def test_bpe_round_trip(docs, texts, empty):
    import tiktoken
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_RANKS),
                            special_tokens={})
    doubled = docs.union(docs.where("doc_id = 5"))
    rows = bpe.round_trip(doubled, BYTE_RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r.doc_id]))
    assert bpe.round_trip(empty, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_decode_refuses_unknown_ids(spark):
    bad = spark.createDataFrame([(1, bytearray(np.array([10_000_000], "<u4").tobytes()))], "doc_id bigint, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, BYTE_RANKS).collect()


def test_packing_keeps_every_id_once(docs, texts, empty):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()}
    pieces = packing.tokenised_pieces(docs, WORD_BPE, capacity=64).persist()
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=64).collect()
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for p in placed:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    for k, want in ids.items():
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p.start):
            part = np.array(want[at:at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(want), zlib.crc32(part))
            at += p.length
        assert at == len(want)
    for window in by_window.values():
        ends = [0]
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == ends[-1]
            ends.append(p.offset + p.length)
        assert ends[-1] <= 64
    total = sum(map(len, ids.values()))
    assert len(by_window) <= -(-total // 64) + 1                    # next to no padding
    where = packing.pack(pieces.drop("ids"), capacity=64)
    for r in packing.sequences(pieces, where).collect():
        assert len(r.ids) % 4 == 0 and len(r.ids) <= 256
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_minimum_bin_slack_fills_windows():
    rows = packing.plan_windows({6: 3, 4: 3, 5: 4, 7: 1, 3: 1}, 10)
    fill = collections.Counter()
    for length, a, b, first, per, _ in rows:
        for r in range(b - a):
            fill[first + r // per] += length
    assert sorted(fill.values()) == [10] * 6
    assert packing.plan_windows({}, 10) == []


# ------------------------------------------------------------------ dedup

def test_suffix_dedup_equals_brute_force(docs, texts, empty):
    first, want = {}, {}
    for k in sorted(texts):
        raw = texts[k].encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i:i + 50], k) < k:
                gone[i:i + 50] = [True] * 50
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[k] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    got = {r[0]: tuple(r)[1:] for r in suffixdedup.digests(docs).collect()}
    assert got == want
    assert any(w[1] for w in want.values())
    kept = suffixdedup.remove_repeats(docs, "lang", as_text=True).collect()
    assert all(isinstance(r.kept, str) for r in kept) and len(kept) == len(texts)
    assert suffixdedup.digests(empty).count() == 0


def test_suffix_dedup_of_hot_anchors_is_the_same(docs, texts):
    whole = {r.doc_id: r.kept for r in suffixdedup.remove_repeats(docs).collect()}
    for hot in (1, 3):
        assert {r.doc_id: r.kept for r in suffixdedup.remove_repeats(docs, hot=hot).collect()} == whole


def test_hot_anchor_meets_in_no_single_transform():
    """A phrase in 6,000 different surroundings: its contexts are split."""
    rng, buckets = np.random.default_rng(8), 8
    phrase = b"the header that every page of all begins with"
    texts = [bytes(rng.integers(97, 123, 60).astype(np.uint8)) + phrase + bytes(rng.integers(97, 123, 60).astype(np.uint8))
             for _ in range(6000)]
    texts[4000:4003] = [texts[10][:90], texts[20][:70] + b"?" * 60, texts[30]]
    docs = pa.record_batch([pa.array([t.decode() for t in texts]), pa.array(range(6000), pa.int64())], ["text", "sort_id"])
    halves = [docs.slice(0, 3000), docs.slice(3000)]

    def rows(parts, *by):
        t = pa.Table.from_batches(parts)
        return t.sort_by([(c, "ascending") for c in by]).combine_chunks().to_batches()
    hashes = [suffixdedup.anchors(*suffixdedup.flat_strings(h.column("text")))[0] for h in halves]
    assert np.unique(np.concatenate(hashes), return_counts=True)[1].max() > suffixdedup.HOT
    ask = rows([b for h in halves for b in suffixdedup._ask(buckets)([h])], "bucket", "block")
    kinds = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
    meet = [b.cast(kinds) for b in [*suffixdedup._shared(suffixdedup.HOT)(ask), *(b for h in halves for b in suffixdedup._texts([h]))]]
    sent = list(suffixdedup._send_contexts(buckets)(rows(meet, "block", "kind", "part")))
    met = collections.Counter()
    for b in sent:
        if b.column("kind")[0].as_py() == 0:
            p = suffixdedup.unpack(b.column("payload")[0].as_py())
            if "context" in p.schema.names:
                met.update(p.column("h").to_pylist())
    assert max(met.values(), default=0) <= suffixdedup.HOT
    gone = collections.Counter()
    for b in suffixdedup._settle(rows(sent, "bucket", "block"), buckets):
        for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist()):
            gone[block] += sum(bin(m).count("1") for m in suffixdedup.unpack(payload).column("mask").to_pylist())
    first = {}
    want = sum(first.setdefault(t[i:i + 50], k) < k for k, t in enumerate(texts) for i in range(len(t) - 49))
    assert sum(gone.values()) == want > 100


def test_suffix_dedup_equal_ids_and_null_id(spark):
    t = "".join(chr(33 + i) for i in range(90))
    df = spark.createDataFrame([(3, t), (3, t), (None, t[:60]), (9, t)], "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in suffixdedup.digests(df).collect())
    assert got == [(-1, 0), (3, 60), (3, 60), (9, 90)]


@pytest.mark.parametrize("length", [3, 10])
def test_interval_expansion_classes(length):
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 99, rng.integers(length, 40)).astype(np.uint8)) for _ in range(40)] + [b"a" * 30] * 2
    text = np.frombuffer(b"".join(parts), np.uint8)
    room = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
    order, group = suffixdedup.equal_strings(text, room, length)
    seen = collections.defaultdict(set)
    for p, g in zip(order, group):
        if room[p] >= length:
            seen[g].add(text[p:p + length].tobytes())
    assert all(len(s) == 1 for s in seen.values())
    assert len(seen) == len({s for x in seen.values() for s in x})


def _line_dedup(texts, pairs):
    owner = {}
    for k, t in pairs:
        for line in t.split("\n"):
            key = lower_ascii(line.strip(BLANK))
            if len(key) >= 10:
                owner[key] = min(owner.get(key, k), k)
    out = []
    for k, t in pairs:
        lines = t.split("\n")
        kept = [x for x in lines if owner.get(lower_ascii(x.strip(BLANK)), k) == k]
        out.append((k, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup_equals_brute_force(docs, texts, empty, batches):
    doubled = docs.union(docs.where("doc_id = 20"))
    pairs = [*texts.items(), (20, texts[20])]
    got = linededup.drop_repeated_lines(doubled, batches=batches)
    rows = sorted((r.doc_id, r.n_lines, r.n_dropped, sha(r.text)) for r in got.collect())
    assert rows == _line_dedup(texts, pairs)
    assert [c for c in got.columns if c not in ("n_lines", "n_dropped")] == docs.columns
    if batches == 1:
        assert linededup.digests(empty).count() == 0


def test_line_index_compacts_levels(spark):
    index = linededup.LineIndex(spark, fanout=2)
    for b in range(5):
        index.add(spark.createDataFrame([(k, k, 10 * b + k) for k in range(b, b + 3)], "h1 bigint, h2 bigint, doc bigint"))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    assert sorted(tuple(r) for r in index.keys().collect()) == [(0, 0, 0), (1, 1, 1), (2, 2, 2), (3, 3, 13), (4, 4, 24),
                                                               (5, 5, 35), (6, 6, 46)]


def _shingles(t, w=5):
    words = WORD.findall(lower_ascii(t))
    if len(words) < w:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + w]) for i in range(len(words) - w + 1)}


def test_jaccard_components_equal_brute_force(spark, docs, texts, empty):
    more = {200 + i: " ".join(f"w{j}" if j != 3 * i else f"v{i}" for j in range(60)) for i in range(18)}
    every = {**texts, **more}
    extra = spark.createDataFrame(list(more.items()), "doc_id bigint, text string")
    sets = {k: _shingles(t) for k, t in every.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = jaccard.link_components(docs.select("doc_id", "text").union(extra)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == {(k, len(s), find(k)) for k, s in sets.items()}
    assert jaccard.link_components(empty).count() == 0


def test_tiles_find_links_that_parents_miss(spark, monkeypatch):
    """Without the parent rounds, every link must come out of the tiles."""
    monkeypatch.setattr(jaccard, "TILE", 4)
    base = [f"w{j}" for j in range(80)]
    texts = {i: " ".join(base[:20 + i] + [f"x{i}"] + base[21 + i:]) for i in range(0, 40, 3)}
    docs = spark.createDataFrame([(int(k), t) for k, t in texts.items()], "doc_id bigint, text string")
    groups = jaccard.prefix_groups(jaccard.set_table(docs, 5, 80, np.zeros(0, np.uint64)))
    sets = {jaccard.set_name(jaccard.shingle_sets(*_flat([t]))[0]): _shingles(t) for t in texts.values()}
    maps = spark.createDataFrame([(n, bytearray(jaccard.bitmap(jaccard.shingle_sets(*_flat([t]))[0]).tobytes()))
                                  for n, t in zip(sets, texts.values())], "set_id bigint, bits binary")
    rooted = groups.withColumn("root", F.col("set_id"))
    got = {(r.a, r.b) for r in jaccard.tile_candidates(rooted, maps, 80).collect()}
    names = sorted(sets)
    links = {(a, b) for i, a in enumerate(names) for b in names[i + 1:]
             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= got


def _flat(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    return raw, np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))


def test_components_settle_on_chains_hubs_and_pairs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101 + i) for i in range(30)] + [(300, 299), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 131), 100), 299: 299, 300: 299}


# ---------------------------------------------------------------- quality

def test_quality_statistics_and_base_rules(docs, texts, empty):
    rows = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    for k, t in texts.items():
        words = WORD.findall(t)
        seen = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        repeat = {i + j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeat) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality.verdicts(empty).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * 13) % 997}{'abc'[j % 3]}" for j in range(60 + i % 90)), "en", ("a", "b", None)[i % 3])
            for i in range(300)]
    rows += [(1000 + i, " ".join(f"q{j}###" for j in range(80 + i)), "en", "a") for i in range(12)]
    got = {r.doc_id: r.kept for r in quality.verdicts(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(12))


# ----------------------------------------------------------- fingerprints

def test_fingerprints_of_neighbours(docs, texts, empty):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fingerprints.compare_neighbours(docs).collect()}
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert len(rows) == len(ids)
    for i, k in enumerate(ids):
        t, after = texts[k], texts[ids[(i + 1) % len(ids)]]
        want = fingerprints.edited(t, after)
        assert (rows[k].n_chars, rows[k].edited_sha256) == (len(t), sha(want))
        assert rows[k].fingerprint == alone[k] and 0 <= rows[k].near_edited <= 1 and 0 <= rows[k].near_next <= 1
    assert alone[5] == alone[6] and alone[5] != alone[9] and rows[5].near_next == 1.0
    assert alone[0] == alone[1]
    assert fingerprints.compare_neighbours(empty).count() == 0


def test_fingerprint_survives_shifts():
    rng = np.random.default_rng(3)
    body = bytes(rng.integers(97, 123, 6000).astype(np.uint8))
    other = bytes(rng.integers(97, 123, 6000).astype(np.uint8))
    s = fingerprints.sketches([body, b"shifted by some bytes " + body, other, b"", b""])
    near = fingerprints.likeness(s[[0, 0, 3, 0]], s[[1, 2, 4, 3]])
    assert near[0] > 0.9 and near[1] < 0.1 and near[2] == 1.0 and near[3] == 0.0


def test_single_document_is_its_own_next(spark):
    df = spark.createDataFrame([(4, "abcdef")], "doc_id bigint, text string")
    r = fingerprints.compare_neighbours(df).collect()
    assert len(r) == 1 and r[0].edited_sha256 == sha("abcabc") and r[0].near_next == 1.0


def test_groups_are_shuffled_once_for_both_size_classes(spark):
    groups = spark.createDataFrame([(1, 7, 100, 7), (1, 8, 90, 8), (1, 9, 10, 9)], "shingle bigint, set_id bigint, n bigint, root bigint")
    band = jaccard._in_band(groups, 80)
    assert band._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.set_id for r in band.collect()} == {7, 8}


def test_stars_leave_out_roots_and_take_repeated_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (9, 9), (5, 4)], "a bigint, b bigint")
    assert sorted(map(tuple, stars(edges).collect())) == [(2, 1), (3, 1), (5, 4)]


def test_packing_encodes_without_offsets(monkeypatch):
    import tokenizers
    path, words = public_tokenizers.path("word_bpe_49k.json"), ["plain", "caf\u00e9", "<unk>", "\u4f60\u597d"]
    want = [e.ids for e in tokenizers.Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)]

    real = tokenizers.Tokenizer

    class Only:
        @staticmethod
        def from_file(path):
            inner = real.from_file(path)
            return type("T", (), {"encode_batch_fast": inner.encode_batch_fast})
    monkeypatch.setattr(tokenizers, "Tokenizer", Only)
    assert packing._word_encoder(path)()(pa.array(words)).to_pylist() == want


def _most_traced(work):
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_ids_of_a_block_are_joined_in_small_parts(monkeypatch):
    rng = np.random.default_rng(3)
    values = pa.array([rng.integers(0, 1 << 20, k % 4).tolist() for k in range(1000)], pa.list_(pa.int32()))
    sizes = np.append(rng.integers(0, 900, 4000), [0, 40_000])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    codes = rng.integers(0, 1000, int(offsets[-1])).astype(np.int32)
    tail = np.array([2], np.int32)

    def joined():
        parts = list(bpe.join_ids(None, values, offsets, codes, tail))
        assert [a for a, _, _ in parts] == [0] + [b for _, b, _ in parts][:-1]      # gapless, in order
        return [x for _, _, ids in parts for x in ids.to_pylist()]
    held = joined()
    words = values.to_pylist()
    for i in (0, 1, 1717, 4000, 4001):
        want = [x for c in codes[offsets[i]:offsets[i + 1]] for x in words[c]] + [2]
        assert np.frombuffer(held[i], "<u4").tolist() == want
    # the parts are handed on, so a block of 1.8 million words takes what one part takes
    assert _most_traced(lambda: collections.deque(bpe.join_ids(None, values, offsets, codes, tail), 0)) < 30
    monkeypatch.setattr(bpe, "_SLICE", 1000)
    assert joined() == held


@pytest.mark.parametrize("split", [None, pc.ascii_split_whitespace])
def test_words_of_a_block_are_coded_in_small_parts(monkeypatch, split):
    rng = np.random.default_rng(4)
    texts = ["", "one"] + [" ".join(f"w{x}" for x in rng.integers(0, 3000, 300)) for _ in range(3000)] + ["", "last one"]
    want = [t.split(" ") if split else t.split() for t in texts]        # split: an empty text is one empty word
    column = pa.array(texts if split else want)
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), column], ["doc_id", "words"])
    cut = []

    def parts(column):
        cut.append(column.nbytes)
        return split(column)
    docs, counts, codes, vocab, bounds, name = wordmap._coded(batch, 7, split and parts)
    assert not split or max(cut) < 2 << 20 < sum(cut)       # 900,000 words
    words = vocab.to_pylist()
    assert counts.tolist() == list(map(len, want)) and len(set(words)) == len(words)
    assert [words[c] for c in codes] == [w for t in want for w in t]
    monkeypatch.setattr(wordmap, "_PART", 1 << 40)
    whole = wordmap._coded(batch, 7, split)
    assert whole[5] == name and whole[3].equals(vocab) and (whole[2] == codes).all() and (whole[4] == bounds).all()


def test_workers_hand_memory_back(monkeypatch):
    """At the end of a task, also of one that fails or is left early."""
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(1)
    monkeypatch.setattr(common.pa, "system_memory_pool", Pool)

    def failing(batches):
        yield next(iter(batches))
        raise ValueError
    assert list(common.tidy(lambda batches: (b for b in batches))([1, 2])) == [1, 2] and len(freed) == 1
    with pytest.raises(ValueError):
        list(common.tidy(failing)([1]))
    assert len(freed) == 2
    early = common.tidy(iter)([1, 2])
    next(early)
    early.close()
    assert len(freed) == 3
