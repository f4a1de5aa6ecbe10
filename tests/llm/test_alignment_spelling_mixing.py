"""Alignment, spelling variants and mixing against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from tierwatch.llm import alignment, mixing, spelling
from tierwatch.llm.mphash import PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- alignment

def test_perfect_hash_numbers_every_key_once():
    keys = np.unique(np.random.default_rng(3).integers(-2**62, 2**62, 5000))
    h = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(h.numbers(keys)) == list(range(len(keys))) and h.size == len(keys)
    assert len(PerfectHash.build(keys[:0]).numbers(keys)) == len(keys)
    assert (PerfectHash.build(keys[:0]).numbers(keys) == -1).all()


def _aligned(rows):
    """Tokens, groups and all overlapping pairs of whole texts, one by one."""
    import sentencepiece
    from tokenizers import Tokenizer
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    from tokenizers.decoders import ByteLevel
    entry = {i: t for t, i in ta.get_vocab().items()}
    code = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for i, b in enumerate([*shown, *[b for b in range(256) if b not in shown]]):
        code[chr(b) if i < len(shown) else chr(256 + i - len(shown))] = b
    assert ByteLevel().decode(["Ġa"]) == " a" and bytes(code[c] for c in "Ġa") == b" a"

    def piece(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()
    out = []
    for key, text in rows:
        want = (" " + (text or "")).encode()
        a = ta.encode(" " + (text or ""), add_special_tokens=False).ids
        b = tb.encode(text or "")
        xa, xb = [bytes(code[c] for c in entry[i]) for i in a], [piece(i) for i in b]
        if not text or b"".join(xa) != want or b"".join(xb) != want:
            out.append((key, None))
            continue
        ea, eb = np.cumsum([len(x) for x in xa]), np.cumsum([len(x) for x in xb])
        sa, sb = ea - [len(x) for x in xa], eb - [len(x) for x in xb]
        links = []
        for i in range(len(a)):
            j = int(np.searchsorted(eb, sa[i], "right"))
            while j < len(b) and sb[j] < ea[i]:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for e in sorted(set(ea.tolist()) & set(eb.tolist())):
            i2, j2 = int(np.searchsorted(ea, e)) + 1, int(np.searchsorted(eb, e)) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        out.append((key, (len(a), len(b), groups, links)))
    return out


def _alignment_rows(rows):
    done = _aligned(rows)
    held = Counter(p for _, d in done if d for p in set(d[3]))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return Counter((key, *((0, 0, 0, 0, 0, 0, "") if d is None else (
        d[0], d[1], len(d[2]), len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]), ";".join(d[2]))))
        for key, d in done)


AWKWARD = ["x▁y", "<s> </s> <|endoftext|>", " lead", "  a  b ", "\n\n x\t y ", "日本　語 x  y\n\n  z ", "a'll 's  's it's  b",
           "\u0000 a   b  “q” x", "  em  space", "a" * 700, " ", "   ", "\t", "tail  ", "x᠎ y"]


def test_alignment_equals_brute_force(spark, docs):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id here"), (1003, "  a  b ")],
                                  "doc_id bigint, text string")
    all_docs = docs.select("doc_id", "text").unionByName(extra)
    got = alignment.align(all_docs, A, B).collect()
    want = _alignment_rows([(r.doc_id, r.text) for r in all_docs.collect()])
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == want
    digest = alignment.align(docs, A, B, groups="sha256").where("doc_id = 3").first()
    groups = next(r.groups for r in alignment.align(docs, A, B).where("doc_id = 3").collect())
    assert digest.groups == hashlib.sha256(groups.encode()).hexdigest()


def test_alignment_counts_are_added_in_a_tree(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 500)             # many blocks, leaves and levels
    monkeypatch.setattr(alignment, "LEAF", 2)
    monkeypatch.setattr(alignment, "FAN", 2)
    asked = alignment.requests(docs, A, B)
    assert asked.agg(F.max("leaf")).first()[0] >= 8
    got = {(r.a_id, r.b_id): r.n_docs for r in alignment.pair_table(alignment.count_pairs(asked)).collect()}
    done = _aligned([(r.doc_id, r.text) for r in docs.collect()])
    assert got == Counter(p for _, d in done if d for p in set(d[3]))


def test_alignment_of_nothing(empty, spark):
    assert alignment.align(empty, A, B).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [tuple(r)[1:] for r in alignment.align(blank, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_units_join_to_the_text():
    import pyarrow as pa

    from tierwatch.llm.common import flat_strings
    rows = ["", *AWKWARD, "plain words  here"]
    units, upto = alignment.cut_units(*flat_strings(pa.array(rows)))
    parts = units.to_pylist()
    assert ["".join(parts[a:b]) for a, b in zip(upto[:-1], upto[1:])] == [" " + t if t else "" for t in rows]


# ----------------------------------------------------------------- spelling

def _variants(rows, every=31):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def apart(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and apart(w, x)] for w in n}
    best = {w: min(m, key=lambda x: (-n[x], x), default=None) for w, m in near.items()}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def _got_variants(docs, every=31):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, every).collect()}


def test_spelling_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    made = [(500 + i, w) for i, w in enumerate([
        "wonderful " * 300, "wonderfull " * 25, "wonderfulle " * 2, "wunderful " * 2, "onderful " * 3, "wonderfu " * 3,
        "aaaaaaa aaaaaaaa aaaaaaaaa " * 3, "aaaabaaa abaaaaaa " * 3, "ÀÉÎõü×÷ Àéîõü×÷ ÀÉÎõü×÷x " * 4, "listens silents tinsels " * 5,
        "q" * 300 + " " + "q" * 301 + " ", "q" * 300 + " " + "q" * 301, "WONDERFUL wonderFUL"])] + [(None, "wonderful nowhere nowhere")]
    docs2 = spark.createDataFrame(rows + made + made[:1], "doc_id bigint, text string")
    want = _variants(rows + made + made[:1])
    assert _got_variants(docs2) == want
    got = _got_variants(docs2, 10**9)                        # hardly a typing error: the chain as written
    assert got == _variants(rows + made + made[:1], 10**9)
    assert got["wonderfulle"][:2] == ("wonderfull", "wonderful")


def test_spelling_of_random_dense_words(spark):
    import random
    rng = random.Random(9)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(700)]
    rows = [(i, " ".join(words[i::20])) for i in range(20)] * 2
    assert _got_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), 3) == _variants(rows, 3)


def test_spelling_of_nothing(empty, spark):
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "12 34")], "doc_id bigint, text string")).collect() == []


# ------------------------------------------------------------------- mixing

def _targets(sizes):
    """Shares by turns of capping and resharing."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, budget = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = budget - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 2.0 * sizes[s] for s in over})


def _sizes(docs):
    out = []
    for r in docs.select("doc_id", "source", "text").collect():
        out.append((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    return out


def _check_mix(docs, near):
    sizes = _sizes(docs)
    total = Counter()
    for _, s, n in sizes:
        total[s] += n
    want = _targets({s: total[s] for s in {s for _, s, _ in sizes}})
    rows = mixing.mix_documents(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == total[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and abs(r.copies - r.rate) < 2
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= near(s, t), (s, taken[s], t)
    return rows


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = _check_mix(docs, lambda s, t: max(2, 0.002 * t))
    again = mixing.mix_documents(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_rates_solve_the_dual(spark):
    """Tilts against a bisection of the same equation in floating point."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_documents(docs).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for s, mine in by_source.items():
        size, target = np.array([r.size for r in mine], float), mine[0].target
        if target >= 2 * size.sum() * (1 - 1e-9):
            assert all(r.rate == 2 for r in mine if r.size)
            continue
        low, high = -50 / size.max() * 100, 50 / size.max() * 100
        for _ in range(200):
            mid = (low + high) / 2
            words = (np.minimum(2, np.exp(np.minimum(mid * size, 50))) * size).sum()
            low, high = (mid, high) if words < target else (low, mid)
        want = np.minimum(2, np.exp(mid * size))
        assert np.allclose([r.rate for r in mine if r.size], want[size > 0], rtol=1e-6)


def test_mix_of_awkward_rows(spark, docs):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "s"), (None, "x " * 50, None), (3, None, None), (4, "", "empty"),
            (5, " \n\t", "empty"), (6, "word " * 9000, "long"), (7, "one", "long"), (8, "é", ""), (9, "q r s t", "")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash"))
    _check_mix(made, lambda s, t: math.inf)
    assert mixing.mix_documents(docs.limit(0)).collect() == []
    _check_mix(docs, lambda s, t: 0.1 * t + 5)


def test_first_pass_aligns_without_group_texts():
    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    units = pa.array([" caf\u00e9", " \u4f60\u597d", " plain", " "])
    whole, links = aligner.align(units), aligner.align(units, spelled=False)
    assert links.text is None and links.links.tolist() == whole.links.tolist() and links.link_off.tolist() == whole.link_off.tolist()
