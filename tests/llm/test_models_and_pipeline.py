"""Learned operators by held-out accuracy, and the pipeline."""
import numpy as np
import pytest
import public_tokenizers

from tierwatch.llm import langid, toxicity

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_grammar_labels_clauses():
    t = toxicity
    assert t.matches([t.OTHER, t.INSULT], [0, 2.0]) == [(0, 2.0)]
    assert t.matches([t.INSULT, t.OTHER, t.TARGET], [2.0, 0, 0]) == [(1, 2.0)]
    assert t.matches([t.NEGATOR, t.OTHER, t.INSULT], [0, 0, 2.0]) == [(2, 2.0)]
    assert t.matches([t.NEGATOR, *[t.OTHER] * 4, t.INSULT], [0] * 5 + [2.0]) == [(0, 2.0)]
    assert t.matches([t.REPORT, t.INSULT], [0, 2.0]) == [(3, 2.0)]
    assert t.matches([t.THREAT], [0]) == [] and t.matches([t.THREAT, t.TARGET], [0, 0]) == [(4, 1.0)]


def test_stems_back_off_to_shorter_ones():
    nodes = toxicity.learn_nodes([("luma", 20, 0), ("lum", 20, 40), ("lumax", 1, 0)], 30, 300)
    m = toxicity.Model(nodes, toxicity._FIXED_WEIGHTS)
    assert m.weight("lumaty") == nodes["luma"] > nodes["lum"]
    assert m.weight("other") == 0.0


def test_rare_insults_are_learned_beside_many_frequent_words(spark):
    import random
    import zlib
    rng = random.Random(3)
    words = " ".join({"".join(rng.choices("abcdefghijklmnop", k=10)) for _ in range(12_000)})     # over 60,000 stems
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 in (1, 2, 3)]
    toxic, clean = ids[:4], ids[4:10]
    rows = [(i, words + (" zorgwump" if i in toxic[:3] else "")) for i in toxic + clean]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in toxic + clean], "doc_id bigint, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), labels)
    assert model.weight("zorgwump") >= toxicity.FLOOR
    assert all(model.weight(w) < toxicity.FLOOR for w in words.split()[:50])


def test_deciding_nodes_class_words_as_all_nodes(spark):
    import random
    rng = random.Random(4)
    words = {"".join(rng.choices("abé", k=rng.randint(3, 12))) for _ in range(3000)} | {"idiot", "clown"}
    texts = [(rng.randint(0, 1), " ".join(rng.sample(sorted(words), 60)) + " clown") for _ in range(150)]
    counts = toxicity._stem_counts(spark.createDataFrame(texts, "y int, text string")).where("hits >= 3")
    fixed = {w + toxicity.END: 6.0 for w in toxicity.INSULTS}
    whole = {**fixed, **toxicity.learn_nodes([tuple(r) for r in counts.collect()], 20, 30)}
    few = {**fixed, **dict(toxicity.deciding_nodes(counts, 20, 30).collect())}
    assert len(few) < len(whole)
    a, b = toxicity.Model(whole, None), toxicity.Model(few, None)
    for w in words:
        x, y = a.weight(w), b.weight(w)
        assert x == y or max(x, y) < toxicity.FLOOR


def test_toxicity_without_labels_uses_fixed_values(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rude = spark.createDataFrame([(1, "You are an idiot, a worthless moron.\nstupid scum."), (2, "a quiet day"), (3, None)],
                                 "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.judge(rude, none).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].score == got[2].score
    assert toxicity.judge(empty, none).count() == 0
    assert toxicity.judge(docs, none).count() == docs.count()


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    got = toxicity.judge(docs, labels)
    assert got.count() == docs.count()
    y = got.join(labels, "doc_id").where("toxic is not null").select("held_out", "predicted", "toxic").collect()
    assert np.mean([r.predicted == r.toxic for r in y]) > 0.95
    assert np.mean([r.predicted == 0 for r in y if r.toxic == 0]) > 0.98


def test_forward_sums_all_segmentations():
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(pieces.size), 2))
    words = ["▁der", "▁nation", "▁zß", "▁x"]
    _, _, table = langid._lattice(words, pieces)

    def every(start, end, row):
        if start == end:
            return 1.0
        total = 0.0
        for k in range(1, min(end - start, langid.MAX_PIECE) + 1):
            i = table[k - 1][start]
            total += (np.exp(logs[row, i]) if i >= 0 else np.exp(langid._FLOOR) if k == 1 else 0) * every(start + k, end, row)
        return total
    got, at = langid.forward(words, pieces, logs), 0
    for j, w in enumerate(words):
        for row in range(2):
            assert got[row, j] == pytest.approx(np.log(every(at, at + len(w), row)))
        at += len(w)


def test_language_held_out_and_undefined(spark, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "123 --- ###", None), (-3, "", "fr")], docs.schema)
    got = {r.doc_id: r for r in langid.identify(docs.union(odd), path).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k in truth if got[k].held_out]
    assert np.mean([got[k].lang_pred == truth[k] for k in held]) > 0.95
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (-1, -2, -3))
    assert langid.identify(empty, path).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp
    rude = "idiot moron. you worthless scum! stupid trash, pathetic loser. disgusting clown. " * 3
    body = " ".join(f"word{i}" for i in range(200))
    shared = " ".join(f"passage{i}" for i in range(60))
    rows = [(1, body, "en", "a", 1), (2, body + " end", "en", "a", 1), (3, rude, "en", "b", 1),
            (4, "Copyright line of everyone\n" + " ".join(f"alpha{i}" for i in range(80)) + " " + shared, None, None, None),
            (5, "copyright line of everyone\n" + shared + " " + " ".join(f"beta{i}" for i in range(90)), "fr", "a", 1),
            (6, None, "fr", "a", None), (7, "", "fr", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out, held = {}, docs
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, held, str(tmp_path)).columns == docs.columns
        path = f"{tmp_path}/{name}"
        stage(spark, held, str(tmp_path)).write.parquet(path)
        held = spark.read.parquet(path)
        out[name] = {r.doc_id: r for r in held.collect()}
    assert set(out["toxicity"]) == {1, 2, 4, 5, 6, 7}
    assert not out["line dedup"][5].text.startswith("copyright") and "Copyright" in out["line dedup"][4].text
    assert set(out["n-gram Jaccard join"]) == {1, 4, 5, 6, 7}
    assert "passage10" in out["suffix-array dedup"][4].text and "passage10" not in out["suffix-array dedup"][5].text
    assert "beta50" in out["suffix-array dedup"][5].text
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {1, 4, 5, 6, 7}
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    """Names that operators add or use themselves, beside one with a blank."""
    import corpus_pipeline as cp
    names = ["score", "kept", "sort_id", "n_bytes", "_name", "_rest", "n_lines", "root", "n", "bits", "_scored", "my own", "doc"]
    body = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text, *[f"{c}{i}" for c in names], 3) for i, text in enumerate([body, body + " end", "a short one", None, ""], 1)]
    ddl = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names) + ", n_chars int"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.createDataFrame(rows, ddl)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, held, str(tmp_path))
        assert out.schema.simpleString() == held.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        held = spark.read.parquet(f"{tmp_path}/{name}")
        for r in held.collect():
            assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names]
    assert {r.doc_id for r in held.collect()} == {1, 3, 4, 5}
    assert {p.doc_id for p in cp.STAGES[-1][1](spark, held, str(tmp_path)).collect()} == {1, 3, 4, 5}


def test_ngram_join_decides_each_text_of_an_id(spark):
    import corpus_pipeline as cp
    body, other, last = (" ".join(f"{w}{i}" for i in range(200)) for w in ("word", "other", "last"))
    rows = [(1, body), (5, body + " end"), (5, other), (5, other + " end"), (5, other), (7, last), (7, body),
            (8, "x"), (8, None), (8, ""), (None, "y")]
    got = cp.ngram_join(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    left = sorted((r.doc_id, r.text) for r in got if r.doc_id in (1, 7))
    assert left == [(1, body), (7, last)]
    five = [r.text for r in got if r.doc_id == 5]
    assert len(five) == 1 and five[0] in (other, other + " end")
    assert {r.text for r in got if r.doc_id == 8} == {"x", None, ""} and [r.text for r in got if r.doc_id is None] == ["y"]


def test_registered_queries_match_their_names():
    import __spark_entry__ as entry
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_pieces_are_found_by_hash_and_only_within_words():
    pieces = langid.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    others = pieces.hashes[:500] + np.uint64(1)
    h = np.concatenate((pieces.hashes[::7], others))
    want = [int(np.flatnonzero(pieces.hashes == x)[0]) if x in pieces.hashes else -1 for x in h[-700:]]
    assert pieces.find(h)[-700:].tolist() == want
    words = ["\u2581the", "\u2581a"]
    _, _, table = langid._lattice(words, pieces)
    assert all(t[-1] == -1 for t in table[1:]) and (langid.forward(words, pieces, np.zeros((2, pieces.size))).shape == (2, 2))
