import datetime as dt
import random
import unicodedata

import pytest

from pyspark.sql import functions as F

from tierwatch import constants as C
from tierwatch.functions.text import fold_text
from tierwatch.operators import chunking, narrative, quality, report, scoring
from tierwatch.scenario import Scenario
from tierwatch.streaming import incremental, streams

NARR_DDL = ("supplier_id string, supplier_name string, overall_risk string, key_risks array<string>, "
            "recommendation string, confidence double, ordinal int")


def _greedy(tokens, budget):
    out, chunk, cur, nonempty = [], 0, 0, False
    for t in tokens:
        if nonempty and cur + t > budget:
            chunk += 1
            cur = 0
        cur += t
        nonempty = True
        out.append(chunk)
    return out


def _random_pieces(rng):
    """(budget, rows of several keys in order, the rows cut into pieces)"""
    budget = rng.choice([1, 5, 10, 50])
    rows = [(k, rng.choice([0, 0, 1, 2, 3, 7, 12, 60])) for k in "abc"[:rng.randint(1, 3)] for _ in range(rng.randint(1, 40))]
    cuts = sorted(rng.sample(range(1, len(rows)), k=min(len(rows) - 1, rng.randint(0, 6)))) if len(rows) > 1 else []
    return budget, rows, [rows[a:b] for a, b in zip([0] + cuts, cuts + [len(rows)])]


def test_transfer_functions_compose_like_the_serial_scan():
    rng = random.Random(7)
    for _ in range(500):
        budget, rows, pieces = _random_pieces(rng)
        expect = [c for k in "abc" for c in _greedy([t for kk, t in rows if kk == k], budget)]
        parts = [chunking.summarize([tuple(map(list, zip(*p[i:i + 3]))) for i in range(0, len(p), 3)], budget) for p in pieces]
        carry, got = None, []
        for piece, part in zip(pieces, parts):
            keys, tokens = map(list, zip(*piece))
            ids, end = chunking.label(keys, tokens, carry, budget)
            carry = chunking.apply(part, carry, budget)
            assert carry == end, (rows, budget)
            got += ids
        assert got == expect, (rows, budget)
        while len(parts) > 1:                                   # any order of composing gives the same function
            i = rng.randrange(len(parts) - 1)
            parts[i:i + 2] = [chunking.compose(parts[i], parts[i + 1], budget)]
        for state in range(budget + 2):
            into = chunking.Carry(rows[0][0], state, 5)
            assert chunking.apply(parts[0], into, budget) == chunking.label(*map(list, zip(*rows)), into, budget)[1]
        assert len(parts[0].reach) <= budget + 2


def test_one_key_over_a_tree_of_partitions(spark):
    rng = random.Random(11)
    rows = [(None if i % 997 == 0 else "x" * (i % 5), i, rng.choice([0, 1, 4, 9, 30]), "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "text string, o int, t long, k string")
    out = chunking.chunk(df, "k", "o", "t", budget=20, num_partitions=23, fan=3)
    got = sorted((r["o"], r["chunk_id"], r["text"]) for r in out.collect())
    assert [g[1] for g in got] == _greedy([r[2] for r in rows], 20) and [g[2] for g in got] == [r[0] for r in rows]
    assert chunking.chunk(df.limit(0), "k", "o", "t", 20).collect() == []


def test_chunk_on_spark_matches_serial(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([0, 1, 4, 9, 30])) for k in range(5) for i in range(rng.randint(1, 200))]
    df = spark.createDataFrame(rows, "k int, o int, t long")
    out = chunking.chunk(df, "k", "o", "t", budget=20, num_partitions=7).collect()
    got = {}
    for r in out:
        got[(r["k"], r["o"])] = r["chunk_id"]
    for k in range(5):
        seq = [(o, t) for kk, o, t in rows if kk == k]
        expect = _greedy([t for _, t in seq], 20)
        assert [got[(k, o)] for o, _ in seq] == expect


def test_two_large_rows_make_two_chunks(spark):
    df = spark.createDataFrame([(1, 0, "x" * 45_000), (1, 1, "y" * 45_000)], "k int, o int, text string")
    df = df.withColumn("tokens", narrative.estimate_tokens("text"))
    chunked = narrative.chunk_rows(df, "k", "o", "tokens")
    assert sorted(r["chunk_id"] for r in chunked.collect()) == [0, 1]
    prompts = narrative.prompt_batches(chunked, "k", "o", "tokens", ["text"]).collect()
    assert len(prompts) == 2 and all(p["prompt"].startswith("\nYou are an elite") for p in prompts)


def test_attribution(spark, valid_pair):
    narr = spark.createDataFrame([
        (None, "Acme Metals", "HIGH", ["a"], "r", 0.9, 1),       # resolved by name
        ("SUP-002", "Whatever", "LOW", [], "r", 0.4, 2),
        ("SUP-002", "Whatever", "CRITICAL", [], "later wins", 0.5, 3),
        ("SUP-999", "Nobody", "MEDIUM", [], "r", 0.1, 4)], NARR_DDL)
    got = {r["resolved_id"]: r for r in narrative.attribute(narr, valid_pair).collect()}
    assert set(got) == {"SUP-001", "SUP-002", "UNKNOWN"}
    assert got["SUP-002"]["recommendation"] == "later wins"
    top = [r["resolved_id"] for r in narrative.top_narratives(narrative.attribute(narr, valid_pair)).collect()]
    assert top == ["SUP-002", "SUP-001", "UNKNOWN"]


def test_duplicate_names_last_wins(spark, suppliers):
    sup = suppliers([("SUP-1", "Same", 0.1, 0.0, 0.0, "EMEA", 2, 1.0, None),
                     ("SUP-2", "Same", 0.1, 0.0, 0.0, "EMEA", 2, 1.0, None)])
    narr = spark.createDataFrame([(None, "Same", "LOW", [], "r", 0.1, 1)], NARR_DDL)
    assert narrative.attribute(narr, sup).first()["resolved_id"] == "SUP-2"


def test_narrative_contract(spark):
    narr = spark.createDataFrame([
        ("S1", "A", "SEVERE", ["a", "b", "c", "d"], "r", 1.5, 1)], NARR_DDL)
    fails = {(r["column"], r["check"]) for r in quality.failures(narr, narrative.narrative_contract()).collect()}
    assert fails == {("overall_risk", "isin(LOW, MEDIUM, HIGH, CRITICAL)"), ("key_risks", "max_length(3)"),
                     ("confidence", "in_range(0.0, 1.0)")}


def test_report_tables(scenario_four):
    scored = scoring.score(scenario_four, Scenario(), "2025-06-30")
    t = report.report_tables(scored)
    assert t["kpis"].first()["total_suppliers_text"] == "4"
    top = t["top"].collect()
    assert len(top) == 4 and all(len(r["name"]) <= 40 for r in top)


def test_fold_text_equals_the_normal_form_on_every_code_point(spark):
    fold = lambda v: unicodedata.normalize("NFKD", v).encode("latin-1", "ignore").decode("latin-1")
    listed = {raw for raw, _ in C.FOLD_REPLACEMENTS}
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c) not in listed]
    texts = ["a" + "".join(chars[i:i + 64]) + "\u0323\u0301\u0302z" for i in range(0, len(chars), 64)] + ["", "\U0001d400\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", fold_text("s").alias("s"))
    assert [r["s"] for r in df.orderBy("i").collect()] == [fold(t) for t in texts]
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
    assert spark.createDataFrame([(None,)], "s string").select(fold_text("s")).first()[0] is None


def test_fold_text(spark):
    df = spark.createDataFrame([("Café — “quoted” ≥ 5€ ★",)], "s string")
    assert df.select(fold_text("s")).first()[0] == "Cafe - \"quoted\" >= 5EUR  "


def test_staleness_edges(spark):
    now = dt.datetime(2026, 1, 1, 12, 0, 0)
    cases = [(now - dt.timedelta(seconds=s), now) for s in (899, 900, 901)]
    cases.append((now - dt.timedelta(seconds=900, microseconds=500_000), now))
    cases.append((None, now))
    df = spark.createDataFrame(cases, "last timestamp, now timestamp")
    got = [r[0] for r in df.select(incremental.stale(F.col("last"), F.col("now"))).collect()]
    assert got == [False, False, True, True, True]


def test_new_files_by_content(spark, tmp_path):
    d = tmp_path / "landing"
    d.mkdir()
    (d / "a.csv").write_text("same")
    (d / "b.csv").write_text("same")
    (d / "c.csv").write_text("different")
    hashes = incremental.file_hashes(spark, str(d))
    ledger_path = str(tmp_path / "ledger")
    first = incremental.new_files(hashes, incremental.read_ledger(spark, ledger_path))
    assert first.select("content_sha256").distinct().count() == 2
    incremental.register(first, ledger_path)
    assert incremental.new_files(hashes, incremental.read_ledger(spark, ledger_path)).count() == 0


def test_pending_and_scenario_keys(spark):
    work = spark.createDataFrame([("h1", "s1"), ("h1", "s2")], "upload string, scen string")
    done = spark.createDataFrame([("h1", "s1")], "upload string, scen string")
    assert [tuple(r) for r in incremental.pending(work, done, ["upload", "scen"]).collect()] == [("h1", "s2")]
    assert incremental.scenario_key(Scenario()) != incremental.scenario_key(Scenario(weighting="financial_heavy"))


def test_supplier_stream(spark, tmp_path):
    src = tmp_path / "landing"
    src.mkdir()
    header = ("supplier_id,supplier_name,risk_score,latitude,longitude,region,tier,"
              "annual_spend_usd,last_audit_date\n")
    (src / "one.csv").write_text(header + "SUP-001, Acme ,0.12,48.1,11.5, EMEA ,2,250000,2025-11-30\n")
    sinks = {k: str(tmp_path / k) for k in ("accepted", "scored", "rejected", "failures")}
    ckpt = str(tmp_path / "ckpt")
    streams.stream_suppliers(spark, str(src), sinks, ckpt).awaitTermination()
    (src / "two.csv").write_text(header + "SUP-002,Bad,0.5,0,0,MARS,2,10,\n")
    streams.stream_suppliers(spark, str(src), sinks, ckpt).awaitTermination()
    scored = spark.read.parquet(sinks["scored"]).collect()
    assert [r["supplier_name"] for r in scored] == ["Acme"]
    fails = spark.read.parquet(sinks["failures"]).collect()
    assert [(r["column"], r["failure_case"]) for r in fails] == [("region", "MARS")]


def test_chunk_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 0, 5), (None, 1, 5), (1, 0, 9)], "k int, o int, t long")
    out = sorted((r["k"] is None, r["o"], r["chunk_id"]) for r in chunking.chunk(df, "k", "o", "t", 8).collect())
    assert out == [(False, 0, 0), (True, 0, 0), (True, 1, 1)]


def test_hot_key_is_split_into_slices(spark):
    """One key with most of the rows is cut into several slices (no task
    holds the whole key) and still gets the serial greedy labels."""
    rng = random.Random(11)
    hot = [(0, i, rng.choice([0, 3, 8, 15, 40])) for i in range(3000)]
    cold = [(k, i, rng.choice([1, 5])) for k in range(1, 40) for i in range(20)]
    df = spark.createDataFrame(hot + cold, "k int, o int, t long")
    out = chunking.chunk(df, "k", "o", "t", budget=50, num_partitions=8)
    got = {(r["k"], r["o"]): r["chunk_id"] for r in out.collect()}
    expect = _greedy([t for _, _, t in hot], 50)
    assert [got[(0, o)] for _, o, _ in hot] == expect
    slices = (df.withColumn("_key", F.concat(F.lit("v"), F.col("k").cast("string")))
              .repartitionByRange(8, "_key", "o").withColumn("_pid", F.spark_partition_id())
              .where("k = 0").select("_pid").distinct().count())
    assert slices > 1


def test_rank_with_a_dominant_group(spark):
    from tierwatch.operators.ranking import global_rank
    rows = [("big", float(i % 97), i) for i in range(5000)] + [("small", float(i), i) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    out = global_rank(df, ["g"], [F.col("v").desc(), F.col("id").asc()], "rk", num_partitions=6)
    got = {(r["g"], r["id"]): r["rk"] for r in out.collect()}
    for g in ("big", "small"):
        ordered = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1], r[2]))
        assert [got[(g, r[2])] for r in ordered] == list(range(1, len(ordered) + 1))


def test_news_stream(spark, tmp_path):
    from tierwatch.streaming import streams as st
    src = tmp_path / "feeds"
    src.mkdir()
    item = "<item><title>{t}</title><link>{l}</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate>" \
           "<description>{d}</description></item>"
    (src / "JOC.xml").write_text("<rss><channel>" + item.format(t="Port strike", l="https://x/1", d="a")
                                 + item.format(t="Calm day", l="https://x/2", d="b") + "</channel></rss>")
    q = st.stream_news(spark, str(src), str(tmp_path / "sink"), str(tmp_path / "ckpt"), keywords="strike")
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "sink")).collect()
    assert [(r["title"], r["source"]) for r in rows] == [("Port strike", "JOC")]


def test_staleness_of_wall_clock_times_across_dst(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame(
            [(dt.datetime(2024, 3, 10, 1, 50), dt.datetime(2024, 3, 10, 3, 4))],   # 74 min of wall clock
            "last timestamp_ntz, now timestamp_ntz")
        assert df.select(incremental.stale(F.col("last"), F.col("now"), 4000)).first()[0] is True
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_one_bad_upload_does_not_reject_the_good_one(spark, tmp_path):
    from tierwatch.streaming import streams as st
    src = tmp_path / "in"
    src.mkdir()
    header = ",".join(st.SUPPLIER_TEXT_SCHEMA.fieldNames()) + "\n"
    (src / "good.csv").write_text(header + "SUP-101,Fine Works,0.2,1,1,EMEA,2,250000,2025-11-30\n")
    (src / "bad.csv").write_text(header + "SUP-102,Odd Works,0.5,0,0,MOON,2,250000,\nSUP-103,Kept Out,0.5,0,0,EMEA,2,250000,\n")
    sinks = {k: str(tmp_path / k) for k in ("accepted", "scored", "rejected", "failures")}
    st.stream_suppliers(spark, str(src), sinks, str(tmp_path / "ckpt")).awaitTermination()
    assert [r["supplier_id"] for r in spark.read.parquet(sinks["scored"]).collect()] == ["SUP-101"]
    assert sorted(r["supplier_id"] for r in spark.read.parquet(sinks["rejected"]).collect()) == ["SUP-102", "SUP-103"]
    assert [r["failure_case"] for r in spark.read.parquet(sinks["failures"]).collect()] == ["MOON"]


def test_rank_keeps_null_groups(spark):
    from tierwatch.operators.ranking import global_rank
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, v int")
    out = global_rank(df, ["g"], [F.col("v").asc()], "rk").collect()
    assert sorted((r["v"], r["rk"]) for r in out) == [(1, 1), (2, 1), (3, 2)]


def test_news_stream_query_runs_twice(spark):
    from tierwatch.plans.catalog import QUERIES
    counts = [QUERIES["stream_news"](spark, "/root/testdata/sf0.001").count() for _ in range(2)]
    assert counts[0] == counts[1] > 0


def test_ledger_errors_other_than_absence_are_raised(spark, tmp_path):
    assert incremental.read_ledger(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        incremental.read_ledger(spark, "nosuchscheme://x/y").count()


def test_fold_text_searches_by_a_short_pattern(spark):
    """A class of every character with several successors is searched one by one, at each character."""
    text = "a\u00e9\ufb03 \u00bd\U0001f100\U0001f600z"
    folded = spark.createDataFrame([(text * 3,)], "s string").select(fold_text("s").alias("s"))
    assert folded.first()[0] == unicodedata.normalize("NFKD", text).encode("latin-1", "ignore").decode("latin-1") * 3
    plan = folded._jdf.queryExecution().analyzed().toString()
    assert "RLIKE" in plan and max(len(p) for p in plan.split("RLIKE")[1].split(")")[:1]) < 100
