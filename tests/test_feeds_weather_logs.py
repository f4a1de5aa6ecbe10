import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tierwatch import constants as C
from tierwatch.functions.errors import classify_error, is_retryable
from tierwatch.functions.weather import shipping_risk
from tierwatch.operators import logs, news, weather
from tierwatch.sources.feeds import normalise_items, read_feed

RSS = """<?xml version="1.0"?>
<rss version="2.0"><channel><title>t</title>
<item><title>Port strike halts cargo</title><link>https://x/1</link>
<pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate><description>Dock workers walk out</description></item>
<item><title>Freight rates ease</title><link>https://x/2</link>
<pubDate>Tue, 6 Jan 2026 09:30:00 +0000</pubDate><description>Shipping STRIKE talks</description></item>
<item><title></title><description>no title, no date</description></item>
</channel></rss>"""


def test_feed_parse_sort_filter(spark, tmp_path):
    (tmp_path / "JOC.xml").write_text(RSS)
    items = normalise_items(read_feed(spark, str(tmp_path / "JOC.xml")))
    rows = news.latest_news(items).collect()
    assert [r["title"] for r in rows] == ["Freight rates ease", "Port strike halts cargo", "Untitled"]
    assert rows[0]["published"] == dt.datetime(2026, 1, 6, 9, 30)
    assert rows[2]["published"] == dt.datetime(1970, 1, 1)         # no date -> epoch 0
    assert rows[2]["url"] == C.FEED_SOURCES["JOC"]                 # no link -> feed URL
    assert rows[0]["source"] == "JOC"
    hits = news.keyword_filter(items, " Strike ,,").collect()
    assert sorted(r["title"] for r in hits) == ["Freight rates ease", "Port strike halts cargo"]
    assert news.keyword_filter(items, "").count() == 3
    assert news.keyword_filter(items, "summary only, walk out").count() == 1


def test_broken_feed_contributes_nothing(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("<rss><channel><item><title>x</title>")
    assert read_feed(spark, str(tmp_path / "bad.xml")).count() == 0


def test_many_keywords(spark, tmp_path):
    (tmp_path / "JOC.xml").write_text(RSS)
    items = normalise_items(read_feed(spark, str(tmp_path / "JOC.xml")))
    words = [f"zz{i}" for i in range(100)] + ["dock"]
    assert news.keyword_filter(items, words).count() == 1


def test_digest_holds_every_item_once(spark, tmp_path):
    (tmp_path / "JOC.xml").write_text(RSS)
    items = normalise_items(read_feed(spark, str(tmp_path / "JOC.xml")))
    whole = news.digest_batches(items, tie="url").collect()
    assert [r["n_items"] for r in whole] == [items.count()]
    assert whole[0]["prompt"].endswith(whole[0]["digest"] + "\n") and "News items:\n- [" in whole[0]["prompt"]
    assert "- [JOC] Freight rates ease (2026-01-06T09:30:00+00:00): Shipping STRIKE talks" in whole[0]["digest"].split("\n")
    small = sorted((r["batch"], r["n_items"], r["digest"]) for r in news.digest_batches(items, budget=20, tie="url").collect())
    assert "\n".join(d for _, _, d in small) == whole[0]["digest"] and len(small) > 1


def test_missing_feed_contributes_nothing(spark, tmp_path):
    assert read_feed(spark, str(tmp_path / "never.xml")).count() == 0


def test_missing_feed_leaves_the_landed_ones(spark, tmp_path):
    from tierwatch.sources.feeds import read_atom
    never = str(tmp_path / "never.xml")
    (tmp_path / "JOC.xml").write_text(RSS)
    (tmp_path / "My Feed.xml").write_text(ATOM)
    for read, path in ((read_feed, str(tmp_path / "JOC.xml")), (read_atom, str(tmp_path / "My Feed.xml"))):
        want = sorted(map(str, read(spark, path).collect()))
        assert want and sorted(map(str, read(spark, [path, never]).collect())) == want
        assert sorted(map(str, read(spark, [never, path]).collect())) == want
        assert read(spark, [never]).columns == read(spark, path).columns and read(spark, never).count() == 0


def test_json_rows_are_ascii_and_keep_nulls(spark):
    import json
    from tierwatch.functions.text import row_json
    rows = [(1, 'say "hi" \\ é 日 \U0001f600\n', None), (2, "", "x")]
    df = spark.createDataFrame(rows, "k long, text string, other string")
    got = [r[0] for r in df.select(row_json(df)).collect()]
    assert got == [json.dumps(dict(zip(("k", "text", "other"), r))) for r in rows]


@pytest.mark.parametrize("wind,precip,level", [
    (29, 10, "LOW"), (30, 10, "MODERATE"), (49, 39, "MODERATE"), (50, 0, "HIGH"),
    (79, 59, "HIGH"), (0, 60, "HIGH"), (80, 0, "SEVERE"), (0, 80, "SEVERE")])
def test_shipping_risk_edges(spark, wind, precip, level):
    df = spark.createDataFrame([(float(wind), float(precip))], "w double, p double")
    assert df.select(shipping_risk("w", "p")).first()[0] == level


def _payload(spark, hourly):
    df = spark.createDataFrame([(1, json.dumps({"hourly": hourly}))], "loc int, payload string")
    return weather.worst_hour_arrays(weather.parse_weather(df)).first()


def test_worst_hour_arrays(spark):
    r = _payload(spark, {"windspeed_10m": [40, 60], "temperature_2m": [5, 6],
                         "precipitation_probability": [10, 20], "weathercode": [0, 61]})
    assert (r["wind_kmh"], r["temperature_c"], r["precip_prob_pct"]) == (60.0, 6.0, 20.0)
    assert (r["condition"], r["risk_level"]) == ("Light rain", "HIGH")


def test_worst_hour_ragged_tied_and_empty(spark):
    r = _payload(spark, {"windspeed_10m": [70, 70, None], "temperature_2m": [1.0],
                         "precipitation_probability": None, "weathercode": [5]})
    assert r["hour_index"] == 0 and r["temperature_c"] == 1.0 and r["precip_prob_pct"] == 0.0
    assert r["condition"] == "Unknown"
    r = _payload(spark, {})
    assert (r["wind_kmh"], r["temperature_c"], r["weather_code"]) == (0.0, 20.0, 0)
    assert (r["condition"], r["risk_level"]) == ("Clear sky", "LOW")


def test_worst_hour_rows(spark):
    obs = spark.createDataFrame([
        (1, "2026-01-01 00:00:00", 10.0, 1.0, 5.0, 3),
        (1, "2026-01-01 01:00:00", 55.0, 2.0, 6.0, 61),
        (1, "2026-01-01 02:00:00", 55.0, 3.0, 7.0, 0),
        (2, "2026-01-01 00:00:00", None, None, None, None)],
        "loc int, hour string, wind double, precip double, temp double, code int"
    ).withColumn("hour", F.to_timestamp("hour"))
    got = {r["loc"]: r for r in weather.worst_hour(obs, "loc", "hour", "wind", "precip", "temp", "code").collect()}
    assert got[1]["precip_prob_pct"] == 2.0 and got[1]["risk_level"] == "HIGH"
    assert got[2]["temperature_c"] == 20.0 and got[2]["condition"] == "Clear sky"


@pytest.mark.parametrize("status,msg,cat", [
    (None, "monthly quota is gone", "CAT_QUOTA"),
    (None, "row 7: SCHEMA has no such field", "CAT_SCHEMA"), (None, "three values failed Validation", "CAT_SCHEMA"),
    (None, "the upstream call timed out after 9 s", "CAT_TIMEOUT"), (None, "past its deadline by far", "CAT_TIMEOUT"),
    (None, "login refused: unauthorized user", "CAT_AUTH"),
    (None, "the printer is on fire", "CAT_FALLBACK"), (429, "x", "CAT_QUOTA"), (401, "x", "CAT_AUTH"),
    (504, "x", "CAT_TIMEOUT"), (502, "x", "CAT_TIMEOUT"), (500, "boom", "CAT_FALLBACK"),
    (None, "server replied 429 twice", "CAT_QUOTA")])
def test_error_categories(spark, status, msg, cat):
    df = spark.createDataFrame([(status, msg)], "status int, message string")
    assert df.select(classify_error("status", "message")).first()[0] == cat


def test_retryable(spark):
    df = spark.createDataFrame([(429,), (502,), (503,), (504,), (None,)], "s int")
    assert [r[0] for r in df.select(is_retryable("s")).collect()] == [True, True, True, False, False]


def test_log_normalise_format_recent(spark):
    df = spark.createDataFrame([
        (dt.datetime(2026, 1, 1, 9, 5, 7), "INFO", "hello", {"request_id": "r1", "k": None}, 1),
        (dt.datetime(2026, 1, 1, 9, 5, 8), "CRITICAL", "boom", {}, 2),
        (dt.datetime(2026, 1, 1, 9, 5, 9), "DEBUG", "hidden", {}, 3)],
        "timestamp timestamp, level string, message string, extra map<string,string>, ord int")
    norm = logs.normalise_logs(df)
    lines = {r["ord"]: r["line"] for r in logs.format_logs(df).collect()}
    assert lines == {1: "09:05:07 | INFO     | hello | request_id=r1 k=None", 2: "09:05:08 | CRITICAL | boom"}
    assert norm.where("ord = 1").first()["request_id"] == "r1"
    assert [r["ord"] for r in logs.recent_logs(df, n=1, ordinal="ord").collect()] == [2]


ATOM = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>
<entry><title>Canal closure</title><link href="https://y/1"/><updated>2026-01-07T08:00:00Z</updated>
<summary>Ships wait</summary></entry>
<entry><title>Rates</title><link href="https://y/2"/><published>2026-01-08T09:15:00+01:00</published>
<updated>2026-01-09T00:00:00Z</updated><summary></summary></entry>
</feed>"""


def test_atom_feed(spark, tmp_path):
    from tierwatch.sources.feeds import read_atom
    (tmp_path / "FreightWaves.xml").write_text(ATOM)
    rows = news.latest_news(normalise_items(read_atom(spark, str(tmp_path / "FreightWaves.xml")))).collect()
    assert [(r["title"], r["url"]) for r in rows] == [("Rates", "https://y/2"), ("Canal closure", "https://y/1")]
    assert rows[0]["published"] == dt.datetime(2026, 1, 8, 8, 15)     # published wins over updated
    assert rows[1]["published"] == dt.datetime(2026, 1, 7, 8, 0)      # falls back to updated
    assert rows[0]["summary"] is None and rows[0]["source"] == "FreightWaves"


def test_news_stream_dedup_within_watermark(spark, tmp_path):
    from tierwatch.streaming import streams as st
    src = tmp_path / "feeds"
    src.mkdir()
    item = "<item><title>{t}</title><link>https://x/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item>"
    (src / "A.xml").write_text("<rss><channel>" + item.format(t="first") + "</channel></rss>")
    (src / "B.xml").write_text("<rss><channel>" + item.format(t="again") + "</channel></rss>")
    q = st.stream_news(spark, str(src), str(tmp_path / "sink"), str(tmp_path / "ckpt"),
                       dedup_watermark="1 day")
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 1
