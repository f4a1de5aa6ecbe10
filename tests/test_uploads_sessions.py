"""Uploads by header, the one-pass gate, number texts, threshold selection and
session state."""

import datetime as dt
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tierwatch import constants as C
from tierwatch.functions.text import number_text, row_json
from tierwatch.operators import quality, ranking
from tierwatch.sources import csv as csv_source
from tierwatch.streaming import sessions, streams

GOOD = "{id},Fine Works,0.2,1,1,EMEA,2,250000,2025-11-30\n"
HEADER = ",".join(C.SUPPLIER_COLUMNS) + "\n"


def _land(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)


def test_bad_header_is_a_verdict_on_its_own_file(spark, tmp_path):
    src = tmp_path / "in"
    turned = [c for c in reversed(C.SUPPLIER_COLUMNS)]
    _land(src, good=HEADER + GOOD.format(id="SUP-1") + "\n" + GOOD.format(id="SUP-2"),
          turned="\ufeff" + ",".join(f'"{c}"' for c in turned) + "\n2025-11-30,250000,3,NA,2,2,0.4,\"Works, Turned\",SUP-3\n",
          short=HEADER.replace("tier,", "") + "SUP-4,No Tier,0.2,1,1,EMEA,250000,2025-11-30\n",
          wide=HEADER.strip() + ",owner\n" + GOOD.format(id="SUP-5").strip() + ",me\n", bare=HEADER, nothing="")
    sinks = {k: str(tmp_path / k) for k in ("accepted", "scored", "rejected", "failures")}
    streams.stream_suppliers(spark, str(src), sinks, str(tmp_path / "ckpt")).awaitTermination()
    scored = {r["supplier_id"]: r for r in spark.read.parquet(sinks["scored"]).collect()}
    assert sorted(scored) == ["SUP-1", "SUP-2", "SUP-3"]
    assert scored["SUP-3"]["supplier_name"] == "Works, Turned" and scored["SUP-3"]["region"] == "NA" and scored["SUP-3"]["tier"] == 3
    cases = spark.read.parquet(sinks["failures"]).collect()
    assert sorted((r[csv_source.FILE].rsplit("/", 1)[1], r["column"], r["check"]) for r in cases) == [
        ("short.csv", "tier", "column_in_dataframe"), ("wide.csv", "owner", "column_in_schema")]
    assert sorted(r["supplier_id"] for r in spark.read.parquet(sinks["rejected"]).collect()) == ["SUP-4", "SUP-5"]
    _land(src, later=HEADER + GOOD.format(id="SUP-6"))                   # the stream goes on
    streams.stream_suppliers(spark, str(src), sinks, str(tmp_path / "ckpt")).awaitTermination()
    assert spark.read.parquet(sinks["scored"]).where("supplier_id = 'SUP-6'").count() == 1


def test_one_id_in_two_rejected_files_is_no_duplicate(spark, tmp_path):
    src = tmp_path / "in"
    bad = "{id},Odd,0.5,0,0,MOON,2,250000,\n"
    _land(src, a=HEADER + bad.format(id="SUP-9"), b=HEADER + bad.format(id="SUP-9"),
          c=HEADER + GOOD.format(id="SUP-8") * 2)
    sinks = {k: str(tmp_path / k) for k in ("accepted", "scored", "rejected", "failures")}
    streams.stream_suppliers(spark, str(src), sinks, str(tmp_path / "ckpt")).awaitTermination()
    cases = spark.read.parquet(sinks["failures"]).collect()
    assert sorted((r[csv_source.FILE][-5:], r["supplier_id"], r["check"].split("(")[0]) for r in cases) == [
        ("a.csv", "SUP-9", "isin"), ("b.csv", "SUP-9", "isin"), ("c.csv", "SUP-8", "unique"), ("c.csv", "SUP-8", "unique")]


def test_many_files_of_few_headers_are_one_scan(spark, tmp_path):
    names = list(C.SUPPLIER_COLUMNS)
    for i in range(60):
        order = [names, names[::-1], names[3:] + names[:3]][i % 3]
        values = dict(zip(names, GOOD.format(id=f"SUP-{i:03d}").strip().split(",")))
        _land(tmp_path / "many", **{f"f{i}": ",".join(order) + "\n" + ",".join(values[c] for c in order) + "\n"})
    rows, headers = csv_source.parse_uploads(csv_source.upload_lines(spark.read, str(tmp_path / "many")), names)
    got = rows.collect()
    assert sorted(r["supplier_id"] for r in got) == [f"SUP-{i:03d}" for i in range(60)]
    assert all(r["region"] == "EMEA" and r["last_audit_date"] == "2025-11-30" for r in got) and headers.count() == 60


def test_gate_write_publishes_or_leaves_staged(spark, valid_pair, suppliers, tmp_path):
    path = str(tmp_path / "table")
    out = quality.gate_write(valid_pair, path)
    assert out.count() == 2 and not (tmp_path / "table.staged").exists()
    bad = suppliers([("SUP-1", "A", 0.1, 0.0, 0.0, "MARS", 2, 1.0, None), ("SUP-1", "B", 0.1, 0.0, 0.0, "NA", 2, 1.0, None)])
    with pytest.raises(quality.GateError) as e:
        quality.gate_write(bad, path)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(e.value.failure_cases) == key(quality.failures(bad)) and "3 error(s)" in str(e.value)
    assert spark.read.parquet(path).count() == 2                          # the accepted table stays
    with pytest.raises(quality.GateError, match="materialised"):
        quality.gate_write(valid_pair.withColumn("tier", F.raise_error(F.lit("no")).cast("bigint")), path)


def test_numbers_read_as_python_prints_them(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, 12500000.0, 1e-4, 9.9e-5, 1e15, 1e16, 123456789012345680.0, 1.5e300, 2.2250738585072014e-308,
              1 / 3, 0.1 + 0.2, -2.5e-7, 1e22, 1e23, 8.41e21, 2e-3, 100.0, 1e100, 1.7976931348623157e308]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(500)]
    values += [x for x in (struct.unpack("d", rng.randbytes(8))[0] for _ in range(500)) if math.isfinite(x) and abs(x) > 2.3e-308]
    values += [round(rng.uniform(0, 1e6), 2) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    got = [r[0] for r in df.select(number_text("x")).collect()]
    other = [(g, x) for g, x in zip(got, values) if g != repr(x)]
    assert len(other) <= 5 and all(float(g) == x and len(g) == len(repr(x)) for g, x in other), other
    odd = spark.createDataFrame([(float("nan"), None), (float("inf"), 1), (float("-inf"), 2)], "x double, k bigint")
    assert [r[0] for r in odd.select(row_json(odd)).collect()] == [
        json.dumps({"x": r.x, "k": r.k}) for r in odd.collect()]
    none = spark.createDataFrame([(None,)], "x double")
    assert none.select(row_json(none)).first()[0] == '{"x": null}'


@pytest.mark.parametrize("n", [1, 7, 500, 5000])
def test_top_n_by_score_equals_a_full_sort(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([rng.random(), 0.5, 1.0, 0.0, None, float("nan"), -3.0, 7.5, rng.random() / 5000])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, risk double").repartition(7)
    got = ranking.top_n_by_score(df, "risk", [F.col("id").asc()], n).collect()
    want = df.orderBy(F.col("risk").desc_nulls_last(), F.col("id").asc()).limit(n).collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]
    assert ranking.top_n_by_score(df.limit(0), "risk", [F.col("id").asc()], n).count() == 0


def test_session_steps():
    state, seen = (None, None, None), []
    for kind, value, second in [("news", None, 0), ("news", None, 899), ("news", None, 900), ("news", None, 901), ("scenario", "s", 902),
                                ("upload", "A", 903), ("upload", "A", 904), ("upload", "B", 905), ("upload", "A", 906),
                                ("news", None, 907), ("scenario", "s", 908), ("scenario", "t", 909), ("upload", None, 910)]:
        state, stages = sessions.steps(state, kind, value, second * 1_000_000)
        seen.append(stages)
    again = sessions.AFTER_UPLOAD
    assert seen == [("news",), (), (), ("news",), (), again, (), again, again, ("news",), (), sessions.AFTER_SCENARIO, ()]


def test_session_state_goes_on_between_batches(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("s", i, t0 + dt.timedelta(seconds=i * 300), k, v) for i, (k, v) in enumerate(
        [("upload", "A"), ("news", None), ("upload", "A"), ("news", None), ("news", None), ("news", None), ("upload", "B"), ("news", None)])]
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part[::-1], sessions.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sessions.stream_sessions(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = [(r["seq"], r["stage"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq", "stage").collect()]
    assert got == [(0, "score"), (0, "text"), (0, "validate"), (1, "news"), (5, "news"), (6, "score"), (6, "text"), (6, "validate"),
                   (7, "news")]


def test_session_without_work_makes_no_frame():
    import numpy as np
    import pandas as pd
    from tierwatch.streaming import sessions

    class State:
        exists, get, held = False, None, None

        def update(self, value):
            self.held = value

    def frame(*rows):
        return pd.DataFrame(rows, columns=["session", "seq", "at", "kind", "value"]).astype({"value": object})
    state, fold = State(), sessions._fold(3600)
    assert list(fold(("s",), iter([frame(("s", 1, 10, "scenario", "balanced"))]), state)) == []
    assert state.held == (None, "balanced", None)
    parts = [frame(("s", 9, sessions._NO_TIME, "upload", "g"), ("s", 4, 20, "news", None), ("s", 3, 20, "upload", "h")),
             frame(("s", 2, 10, "upload", np.nan), ("s", 5, 20, "upload", None))]
    rows = [tuple(r) for df in fold(("s",), iter(parts), State()) for r in df.itertuples(index=False)]
    assert rows == [("s", 3, "validate"), ("s", 3, "score"), ("s", 3, "text"), ("s", 4, "news"),
                    ("s", 9, "validate"), ("s", 9, "score"), ("s", 9, "text")]
