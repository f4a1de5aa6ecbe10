from pyspark.sql import functions as F

from tierwatch.functions.bands import risk_band
from tierwatch.operators import geo, screening
from tierwatch.scenario import Scenario
from tierwatch.sources.csv import read_sanctions


def test_sanctions_screening_from_csv(spark, valid_pair, tmp_path):
    p = tmp_path / "sanctions.csv"
    p.write_text("entity_id,entity_name,list_source\n"
                 "SUP-001,Acme,OFAC\nSUP-003,Ghost,EU\nSUP-001,Acme,EU\nSUP-002,Pac,\n")
    out = screening.screen(valid_pair, read_sanctions(spark, str(p))).collect()
    got = [(r["supplier_id"], r["is_sanctioned"], r["sanctions_list_source"]) for r in out]
    # fan-out for two lists; a match without a list name is sanctioned with NONE
    assert sorted(got) == [("SUP-001", True, "EU"), ("SUP-001", True, "OFAC"), ("SUP-002", True, "NONE")]
    one = screening.screen(valid_pair, read_sanctions(spark, str(p)), one_row_per_supplier=True)
    got = {r["supplier_id"]: r["sanctions_list_source"] for r in one.collect()}
    assert got == {"SUP-001": "EU,OFAC", "SUP-002": "NONE"}


def test_unlisted_supplier_defaults(spark, valid_pair):
    empty = spark.createDataFrame([], "entity_id string, entity_name string, list_source string")
    rows = screening.screen(valid_pair, empty).collect()
    assert [(r["is_sanctioned"], r["sanctions_list_source"]) for r in rows] == [(False, "NONE")] * 2


def test_band_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.85, 0.8499, 0.70, 0.6999, 0.40, 0.3999, None)], "x double")
    got = [r[0] for r in df.select(risk_band("x")).collect()]
    assert got == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_map_points_escape_and_colour(spark):
    df = spark.createDataFrame(
        [("S<1>", "A & \"B\" 'C'", "EMEA", 2, 0.92, 10.0, 20.0),
         (None, None, None, 3, 0.34, -10.0, -20.0)],
        "supplier_id string, supplier_name string, region string, tier int, composite_risk double, "
        "latitude double, longitude double")
    rows = geo.map_points(df).collect()
    assert rows[0]["supplier_id"] == "S&lt;1&gt;"
    assert rows[0]["supplier_name"] == "A &amp; &quot;B&quot; &#39;C&#39;"
    assert rows[0]["risk_rgb"] == [244, 63, 94, 210] and rows[0]["risk_display"] == "0.92"
    assert rows[0]["risk_radius"] == 60000 + 240000 * 0.92
    assert (rows[1]["supplier_id"], rows[1]["supplier_name"], rows[1]["region"]) == ("ENTITY", "Unknown Entity", "-")
    assert rows[1]["risk_rgb"] == [52, 211, 153, 210]
    c = geo.map_center(geo.map_points(df)).first()
    assert (c["center_latitude"], c["center_longitude"]) == (0.0, 0.0)


def test_map_cap_and_large_payload(spark):
    i = F.col("id")
    df = spark.range(50_000).select(
        F.format_string("SUP-%06d", i).alias("supplier_id"), F.lit("n").alias("supplier_name"),
        F.lit("EMEA").alias("region"), ((i % 100) / 100.0).alias("composite_risk"),
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    assert geo.map_points(df, Scenario(max_map_points=1000)).count() == 1000
    assert geo.map_points(df).count() == 50_000
    capped = geo.map_points(df, Scenario(max_map_points=20_000))   # distributed top-N path
    assert capped.count() == 20_000
    assert capped.agg(F.min("risk_display")).first()[0] == "0.6"   # 40 values x 500 rows


def test_risk_column_fallback(spark):
    df = spark.createDataFrame([("S1", 0.5, 1.0, 2.0)], "supplier_id string, risk_score double, "
                                                         "latitude double, longitude double")
    r = geo.map_points(df).first()
    assert r["risk_display"] == "0.5" and r["supplier_name"] == "Unknown Entity" and r["region"] == "-"


def test_cluster_payload_columns(spark):
    df = spark.range(50_000).selectExpr("id * 0.001 AS latitude", "id * 0.002 AS longitude",
                                        "concat('p', id) AS popup_text", "id")
    out = geo.cluster_payload(df)
    assert out.columns == ["latitude", "longitude", "popup_text"]
    assert out.count() == 50_000


def test_top_n_is_exact_under_ties(spark):
    import random
    from tierwatch.operators import ranking
    rng = random.Random(5)
    rows = [(i, float(rng.choice(range(50)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, r double").repartition(4)
    order = [F.col("r").desc(), F.col("id").asc()]
    expect = [i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:1500]]
    assert [r["id"] for r in ranking.top_n(df, order, 1500, ordered=True).collect()] == expect
    assert ranking.top_n(df, order, 7000).count() == 6000


def test_nan_risk_is_critical_red(spark):
    from tierwatch import constants as C
    df = spark.createDataFrame([("SUP-1", float("nan")), ("SUP-2", None), ("SUP-3", 0.9)],
                               "supplier_id string, composite_risk double")
    df = df.selectExpr("*", "0.0D AS latitude", "0.0D AS longitude")
    got = {r["supplier_id"]: tuple(r["risk_rgb"][:3]) for r in geo.map_points(df).collect()}
    assert got == {"SUP-1": C.RISK_RGB["CRITICAL"], "SUP-2": C.RISK_RGB["LOW"], "SUP-3": C.RISK_RGB["CRITICAL"]}


def test_payload_and_report_sinks(spark, tmp_path, scenario_four):
    from tierwatch.operators import report, scoring
    from tierwatch.sources.sinks import write_table, write_tables
    scored = scoring.score(scenario_four, Scenario(), "2025-06-30")
    path = write_table(geo.cluster_payload(geo.with_popup(scored)), str(tmp_path / "cluster"), "json")
    back = spark.read.json(path)
    assert sorted(back.columns) == ["latitude", "longitude", "popup_text"] and back.count() == 4
    paths = write_tables(report.report_tables(scored), str(tmp_path / "report"))
    assert set(paths) == {"kpis", "regions", "top"}
    assert spark.read.parquet(paths["top"]).count() == 4
