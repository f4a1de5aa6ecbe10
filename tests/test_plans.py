"""Plan-shape guards: properties that matter at scale, checked on the
physical plan Spark builds (explain), not on results."""

SF_CHECK = "/root/testdata/sf0.01"


def _plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_lineitem_is_never_the_broadcast_side(spark):
    from tierwatch.sources import tables
    plan = _plan(tables.line_exposures(spark, SF_CHECK))
    assert "LeftOuter" in plan and "BuildLeft" not in plan    # no hint: AQE decides for the profile side


def test_scoring_has_no_join_for_the_global_max(spark):
    from tierwatch.operators import scoring
    from tierwatch.scenario import Scenario
    from tierwatch.sources import tables
    plan = _plan(scoring.score(tables.supplier_facts(spark, SF_CHECK), Scenario(), tables.AS_OF))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert "Subquery" in plan


def test_scans_are_pruned_and_filtered(spark):
    from tierwatch.sources import tables
    plan = _plan(tables.line_exposures(spark, SF_CHECK).select("l_orderkey", "region"))
    lineitem_scan = plan[plan.index("lineitem.parquet"):].split("\n\n")[0]
    assert "l_comment" not in lineitem_scan and "l_quantity" not in lineitem_scan
    assert "struct<l_orderkey:bigint,l_suppkey:bigint>" in lineitem_scan


def test_no_window_over_the_whole_input_for_sweeps(spark):
    from tierwatch.operators import scoring
    from tierwatch.sources import tables
    swept = scoring.sweep(tables.supplier_facts(spark, SF_CHECK), tables.AS_OF)
    plan = _plan(swept)
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_tables_are_listed_anew(spark, tmp_path):
    from tierwatch.sources import tables
    spark.range(5).write.parquet(f"{tmp_path}/nation.parquet")
    assert tables.load(spark, str(tmp_path), "nation").count() == 5
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/nation.parquet")
    assert tables.load(spark, str(tmp_path), "nation").count() == 6


def test_long_keys_stay_whole(spark):
    from pyspark.sql import functions as F
    from tierwatch.sources.tables import supplier_code
    rows = spark.createDataFrame([(7,), (100000,), (1000007,), (1000008,), (None,)], "k long")
    got = [r[0] for r in rows.select(supplier_code(F.col("k"))).collect()]
    assert got == ["SUP-000007", "SUP-100000", "SUP-1000007", "SUP-1000008", None]


def test_hot_duplicate_id_expands_across_tasks(spark):
    from pyspark.sql import functions as F
    from tierwatch.operators import quality
    counts = spark.createDataFrame([("HOT", 250_000), ("x", 2)], "k string, n long")
    out = quality.expand_counts(counts, block=10_000)
    assert out.count() == 250_002
    per_task = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 250_000
