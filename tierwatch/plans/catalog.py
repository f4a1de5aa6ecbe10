"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the given parquet tables (or views Spark derives from
them) in full, so its work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rollups, scoring
from ..scenario import Scenario
from ..sources import tables
from .common import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


SUPPLIER_OUT = ["supplier_id", "supplier_name", "risk_score", "latitude", "longitude",
                "region", "tier", "annual_spend_usd", "last_audit_date"]


def scored_suppliers(spark, sf_dir, weighting="balanced", **kw) -> DataFrame:
    facts = tables.supplier_facts(spark, sf_dir)
    return scoring.score(facts, Scenario(weighting=weighting, **kw), tables.AS_OF)


def _score_query(weighting):
    def q(spark, sf_dir):
        return rounded(scored_suppliers(spark, sf_dir, weighting))
    return q


for _w in ("balanced", "financial", "operational", "geopolitical"):
    register(f"score_{_w}")(_score_query(_w if _w == "balanced" else f"{_w}_heavy"))


@register("score_filtered")
def score_filtered(spark, sf_dir):
    facts = tables.supplier_facts(spark, sf_dir)
    sc = Scenario(scenario_name="EMEA-APAC mid band", regions=("EMEA", "APAC"),
                  min_risk_threshold=0.4, max_risk_threshold=0.8)
    return rounded(scoring.score(facts, sc, tables.AS_OF))


@register("score_region_only")
def score_region_only(spark, sf_dir):
    facts = tables.supplier_facts(spark, sf_dir)
    sc = Scenario(scenario_name="Americas", regions=("NA", "LATAM"),
                  min_risk_threshold=0.5, max_risk_threshold=0.6)
    return rounded(scoring.score(facts, sc, tables.AS_OF, apply_filters=False))


@register("score_lines")
def score_lines(spark, sf_dir):
    lines = tables.line_exposures(spark, sf_dir)
    out = scoring.score(lines, Scenario(), tables.LINES_AS_OF)
    return rounded(out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "supplier_id", "region",
        "tier", "annual_spend_usd", F.col("last_audit_date").cast("string").alias("last_audit_date"),
        *scoring.C.COMPONENTS,
        "composite_risk"))


@register("weight_sweep_rank")
def weight_sweep_rank(spark, sf_dir):
    facts = tables.supplier_facts(spark, sf_dir)
    ranked = scoring.rank_by_scenario(scoring.sweep(facts, tables.AS_OF))
    return rounded(ranked.select("weighting", "supplier_id", "composite_risk", "scenario_rank"))


@register("kpis")
def kpis(spark, sf_dir):
    return rounded(rollups.kpis(scored_suppliers(spark, sf_dir)))


@register("region_rollup")
def region_rollup(spark, sf_dir):
    return rounded(rollups.region_rollup(scored_suppliers(spark, sf_dir)))


@register("band_counts")
def band_counts(spark, sf_dir):
    return rollups.band_counts(scored_suppliers(spark, sf_dir))


@register("top_risks")
def top_risks(spark, sf_dir):
    return rounded(rollups.top_risks(scored_suppliers(spark, sf_dir)))


@register("ledger")
def ledger(spark, sf_dir):
    return rounded(rollups.ledger(scored_suppliers(spark, sf_dir)))


@register("risk_matrix")
def risk_matrix(spark, sf_dir):
    return rounded(rollups.risk_matrix(scored_suppliers(spark, sf_dir)))


@register("line_region_rollup")
def line_region_rollup(spark, sf_dir):
    lines = tables.line_exposures(spark, sf_dir)
    scored = scoring.score(lines, Scenario(), tables.LINES_AS_OF)
    return rounded(rollups.region_rollup(scored))


@register("line_kpis")
def line_kpis(spark, sf_dir):
    lines = tables.line_exposures(spark, sf_dir)
    scored = scoring.score(lines, Scenario(), tables.LINES_AS_OF)
    return rounded(rollups.kpis(scored))


# --- cleansing and the quality gate -----------------------------------------

from ..operators import cleanse, quality  # noqa: E402
from ..sources import derived  # noqa: E402


def faulty_suppliers(spark, sf_dir) -> DataFrame:
    return derived.faulty_facts(tables.supplier_facts(spark, sf_dir, keep_key=True), "s_suppkey")


def line_keyed(spark, sf_dir) -> DataFrame:
    lines = tables.line_exposures(spark, sf_dir)
    return lines.withColumn("line_key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


@register("clean_suppliers")
def clean_suppliers(spark, sf_dir):
    dirty = derived.dirty_text(tables.supplier_facts(spark, sf_dir, keep_key=True), "s_suppkey")
    return rounded(cleanse.clean_suppliers(dirty))


@register("clean_lines")
def clean_lines(spark, sf_dir):
    dirty = derived.dirty_text(line_keyed(spark, sf_dir), "line_key")
    return rounded(cleanse.clean_suppliers(dirty))


@register("gate_failures")
def gate_failures(spark, sf_dir):
    return quality.failures(faulty_suppliers(spark, sf_dir).drop("s_suppkey"))


_KEYED_CONTRACT: list = []


def keyed_supplier_contract() -> "quality.Contract":
    """The supplier contract plus the s_suppkey lineage column (the strict
    contract would otherwise reject it as an extra column)."""
    if not _KEYED_CONTRACT:
        base = quality.supplier_contract()
        _KEYED_CONTRACT.append(quality.Contract(
            dtypes={**base.dtypes, "s_suppkey": "bigint"},
            nullable=base.nullable | {"s_suppkey"}, unique=base.unique, checks=base.checks))
    return _KEYED_CONTRACT[0]


@register("gate_clean")
def gate_clean(spark, sf_dir):
    passing, _ = quality.split(faulty_suppliers(spark, sf_dir), keyed_supplier_contract())
    return rounded(passing)


@register("duplicate_ids")
def duplicate_ids(spark, sf_dir):
    return quality.duplicate_keys(faulty_suppliers(spark, sf_dir), "supplier_id")


# --- sanctions, map payloads, escaping --------------------------------------

from ..functions.text import html_escape as _html_escape  # noqa: E402
from ..operators import geo, screening  # noqa: E402


@register("sanctions_screen")
def sanctions_screen(spark, sf_dir):
    facts = tables.supplier_facts(spark, sf_dir)
    return rounded(screening.screen(facts, tables.sanctions_lists(spark, sf_dir)))


@register("sanctions_one_row")
def sanctions_one_row(spark, sf_dir):
    facts = tables.supplier_facts(spark, sf_dir)
    return rounded(screening.screen(facts, tables.sanctions_lists(spark, sf_dir),
                                    one_row_per_supplier=True))


@register("map_points")
def map_points(spark, sf_dir):
    return rounded(geo.map_points(scored_suppliers(spark, sf_dir)))


@register("map_points_lines")
def map_points_lines(spark, sf_dir):
    lines = tables.line_exposures(spark, sf_dir)
    scored = scoring.score(lines, Scenario(), tables.LINES_AS_OF)
    sc = Scenario(scenario_name="Line map", max_map_points=1000)
    return rounded(geo.map_points(scored, sc, tie_keys=("l_orderkey", "l_linenumber")))


@register("map_center")
def map_center(spark, sf_dir):
    return rounded(geo.map_center(geo.map_points(scored_suppliers(spark, sf_dir))))


@register("cluster_payload")
def cluster_payload(spark, sf_dir):
    lines = tables.line_exposures(spark, sf_dir)
    scored = scoring.score(lines, Scenario(), tables.LINES_AS_OF)
    return rounded(geo.cluster_payload(geo.with_popup(scored)))


@register("html_escape")
def html_escape_pages(spark, sf_dir):
    pages = tables.load(spark, sf_dir, "pages")
    return pages.select("page_id", _html_escape("url").alias("url_escaped"),
                        _html_escape("html").alias("html_escaped"))


# --- news, weather, logs ----------------------------------------------------

from ..operators import logs as logops  # noqa: E402
from ..operators import news, weather  # noqa: E402
from ..sources import events as ev  # noqa: E402
from ..sources import feeds  # noqa: E402

NEWS_KEYWORDS = "ouch, Zuver , license,, Strike"
NEWS_SOURCES = ("src1", "src3", "src5", "src7")
ITEM_COLS = ["doc_id", "title", "url", "source", "published", "summary"]


def news_items(spark, sf_dir) -> DataFrame:
    return feeds.items_from_documents(tables.load(spark, sf_dir, "documents"))


def _items_out(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "published" else c
                       for c in ITEM_COLS])


@register("news_filter")
def news_filter(spark, sf_dir):
    return _items_out(news.keyword_filter(news_items(spark, sf_dir), NEWS_KEYWORDS))


@register("latest_news")
def latest_news(spark, sf_dir):
    return _items_out(news.latest_news(news_items(spark, sf_dir), NEWS_SOURCES))


@register("digest_lines")
def digest_lines(spark, sf_dir):
    items = news.keyword_filter(news_items(spark, sf_dir), NEWS_KEYWORDS)
    return news.digest_batches(items)


@register("worst_hour")
def worst_hour(spark, sf_dir):
    obs = ev.weather_observations(tables.load(spark, sf_dir, "events"))
    out = weather.worst_hour(obs, "location_id", "hour", "wind", "precip", "temp", "code",
                             tie="event_id")
    return rounded(out)


@register("shipping_risk")
def shipping_risk(spark, sf_dir):
    from ..functions.weather import shipping_risk as rule
    obs = ev.weather_observations(tables.load(spark, sf_dir, "events"))
    w = F.coalesce(F.col("wind"), F.lit(0.0))
    return rounded(obs.select("location_id", "event_id", w.alias("wind_kmh"),
                              F.col("precip").alias("precip_prob_pct"),
                              rule(w, F.col("precip")).alias("risk_level")))


def raw_logs(spark, sf_dir) -> DataFrame:
    return ev.log_records(tables.load(spark, sf_dir, "events"))


def app_logs(spark, sf_dir) -> DataFrame:
    return logops.normalise_logs(raw_logs(spark, sf_dir))


@register("error_categories")
def error_categories(spark, sf_dir):
    return logops.error_categories(app_logs(spark, sf_dir))


@register("recent_logs")
def recent_logs(spark, sf_dir):
    recent = logops.recent_logs(raw_logs(spark, sf_dir), ordinal="event_id")
    return logops.normalise_logs(logops.format_logs(recent)).select(
        "event_id", "request_id", "supplier_id", "batch_id", "line")


@register("format_logs")
def format_logs(spark, sf_dir):
    return logops.format_logs(raw_logs(spark, sf_dir)).select("event_id", "level", "line")


# --- narratives, prompts, report --------------------------------------------

from .. import constants as C  # noqa: E402
from ..functions.text import fold_text  # noqa: E402
from ..operators import narrative, report  # noqa: E402

# A small budget (a parameter, not a cut) gives the test data many chunks;
# ``chunk_assign_default`` uses the default.
CHUNK_BUDGET = 256
ROW_COLS = ["conv_id", "turn", "role", "text"]


def scored_keyed(spark, sf_dir) -> DataFrame:
    facts = tables.supplier_facts(spark, sf_dir, keep_key=True)
    return scoring.score(facts, Scenario(), tables.AS_OF)


def narratives(spark, sf_dir) -> DataFrame:
    return derived.narratives_from_scored(scored_keyed(spark, sf_dir), "s_suppkey").drop("s_suppkey")


@register("attribute_narratives")
def attribute_narratives(spark, sf_dir):
    return narrative.attribute(narratives(spark, sf_dir), tables.supplier_facts(spark, sf_dir, True),
                               ordinal="ordinal", supplier_ordinal="s_suppkey")


@register("top_narratives")
def top_narratives(spark, sf_dir):
    att = narrative.attribute(narratives(spark, sf_dir), tables.supplier_facts(spark, sf_dir, True),
                              ordinal="ordinal", supplier_ordinal="s_suppkey")
    return narrative.top_narratives(att)


@register("narrative_contract")
def narrative_contract(spark, sf_dir):
    return quality.failures(narratives(spark, sf_dir), narrative.narrative_contract())


@register("narrative_input")
def narrative_input(spark, sf_dir):
    return rounded(narrative.narrative_input(scored_suppliers(spark, sf_dir)))


@register("supplier_picker")
def supplier_picker(spark, sf_dir):
    facts = tables.supplier_facts(spark, sf_dir, keep_key=True)
    out = narrative.labelled(facts.select("s_suppkey", "supplier_id", "supplier_name",
                                          "latitude", "longitude"), ordinal="s_suppkey")
    return rounded(out)


def conversation_tokens(spark, sf_dir) -> DataFrame:
    conv = tables.load(spark, sf_dir, "conversations").select(*ROW_COLS)
    return conv.withColumn("tokens", narrative.row_tokens(conv, ROW_COLS))


@register("token_estimate")
def token_estimate(spark, sf_dir):
    return conversation_tokens(spark, sf_dir).select("conv_id", "turn", "role", "tokens")


def chunked_conversations(spark, sf_dir, budget: int = CHUNK_BUDGET) -> DataFrame:
    return narrative.chunk_rows(conversation_tokens(spark, sf_dir), "conv_id", "turn", "tokens", budget)


@register("chunk_assign_default")
def chunk_assign_default(spark, sf_dir):
    return chunked_conversations(spark, sf_dir, C.MAX_INPUT_TOKENS).select(
        "conv_id", "turn", "tokens", "chunk_id")


@register("chunk_assign")
def chunk_assign(spark, sf_dir):
    return chunked_conversations(spark, sf_dir).select("conv_id", "turn", "tokens", "chunk_id")


@register("chunk_stats")
def chunk_stats(spark, sf_dir):
    batches = narrative.prompt_batches(chunked_conversations(spark, sf_dir), "conv_id", "turn",
                                       "tokens", ROW_COLS)
    return batches.drop("prompt")


@register("prompts")
def prompts(spark, sf_dir):
    return narrative.prompt_batches(chunked_conversations(spark, sf_dir), "conv_id", "turn",
                                    "tokens", ROW_COLS).select(
        "conv_id", "chunk_id", "n_rows", "prompt")


@register("report_kpis")
def report_kpis(spark, sf_dir):
    return report.kpi_table(scored_suppliers(spark, sf_dir))


@register("report_top")
def report_top(spark, sf_dir):
    return rounded(report.top_table(scored_suppliers(spark, sf_dir)))


@register("fold_text")
def fold_text_docs(spark, sf_dir):
    docs = tables.load(spark, sf_dir, "documents")
    return docs.select("doc_id", fold_text("text").alias("text_latin1"))


# --- incremental work and streams -------------------------------------------

import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..streaming import incremental, streams  # noqa: E402


def scratch_dir(spark, tag: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tierwatch-{tag}-{uuid.uuid4().hex[:12]}"


@register("stale_caches")
def stale_caches(spark, sf_dir):
    ev_ = tables.load(spark, sf_dir, "events")
    last = ev_.groupBy("user_id").agg(F.max("ts").alias("last_fetch"))
    now = ev_.agg(F.max("ts")).scalar()      # latest event time, one value
    return last.select("user_id", "last_fetch",
                       incremental.stale(F.col("last_fetch"), now).alias("is_stale"))


@register("pending_work")
def pending_work(spark, sf_dir):
    ev_ = tables.load(spark, sf_dir, "events")
    work = ev_.select("user_id", "event_type").distinct()
    done = ev_.where(F.col("value") > 50).select("user_id", "event_type")
    return incremental.pending(work, done, ["user_id", "event_type"])


@register("new_files")
def new_files(spark, sf_dir):
    # the texts of documents stand for uploaded contents; every 7th is in the ledger already
    docs = tables.load(spark, sf_dir, "documents")
    hashes = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("length"),
                         F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"))
    ledger = hashes.where(F.col("doc_id") % 7 == 0).select("content_sha256")
    return incremental.new_files(hashes, ledger).select("doc_id", "length", "content_sha256")


UPLOADS = 48


@register("stream_suppliers")
def stream_suppliers(spark, sf_dir):
    root = scratch_dir(spark, "uploads")
    src, ckpt = f"{root}/landing", f"{root}/_checkpoint"
    sinks = {k: f"{root}/{k}" for k in ("accepted", "scored", "rejected", "failures")}
    facts = tables.supplier_facts(spark, sf_dir, keep_key=True)
    good, _ = quality.split(facts.drop("s_suppkey"))
    text = lambda df: df.select(*[F.col(c).cast("string") for c in SUPPLIER_OUT])
    # First upload: rows that pass the contract; second: files with faults.
    text(good).write.option("header", True).mode("append").csv(src)
    q = streams.stream_suppliers(spark, src, sinks, ckpt, Scenario(), tables.AS_OF)
    q.awaitTermination()
    # the second comes as one file for each remainder: some with another order
    # of columns, some without the tier; each is judged by itself
    faulty = faulty_suppliers(spark, sf_dir).withColumn("upload", F.col("s_suppkey") % UPLOADS)
    for i, names in enumerate((SUPPLIER_OUT, SUPPLIER_OUT[::-1], [c for c in SUPPLIER_OUT if c != "tier"])):
        part = faulty.where(F.col("upload") % 3 == i).select(*[F.col(c).cast("string") for c in names], "upload")
        part.repartition(UPLOADS, "upload").write.option("header", True).mode("append").partitionBy("upload").csv(src)
    q = streams.stream_suppliers(spark, src, sinks, ckpt, Scenario(), tables.AS_OF)
    q.awaitTermination()
    scored = spark.read.parquet(sinks["scored"])
    return rounded(scored.select(*SUPPLIER_OUT, *scoring.C.COMPONENTS, "composite_risk"))


def _as_feed(items: DataFrame) -> DataFrame:
    """Items as the elements of a feed file."""
    return items.select(
        F.when(F.col("title") != "Untitled", F.col("title")).alias("title"),
        F.lit(None).cast("string").alias("link"),
        F.date_format("published", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"),
        F.lit(None).cast("string").alias("updated"),
        F.col("summary").alias("description"),
        "source")


@register("stream_news")
def stream_news(spark, sf_dir):
    root = scratch_dir(spark, "feeds")
    src, sink, ckpt = f"{root}/landing", f"{root}/items", f"{root}/_checkpoint"
    landed = _as_feed(news_items(spark, sf_dir))
    landed.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(src)
    schema = T.StructType([*streams.RSS_SCHEMA.fields, T.StructField("source", T.StringType())])
    q = streams.stream_news(spark, src, sink, ckpt, keywords=NEWS_KEYWORDS, schema=schema)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("title", "url", "source",
                      F.col("published").cast("timestamp_ntz").alias("published"), "summary")


@register("demo_sample")
def demo_sample(spark, sf_dir):
    lines = tables.line_exposures(spark, sf_dir)
    lines = lines.withColumn("last_audit_date", F.col("last_audit_date").cast("string"))
    return rounded(rollups.sample_rows(lines, 500, ["l_orderkey", "l_linenumber"]))


@register("retryable_errors")
def retryable_errors(spark, sf_dir):
    from ..functions.errors import is_retryable
    logs_ = app_logs(spark, sf_dir).where(F.col("status").isNotNull())
    return (logs_.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("retryable", is_retryable("status")))


# --- sources and rules by their own rows --------------------------------------

from ..functions.text import row_json  # noqa: E402
from ..sources import csv as csv_source  # noqa: E402


@register("suppliers_from_csv")
def suppliers_from_csv(spark, sf_dir):
    """Dirty supplier files landed as CSV, read by header and cleaned."""
    path = scratch_dir(spark, "suppliers-csv")
    dirty = derived.dirty_text(tables.supplier_facts(spark, sf_dir, keep_key=True), "s_suppkey")
    dirty.drop("s_suppkey").write.option("header", True).csv(path)
    return rounded(cleanse.clean_suppliers(csv_source.read_suppliers(spark, path)))


@register("clean_typed")
def clean_typed(spark, sf_dir):
    """Cleansing with a type override, on an input that lacks a column."""
    dirty = derived.dirty_text(tables.supplier_facts(spark, sf_dir, keep_key=True), "s_suppkey").drop("longitude")
    return rounded(cleanse.clean_suppliers(dirty, {"last_audit_date": "date"}))


@register("sanctions_from_csv")
def sanctions_from_csv(spark, sf_dir):
    path = scratch_dir(spark, "sanctions-csv")
    tables.sanctions_lists(spark, sf_dir).write.option("header", True).csv(path)
    return rounded(screening.screen(tables.supplier_facts(spark, sf_dir), csv_source.read_sanctions(spark, path)))


@register("schema_failures")
def schema_failures(spark, sf_dir):
    """A batch without the tier, with one column too many and one of another type."""
    facts = tables.supplier_facts(spark, sf_dir).drop("tier")
    return quality.failures(facts.withColumn("audited_by", F.lit("x")).withColumn(
        "annual_spend_usd", F.col("annual_spend_usd").cast("string")))


@register("gate_written")
def gate_written(spark, sf_dir):
    """The rows that pass the rules, taken through the gate into a table."""
    good, _ = quality.split(tables.supplier_facts(spark, sf_dir))
    return rounded(quality.gate_write(good, scratch_dir(spark, "gated")))


@register("map_points_unscored")
def map_points_unscored(spark, sf_dir):
    """Without a composite the raw risk score is drawn."""
    return rounded(geo.map_points(tables.supplier_facts(spark, sf_dir)))


@register("supplier_rows_json")
def supplier_rows_json(spark, sf_dir):
    """Supplier rows as the prompt shows them, numbers in their shortest form."""
    facts = tables.supplier_facts(spark, sf_dir).select(*SUPPLIER_OUT)
    return facts.select("supplier_id", row_json(facts).alias("row_json"), narrative.row_tokens(facts).alias("tokens"))


@register("worst_hour_payloads")
def worst_hour_payloads(spark, sf_dir):
    """Hourly forecasts as landed JSON documents, one a location."""
    obs = ev.weather_observations(tables.load(spark, sf_dir, "events"))
    hours = F.array_sort(F.collect_list(F.struct("hour", "event_id", "wind", "precip", "temp", "code")))
    by_place = obs.groupBy("location_id").agg(hours.alias("h"))
    hourly = F.struct(F.col("h.temp").alias("temperature_2m"), F.col("h.wind").alias("windspeed_10m"),
                      F.col("h.precip").alias("precipitation_probability"), F.col("h.code").alias("weathercode"))
    payloads = by_place.select("location_id", F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"))
    return rounded(weather.worst_hour_arrays(weather.parse_weather(payloads)))


SWEEP = (Scenario(), Scenario(weighting="financial_heavy"))


@register("scenario_work")
def scenario_work(spark, sf_dir):
    """What a change of scenario leaves to do: suppliers stand for uploads, of
    which every third has been scored under the first scenario."""
    ids = tables.supplier_facts(spark, sf_dir, keep_key=True).select("s_suppkey", "supplier_id")
    work = [ids.select(*incremental.result_keys(F.sha2("supplier_id", 256), sc)) for sc in SWEEP]
    done = ids.where(F.col("s_suppkey") % 3 == 0).select(*incremental.result_keys(F.sha2("supplier_id", 256), SWEEP[0]))
    return incremental.pending(work[0].unionByName(work[1]), done, ["upload_sha256", "scenario_key"])


SESSION_TTL = 12 * 3600


@register("session_stages")
def session_stages(spark, sf_dir):
    """Stages that users' sessions have to do again: purchases stand for
    uploads, signups for scenarios, all other events ask for news.  The events
    land in three parts, and state goes on from one to the next."""
    from ..streaming import sessions
    root = scratch_dir(spark, "sessions")
    e = tables.load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "upload").when(F.col("event_type") == "signup", "scenario").otherwise("news")
    value = (F.when(kind == "upload", F.concat(F.lit("h"), (F.floor("value") % 2).cast("string")))
             .when(kind == "scenario", F.when(F.col("event_id") % 2 == 0, "balanced").otherwise("financial_heavy")))
    landed = e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").cast("bigint").alias("seq"),
                      F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), value.alias("value"))
    day = F.dayofmonth("at")
    for part in (landed.where(day <= 10), landed.where((day > 10) & (day <= 20)), landed.where(day > 20)):
        part.write.mode("append").parquet(f"{root}/landing")
        sessions.stream_sessions(spark, f"{root}/landing", f"{root}/work", f"{root}/_checkpoint", SESSION_TTL).awaitTermination()
    return spark.read.schema(sessions.OUT_SCHEMA).parquet(f"{root}/work")


def _lines_by_upload(spark, sf_dir):
    """Lines as uploads, one a year of shipping; the later years are added to
    the state of the earlier ones."""
    from ..streaming import rollup_state
    root = scratch_dir(spark, "rollups")
    lines = tables.line_exposures(spark, sf_dir).withColumn("upload", F.year("last_audit_date").cast("string"))
    for part in (lines.where("upload <= '1995'"), lines.where("upload > '1995'")):
        rollup_state.add(part, "upload", Scenario(), tables.LINES_AS_OF, root)
    return rollup_state, rollup_state.load(spark, root, Scenario(), tables.LINES_AS_OF)


@register("kpis_by_upload")
def kpis_by_upload(spark, sf_dir):
    state, rollup = _lines_by_upload(spark, sf_dir)
    return rounded(state.kpis(rollup))


@register("regions_by_upload")
def regions_by_upload(spark, sf_dir):
    state, rollup = _lines_by_upload(spark, sf_dir)
    return rounded(state.region_rollup(rollup))


@register("bands_by_upload")
def bands_by_upload(spark, sf_dir):
    state, rollup = _lines_by_upload(spark, sf_dir)
    return state.band_counts(rollup)


# Landed out of order: the newest part comes second, older ones before and after.
def _thirds(df: DataFrame, at: str) -> list[DataFrame]:
    day = F.coalesce(F.dayofmonth(at), F.lit(1))
    return [df.where(part) for part in ((day > 10) & (day <= 20), day > 20, day <= 10)]


@register("stream_recent_logs")
def stream_recent_logs(spark, sf_dir):
    """The buffer of the newest log lines after three landings."""
    from ..streaming import recent
    root = scratch_dir(spark, "log-buffer")
    records = raw_logs(spark, sf_dir)
    for part in _thirds(records, "timestamp"):
        part.write.mode("append").parquet(f"{root}/landing")
        stream = spark.readStream.schema(records.schema).parquet(f"{root}/landing")
        recent.stream_recent_logs(stream, f"{root}/buffer", f"{root}/_checkpoint", ordinal="event_id").awaitTermination()
    newest = recent.read_buffer(spark, f"{root}/buffer", records.schema)
    return logops.normalise_logs(logops.format_logs(newest)).select(
        "event_id", "request_id", "supplier_id", "batch_id", "line")


@register("stream_latest_news")
def stream_latest_news(spark, sf_dir):
    """The buffer of the latest news of some sources after feeds landed in three parts."""
    from ..streaming import recent
    root = scratch_dir(spark, "news-buffer")
    schema = T.StructType([*streams.RSS_SCHEMA.fields, T.StructField("source", T.StringType())])
    for part in _thirds(news_items(spark, sf_dir), "published"):
        _as_feed(part).write.format("xml").option("rowTag", "item").option("rootTag", "channel").mode("append").save(f"{root}/landing")
        items = streams.news_stream_frame(spark, f"{root}/landing", schema=schema)
        recent.stream_latest_news(items, f"{root}/buffer", f"{root}/_checkpoint", NEWS_SOURCES).awaitTermination()
    newest = recent.read_buffer(spark, f"{root}/buffer", items.schema)
    return newest.select("title", "url", "source", F.col("published").cast("timestamp_ntz").alias("published"), "summary")
