"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The oracle sees only the raw tables, so every statement carries the
supplier derivation as CTEs.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from .. import constants as C
from ..sources import tables as TB

ORACLE: dict[str, str] = {}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- derived supplier views -------------------------------------------------

PROFILE_CTE = f"""
sup_geo AS (
  SELECT s.s_suppkey, s.s_name, s.s_nationkey,
    CASE WHEN r.r_name = 'ASIA' THEN 'APAC'
         WHEN r.r_name = 'AMERICA' AND n.n_nationkey % 2 = 0 THEN 'NA'
         WHEN r.r_name = 'AMERICA' THEN 'LATAM'
         ELSE 'EMEA' END AS region
  FROM supplier s
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
supplier_profile AS (
  SELECT s_suppkey,
    printf('SUP-%06d', s_suppkey) AS supplier_id,
    s_name AS supplier_name,
    ((s_suppkey * 37 + s_nationkey * 11) % 128) / 128.0e0 AS risk_score,
    65.0e0 - s_nationkey * 4 - (s_suppkey % 16) / 8.0e0 AS latitude,
    s_nationkey * 12 + (s_suppkey % 64) / 8.0e0 - 140.0e0 AS longitude,
    region,
    CAST((s_suppkey // 7) % 4 + 1 AS BIGINT) AS tier,
    CASE WHEN s_suppkey % 10 = 0 THEN NULL
         ELSE strftime(DATE '{TB.AUDIT_EPOCH}' + CAST((s_suppkey * 37) % {TB.AUDIT_SPAN_DAYS} AS INTEGER), '%Y-%m-%d')
    END AS last_audit_date
  FROM sup_geo
)"""

FACTS_CTE = PROFILE_CTE + """,
supplier_spend AS (
  SELECT l_suppkey,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(1.0e0 - l_discount AS DECIMAL(15,2))) AS DECIMAL(28,4)) AS spend_dec
  FROM lineitem GROUP BY l_suppkey
),
supplier_facts AS (
  SELECT p.supplier_id, p.supplier_name, p.risk_score, p.latitude, p.longitude, p.region, p.tier,
    CAST(ROUND(COALESCE(sp.spend_dec, CAST(0 AS DECIMAL(28,4)))
               * CAST(power(10.0e0, -(p.s_suppkey % 6)) AS DECIMAL(6,5)), 2) AS DOUBLE) AS annual_spend_usd,
    p.last_audit_date
  FROM supplier_profile p LEFT JOIN supplier_spend sp ON p.s_suppkey = sp.l_suppkey
)"""

LINES_CTE = PROFILE_CTE + """,
line_exposures AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
    l.l_extendedprice * (1.0e0 - l.l_discount) AS annual_spend_usd,
    strftime(l.l_shipdate, '%Y-%m-%d') AS last_audit_date,
    p.supplier_id, p.supplier_name, p.risk_score, p.latitude, p.longitude, p.region, p.tier
  FROM lineitem l LEFT JOIN supplier_profile p ON l.l_suppkey = p.s_suppkey
)"""


def _fill(col: str) -> str:
    return f"COALESCE(CASE WHEN isnan({col}) THEN 0.0e0 ELSE {col} END, 0.0e0)"


def components_cte(src: str, as_of: str, name: str = "comp") -> str:
    """Five components over CTE ``src``; the spend max covers all of src."""
    geo = " ".join(f"WHEN region = '{k}' THEN {v}e0" for k, v in C.GEO_RISK.items())
    ls = f"ln(1.0e0 + {_fill('CAST(annual_spend_usd AS DOUBLE)')})"
    return f"""
{name}_mx AS (SELECT max({ls}) AS mx FROM {src}),
{name} AS (
  SELECT s.*,
    {_fill('CAST(risk_score AS DOUBLE)')} AS component_base,
    CASE WHEN m.mx IS NULL OR m.mx = 0 OR isnan({ls} / m.mx) THEN 0.0e0 ELSE {ls} / m.mx END
      AS component_financial,
    1.0e0 - (COALESCE(CAST(tier AS DOUBLE), {C.NULL_TIER}e0) - 1.0e0) / 3.0e0 AS component_operational,
    CASE {geo} ELSE {C.GEO_RISK_DEFAULT}e0 END AS component_geopolitical,
    CASE WHEN TRY_CAST(last_audit_date AS DATE) IS NULL THEN 1.0e0
         ELSE LEAST(GREATEST(date_diff('day', TRY_CAST(last_audit_date AS DATE), DATE '{as_of}')
                             / {C.STALENESS_DAYS}e0, 0.0e0), 1.0e0) END AS component_audit_staleness
  FROM {src} s CROSS JOIN {name}_mx m
)"""


def _w(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def composite_expr(weights) -> str:
    terms = " + ".join(f"{_w(w)} * {c}" for w, c in zip(weights, C.COMPONENTS))
    return f"GREATEST(0.0e0, LEAST(1.0e0, 0.0e0 + {terms}))"


def scored_cte(weighting="balanced", lo=0.0, hi=1.0, regions=C.REGIONS, apply_filters=True,
               src="supplier_facts", as_of=TB.AS_OF, base_cte=FACTS_CTE) -> str:
    """CTE list ending in ``scored``."""
    where = []
    if apply_filters:
        where.append(f"composite_risk BETWEEN {_w(lo)} AND {_w(hi)}")
    if regions:
        where.append("region IN (" + ", ".join(f"'{r}'" for r in regions) + ")")
    cond = ("WHERE " + " AND ".join(where)) if where else ""
    return (base_cte + "," + components_cte(src, as_of) + f""",
scored_all AS (SELECT *, {composite_expr(C.WEIGHTS[weighting])} AS composite_risk FROM comp),
scored AS (SELECT * FROM scored_all {cond})""")


R6 = lambda c: f"round({c}, 6) AS {c}"

SUPPLIER_SELECT = ", ".join(
    ["supplier_id", "supplier_name", R6("risk_score"), R6("latitude"), R6("longitude"),
     "region", "tier", R6("annual_spend_usd"), "last_audit_date"]
    + [R6(c) for c in C.COMPONENTS] + [R6("composite_risk")])


def _score_sql(weighting, **kw):
    return f"WITH {scored_cte(weighting, **kw)}\nSELECT {SUPPLIER_SELECT} FROM scored"


ORACLE["score_balanced"] = _score_sql("balanced")
ORACLE["score_financial"] = _score_sql("financial_heavy")
ORACLE["score_operational"] = _score_sql("operational_heavy")
ORACLE["score_geopolitical"] = _score_sql("geopolitical_heavy")
ORACLE["score_filtered"] = _score_sql("balanced", lo=0.4, hi=0.8, regions=("EMEA", "APAC"))
ORACLE["score_region_only"] = _score_sql("balanced", lo=0.5, hi=0.6, regions=("NA", "LATAM"),
                                         apply_filters=False)

LINES_SCORED = scored_cte(src="line_exposures", as_of=TB.LINES_AS_OF, base_cte=LINES_CTE)

ORACLE["score_lines"] = f"""WITH {LINES_SCORED}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, supplier_id, region, tier,
  {R6('annual_spend_usd')}, last_audit_date, {', '.join(R6(c) for c in C.COMPONENTS)},
  {R6('composite_risk')}
FROM scored"""

_SWEEP_ROWS = " UNION ALL ".join(
    f"SELECT '{n}' AS weighting, " + ", ".join(f"{_w(x)} AS w{i}" for i, x in enumerate(ws))
    for n, ws in C.WEIGHTS.items())

ORACLE["weight_sweep_rank"] = f"""WITH {FACTS_CTE}, {components_cte('supplier_facts', TB.AS_OF)},
presets AS ({_SWEEP_ROWS}),
swept AS (
  SELECT p.weighting, c.supplier_id,
    GREATEST(0.0e0, LEAST(1.0e0, 0.0e0 + {' + '.join(f'p.w{i} * c.{n}' for i, n in enumerate(C.COMPONENTS))})) AS composite_risk
  FROM comp c CROSS JOIN presets p
)
SELECT weighting, supplier_id, round(composite_risk, 6) AS composite_risk,
  CAST(row_number() OVER (PARTITION BY weighting ORDER BY composite_risk DESC, supplier_id ASC NULLS LAST) AS BIGINT) AS scenario_rank
FROM swept"""

BAL = scored_cte("balanced")


def band_sql(col: str) -> str:
    parts = " ".join(f"WHEN {col} >= {lo}e0 THEN '{name}'" for name, lo in C.BANDS)
    return f"CASE {parts} ELSE 'LOW' END"


ORACLE["kpis"] = f"""WITH {BAL}
SELECT CAST(count(*) AS BIGINT) AS total_suppliers,
  round(COALESCE(avg(composite_risk), 0.0e0), 6) AS avg_risk,
  CAST(count(*) FILTER (WHERE composite_risk >= 0.7e0) AS BIGINT) AS high_risk_count,
  CAST(count(*) FILTER (WHERE composite_risk >= 0.85e0) AS BIGINT) AS critical_count
FROM scored"""

ORACLE["region_rollup"] = f"""WITH {BAL}
SELECT region, round(avg(composite_risk), 6) AS avg_risk,
  CAST(count(supplier_id) AS BIGINT) AS supplier_count, {band_sql('avg(composite_risk)')} AS band
FROM scored GROUP BY region"""

_BAND_ORDER = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(C.BAND_ORDER))
ORACLE["band_counts"] = f"""WITH {BAL},
bands AS (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS band),
counts AS (SELECT {band_sql('composite_risk')} AS band, count(*) AS n FROM scored GROUP BY 1)
SELECT b.band, CAST(COALESCE(c.n, 0) AS BIGINT) AS n,
  CASE b.band {_BAND_ORDER} END AS band_order
FROM bands b LEFT JOIN counts c ON b.band = c.band"""

ORACLE["top_risks"] = f"""WITH {BAL}
SELECT supplier_id, supplier_name, round(composite_risk, 6) AS composite_risk, region,
  {band_sql('composite_risk')} AS band
FROM scored ORDER BY composite_risk DESC, supplier_id ASC NULLS LAST LIMIT 10"""

ORACLE["ledger"] = f"""WITH {BAL}
SELECT supplier_id, supplier_name, region, tier, round(composite_risk, 6) AS composite_risk,
  round(annual_spend_usd, 6) AS annual_spend_usd
FROM scored"""

ORACLE["risk_matrix"] = f"""WITH {BAL}
SELECT supplier_id, supplier_name, region, tier, round(annual_spend_usd, 6) AS annual_spend_usd,
  round(composite_risk, 6) AS composite_risk,
  round(CASE WHEN annual_spend_usd > 0 THEN log10(annual_spend_usd) END, 6) AS log_spend
FROM scored"""

ORACLE["line_region_rollup"] = f"""WITH {LINES_SCORED}
SELECT region, round(avg(composite_risk), 6) AS avg_risk,
  CAST(count(supplier_id) AS BIGINT) AS supplier_count, {band_sql('avg(composite_risk)')} AS band
FROM scored GROUP BY region"""

ORACLE["line_kpis"] = f"""WITH {LINES_SCORED}
SELECT CAST(count(*) AS BIGINT) AS total_suppliers,
  round(COALESCE(avg(composite_risk), 0.0e0), 6) AS avg_risk,
  CAST(count(*) FILTER (WHERE composite_risk >= 0.7e0) AS BIGINT) AS high_risk_count,
  CAST(count(*) FILTER (WHERE composite_risk >= 0.85e0) AS BIGINT) AS critical_count
FROM scored"""

# --- cleansing and the quality gate -----------------------------------------

FACTS_KEYED_CTE = FACTS_CTE.replace(
    "SELECT p.supplier_id, p.supplier_name,", "SELECT p.s_suppkey, p.supplier_id, p.supplier_name,")

LINES_KEYED_CTE = LINES_CTE + """,
line_keyed AS (SELECT l_orderkey * 8 + l_linenumber AS line_key, * FROM line_exposures)"""


def dirty_sql(src: str, key: str) -> str:
    k = key
    s = lambda c: f"CAST({c} AS VARCHAR)"
    return f"""SELECT {k},
  CASE WHEN {k} % 5 = 0 THEN '  ' || {s('supplier_id')} || ' '
       WHEN {k} % 5 = 1 THEN substr({s('supplier_id')}, 1, 4) || ' ' || substr({s('supplier_id')}, 5)
       WHEN {k} % 5 = 2 THEN chr(160) || {s('supplier_id')}
       ELSE {s('supplier_id')} END AS supplier_id,
  CASE WHEN {k} % 9 = 0 THEN 'N/A'
       WHEN {k} % 4 = 0 THEN ' ' || {s('supplier_name')} || chr(8195)
       WHEN {k} % 4 = 2 THEN 'N U L L'
       ELSE {s('supplier_name')} END AS supplier_name,
  CASE WHEN {k} % 6 = 0 THEN ' ' || {s('risk_score')} || ' '
       WHEN {k} % 6 = 1 THEN substr({s('risk_score')}, 1, 1) || ' ' || substr({s('risk_score')}, 2)
       WHEN {k} % 6 = 2 THEN {s('risk_score')} || 'd'
       WHEN {k} % 6 = 3 THEN 'N/A'
       ELSE {s('risk_score')} END AS risk_score,
  CASE WHEN {k} % 7 = 0 THEN {s('latitude')} || 'e0'
       WHEN {k} % 7 = 1 THEN ''
       ELSE {s('latitude')} END AS latitude,
  CASE WHEN {k} % 8 = 0 THEN '+' || {s('longitude')} ELSE {s('longitude')} END AS longitude,
  CASE WHEN {k} % 10 = 1 THEN substr({s('region')}, 1, 2) || ' ' || substr({s('region')}, 3)
       WHEN {k} % 10 = 2 THEN 'N U L L'
       WHEN {k} % 10 = 3 THEN 'NULL'
       WHEN {k} % 3 = 0 THEN '  ' || {s('region')} || chr(9)
       ELSE {s('region')} END AS region,
  CASE WHEN {k} % 5 = 3 THEN {s('tier')} || '.0'
       WHEN {k} % 5 = 4 THEN ' ' || {s('tier')}
       ELSE {s('tier')} END AS tier,
  CASE WHEN {k} % 4 = 3 THEN substr({s('annual_spend_usd')}, 1, 1) || ' ' || substr({s('annual_spend_usd')}, 2)
       ELSE {s('annual_spend_usd')} END AS annual_spend_usd,
  CASE WHEN {k} % 11 = 0 THEN 'null'
       WHEN {k} % 3 = 1 THEN ' ' || {s('last_audit_date')} || ' '
       WHEN {k} % 3 = 2 THEN replace({s('last_audit_date')}, '-', ' - ')
       ELSE {s('last_audit_date')} END AS last_audit_date
FROM {src}"""


# Unicode White_Space, spelled out for RE2 (whose \\s is ASCII-only).
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NULLS = "('NULL', 'null', 'N/A', ' ', '')"
_DEC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INT = r"^[+-]?[0-9]+$"


def _clean_str(c: str, despace: bool) -> str:
    t = f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
    t = f"CASE WHEN {t} IN {_NULLS} THEN NULL ELSE {t} END"
    if despace:
        t = f"regexp_replace({t}, '{_WS}+', '', 'g')"
    return f"{t} AS {c}"


def _clean_num(c: str, typ: str, pattern: str) -> str:
    t = f"regexp_replace({c}, '{_WS}+', '', 'g')"
    return f"CASE WHEN regexp_matches({t}, '{pattern}') THEN TRY_CAST({t} AS {typ}) END AS {c}"


def clean_sql(src: str, key: str) -> str:
    return f"""SELECT {key}, {_clean_str('supplier_id', True)}, {_clean_str('supplier_name', False)},
  {_clean_num('risk_score', 'DOUBLE', _DEC)}, {_clean_num('latitude', 'DOUBLE', _DEC)},
  {_clean_num('longitude', 'DOUBLE', _DEC)}, {_clean_str('region', True)},
  {_clean_num('tier', 'BIGINT', _INT)}, {_clean_num('annual_spend_usd', 'DOUBLE', _DEC)},
  {_clean_str('last_audit_date', True)}
FROM {src}"""


_CLEAN_OUT = ", ".join([
    "{k}", "supplier_id", "supplier_name", R6("risk_score"), R6("latitude"), R6("longitude"),
    "region", "tier", R6("annual_spend_usd"), "last_audit_date"])

ORACLE["clean_suppliers"] = f"""WITH {FACTS_KEYED_CTE},
dirty AS ({dirty_sql('supplier_facts', 's_suppkey')}),
cleaned AS ({clean_sql('dirty', 's_suppkey')})
SELECT {_CLEAN_OUT.format(k='s_suppkey')} FROM cleaned"""

ORACLE["clean_lines"] = f"""WITH {LINES_KEYED_CTE},
dirty AS ({dirty_sql('line_keyed', 'line_key')}),
cleaned AS ({clean_sql('dirty', 'line_key')})
SELECT {_CLEAN_OUT.format(k='line_key')} FROM cleaned"""

FAULTY_CTE = FACTS_KEYED_CTE + """,
faulty AS (
  SELECT s_suppkey,
    CASE WHEN s_suppkey % 19 = 7 THEN printf('SUP-%06d', s_suppkey - 1) ELSE supplier_id END AS supplier_id,
    CASE WHEN s_suppkey % 29 = 3 THEN '' ELSE supplier_name END AS supplier_name,
    CASE WHEN s_suppkey % 17 = 5 THEN risk_score + 1.5e0
         WHEN s_suppkey % 23 = 11 THEN CAST(NULL AS DOUBLE) ELSE risk_score END AS risk_score,
    CASE WHEN s_suppkey % 31 = 2 THEN latitude + 200.0e0 ELSE latitude END AS latitude,
    CASE WHEN s_suppkey % 37 = 9 THEN CAST('NaN' AS DOUBLE) ELSE longitude END AS longitude,
    CASE WHEN s_suppkey % 13 = 4 THEN 'MARS'
         WHEN s_suppkey % 41 = 6 THEN CAST(NULL AS VARCHAR) ELSE region END AS region,
    CASE WHEN s_suppkey % 11 = 10 THEN CAST(5 AS BIGINT) ELSE tier END AS tier,
    CASE WHEN s_suppkey % 43 = 12 THEN -CAST(s_suppkey % 1000 AS DOUBLE) - 0.5e0 ELSE annual_spend_usd END AS annual_spend_usd,
    CASE WHEN s_suppkey % 7 = 3 THEN replace(last_audit_date, '-', '/')
         WHEN s_suppkey % 47 = 20 THEN '2025-02-30' ELSE last_audit_date END AS last_audit_date
  FROM supplier_facts
)"""


def _miss(c: str, dbl: bool) -> str:
    return f"({c} IS NULL OR isnan({c}))" if dbl else f"({c} IS NULL)"


# (column, check, failing condition given presence, reported value, needed (col, is_double))
_CHECKS = [
    ("supplier_id", "str_length(3, 20)", "NOT (length(supplier_id) BETWEEN 3 AND 20)", "supplier_id", [("supplier_id", False)]),
    ("supplier_name", "str_length(1, 200)", "NOT (length(supplier_name) BETWEEN 1 AND 200)", "supplier_name", [("supplier_name", False)]),
    ("risk_score", "in_range(0.0, 1.0)", "NOT (risk_score BETWEEN 0.0e0 AND 1.0e0)", "risk_score", [("risk_score", True)]),
    ("latitude", "in_range(-90.0, 90.0)", "NOT (latitude BETWEEN -90.0e0 AND 90.0e0)", "latitude", [("latitude", True)]),
    ("longitude", "in_range(-180.0, 180.0)", "NOT (longitude BETWEEN -180.0e0 AND 180.0e0)", "longitude", [("longitude", True)]),
    ("region", "isin(EMEA, APAC, NA, LATAM)", "region NOT IN ('EMEA', 'APAC', 'NA', 'LATAM')", "region", [("region", False)]),
    ("tier", "in_range(1, 4)", "NOT (tier BETWEEN 1 AND 4)", "tier", [("tier", False)]),
    ("annual_spend_usd", "greater_than_or_equal_to(0.0)", "NOT (annual_spend_usd >= 0.0e0)", "annual_spend_usd", [("annual_spend_usd", True)]),
    ("last_audit_date", "str_matches(^\\d{4}-\\d{2}-\\d{2}$)", "NOT regexp_full_match(last_audit_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}')", "last_audit_date", [("last_audit_date", False)]),
    ("annual_spend_usd", "spend_matches_tier_floor", "NOT (tier <> 1 OR annual_spend_usd >= 10000.0e0)", "annual_spend_usd", [("tier", False), ("annual_spend_usd", True)]),
]
_NOT_NULL = [("supplier_id", False), ("supplier_name", False), ("risk_score", True), ("latitude", True),
             ("longitude", True), ("region", False), ("tier", False), ("annual_spend_usd", True)]


def _fail_parts(src: str) -> list[str]:
    parts = []
    for c, dbl in _NOT_NULL:
        parts.append(f"SELECT supplier_id, '{c}' AS \"column\", 'not_nullable' AS \"check\", "
                     f"CAST(NULL AS VARCHAR) AS failure_case FROM {src} WHERE {_miss(c, dbl)}")
    for col, chk, bad, val, needs in _CHECKS:
        present = " AND ".join(f"NOT {_miss(c, d)}" for c, d in needs)
        chk_sql = chk.replace("'", "''")
        parts.append(f"SELECT supplier_id, '{col}' AS \"column\", '{chk_sql}' AS \"check\", "
                     f"CAST({val} AS VARCHAR) AS failure_case FROM {src} WHERE {present} AND ({bad})")
    return parts


def _row_bad(src_alias: str = "") -> str:
    conds = [_miss(c, d) for c, d in _NOT_NULL]
    for col, chk, bad, val, needs in _CHECKS:
        present = " AND ".join(f"NOT {_miss(c, d)}" for c, d in needs)
        conds.append(f"({present} AND ({bad}))")
    return " OR ".join(f"COALESCE({c}, false)" for c in conds)


ORACLE["gate_failures"] = f"""WITH {FAULTY_CTE},
dups AS (SELECT supplier_id FROM faulty WHERE supplier_id IS NOT NULL GROUP BY supplier_id HAVING count(*) > 1)
{' UNION ALL '.join(_fail_parts('faulty'))}
UNION ALL SELECT supplier_id, 'supplier_id' AS "column", 'unique' AS "check", supplier_id AS failure_case
FROM faulty WHERE supplier_id IN (SELECT supplier_id FROM dups)"""

ORACLE["gate_clean"] = f"""WITH {FAULTY_CTE},
dups AS (SELECT supplier_id FROM faulty WHERE supplier_id IS NOT NULL GROUP BY supplier_id HAVING count(*) > 1)
SELECT s_suppkey, supplier_id, supplier_name, {R6('risk_score')}, {R6('latitude')}, {R6('longitude')},
  region, tier, {R6('annual_spend_usd')}, last_audit_date
FROM faulty
WHERE NOT ({_row_bad()}) AND (supplier_id IS NULL OR supplier_id NOT IN (SELECT supplier_id FROM dups))"""

ORACLE["duplicate_ids"] = f"""WITH {FAULTY_CTE}
SELECT supplier_id, CAST(count(*) AS BIGINT) AS n FROM faulty
WHERE supplier_id IS NOT NULL GROUP BY supplier_id HAVING count(*) > 1"""

# --- sanctions, map payloads, escaping --------------------------------------

SANCTIONS_CTE = """
sanctions AS (
  SELECT printf('SUP-%06d', s_suppkey) AS entity_id, s_name AS entity_name, 'OFAC' AS list_source
  FROM supplier WHERE s_suppkey % 5 = 0
  UNION ALL
  SELECT printf('SUP-%06d', s_suppkey), s_name, 'EU' FROM supplier WHERE s_suppkey % 15 = 0
  UNION ALL
  SELECT printf('SUP-%06d', s_suppkey), s_name, CAST(NULL AS VARCHAR) FROM supplier WHERE s_suppkey % 35 = 0
)"""

_FACT_COLS = ("supplier_id, supplier_name, round(risk_score, 6) AS risk_score, round(latitude, 6) AS latitude, "
              "round(longitude, 6) AS longitude, region, tier, round(annual_spend_usd, 6) AS annual_spend_usd, "
              "last_audit_date")

ORACLE["sanctions_screen"] = f"""WITH {FACTS_CTE}, {SANCTIONS_CTE}
SELECT {_FACT_COLS}, x.entity_id IS NOT NULL AS is_sanctioned,
  COALESCE(x.list_source, 'NONE') AS sanctions_list_source
FROM supplier_facts s LEFT JOIN sanctions x ON s.supplier_id = x.entity_id"""

ORACLE["sanctions_one_row"] = f"""WITH {FACTS_CTE}, {SANCTIONS_CTE},
folded AS (
  SELECT entity_id, nullif(array_to_string(list_sort(list_distinct(list(list_source) FILTER (WHERE list_source IS NOT NULL))), ','), '') AS list_source
  FROM sanctions GROUP BY entity_id
)
SELECT {_FACT_COLS}, x.entity_id IS NOT NULL AS is_sanctioned,
  COALESCE(x.list_source, 'NONE') AS sanctions_list_source
FROM supplier_facts s LEFT JOIN folded x ON s.supplier_id = x.entity_id"""


def esc_sql(c: str) -> str:
    out = c
    for raw, rep in C.HTML_ESCAPES:
        out = f"replace({out}, '{raw.replace(chr(39), chr(39) * 2)}', '{rep}')"
    return out


def _rgb_sql(r: str) -> str:
    def arr(name):
        x, y, z = C.RISK_RGB[name]
        return f"[{x}, {y}, {z}, {C.RGB_ALPHA}]"
    parts = " ".join(f"WHEN {r} >= {lo}e0 THEN {arr(name)}" for name, lo in C.BANDS)
    return f"CASE {parts} ELSE {arr('LOW')} END"


def map_select(src: str, extra: str = "") -> str:
    r = "COALESCE(CASE WHEN isnan(composite_risk) THEN 0.0e0 ELSE composite_risk END, 0.0e0)"
    return f"""SELECT {extra}
  {esc_sql("COALESCE(CAST(supplier_id AS VARCHAR), 'ENTITY')")} AS supplier_id,
  {esc_sql("COALESCE(CAST(supplier_name AS VARCHAR), 'Unknown Entity')")} AS supplier_name,
  {esc_sql("COALESCE(CAST(region AS VARCHAR), '-')")} AS region,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  CAST(round_even({r}, 3) AS VARCHAR) AS risk_display,
  {_rgb_sql('composite_risk')} AS risk_rgb,
  round({C.RADIUS_BASE}e0 + {r} * {C.RADIUS_SCALE}e0, 6) AS risk_radius
FROM {src}"""


ORACLE["map_points"] = f"""WITH {BAL},
capped AS (SELECT * FROM scored ORDER BY composite_risk DESC NULLS LAST, supplier_id ASC NULLS LAST LIMIT 50000)
{map_select('capped')}"""

ORACLE["map_points_lines"] = f"""WITH {LINES_SCORED},
capped AS (SELECT * FROM scored ORDER BY composite_risk DESC NULLS LAST, l_orderkey ASC NULLS LAST,
           l_linenumber ASC NULLS LAST LIMIT 1000)
{map_select('capped', 'l_orderkey, l_linenumber,')}"""

ORACLE["map_center"] = f"""WITH {BAL},
capped AS (SELECT * FROM scored ORDER BY composite_risk DESC NULLS LAST, supplier_id ASC NULLS LAST LIMIT 50000)
SELECT round(COALESCE(avg(latitude), 0.0e0), 6) AS center_latitude,
  round(COALESCE(avg(longitude), 0.0e0), 6) AS center_longitude FROM capped"""

ORACLE["cluster_payload"] = f"""WITH {LINES_SCORED}
SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  {esc_sql("COALESCE(CAST(supplier_name AS VARCHAR), 'Unknown Entity')")} || ' (' ||
  CAST(round_even(COALESCE(CASE WHEN isnan(composite_risk) THEN 0.0e0 ELSE composite_risk END, 0.0e0), 3) AS VARCHAR) || ')' AS popup_text
FROM scored"""

ORACLE["html_escape"] = f"""SELECT page_id, {esc_sql('url')} AS url_escaped, {esc_sql('html')} AS html_escaped FROM pages"""

# --- news, weather, logs ----------------------------------------------------

from ..sources import events as EV  # noqa: E402

_FEED_URL = "CASE source " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in C.FEED_SOURCES.items()) + " ELSE source END"

ITEMS_CTE = f"""
items AS (
  SELECT doc_id,
    COALESCE(NULLIF(split_part(text, chr(10), 1), ''), '{C.UNTITLED}') AS title,
    {_FEED_URL} AS url,
    source,
    CASE WHEN doc_id % 50 <> 7 THEN TIMESTAMP '1970-01-01 00:00:00' + to_seconds(doc_id * 3600)
         ELSE TIMESTAMP '1970-01-01 00:00:00' END AS published,
    NULLIF(text, '') AS summary
  FROM documents
)"""

_KW = ["ouch", "zuver", "license", "strike"]
_KW_COND = " OR ".join(
    f"contains(lower(title || ' ' || COALESCE(summary, '')), '{k}')" for k in _KW)
_ITEM_COLS = "doc_id, title, url, source, published, summary"

ORACLE["news_filter"] = f"WITH {ITEMS_CTE}\nSELECT {_ITEM_COLS} FROM items WHERE {_KW_COND}"

ORACLE["latest_news"] = f"""WITH {ITEMS_CTE}
SELECT {_ITEM_COLS} FROM items WHERE source IN ('src1', 'src3', 'src5', 'src7')
ORDER BY published DESC, url, title LIMIT 25"""

ORACLE["digest_lines"] = f"""WITH RECURSIVE {ITEMS_CTE},
listed AS (
  SELECT row_number() OVER (ORDER BY published DESC, url, title, doc_id) AS rn,
    '- [' || source || '] ' || title || ' (' || strftime(published, '%Y-%m-%dT%H:%M:%S')
    || '+00:00): ' || COALESCE(summary, '') AS line
  FROM items WHERE {_KW_COND}
),
sized AS (SELECT rn, line, length(line) // 4 AS tok FROM listed),
r AS (
  SELECT rn, line, tok AS cur, CAST(0 AS BIGINT) AS batch FROM sized WHERE rn = 1
  UNION ALL
  SELECT s.rn, s.line, CASE WHEN r.cur + s.tok > {C.MAX_INPUT_TOKENS} THEN s.tok ELSE r.cur + s.tok END,
    CASE WHEN r.cur + s.tok > {C.MAX_INPUT_TOKENS} THEN r.batch + 1 ELSE r.batch END
  FROM r JOIN sized s ON s.rn = r.rn + 1
)
SELECT batch, CAST(count(*) AS BIGINT) AS n_items, string_agg(line, chr(10) ORDER BY rn) AS digest,
  {_sql_text(C.DIGEST_PROMPT_HEAD)} || string_agg(line, chr(10) ORDER BY rn) || chr(10) AS prompt
FROM r GROUP BY batch"""

_CODE = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in EV.EVENT_WEATHER_CODE.items()) + " END"
_CONDITIONS = ", ".join(f"({k}, '{v}')" for k, v in sorted(C.WEATHER_CONDITIONS.items()))


def risk_sql(w: str, p: str) -> str:
    parts = " ".join(f"WHEN {w} >= {a}e0 OR {p} >= {b}e0 THEN '{lvl}'" for lvl, a, b in C.SHIPPING_RISK)
    return f"CASE {parts} ELSE '{C.SHIPPING_RISK_DEFAULT}' END"


OBS_CTE = f"""
obs AS (
  SELECT user_id AS location_id, event_id, ts AS hour,
    CASE WHEN event_id % 97 <> 0 THEN value END AS wind,
    CAST((event_id * 37) % 101 AS DOUBLE) AS precip,
    CAST(((event_id * 13) % 60) - 10 AS DOUBLE) AS temp,
    CAST({_CODE} AS INTEGER) AS code
  FROM events
)"""

ORACLE["worst_hour"] = f"""WITH {OBS_CTE},
conditions(code, condition) AS (VALUES {_CONDITIONS}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY location_id
    ORDER BY COALESCE(wind, 0.0e0) DESC, hour ASC, event_id ASC) AS rn
  FROM obs
),
best AS (
  SELECT location_id, hour, COALESCE(temp, 20.0e0) AS temperature_c, COALESCE(wind, 0.0e0) AS wind_kmh,
    COALESCE(precip, 0.0e0) AS precip_prob_pct, COALESCE(code, 0) AS weather_code
  FROM ranked WHERE rn = 1
)
SELECT b.location_id, b.hour, round(b.temperature_c, 6) AS temperature_c, round(b.wind_kmh, 6) AS wind_kmh,
  round(b.precip_prob_pct, 6) AS precip_prob_pct, b.weather_code,
  COALESCE(c.condition, '{C.CONDITION_UNKNOWN}') AS condition, {risk_sql('b.wind_kmh', 'b.precip_prob_pct')} AS risk_level
FROM best b LEFT JOIN conditions c ON b.weather_code = c.code"""

ORACLE["shipping_risk"] = f"""WITH {OBS_CTE}
SELECT location_id, event_id, round(COALESCE(wind, 0.0e0), 6) AS wind_kmh, round(precip, 6) AS precip_prob_pct,
  {risk_sql('COALESCE(wind, 0.0e0)', 'precip')} AS risk_level
FROM obs"""

_STATUS = "[" + ", ".join(str(s) for s in EV.ERROR_STATUS) + "]"
_MSGS = "[" + ", ".join(f"'{m}'" for m in EV.ERROR_MESSAGES) + "]"
_LEVEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EV.EVENT_LEVEL.items()) + " ELSE 'INFO' END"

LOGS_CTE = f"""
logs AS (
  SELECT event_id, ts AS "timestamp", {_LEVEL} AS level,
    CASE WHEN event_type = 'error' THEN {_MSGS}[event_id % {len(EV.ERROR_MESSAGES)} + 1]
         ELSE event_type || ' event ' || props END AS message,
    CASE WHEN event_type = 'error' THEN {_STATUS}[event_id % {len(EV.ERROR_STATUS)} + 1] END AS status,
    CAST(event_id AS VARCHAR) AS request_id,
    printf('SUP-%06d', user_id) AS supplier_id,
    CASE WHEN event_id % 3 = 0 THEN 'B' || CAST(event_id // 100 AS VARCHAR) END AS batch_id,
    'event_type=' || event_type || ' k=' || COALESCE(CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR), 'None') AS rest_text
  FROM events
),
raw AS (
  SELECT *, 'request_id=' || request_id || ' supplier_id=' || COALESCE(supplier_id, 'None')
    || ' batch_id=' || COALESCE(batch_id, 'None') || ' ' || rest_text AS extra_text
  FROM logs
),
lines AS (
  SELECT *, strftime("timestamp", '%H:%M:%S') || ' | ' ||
    CASE WHEN length(level) < {C.LOG_LEVEL_WIDTH} THEN rpad(level, {C.LOG_LEVEL_WIDTH}, ' ') ELSE level END
    || ' | ' || message || ' | ' || extra_text AS line
  FROM raw WHERE level <> 'DEBUG'
)"""


def classify_sql(status: str, message: str) -> str:
    m = f"lower(COALESCE({message}, ''))"
    parts = []
    for cat, codes in C.STATUS_CATEGORIES:
        parts.append(f"WHEN {status} IN ({', '.join(str(c) for c in codes)}) THEN '{cat}'")
    for cat, words in C.MESSAGE_CATEGORIES:
        cond = " OR ".join(f"contains({m}, '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{cat}'")
    return "CASE " + " ".join(parts) + f" ELSE '{C.CAT_FALLBACK}' END"


ORACLE["error_categories"] = f"""WITH {LOGS_CTE}
SELECT {classify_sql('status', 'message')} AS category, CAST(count(*) AS BIGINT) AS n FROM logs GROUP BY 1"""

ORACLE["recent_logs"] = f"""WITH {LOGS_CTE}
SELECT event_id, request_id, supplier_id, batch_id, line FROM lines
ORDER BY "timestamp" DESC, event_id DESC LIMIT 1000"""

ORACLE["format_logs"] = f"""WITH {LOGS_CTE}
SELECT event_id, level, line FROM lines"""

# --- narratives, prompts, report --------------------------------------------

from ..sources import derived as DV  # noqa: E402

SCORED_KEYED = scored_cte("balanced", base_cte=FACTS_KEYED_CTE)
_RISK_LIST = "[" + ", ".join(
    f"{{'n': '{n}', 'v': round(component_{n}, 6)}}" for n in DV.RISK_NAMES) + "]"

NARR_CTE = SCORED_KEYED + f""",
narr_base AS (
  SELECT s_suppkey,
    CASE WHEN s_suppkey % 7 = 0 THEN CAST(NULL AS VARCHAR)
         WHEN s_suppkey % 11 = 0 THEN 'SUP-X' || CAST(s_suppkey AS VARCHAR) ELSE supplier_id END AS supplier_id,
    CASE WHEN s_suppkey % 11 = 0 AND s_suppkey % 2 = 0 THEN 'Ghost ' || CAST(s_suppkey AS VARCHAR)
         ELSE supplier_name END AS supplier_name,
    CASE WHEN s_suppkey % 23 = 0 THEN 'SEVERE' ELSE {band_sql('composite_risk')} END AS overall_risk,
    list_transform(list_filter({_RISK_LIST}, lambda x: x.v >= 0.5), lambda x: x.n) AS key_risks,
    'Review ' || supplier_name AS recommendation,
    CASE WHEN s_suppkey % 29 = 0 THEN 1.2e0 ELSE round(composite_risk, 3) END AS confidence,
    s_suppkey * 2 AS ordinal
  FROM scored
),
narr AS (
  SELECT supplier_id, supplier_name, overall_risk, key_risks, recommendation, confidence, ordinal FROM narr_base
  UNION ALL
  SELECT supplier_id, supplier_name, overall_risk, key_risks, 'Escalate ' || supplier_name,
    round(confidence / 2, 3), ordinal + 1 FROM narr_base WHERE s_suppkey % 13 = 0
),
valid AS (SELECT DISTINCT supplier_id AS vid FROM supplier_facts WHERE supplier_id IS NOT NULL),
names AS (SELECT supplier_name AS nm, arg_max(supplier_id, s_suppkey) AS nid FROM supplier_facts
          WHERE supplier_name IS NOT NULL GROUP BY supplier_name),
resolved AS (
  SELECT COALESCE(v.vid, n2.nid, '{C.UNKNOWN_SUPPLIER}') AS resolved_id, narr.*
  FROM narr LEFT JOIN valid v ON narr.supplier_id = v.vid LEFT JOIN names n2 ON narr.supplier_name = n2.nm
),
attributed AS (
  SELECT resolved_id, supplier_id, supplier_name, overall_risk, key_risks, recommendation, confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY resolved_id ORDER BY ordinal DESC) AS rn FROM resolved)
  WHERE rn = 1
)"""

ORACLE["attribute_narratives"] = f"WITH {NARR_CTE}\nSELECT * FROM attributed"

_SEV = "CASE overall_risk " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in C.SEVERITY_RANK.items()) + f" ELSE {C.SEVERITY_OTHER} END"

ORACLE["top_narratives"] = f"""WITH {NARR_CTE}
SELECT *, {_SEV} AS severity_rank FROM attributed
ORDER BY severity_rank, confidence DESC NULLS LAST, resolved_id LIMIT 5"""

ORACLE["narrative_contract"] = f"""WITH {NARR_CTE}
SELECT supplier_id, 'supplier_name' AS "column", 'not_nullable' AS "check", CAST(NULL AS VARCHAR) AS failure_case FROM narr WHERE supplier_name IS NULL
UNION ALL SELECT supplier_id, 'overall_risk', 'not_nullable', NULL FROM narr WHERE overall_risk IS NULL
UNION ALL SELECT supplier_id, 'key_risks', 'not_nullable', NULL FROM narr WHERE key_risks IS NULL
UNION ALL SELECT supplier_id, 'confidence', 'not_nullable', NULL FROM narr WHERE confidence IS NULL OR isnan(confidence)
UNION ALL SELECT supplier_id, 'overall_risk', 'isin(LOW, MEDIUM, HIGH, CRITICAL)', overall_risk FROM narr
  WHERE overall_risk IS NOT NULL AND overall_risk NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
UNION ALL SELECT supplier_id, 'key_risks', 'max_length({C.MAX_KEY_RISKS})', CAST(key_risks AS VARCHAR) FROM narr
  WHERE key_risks IS NOT NULL AND len(key_risks) > {C.MAX_KEY_RISKS}
UNION ALL SELECT supplier_id, 'confidence', 'in_range(0.0, 1.0)', CAST(confidence AS VARCHAR) FROM narr
  WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND NOT (confidence BETWEEN 0.0e0 AND 1.0e0)"""

ORACLE["narrative_input"] = f"""WITH {BAL}
SELECT {SUPPLIER_SELECT} FROM scored ORDER BY supplier_id LIMIT 10"""

ORACLE["supplier_picker"] = f"""WITH {FACTS_KEYED_CTE}
SELECT supplier_id || ' · ' || supplier_name AS label,
  arg_max(s_suppkey, s_suppkey) AS s_suppkey, arg_max(supplier_id, s_suppkey) AS supplier_id,
  arg_max(supplier_name, s_suppkey) AS supplier_name, round(arg_max(latitude, s_suppkey), 6) AS latitude,
  round(arg_max(longitude, s_suppkey), 6) AS longitude
FROM supplier_facts GROUP BY 1"""



def _py_json(c: str) -> str:
    """A text value as the JSON that the reference's rows are sized and sent
    in: ASCII only, others as lower-case \\u escapes."""
    return f"""COALESCE(array_to_string(list_transform(string_split(CAST(to_json({c}) AS VARCHAR), ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN x ELSE '\\u' || lpad(lower(to_hex(unicode(x))), 4, '0') END), ''), 'null')"""


ROW_JSON_CTE = f"""
json_rows AS (
  SELECT conv_id, turn, role, '{{{{"conv_id": ' || conv_id || ', "turn": ' || turn || ', "role": ' || {_py_json('role')}
    || ', "text": ' || {_py_json('text')} || '}}}}' AS row_json
  FROM conversations
)""".replace("{{", "{").replace("}}", "}")

ORACLE["token_estimate"] = f"""WITH {ROW_JSON_CTE}
SELECT conv_id, turn, role, CAST(length(row_json) // 4 AS BIGINT) AS tokens FROM json_rows"""

_B = 256


def chunk_cte(_B: int) -> str:
    return f"""RECURSIVE {ROW_JSON_CTE},
t AS (
  SELECT conv_id, turn, CAST(length(row_json) // 4 AS BIGINT) AS tokens, length(row_json) // 4 AS tok,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
  FROM json_rows
),
r AS (
  SELECT conv_id, rn, turn, tokens, tok, LEAST(tok, {_B + 1}) AS cur, CAST(0 AS BIGINT) AS chunk_id FROM t WHERE rn = 1
  UNION ALL
  SELECT t.conv_id, t.rn, t.turn, t.tokens, t.tok,
    CASE WHEN r.cur + t.tok > {_B} THEN LEAST(t.tok, {_B + 1}) ELSE LEAST(r.cur + t.tok, {_B + 1}) END,
    CASE WHEN r.cur + t.tok > {_B} THEN r.chunk_id + 1 ELSE r.chunk_id END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.rn = r.rn + 1
)"""


CHUNK_CTE = chunk_cte(_B)
ORACLE["chunk_assign_default"] = f"WITH {chunk_cte(C.MAX_INPUT_TOKENS)}\nSELECT conv_id, turn, tokens, chunk_id FROM r"
ORACLE["chunk_assign"] = f"WITH {CHUNK_CTE}\nSELECT conv_id, turn, tokens, chunk_id FROM r"

ORACLE["chunk_stats"] = f"""WITH {CHUNK_CTE}
SELECT conv_id, chunk_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(tokens) AS BIGINT) AS chunk_tokens,
  min(turn) AS first_turn, max(turn) AS last_turn
FROM r GROUP BY conv_id, chunk_id"""

ORACLE["report_kpis"] = f"""WITH {BAL}, k AS (
  SELECT count(*) AS total, COALESCE(avg(composite_risk), 0.0e0) AS avg_risk,
    count(*) FILTER (WHERE composite_risk >= 0.7e0) AS high, count(*) FILTER (WHERE composite_risk >= 0.85e0) AS crit
  FROM scored)
SELECT format('{{:,}}', total) AS total_suppliers_text, printf('%.3f', avg_risk) AS avg_risk_text,
  format('{{:,}}', high) AS high_risk_text, format('{{:,}}', crit) AS critical_text FROM k"""

ORACLE["report_top"] = f"""WITH {BAL},
top AS (SELECT * FROM scored ORDER BY composite_risk DESC, supplier_id ASC LIMIT 10)
SELECT substr(supplier_id, 1, {C.REPORT_ID_WIDTH}) AS entity_id, substr(supplier_name, 1, {C.REPORT_NAME_WIDTH}) AS name,
  printf('%.3f', composite_risk) AS risk, {band_sql('composite_risk')} AS band,
  substr(region, 1, {C.REPORT_REGION_WIDTH}) AS region, round(composite_risk, 6) AS composite_risk
FROM top"""

# --- incremental work -------------------------------------------------------

ORACLE["new_files"] = """WITH h AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS content_sha256 FROM documents)
SELECT * FROM h WHERE content_sha256 NOT IN (SELECT content_sha256 FROM h WHERE doc_id % 7 = 0)"""

ORACLE["stream_news"] = f"WITH {ITEMS_CTE}\nSELECT title, url, source, published, summary FROM items WHERE {_KW_COND}"

_LATIN = "text"
for _raw, _rep in C.FOLD_REPLACEMENTS:
    _LATIN = f"replace({_LATIN}, {_sql_text(_raw)}, {_sql_text(_rep)})"
ORACLE["fold_text"] = f"SELECT doc_id, regexp_replace(nfc_normalize(strip_accents({_LATIN})), '[^\\x00-\\xFF]', '', 'g') AS text_latin1 FROM documents"

ORACLE["stale_caches"] = f"""WITH last AS (SELECT user_id, max(ts) AS last_fetch FROM events GROUP BY user_id),
now AS (SELECT max(ts) AS now FROM events)
SELECT user_id, last_fetch,
  COALESCE(epoch_us(now) - epoch_us(last_fetch) > {C.NEWS_TTL_SECONDS} * 1000000, true) AS is_stale
FROM last CROSS JOIN now"""

ORACLE["pending_work"] = """SELECT DISTINCT user_id, event_type FROM events
EXCEPT SELECT user_id, event_type FROM events WHERE value > 50"""

ORACLE["demo_sample"] = f"""WITH {LINES_CTE}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(annual_spend_usd, 6) AS annual_spend_usd,
  last_audit_date, supplier_id, supplier_name, round(risk_score, 6) AS risk_score,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, region, tier
FROM line_exposures ORDER BY l_orderkey, l_linenumber LIMIT 500"""

ORACLE["retryable_errors"] = f"""WITH {LOGS_CTE}
SELECT status, CAST(count(*) AS BIGINT) AS n, status IN ({', '.join(str(s) for s in C.RETRYABLE_STATUS)}) AS retryable
FROM logs WHERE status IS NOT NULL GROUP BY status"""

ORACLE["prompts"] = f"""WITH {CHUNK_CTE},
rows_ AS (SELECT r.conv_id, r.chunk_id, r.turn, c.row_json
          FROM r JOIN json_rows c ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT conv_id, chunk_id, CAST(count(*) AS BIGINT) AS n_rows,
  {_sql_text(C.NARRATIVE_PROMPT)} || '[' || string_agg(row_json, ', ' ORDER BY turn) || ']' || chr(10) AS prompt
FROM rows_ GROUP BY conv_id, chunk_id"""


# --- sources and rules by their own rows --------------------------------------

_CLEANED = f"""WITH {FACTS_KEYED_CTE},
dirty AS ({dirty_sql('supplier_facts', 's_suppkey')}),
cleaned AS ({clean_sql('dirty', 's_suppkey')})"""

ORACLE["suppliers_from_csv"] = f"{_CLEANED} SELECT {_CLEAN_OUT.format(k='').lstrip(', ')} FROM cleaned"

ORACLE["clean_typed"] = f"""{_CLEANED}
SELECT s_suppkey, supplier_id, supplier_name, {R6('risk_score')}, {R6('latitude')}, region, tier,
  {R6('annual_spend_usd')}, TRY_CAST(last_audit_date AS DATE) AS last_audit_date FROM cleaned"""

ORACLE["sanctions_from_csv"] = ORACLE["sanctions_screen"]

ORACLE["schema_failures"] = f"""WITH {FACTS_CTE}
SELECT CAST(NULL AS VARCHAR) AS supplier_id, c AS "column", k AS "check", v AS failure_case
FROM (VALUES ('tier', 'column_in_dataframe', 'tier'), ('annual_spend_usd', 'dtype(''double'')', 'string'),
             ('audited_by', 'column_in_schema', 'audited_by')) AS t(c, k, v)"""

ORACLE["gate_written"] = f"""WITH {FACTS_CTE}
SELECT supplier_id, supplier_name, {R6('risk_score')}, {R6('latitude')}, {R6('longitude')},
  region, tier, {R6('annual_spend_usd')}, last_audit_date FROM supplier_facts WHERE NOT ({_row_bad()})"""

ORACLE["map_points_unscored"] = f"""WITH {FACTS_CTE},
capped AS (SELECT *, risk_score AS composite_risk FROM supplier_facts ORDER BY risk_score DESC NULLS LAST, supplier_id LIMIT 50000)
{map_select('capped')}"""


def _json_sql(c: str, text: bool) -> str:
    value = f"CAST(to_json({c}) AS VARCHAR)" if text else f"CAST({c} AS VARCHAR)"
    return f"""'"{c}": ' || COALESCE({value}, 'null')"""


_FACT_JSON = " || ', ' || ".join(_json_sql(c, c in C.STRING_COLUMNS) for c in C.SUPPLIER_COLUMNS)

ORACLE["supplier_rows_json"] = f"""WITH {FACTS_CTE},
j AS (SELECT supplier_id, '{{' || {_FACT_JSON} || '}}' AS row_json FROM supplier_facts)
SELECT supplier_id, row_json, CAST(length(row_json) // 4 AS BIGINT) AS tokens FROM j"""

ORACLE["worst_hour_payloads"] = f"""WITH {OBS_CTE},
conditions(code, condition) AS (VALUES {_CONDITIONS}),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY hour, event_id) - 1 AS i FROM obs
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY COALESCE(wind, 0.0e0) DESC, i) AS rn FROM numbered
),
best AS (
  SELECT location_id, CAST(i AS INTEGER) AS hour_index, COALESCE(temp, 20.0e0) AS temperature_c, COALESCE(wind, 0.0e0) AS wind_kmh,
    COALESCE(precip, 0.0e0) AS precip_prob_pct, COALESCE(code, 0) AS weather_code
  FROM ranked WHERE rn = 1
)
SELECT b.location_id, b.hour_index, round(b.temperature_c, 6) AS temperature_c, round(b.wind_kmh, 6) AS wind_kmh,
  round(b.precip_prob_pct, 6) AS precip_prob_pct, b.weather_code,
  COALESCE(c.condition, '{C.CONDITION_UNKNOWN}') AS condition, {risk_sql('b.wind_kmh', 'b.precip_prob_pct')} AS risk_level
FROM best b LEFT JOIN conditions c ON b.weather_code = c.code"""


def _scenario_work_sql() -> str:
    from ..scenario import Scenario
    from ..streaming.incremental import scenario_key
    first, second = scenario_key(Scenario()), scenario_key(Scenario(weighting="financial_heavy"))
    return f"""SELECT sha256(printf('SUP-%06d', s_suppkey)) AS upload_sha256, k AS scenario_key
FROM supplier, (VALUES ('{first}'), ('{second}')) AS t(k) WHERE NOT (s_suppkey % 3 = 0 AND k = '{first}')"""


ORACLE["scenario_work"] = _scenario_work_sql()

_GATED = ", ".join(C.SUPPLIER_COLUMNS)

# Uploads of the second batch: one a remainder, every third without the tier column.
ORACLE["stream_suppliers"] = f"""WITH {FAULTY_CTE},
first_batch AS (SELECT {_GATED} FROM supplier_facts WHERE NOT ({_row_bad()})),
landed AS (SELECT *, s_suppkey % 48 AS upload FROM faulty),
bad AS (
  SELECT upload FROM landed WHERE upload % 3 = 2 OR ({_row_bad()})
  UNION SELECT upload FROM landed WHERE supplier_id IS NOT NULL GROUP BY upload, supplier_id HAVING count(*) > 1
),
second_batch AS (SELECT {_GATED} FROM landed WHERE upload NOT IN (SELECT upload FROM bad)),
{components_cte('first_batch', TB.AS_OF, 'c1')},
{components_cte('second_batch', TB.AS_OF, 'c2')},
both_batches AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
scored AS (SELECT *, {composite_expr(C.WEIGHTS['balanced'])} AS composite_risk FROM both_batches)
SELECT {SUPPLIER_SELECT} FROM scored"""

ORACLE["session_stages"] = f"""WITH RECURSIVE ev AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY moment, seq) AS rn FROM (
    SELECT CAST(user_id AS VARCHAR) AS session, CAST(event_id AS BIGINT) AS seq, ts AS moment,
      CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'signup' THEN 'scenario' ELSE 'news' END AS kind,
      CASE event_type WHEN 'purchase' THEN 'h' || CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR)
        WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'balanced' ELSE 'financial_heavy' END END AS value
    FROM events)
),
fold AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS upload,
    CAST(NULL AS VARCHAR) AS scenario, CAST(NULL AS TIMESTAMP) AS fetched, CAST([] AS VARCHAR[]) AS stages FROM ev
  UNION ALL
  SELECT e.session, e.rn, e.seq,
    CASE WHEN e.kind = 'upload' AND e.value IS NOT NULL THEN e.value ELSE f.upload END,
    CASE WHEN e.kind = 'scenario' THEN e.value ELSE f.scenario END,
    CASE WHEN e.kind = 'upload' AND e.value IS NOT NULL AND e.value IS DISTINCT FROM f.upload THEN NULL
         WHEN e.kind = 'news' AND (f.fetched IS NULL OR e.moment - f.fetched > INTERVAL {12 * 3600} SECOND) THEN e.moment ELSE f.fetched END,
    CASE WHEN e.kind = 'upload' AND e.value IS NOT NULL AND e.value IS DISTINCT FROM f.upload THEN ['validate', 'score', 'text']
         WHEN e.kind = 'scenario' AND e.value IS DISTINCT FROM f.scenario AND f.upload IS NOT NULL THEN ['score', 'text']
         WHEN e.kind = 'news' AND (f.fetched IS NULL OR e.moment - f.fetched > INTERVAL {12 * 3600} SECOND) THEN ['news']
         ELSE CAST([] AS VARCHAR[]) END
  FROM fold f JOIN ev e ON e.session = f.session AND e.rn = f.rn + 1
)
SELECT session, seq, unnest(stages) AS stage FROM fold WHERE len(stages) > 0"""


ORACLE["kpis_by_upload"] = ORACLE["line_kpis"]
ORACLE["regions_by_upload"] = ORACLE["line_region_rollup"]
ORACLE["bands_by_upload"] = ORACLE["band_counts"].replace(BAL, LINES_SCORED)

ORACLE["stream_recent_logs"] = ORACLE["recent_logs"]

ORACLE["stream_latest_news"] = f"""WITH {ITEMS_CTE}
SELECT title, url, source, published, summary FROM items WHERE source IN ('src1', 'src3', 'src5', 'src7')
ORDER BY published DESC, url, title LIMIT 25"""
