"""Data-quality gate: report every failing value, then accept or reject.

Row rules are evaluated in one pass: each row yields an array holding a
failure struct per broken rule, and ``inline`` turns that into failure
rows.  Uniqueness is a partial count per id (one value per task for a
hot id) whose duplicates are expanded back into failure rows in bounded
blocks.  Schema-level problems (missing, extra or mistyped columns) come
from the schema alone and are added as rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

FAILURE_SCHEMA = T.StructType([
    T.StructField("supplier_id", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("check", T.StringType()),
    T.StructField("failure_case", T.StringType()),
])

# FIXED VALUES: the supplier contract.
SUPPLIER_DTYPES = {
    "supplier_id": "string",
    "supplier_name": "string",
    "risk_score": "double",
    "latitude": "double",
    "longitude": "double",
    "region": "string",
    "tier": "bigint",
    "annual_spend_usd": "double",
    "last_audit_date": "string",
}
NULLABLE = {"last_audit_date"}
AUDIT_DATE_PATTERN = r"(?U)^\d{4}-\d{2}-\d{2}\z"
TIER1_SPEND_FLOOR = 10_000.0


@dataclass(frozen=True)
class Check:
    column: str | None
    name: str
    passes: object          # callable: () -> boolean Column (null = pass)
    needs: tuple = ()       # columns that must exist for the check to run
    value: str | None = None  # column reported as failure_case


@dataclass(frozen=True)
class Contract:
    dtypes: dict
    nullable: set = field(default_factory=set)
    unique: tuple = ()
    checks: tuple = ()
    strict: bool = True     # extra columns rejected
    key: str | None = "supplier_id"


def _in_range(col, lo, hi):
    return lambda: F.col(col).between(lo, hi)


@lru_cache(maxsize=None)
def supplier_contract() -> Contract:
    checks = (
        Check("supplier_id", "str_length(3, 20)",
              lambda: F.char_length("supplier_id").between(3, 20)),
        Check("supplier_name", "str_length(1, 200)",
              lambda: F.char_length("supplier_name").between(1, 200)),
        Check("risk_score", "in_range(0.0, 1.0)", _in_range("risk_score", 0.0, 1.0)),
        Check("latitude", "in_range(-90.0, 90.0)", _in_range("latitude", -90.0, 90.0)),
        Check("longitude", "in_range(-180.0, 180.0)", _in_range("longitude", -180.0, 180.0)),
        Check("region", "isin(EMEA, APAC, NA, LATAM)", lambda: F.col("region").isin(*C.REGIONS)),
        Check("tier", "in_range(1, 4)", _in_range("tier", 1, 4)),
        Check("annual_spend_usd", "greater_than_or_equal_to(0.0)",
              lambda: F.col("annual_spend_usd") >= 0.0),
        Check("last_audit_date", "str_matches(^\\d{4}-\\d{2}-\\d{2}$)",
              lambda: F.col("last_audit_date").rlike(AUDIT_DATE_PATTERN)),
        # Row rule: a tier-1 supplier must carry the spend floor.
        Check("annual_spend_usd", "spend_matches_tier_floor",
              lambda: (F.col("tier") != 1) | (F.col("annual_spend_usd") >= TIER1_SPEND_FLOOR),
              needs=("tier", "annual_spend_usd")),
    )
    return Contract(dtypes=SUPPLIER_DTYPES, nullable=NULLABLE, unique=("supplier_id",),
                    checks=checks)


def _missing(c: str, dtype: str) -> Column:
    col = F.col(c)
    if dtype in ("double", "float"):
        return col.isNull() | F.isnan(col)   # NaN counts as missing
    return col.isNull()


def _fail(column, check, value: Column) -> Column:
    return F.struct(F.lit(column).cast("string").alias("column"),
                    F.lit(check).alias("check"),
                    value.cast("string").alias("failure_case"))


_CHECK_CACHE: dict = {}


def _row_checks(df: DataFrame, contract: Contract) -> list[tuple[Column, Column]]:
    """(fails, failure struct) per applicable row rule.  Plain boolean
    columns and structs, no lambdas: the expressions stay small for the
    optimizer and code generator.  Built once per (schema, contract)."""
    key = (tuple(df.dtypes), id(contract))
    hit = _CHECK_CACHE.get(key)
    if hit is not None and hit[0] is contract:
        return hit[1]
    out = _build_checks(dict(df.dtypes), contract)
    _CHECK_CACHE[key] = (contract, out)
    return out


def _build_checks(dtypes: dict, contract: Contract) -> list[tuple[Column, Column]]:
    present = set(dtypes)
    out = []
    for c, want in contract.dtypes.items():
        if c not in present or dtypes[c] != want:
            continue
        if c not in contract.nullable:
            out.append((_missing(c, want), _fail(c, "not_nullable", F.lit(None))))
    for chk in contract.checks:
        cols = chk.needs or ((chk.column,) if chk.column else ())
        if any(c not in present or dtypes[c] != contract.dtypes.get(c, dtypes[c]) for c in cols):
            continue
        # A missing value is reported by not_nullable only.
        skip = None
        for c in cols:
            m = _missing(c, contract.dtypes.get(c, dtypes[c]))
            skip = m if skip is None else (skip | m)
        fails = ~skip & ~F.coalesce(chk.passes(), F.lit(True))
        out.append((fails, _fail(chk.column, chk.name, F.col(chk.value or chk.column))))
    return out


_FAIL_ARRAY = "array<struct<column:string,check:string,failure_case:string>>"


def _row_failures(df: DataFrame, contract: Contract) -> Column:
    """Array of this row's failure structs (empty when it passes)."""
    checks = _row_checks(df, contract)
    if not checks:
        return F.array().cast(_FAIL_ARRAY)
    return F.array_compact(F.array(*[F.when(f, st) for f, st in checks]))


def _row_failure_count(df: DataFrame, contract: Contract) -> Column:
    checks = _row_checks(df, contract)
    if not checks:
        return F.lit(0)
    total = None
    for f, _ in checks:
        x = F.when(f, F.lit(1)).otherwise(F.lit(0))
        total = x if total is None else total + x
    return total


def schema_failures(df: DataFrame, contract: Contract) -> list[tuple]:
    """Missing, extra and mistyped columns, from the schema alone."""
    dtypes = dict(df.dtypes)
    out = []
    for c, want in contract.dtypes.items():
        if c not in dtypes:
            out.append((None, c, "column_in_dataframe", c))
        elif dtypes[c] != want:
            out.append((None, c, f"dtype('{want}')", dtypes[c]))
    if contract.strict:
        for c in df.columns:
            if c not in contract.dtypes:
                out.append((None, c, "column_in_schema", c))
    return out


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with their count (partial aggregation
    before the shuffle, so a hot id costs one row per task)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def _key_col(df: DataFrame, contract: Contract) -> Column:
    if contract.key and contract.key in df.columns:
        return F.col(contract.key).cast("string")
    return F.lit(None).cast("string")


# Duplicate-id failure rows are expanded from the per-id counts in blocks
# of at most this many rows, so a hot id never becomes one huge array.
EXPAND_BLOCK = 100_000


def expand_counts(counts: DataFrame, n_col: str = "n", block: int = EXPAND_BLOCK) -> DataFrame:
    """One output row per unit of ``n_col`` (``n`` copies of each input
    row), in bounded blocks: first one row per block, spread round-robin
    across tasks, then each block expanded."""
    n = F.col(n_col).cast("long")
    blocks = counts.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"),
                                                          F.floor((n - 1) / block).cast("long"))))
    size = F.least(F.lit(block).cast("long"), n - F.col("_b") * block)
    spread = blocks.repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (spread.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size)))
            .drop("_b", "_i"))


def _any_failure(checks: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f, _ in checks], F.lit(False))


def failing_groups(df: DataFrame, group: str, contract: Contract | None = None) -> DataFrame:
    """Groups (one column) of rows that the contract rejects, each group
    judged by itself: a group fails by any row or by an id repeated in it.
    ``group`` is not part of the contract."""
    contract = contract or supplier_contract()
    body = df.drop(group)
    if schema_failures(body, contract):
        return df.select(group).distinct()
    bad = df.where(_any_failure(_row_checks(body, contract))).select(group)
    for u in contract.unique:
        again = df.where(F.col(u).isNotNull()).groupBy(group, u).count().where("count > 1")
        bad = bad.union(again.select(group))
    return bad.distinct()


def group_failures(df: DataFrame, group: str, contract: Contract | None = None) -> DataFrame:
    """``failures`` of each group of rows by itself, with the group: an id is a
    duplicate only where its own group repeats it."""
    contract = contract or supplier_contract()
    checks = _row_checks(df.drop(group), contract)
    arr = F.array_compact(F.array(*[F.when(f, st) for f, st in checks]))
    out = df.where(_any_failure(checks)).select(group, _key_col(df, contract).alias("supplier_id"), F.inline(arr))
    for u in contract.unique:
        again = df.where(F.col(u).isNotNull()).groupBy(group, u).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(expand_counts(again).select(
            group, F.col(u).cast("string").alias("supplier_id"), F.lit(u).alias("column"), F.lit("unique").alias("check"),
            F.col(u).cast("string").alias("failure_case")))
    return out


def failures(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Every failing value: (supplier_id, column, check, failure_case).

    Row rules come from one pass over the rows.  A duplicated id fails on
    every row that carries it; those rows hold nothing but the id, so they
    are generated from the per-id counts instead of joining the whole input
    back to its duplicates."""
    contract = contract or supplier_contract()
    spark = df.sparkSession
    checks = _row_checks(df, contract)
    arr = (F.array(*[F.when(f, st) for f, st in checks]) if checks
           else F.array().cast(_FAIL_ARRAY))
    # Only rows with a failure are expanded to their failures.
    rows = df.where(_any_failure(checks)).select(_key_col(df, contract).alias("supplier_id"), F.inline(F.array_compact(arr)))
    parts = [rows]
    for u in contract.unique:
        if u in df.columns:
            dup = expand_counts(duplicate_keys(df, u))
            key = (F.col(u).cast("string") if contract.key == u
                   else F.lit(None).cast("string"))
            if contract.key and contract.key != u:
                # The row key differs from the unique column: it has to come
                # from the rows themselves.
                dup_ids = duplicate_keys(df, u).select(u)
                dup = df.join(dup_ids, u, "left_semi")
                key = _key_col(df, contract)
            parts.append(dup.select(
                key.alias("supplier_id"), F.lit(u).alias("column"),
                F.lit("unique").alias("check"), F.col(u).cast("string").alias("failure_case")))
    sf = schema_failures(df, contract)
    if sf:
        parts.append(spark.createDataFrame(sf, FAILURE_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split(df: DataFrame, contract: Contract | None = None) -> tuple[DataFrame, DataFrame]:
    """(passing rows, failing rows with their failure list) for quarantine
    use.  Schema-level problems make every row fail."""
    contract = contract or supplier_contract()
    if schema_failures(df, contract):
        return df.limit(0), df
    flagged = df.withColumn("_failures", _row_failures(df, contract))
    for u in contract.unique:
        dup = duplicate_keys(df, u).select(u, F.lit(True).alias(f"_dup_{u}"))
        flagged = (flagged.join(dup, u, "left")
                   .withColumn("_failures", F.when(
                       F.col(f"_dup_{u}"),
                       F.concat("_failures", F.array(_fail(u, "unique", F.col(u)))))
                       .otherwise(F.col("_failures")))
                   .drop(f"_dup_{u}"))
    ok = F.size("_failures") == 0
    passing = flagged.where(ok).drop("_failures")
    failing = flagged.where(~ok)
    return passing, failing


class GateError(Exception):
    """Structured ingestion failure carrying the failure rows."""

    def __init__(self, message: str, failure_cases: DataFrame | None = None):
        super().__init__(message)
        self.failure_cases = failure_cases


def failure_count(df: DataFrame, contract: Contract | None = None) -> int:
    """Number of failure rows ``failures`` would produce, from one job of
    two small aggregates (no semi-join, no failure rows materialised)."""
    contract = contract or supplier_contract()
    n_schema = len(schema_failures(df, contract))
    total = F.coalesce(F.sum(_row_failure_count(df, contract)), F.lit(0))
    for u in contract.unique:
        if u in df.columns:
            # duplicate rows as a scalar subquery of the per-id counts
            dup = duplicate_keys(df, u).agg(F.coalesce(F.sum("n"), F.lit(0)))
            total = total + dup.scalar()
    return n_schema + int(df.agg(total.alias("n")).first()[0] or 0)


def gate(df: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Accept the whole batch or raise ``GateError`` with all failures.

    The input is persisted across the check so the accepted batch is not
    recomputed; a failure to materialise surfaces as a ``GateError``
    without cases."""
    contract = contract or supplier_contract()
    df = df.persist()
    try:
        n = failure_count(df, contract)
    except Exception as exc:  # noqa: BLE001 - any materialisation error
        df.unpersist()
        raise GateError("Supplier data could not be materialised for validation.") from exc
    if n:
        # the failure rows are recomputed by whoever reads them: nothing stays cached
        cases = failures(df, contract)
        df.unpersist()
        raise GateError(f"Supplier data failed schema validation: {n} error(s).", cases)
    return df


def gate_write(df: DataFrame, path: str, contract: Contract | None = None) -> DataFrame:
    """``gate`` into a table: the batch is written to ``<path>.staged`` while its
    failing values are counted on the way (``observe``), and takes the place of
    ``path`` only if it passes.  The input is read once and nothing is kept in
    memory; ids are counted from the staged table's one column.  A rejected
    batch stays staged, and the failures are read from there."""
    contract = contract or supplier_contract()
    spark = df.sparkSession
    staged = path.rstrip("/") + ".staged"
    seen = Observation("gate")
    try:
        (df.observe(seen, F.coalesce(F.sum(_row_failure_count(df, contract)), F.lit(0)).cast("bigint").alias("bad"))
         .write.mode("overwrite").parquet(staged))
    except Exception as exc:  # noqa: BLE001 - any materialisation error
        raise GateError("Supplier data could not be materialised for validation.") from exc
    table = spark.read.schema(df.schema).parquet(staged)
    n = len(schema_failures(df, contract)) + int(seen.get["bad"])
    for u in contract.unique:
        if u in df.columns:
            n += int(duplicate_keys(table, u).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    if n:
        raise GateError(f"Supplier data failed schema validation: {n} error(s).", failures(table, contract))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    if not fs.rename(hadoop(staged), hadoop(path)):
        raise GateError("The accepted batch could not be published.")
    return spark.read.schema(df.schema).parquet(path)
