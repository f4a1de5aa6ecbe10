"""Sinks for the payload and report tables: each DataFrame is written by
the executors (no collect), one folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("json", "parquet", "csv")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    getattr(writer, fmt)(path)
    return path


def write_tables(tables: dict, root: str, fmt: str = "parquet", mode: str = "overwrite") -> dict:
    """Write named tables (e.g. ``report.report_tables``) under ``root``."""
    return {name: write_table(df, f"{root.rstrip('/')}/{name}", fmt, mode)
            for name, df in tables.items()}
