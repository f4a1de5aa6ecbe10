"""Summarise the physical plans of the headline queries into PLANS.md.

    python tools/plans.py [--sf /root/testdata/sf0.1]

For each query: scans (pruned ReadSchema, PushedFilters), shuffles by
partitioning, broadcasts, join strategies, windows and Python nodes, taken
from ``explain("formatted")`` of the plan Spark builds before execution
(AQE may still coalesce partitions or turn a shuffle join into a broadcast
at runtime).
"""

from __future__ import annotations

import argparse
import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plan_text(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def summarise(text: str) -> dict:
    tree = text.split("\n\n")[0]
    ops = collections.Counter()
    for line in tree.splitlines():
        m = re.search(r"[+-]- \*?\s*([A-Za-z]+(?: [A-Za-z]+)*)", line) or re.match(r"\s*([A-Za-z]+)", line)
        if m:
            ops[m.group(1).strip()] += 1
    exchanges = re.findall(r"Arguments: (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|"
                           r"RoundRobinPartitioning\(\d+\)|SinglePartition)", text)
    scans = []
    for block in re.findall(r"\(\d+\) Scan parquet[^\n]*\n(.*?)(?:\n\n|\Z)", text, re.S):
        loc = re.search(r"Location: \S+ \[([^\]]+)\]", block)
        rs = re.search(r"ReadSchema: (.*)", block)
        pf = re.search(r"PushedFilters: (.*)", block)
        scans.append((os.path.basename(loc.group(1)) if loc else "?", rs.group(1) if rs else "",
                      pf.group(1) if pf else ""))
    subqueries = len(re.findall(r"^Subquery:\d+ ", text, re.M))
    return {"ops": ops, "exchanges": exchanges, "scans": scans, "subqueries": subqueries}


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"))
    args = ap.parse_args()
    import bench
    from tierwatch.plans.catalog import QUERIES
    from tierwatch.session import local_session
    spark = local_session(8, shuffle_partitions=16)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lines = ["# Physical plans of the headline queries", "",
             f"Generated by `tools/plans.py` at `{args.sf}` (local[8], 16 shuffle partitions), from",
             "`explain(\"formatted\")` before execution; AQE may still coalesce partitions or turn a",
             "shuffle join into a broadcast join at runtime.", ""]
    keep = ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
            "BroadcastNestedLoopJoin", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window",
            "TakeOrderedAndProject", "MapInPandas", "ArrowEvalPython", "FlatMapGroupsInPandas",
            "Generate", "Union", "Sort", "Expand")
    for name in [n for n in bench.HEADLINE if n in QUERIES]:
        df = QUERIES[name](spark, args.sf)
        s = summarise(plan_text(df))
        lines.append(f"## {name}")
        lines.append("")
        ops = ", ".join(f"{k} x{v}" for k, v in sorted(s["ops"].items()) if k in keep)
        lines.append(f"* operators: {ops or '-'}")
        if s["subqueries"]:
            lines.append(f"* scalar subqueries (one-row aggregates evaluated once): {s['subqueries']}")
        if s["exchanges"]:
            shuffles = collections.Counter(re.sub(r"\(.*", "", e) for e in s["exchanges"])
            lines.append("* shuffles: " + ", ".join(f"{k} x{v}" for k, v in sorted(shuffles.items())))
        else:
            lines.append("* shuffles: none")
        for table, schema, pushed in s["scans"]:
            lines.append(f"* scan `{table}`: ReadSchema `{schema}`" + (f"; PushedFilters `{pushed}`" if pushed and pushed != "[]" else ""))
        lines.append("")
    with open(args.out, "w") as f:
        f.write("\n".join(lines))
    print(f"wrote {args.out}")
    spark.stop()


if __name__ == "__main__":
    main()
