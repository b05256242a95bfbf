"""Summarize the physical plans of the headline queries (writes PLANS.md).

usage: python scripts/explain_plans.py [sf_dir]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from panelcast.plans import queries as Q  # noqa: E402
from panelcast.session import get_session  # noqa: E402

PATTERNS = {
    "file scans": r"FileScan parquet",
    "shuffle exchanges": r"Exchange hashpartitioning",
    "single-partition exchanges": r"Exchange SinglePartition",
    "broadcast exchanges": r"BroadcastExchange",
    "sort-merge joins": r"SortMergeJoin",
    "broadcast hash joins": r"BroadcastHashJoin",
    "window nodes": r"\bWindow \[",
    "hash aggregates": r"HashAggregate\(",
    "python (mapInPandas) nodes": r"MapInPandas|PythonMapInArrow",
    "scalar subqueries": r"Subquery subquery",
    "reused exchanges (computed once, read again)": r"ReusedExchange",
    "reused subqueries": r"ReusedSubquery",
}


def final_only(plan: str) -> str:
    """Drop every '== Initial Plan ==' section of the adaptive plans."""
    out, skip_at = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_at is not None:
            if indent > skip_at:
                continue
            skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = indent
            continue
        out.append(line)
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/explain_plans.py` on `{sf}`: each query is executed, then "
           "its final adaptive plan is scanned (AQE has applied exchange reuse and runtime "
           "broadcast conversion). Queries that checkpoint show only the work after the "
           "checkpoint (the checkpoint job itself reads the raw tables once).", ""]
    for name in HEADLINE:
        df = Q.REGISTRY[name][0](spark, sf)
        df.collect()                       # run it: AQE finalizes the plan (reuse, broadcasts)
        ep = df._jdf.queryExecution().executedPlan()
        try:
            plan = ep.finalPhysicalPlan().toString()      # adaptive plan after execution
        except Exception:
            plan = final_only(ep.toString())
        out.append(f"## {name}")
        out.append("")
        for label, pat in PATTERNS.items():
            n = len(re.findall(pat, plan))
            if n:
                out.append(f"- {label}: {n}")
        pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))[:4]
        for p in pushed:
            out.append(f"- pushed filters: `{p[:160]}`")
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
        for sch in schemas[:6]:
            out.append(f"- read schema: `{sch.splitlines()[0][:160]}`")
        out.append("")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
