"""Summarise the physical plans of the bench's headline queries.

    python scripts/plan_report.py [sf_dir] > PLANS.md

Each key is run once; then its final adaptive plan (after AQE's run-time
re-planning, e.g. sort-merge turned into broadcast) is read: parquet scans
with the columns they read, exchanges, join strategies and windows, plus
the number of Spark jobs the run started.  Scalar subqueries are printed
in full at every place they are referenced but run once; the job count is
the reliable measure of work there.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from cohortcraft.plans.registry import all_queries  # noqa: E402
from cohortcraft.session import build_session  # noqa: E402


def explain(df, mode: str) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def final_plan(text: str) -> str:
    """The part of an executed adaptive plan after ``== Final Plan ==`` and
    before ``== Initial Plan ==`` (subquery plans included)."""
    parts = re.split(r"== Initial Plan ==", text)
    kept = []
    for i, part in enumerate(parts):
        if i == 0:
            kept.append(part)
        else:   # drop the initial-plan subtree up to the next final plan, if any
            nxt = part.find("== Final Plan ==")
            kept.append(part[nxt:] if nxt >= 0 else "")
    return "".join(kept)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=16)
    qs = all_queries()
    print(f"# Physical plans of the headline queries ({os.path.basename(sf_dir)})\n")
    print("Generated by `scripts/plan_report.py` from the final adaptive plan after one run.")
    print("Counts are taken in the `== Final Plan ==` parts; a scalar subquery is counted at each")
    print("reference but runs once. `jobs` is the number of Spark jobs the run started (model keys")
    print("also count their fitting jobs). Keys that write joined rows or statistics first, and those whose")
    print("result is a small fitted table, show only their last step here; for them `jobs` is the measure.\n")
    print("| key | jobs | scans | shuffle exchanges | broadcasts | joins | windows |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    details = []
    sc = spark.sparkContext
    for i, k in enumerate(HEADLINE):
        group = f"plan-report-{i}"
        sc.setJobGroup(group, k)
        df = qs[k](spark, sf_dir)
        df.collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
        p = final_plan(explain(df, "simple"))
        scans = len(re.findall(r"FileScan parquet", p))
        exch = len(re.findall(r"[+:\s-]Exchange (?:hashpartitioning|SinglePartition|rangepartitioning|RoundRobin)", p))
        bcast = len(re.findall(r"BroadcastExchange", p))
        joins = sorted(set(re.findall(r"(\w*Join)\b", p)))
        windows = len(re.findall(r"[+:\s-]Window \[", p))
        print(f"| `{k}` | {jobs} | {scans} | {exch} | {bcast} | {', '.join(joins) or '-'} | {windows} |")
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^>\n]*>?)", p)))
        details.append((k, schemas))
    print("\n## Columns read by each scan\n")
    for k, schemas in details:
        print(f"* `{k}`: " + "; ".join(f"`{s}`" for s in schemas))
    spark.stop()


if __name__ == "__main__":
    main()
