"""Summarise the executed (final adaptive) physical plan of every registered query.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Broadcasts are off, so the plans are those of inputs too large for them; what is broadcast
all the same has a bound that the code states. For each key the query is run once
(collect), then its final plan is inspected: number of shuffle exchanges, broadcast
exchanges, join strategies, and the filters pushed into Parquet scans. For iterative
queries the final plan is the last step over the round tables; one level of the search and
one round of the components, which are jobs of their own, follow in full.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from routegraph.operators import components, paths  # noqa: E402
from routegraph.operators.edges import SaltedEdges  # noqa: E402
from routegraph.operators.lineage import RoundTables, row_count  # noqa: E402
from routegraph.plans.catalog import QUERIES  # noqa: E402
from routegraph.plans.network import Network  # noqa: E402
from routegraph.session import local_session  # noqa: E402


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()  # physical plan; after execution AQE prints the final plan first
    return buf.getvalue()


def summarise(text: str) -> dict:
    final = text.split("\n+- == Initial Plan ==")[0]  # top level only (subqueries nest their own)
    pushed = []
    for m in re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", final):
        rest = re.sub(r"IsNotNull\([^)]*\)(, )?", "", m).strip(", ")
        if rest:
            pushed.append(rest)
    return {
        "final": "isFinalPlan=true" in text,
        "shuffles": len(re.findall(r"(?<!Broadcast)Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", final)),
        "reused": len(re.findall(r"ReusedExchange", final)),
        "broadcasts": len(re.findall(r"BroadcastExchange", final)),
        "bhj": len(re.findall(r"BroadcastHashJoin", final)),
        "smj": len(re.findall(r"SortMergeJoin", final)),
        "scans": len(re.findall(r"FileScan parquet", final)),
        "pushed": sorted(set(pushed)),
    }


def tree(df) -> str:
    df.collect()
    text = plan_text(df).split("+- == Initial Plan ==")[0]
    return re.sub(r"#\d+L?|, \[plan_id=\d+\]|Location: [^\]]*\], |\[file:[^\]]*\]", "", text).strip()


def level_and_round(spark, sf_dir: str) -> None:
    """One search level and one star round over the test network, as executed."""
    net = Network.from_test_tables(spark, sf_dir)
    t = RoundTables(spark, "plans")
    pairs, m = t.write(net.graph().real_edges().select("src", "dst").distinct(), "pairs", row_count())
    back = SaltedEdges(t, pairs, m["n"], "dst", "back")
    visited = paths.BucketedTable(t, "visited", ["id", "landmark"], m["n"], None, 2_000_000)
    try:
        start = pairs.filter("dst = 5").selectExpr("src as id", "5L as landmark", "1 as hops")
        visited.append(start)
        front = visited.table().selectExpr("id as dst", "landmark")
        print("\n## One level of the hop search\n\n```\n" + tree(paths.new_level(back.met(front), visited, 2)) + "\n```")
        edges = pairs.filter("src != dst").selectExpr("greatest(src, dst) as x", "least(src, dst) as y").distinct()
        edges, _ = t.write(edges, "edges", row_count())
        least, _ = t.write(components.large_minima(edges), "least", row_count())
        print("\n## One large-star round\n\nMinima:\n\n```\n" + tree(components.large_minima(edges)) + "\n```\n\nJoin:\n")
        print("```\n" + tree(components.large_star(edges, least)) + "\n```")
    finally:
        back.drop()
        visited.drop()
        t.drop()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    print(f"# Executed plans ({sf_dir}, local session, AQE on, broadcasts off)\n")
    print("| key | final | shuffle exchanges | reused | broadcasts | BHJ | SMJ | parquet scans | pushed filters (besides IsNotNull) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for k, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()
        s = summarise(plan_text(df))
        pushed = "; ".join(s["pushed"]) or "—"
        print(f"| `{k}` | {'yes' if s['final'] else 'no'} | {s['shuffles']} | {s['reused']} | {s['broadcasts']} | "
              f"{s['bhj']} | {s['smj']} | {s['scans']} | {pushed} |", flush=True)
    level_and_round(spark, sf_dir)
    spark.stop()


if __name__ == "__main__":
    main()
