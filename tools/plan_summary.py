"""Summarise the physical plans of registered queries from ``explain("formatted")``.

usage: python tools/plan_summary.py [sf_dir] [query ...]

Per query: shuffles (Exchange), broadcasts, join strategies, aggregates, windows, whole-stage
codegen spans, and for every parquet scan its pushed filters and read schema.  Building a plan
runs the small planning actions some operators take (size checks, checkpoints of small tables).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(text: str) -> dict:
    header = text.split("\n\n", 1)[0]
    nodes = re.findall(r"[+\- :]*([A-Za-z]+(?: [A-Za-z]+)*) \(\d+\)", header)
    count = lambda name: sum(1 for n in nodes if n.startswith(name))
    scans = []
    for block in re.split(r"\n\(\d+\) ", text):
        if block.startswith("Scan parquet"):
            loc = re.search(r"Location: .*\[(.*?)\]", block)
            pushed = re.search(r"PushedFilters: (\[.*?\])", block)
            schema = re.search(r"ReadSchema: (struct<.*?>)\n", block + "\n")
            scans.append({"table": os.path.basename(loc.group(1)) if loc else "?",
                          "pushed": pushed.group(1) if pushed else "[]",
                          "columns": len(re.findall(r"[a-z_]+:", schema.group(1))) if schema else 0})
    joins = [n for n in nodes if n.endswith("Join") or "Join " in n]
    return {"exchanges": count("Exchange"), "broadcasts": count("BroadcastExchange"),
            "joins": sorted(set(joins)), "aggregates": sum(1 for n in nodes if n.endswith("Aggregate")), "sort_aggregates": count("SortAggregate"),
            "windows": count("Window"), "codegen_spans": len(set(re.findall(r"codegen id : (\d+)", text))),
            "python": sum(1 for n in nodes if "Python" in n or "InPandas" in n), "scans": scans}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from gridweave.session import get_spark
    from gridweave import plans
    spark = get_spark("local[8]", 8)
    for name, fn in plans.queries().items():
        if (names and name not in names) or name.startswith("stream_"):
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf_dir).explain("formatted")
        s = summarise(buf.getvalue())
        scans = "; ".join(f"{x['table']} cols={x['columns']} pushed={x['pushed']}" for x in s.pop("scans"))
        print(f"{name}: {s} | {scans}", flush=True)


if __name__ == "__main__":
    main(sys.argv)
