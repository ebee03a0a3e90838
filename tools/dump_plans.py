"""Write PLANS.md: the physical plan trees of the headline jobs (sf0.1)."""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from ecotally.queries import QUERIES  # noqa: E402
from ecotally.session import build_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n\n")[0].replace("== Physical Plan ==\n", "")
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", text)))
    return head + "\n" + "\n".join(f"ReadSchema: {s}" for s in schemas)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session()
    out = ["# Physical plans of the headline jobs", "",
           f"`explain('formatted')` at `{sf}` before execution (AQE may still coalesce partitions, turn joins into "
           "broadcasts and reuse exchanges at run time). Generated by `tools/dump_plans.py`.", ""]
    for name in HEADLINE:
        out += [f"## {name}", "", "```", tree(QUERIES[name](spark, sf)).rstrip(), "```", ""]
    # how the parcel report is planned when its per-parcel results are too big to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    out += ["## parcel_report, planned as for large inputs", "",
            "Automatic broadcast and AQE off: sort-merge join of the two per-parcel results on the null-free parcel "
            "keys, directly on their aggregation exchanges; the unit exchange is reused (one scan).", "",
            "```", tree(QUERIES["parcel_report"](spark, sf)).rstrip(), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
