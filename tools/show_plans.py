"""Write PLANS.md: the physical operator tree of every query of plans/queries.py.

Usage: python tools/show_plans.py [sf_dir]  (default /root/testdata/sf0.01)
Only the operator tree (from ``explain("formatted")``) and the scan schemas
are kept; the long cascade expressions are left out.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from treecut.plans.queries import REGISTRY  # noqa: E402
from treecut.session import get_session  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    head = text.split("\n\n", 1)[0].replace("== Physical Plan ==\n", "")
    schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*>)", text)))
    return head + ("\n" + "\n".join("ReadSchema: " + s for s in schemas) if schemas else "")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    out = ["# Physical plans of the registered queries", "",
           f"Generated by `tools/show_plans.py` on `{sf_dir}` (initial AQE plans; exchanges, joins,",
           "windows, Python stages and scan schemas are what to look at).", "",
           "The first `Exchange` above each Parquet scan is `spread`: the test tables are single",
           "row-group files read as one task, so they are hashed over 2 x cores before the CPU-heavy",
           "cascade. A large input arrives in many splits and has no such exchange. Broadcasts of",
           "whole tables appear only because the test tables are small (Spark's size check);",
           "`Scan ExistingRDD` is a checkpointed table.", ""]
    for name, fn in REGISTRY.items():
        if name.startswith("ptb_rule_") and name != "ptb_rule_T1":
            continue
        out += [f"## {name}", "", "```", tree(fn(spark, sf_dir)), "```", ""]
    out += ["`ptb_rule_T2` ... `ptb_rule_T24` have the plan of `ptb_rule_T1` (one projection).", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print("wrote", path)


if __name__ == "__main__":
    main()
