"""Does tokenising throughput hold as the data grows?

Usage: python tools/scale_probe.py [sf_dir] [copies ...]   (default sf0.1, copies 1 10)

Reads ``documents`` ``copies`` times (keys shifted, one union, no cross
join), tokenises everything (files, bytes, tokens per language) and prints
one line per size: bytes, tokens, warm seconds, MB/s.
"""

from __future__ import annotations

import os
import sys
import time
from functools import reduce

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from treecut.operators.stats import corpus_totals  # noqa: E402
from treecut.session import get_session, spread  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    sizes = [int(x) for x in sys.argv[2:]] or [1, 10]
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "16", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    for copies in sizes:
        big = reduce(lambda a, b: a.unionByName(b),
                     [docs.withColumn("doc_id", F.col("doc_id") + i * 10**9) for i in range(copies)])
        big = spread(big, "doc_id", factor=max(2, copies))
        best = None
        for _ in range(2):
            t0 = time.perf_counter()
            rows = corpus_totals(big, group_cols=["lang"]).collect()
            secs = time.perf_counter() - t0
            best = secs if best is None else min(best, secs)
        nbytes, ntok = sum(r.bytes for r in rows), sum(r.tokens for r in rows)
        print(f"copies={copies} bytes={nbytes} tokens={ntok} sec={best:.2f} MB/s={nbytes / best / 1e6:.2f}", flush=True)


if __name__ == "__main__":
    main()
