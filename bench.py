"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query runs to completion into the ``noop`` sink (all rows computed,
nothing collected); each is timed ``BENCH_RUNS`` times (default 2) and the
best run is reported - the VM's run-to-run noise is large.  A warm-up (the tokeniser over sf0.01 documents) starts
the JVM and its JIT first; it is not timed.
Also reported, as the reference does: bytes, tokens and seconds of one
tokenising pass over ``documents`` (A3 run report), and - as a single-node
reference point, since the baseline publishes only ratios over a Python
Treebank tokeniser - the same ordered regex cascade run by Python ``re`` in
one process over the same documents (``BENCH_PY_BASELINE=0`` skips it).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from treecut.operators.stats import run_report  # noqa: E402
from treecut.plans.derived import documents_as_files  # noqa: E402
from treecut.plans.queries import REGISTRY  # noqa: E402
from treecut.plans.tables import load, load_text  # noqa: E402
from treecut.session import get_session  # noqa: E402

HEADLINE = [
    "ptb_tokens",             # T27 on every document, tokens as text
    "token_table",            # F8: one row per token
    "corpus_totals_by_lang",  # A2: files, bytes, tokens per language
    "ptb_tokens_pages",       # markup-heavy text
    "previews",               # L1/L2 per document
    "token_diff",             # J2: ptb vs whitespace, greedy resync
    "token_diff_rows",        # J3: mismatch listing
    "batch_manifest",         # W1: exact next-fit batching
    "batch_previews",         # L1/L2 per batch
    "token_parts",            # S6 + S7: parts written per batch and read back
    "large_file_tokens",      # S4: files read by lines in parallel, positions in the file
]


def python_cascade_baseline(sf_dir: str) -> dict:
    """The rule cascade in plain Python ``re``, one process (reference point only)."""
    import pyarrow.parquet as pq

    from treecut.functions.rules import python_cascade

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column("text").to_pylist()
    t0 = time.perf_counter()
    n = sum(len(python_cascade(t)) for t in texts if t is not None)
    secs = time.perf_counter() - t0
    nbytes = sum(len(t.encode()) for t in texts if t is not None)
    return {"sec": round(secs, 3), "tokens": n, "bytes": nbytes, "kb_per_s": round(nbytes / 1024 / secs, 1)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", conf={
        "spark.sql.shuffle.partitions": str(2 * cpus),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    })
    spark.sparkContext.setLogLevel("ERROR")

    warm = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    if os.path.isdir(warm):
        REGISTRY["ptb_tokens"](spark, warm).write.format("noop").mode("overwrite").save()

    t0 = time.perf_counter()
    documents_as_files(spark, sf_dir)
    files_written = time.perf_counter() - t0
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            t0 = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        times[name] = round(best, 3)

    rep = min((run_report(load_text(spark, sf_dir, "documents")) for _ in range(runs)), key=lambda r: r.seconds)
    one_task = load(spark, sf_dir, "documents").select("doc_id", "text").coalesce(1)
    one = min((run_report(one_task) for _ in range(runs)), key=lambda r: r.seconds)
    py = python_cascade_baseline(sf_dir) if os.environ.get("BENCH_PY_BASELINE", "1") != "0" else None
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "per_query": f"best of {runs} runs (BENCH_RUNS), after an untimed warm-up",
        "tokenise_documents": {
            "bytes": rep.bytes, "tokens": rep.tokens, "files": rep.files,
            "sec": round(rep.seconds, 3), "kb_per_s": round(rep.kb_per_s, 1),
        },
        "tokenise_documents_one_core": {"sec": round(one.seconds, 3), "kb_per_s": round(one.kb_per_s, 1)},
        "files_written_before_large_file_tokens_sec": round(files_written, 3),
        **({"python_cascade_one_process": py,
            "speedup_vs_python_cascade": round(py["sec"] / rep.seconds, 2)} if py else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
