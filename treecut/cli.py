"""Command line: the two runs a user of the reference makes, as Spark jobs.

    python -m treecut tokenize PATH [--method ptb|whitespace|ptb_lines]
                                    [--limit BYTES] [--out FOLDER] [--cap N]
    python -m treecut compare PATH [--base ptb] [--other ptb_lines] [--rows N]
    python -m treecut compare PATH --parts FOLDER [--base ptb] [--limit BYTES]

``tokenize`` lists the file or folder (S2/S3) with its sizes, packs the files
into size-bounded batches (W1), tokenises every file (T27), prints each batch's
preview (first 50 and last 10 tokens and the count, L1/L2), the seconds of each
phase and the timing line (A3), and with ``--out`` writes one token part per
batch (S6).  ``--cap`` (off by default) keeps the first tokens of each written
part (L4); counts and previews are of all tokens.  ``compare`` tokenises every
file two ways, or reads one tokenisation back from parts (S7), and prints the
mismatches per file or batch and in total (J1/J2/A4), with ``--rows`` also the
first mismatches with their context (J3).  Everything runs on the session's
cluster; the driver gets one line per batch or file at a time.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tokenize import TOKENISERS
from .operators import batching, compare, stats
from .operators import tokens as tok
from .session import cut_lineage, get_session
from .sources.files import manifest, read_corpus
from .sources.sinks import write_token_parts


def _batched(spark: SparkSession, path: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The files with their texts and batches, and the manifest with its batches."""
    batches = cut_lineage(batching.next_fit(manifest(spark, path), ["path"], "length", limit))
    return read_corpus(spark, path).join(batches.select("path", "batch_id"), "path"), batches


def _tokenize(args) -> int:
    spark = get_session()
    start = time.perf_counter()
    docs, batches = _batched(spark, args.path, args.limit)
    if batches.isEmpty():
        print(f"no files in {args.path}", file=sys.stderr)
        return 1
    for r in batches.orderBy("rank").toLocalIterator():
        print(f"{r.path} {r.length}b batch {r.batch_id}")
    listed = time.perf_counter()
    previews = cut_lineage(tok.batch_previews(docs, "batch_id", ["path"], "text", args.method))
    done = time.perf_counter()
    for r in previews.orderBy("batch_id").toLocalIterator():
        print(f"batch {r.batch_id} tokens:")
        print(r.preview)
    if args.out:
        write_token_parts(docs, args.out, order_cols=("path",), method=args.method, cap=args.cap)
    written = time.perf_counter()
    sizes = batches.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.countDistinct("batch_id").alias("parts")).first()
    n_tokens = previews.agg(F.sum("n_tokens")).first()[0] or 0
    if args.out:
        print(f"{sizes.parts} parts in {args.out}")
    report = stats.RunReport(seconds=written - start, bytes=int(sizes.bytes or 0), tokens=int(n_tokens), files=int(sizes.files))
    print(f"files: {report.files}")
    print(f"seconds: listing {listed - start:.3f}, tokenising {done - listed:.3f}, writing {written - done:.3f}")
    print(report.line())
    return 0


def _compare(args) -> int:
    spark = get_session()
    if args.parts:
        docs, _ = _batched(spark, args.path, args.limit)
        chunks = compare.compare_with_parts(docs, args.parts, order_cols=("path",), method=args.base)
        diffs, rows, key, other = chunks.diff(), chunks.rows, "batch_id", args.parts
    else:
        pairs = compare.file_pairs(spark, args.path, args.base, args.other)
        diffs, rows, key, other = compare.diff_table(pairs, ["path"]), lambda: compare.diff_rows(pairs, ["path"]), "path", args.other
    per_key = cut_lineage(diffs)
    if per_key.isEmpty():
        print(f"nothing to compare in {args.path}", file=sys.stderr)
        return 1
    for r in per_key.orderBy(key).toLocalIterator():
        print(f"{r[key]}: {r.mismatched} of {r.compared} tokens differ")
    if args.rows:
        for r in rows().orderBy(key, "seq").limit(args.rows).toLocalIterator():
            print(f"{r[key]} #{r.seq} {r.kind} at {r.i}/{r.j}: [{r.a_context}] [{r.b_context}]")
    total = compare.mismatch_rollup(per_key).first()
    print(f"{args.base} against {other}: {total.mismatched or 0} of {total.compared or 0} tokens differ")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m treecut")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("tokenize", help="tokenise a file or a folder of files")
    t.add_argument("path")
    t.add_argument("--method", choices=TOKENISERS, default="ptb")
    t.add_argument("--limit", type=int, default=batching.REFERENCE_LIMIT_PY, help="bytes per batch")
    t.add_argument("--out", help="folder for the token parts (replaced)")
    t.add_argument("--cap", type=int, help="tokens kept per written part (default: all)")
    c = sub.add_parser("compare", help="compare two tokenisations file by file")
    c.add_argument("path")
    c.add_argument("--base", choices=TOKENISERS, default="ptb")
    c.add_argument("--other", choices=TOKENISERS, default="ptb_lines")
    c.add_argument("--parts", help="folder of token parts to compare with, batch by batch")
    c.add_argument("--limit", type=int, default=batching.REFERENCE_LIMIT_PY, help="bytes per batch of the parts")
    c.add_argument("--rows", type=int, default=0, help="mismatches to list with their context")
    args = p.parse_args(argv)
    return _tokenize(args) if args.cmd == "tokenize" else _compare(args)


if __name__ == "__main__":
    sys.exit(main())
