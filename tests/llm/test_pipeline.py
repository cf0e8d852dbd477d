"""The pipeline's stages against the brute-force versions of their operators."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline as C  # noqa: E402
import test_decontaminate  # noqa: E402
import test_linededup_runs  # noqa: E402
import test_neardedup  # noqa: E402
from treecut.llm import langid  # noqa: E402


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """Small documents with cases planted, beside the benchmark of sf0.001."""
    sf, out = "/root/testdata/sf0.001", str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    first = docs.where("doc_id = 3").first()
    item = bench.where("item_id = 1").first().text
    planted = [(900, "12345 ..."), (901, first.text), (902, first.text + " one more word"), (903, "some words first " + item), (904, None), (905, first.text), (905, first.text)]
    extra = spark.createDataFrame([(i, t, None if i == 900 else "en", "p", len(t or "")) for i, t in planted], docs.schema)
    docs.unionByName(extra).withColumns({n: F.lit("a column of this name") for n in CLASHING}).write.parquet(f"{out}/documents.parquet")
    bench.write.parquet(f"{out}/benchmark.parquet")
    return out


CLASHING = ["kept", "_row", "row", "_cuts", "_lines", "_text", "_more", "label", "c0", "_n_removed"]


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, written):
    assert [name for name, _ in C.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{written}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{written}/documents.parquet")
    seen = []
    for name, stage in C.STAGES:
        before = rows(docs)
        after = C.stored(stage(spark, docs, written), f"test-{name}")
        if name == "language_id":
            found = langid.identify(docs, langid.learn(docs.where(langid.fold(F.col("doc_id"), 3) != 1)))
            kept = found.where("lang_pred <> 'und' and not ambiguous").select("doc_id").collect()
            assert sorted(r.doc_id for r in kept) == sorted(i for i, _ in rows(after))
            assert not {900, 904} & {i for i, _ in rows(after)}
        elif name == "line_dedup":
            want = [(i, t) for i, _, cut, t in test_linededup_runs.brute(before) if not cut or t.strip()]
            assert sorted(rows(after)) == sorted(want)
            assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        elif name == "near_dedup":
            keep = [row for row, (_, _, _, kept) in zip(before, test_neardedup.brute(before, 5)) if kept]
            assert sorted(rows(after)) == sorted(set(keep))
        elif name == "decontamination":
            bad = {d for d, *_, contaminated in test_decontaminate.brute(before, bench) if contaminated}
            assert sorted(rows(after)) == sorted(x for x in before if x[0] not in bad) and 903 in bad
        if name != "best_fit_packing":
            assert after.dtypes == docs.dtypes
            assert after.where(" or ".join(f"{n} <> 'a column of this name'" for n in CLASHING)).isEmpty()
            seen.append(after.count())
            docs = after
        else:
            assert {r.doc_id for r in after.collect()} == {i for i, _ in before}
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]


def test_run(spark, written):
    got = C.run(spark, written)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(got.columns) and got.count() > 0


def test_empty_documents(spark, tmp_path):
    out = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    assert C.run(spark, out).count() == 0
