"""What reading many files by lines costs besides the tokens."""

import os

from pyspark.sql import functions as F
from treecut.plans import derived
from treecut.sources import files as S


def folders(tmp_dir, n):
    for i in range(n):
        os.makedirs(f"{tmp_dir}/file={i}")
        with open(f"{tmp_dir}/file={i}/part.txt", "w") as f:
            f.write(f"It's line {i}.\n\nThe end.\n")
    return f"{tmp_dir}/file=*"


def test_folders_are_listed_by_few_tasks(spark, tmp_dir):
    sc, path = spark.sparkContext, folders(tmp_dir, 300)
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc.setJobGroup("listing", "folders are listed")
    try:
        lines = S.read_lines(spark, path)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= S.LISTING_FACTOR * sc.defaultParallelism < 300
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert lines.count() == 900


def test_tokens_are_written_as_one_text(spark, tmp_dir):
    path = folders(tmp_dir, 3)
    plain, edges = S._plain_and_edges(spark, path, "lines", S.PIECE)
    assert dict(plain.dtypes)["tokens"].startswith("struct<n:int,joined:string")
    got = S.file_token_table(spark, path).where(F.col("path").contains("file=2/")).orderBy("pos").collect()
    assert [(r.pos, r.token) for r in got] == list(enumerate(["It", "'s", "line", "2.", "The", "end", "."]))


def test_many_tasks_write_the_files(spark, monkeypatch):
    sc = spark.sparkContext
    monkeypatch.setattr(derived, "_WRITTEN", {})
    sc.setJobGroup("writing", "files are written")
    try:
        folder = derived.documents_as_files(spark, "/root/testdata/sf0.001")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("writing")]
    assert derived.WRITING_FACTOR * sc.defaultParallelism in [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.file: "".join(x.text + "\n" for x in sorted(r.docs)) for r in docs.groupBy(F.floor(F.col("doc_id") / 16).alias("file")).agg(F.collect_list(F.struct("doc_id", "text")).alias("docs")).collect()}
    got = S.read_corpus(spark, f"{folder}/file=*").withColumn("file", derived.file_number()).collect()
    assert {r.file: r.text for r in got} == want and len(got) == len(want)
