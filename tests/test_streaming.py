"""ST1-ST3: the stream gives the batch result, in size-bounded chunks."""

import glob
import os
import shutil

from treecut.functions.rules import GOLDEN, python_cascade
from treecut.streaming.stream import chunk_manifest, part_tokens, text_stream, tokenised_stream, totals_to_table, write_parts


def _files(tmp_dir):
    src = f"{tmp_dir}/in"
    os.makedirs(src)
    texts = {}
    for k, (_g, text, _e) in enumerate(GOLDEN):
        if not text:
            continue
        name = f"{src}/f{k:02d}.txt"
        with open(name, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        texts[f"f{k:02d}.txt"] = text
    return src, texts


def test_stream_totals_and_parts(spark, tmp_dir):
    src, texts = _files(tmp_dir)
    q = totals_to_table(tokenised_stream(text_stream(spark, src, max_bytes_per_trigger=200)), "treecut_totals",
                        f"{tmp_dir}/ck1")
    q.awaitTermination()
    row = spark.table("treecut_totals").collect()[0]
    assert row.files == len(texts)
    assert row.bytes == sum(len(t.encode()) for t in texts.values())
    assert row.tokens == sum(len(python_cascade(t)) for t in texts.values())

    out = f"{tmp_dir}/out"
    q = write_parts(text_stream(spark, src, max_bytes_per_trigger=200), out, f"{tmp_dir}/ck2")
    q.awaitTermination()
    chunks = sorted(glob.glob(f"{out}/chunk=*"))
    assert len(chunks) > 1          # the byte limit cut the input into several chunks
    written = []
    for c in chunks:
        for part in sorted(glob.glob(f"{c}/part-*")):
            with open(part, encoding="utf-8") as f:
                written += f.read().split("\n")
        # Files of a chunk come in path order, each one's tokens in reading order.
        own = [t for part in sorted(glob.glob(f"{c}/part-*")) for t in open(part, encoding="utf-8").read().split("\n") if t]
        held = [x for x in texts if all(t in own for t in python_cascade(texts[x]))]
        in_order = [t for x in sorted(held) for t in python_cascade(texts[x])]
        assert own == in_order or len(own) < len(in_order)
    written = [t for t in written if t]
    assert sorted(written) == sorted(t for x in texts.values() for t in python_cascade(x))


def test_restart_processes_only_new_files(spark, tmp_dir):
    src, texts = _files(tmp_dir)
    out, ck = f"{tmp_dir}/out2", f"{tmp_dir}/ck3"
    write_parts(text_stream(spark, src, max_bytes_per_trigger=300), out, ck).awaitTermination()
    first = set(glob.glob(f"{out}/chunk=*"))
    extra = "Restarted streams don't repeat: \"quoted\" text, cannot."
    with open(f"{src}/zz_new.txt", "w", encoding="utf-8") as f:
        f.write(extra)
    write_parts(text_stream(spark, src, max_bytes_per_trigger=300), out, ck).awaitTermination()
    assert first < set(glob.glob(f"{out}/chunk=*"))   # new chunks only, old ones kept
    written = []
    for part in sorted(glob.glob(f"{out}/chunk=*/part-*")):
        with open(part, encoding="utf-8") as f:
            written += [t for t in f.read().split("\n") if t]
    exp = [t for x in list(texts.values()) + [extra] for t in python_cascade(x)]
    assert sorted(written) == sorted(exp)


def _in_order(spark, out):
    got = {}
    for r in part_tokens(spark, out).collect():
        own = got.setdefault(os.path.basename(r.path), {})
        assert r.pos not in own
        own[r.pos] = r.token
    return {name: [own[i] for i in range(len(own))] for name, own in got.items()}


def test_manifest_order_limit_and_restart(spark, tmp_dir):
    src, texts = _files(tmp_dir)
    texts["blank.txt"], texts["large.txt"] = " \n", "it's large, \"quoted\" and more. " * 40
    for name in ("blank.txt", "large.txt"):
        with open(f"{src}/{name}", "w", encoding="utf-8") as f:
            f.write(texts[name])
    out, ck, limit = f"{tmp_dir}/out", f"{tmp_dir}/ck", 300
    write_parts(text_stream(spark, src, max_bytes_per_trigger=limit), out, ck).awaitTermination()
    listed = chunk_manifest(spark, out).collect()
    assert sorted((os.path.basename(r.path), r.bytes, r.tokens) for r in listed) == sorted((n, len(t.encode()), len(python_cascade(t))) for n, t in texts.items())
    for chunk in {r.chunk for r in listed}:
        own = [r for r in listed if r.chunk == chunk]
        assert sum(r.bytes for r in own) <= limit or len(own) == 1
    assert _in_order(spark, out) == {n: python_cascade(t) for n, t in texts.items() if t.strip()}
    # A chunk that was not committed is written again, in its own place.
    texts["zz.txt"] = "Later text, cannot wait."
    with open(f"{src}/zz.txt", "w", encoding="utf-8") as f:
        f.write(texts["zz.txt"])
    write_parts(text_stream(spark, src, max_bytes_per_trigger=limit), out, ck).awaitTermination()
    last = max(r.chunk for r in chunk_manifest(spark, out).collect())
    again = f"{tmp_dir}/again"
    shutil.copytree(ck, again, ignore=lambda folder, names: [n for n in names if folder.endswith("commits") and n in (str(last), f".{last}.crc")])
    write_parts(text_stream(spark, src, max_bytes_per_trigger=limit), out, again).awaitTermination()
    assert _in_order(spark, out) == {n: python_cascade(t) for n, t in texts.items() if t.strip()}


def test_a_batch_is_cut_into_chunks(spark, tmp_dir):
    """One micro-batch, many chunks under the limit, each file's tokens in order."""
    src, texts = _files(tmp_dir)
    texts["large.txt"], texts["f000.txt"] = "it's large, \"quoted\" and more. " * 40, " "
    for name in ("large.txt", "f000.txt"):
        with open(f"{src}/{name}", "w", encoding="utf-8") as f:
            f.write(texts[name])
    out, ck, limit = f"{tmp_dir}/out", f"{tmp_dir}/ck", 300
    for _ in range(2):  # the second run replays the batch
        write_parts(text_stream(spark, src, max_bytes_per_trigger=1 << 20), out, ck, chunk_bytes=limit).awaitTermination()
        assert len(glob.glob(f"{ck}/offsets/[0-9]*")) == 1
        listed = chunk_manifest(spark, out).collect()
        assert sorted((os.path.basename(r.path), r.bytes, r.tokens) for r in listed) == sorted((n, len(t.encode()), len(python_cascade(t))) for n, t in texts.items())
        sizes = {chunk: [r.bytes for r in listed if r.chunk == chunk] for chunk in {r.chunk for r in listed}}
        assert all(sum(x) <= limit or len(x) == 1 for x in sizes.values())
        assert 1 < len(sizes) < len(listed)
        assert [r.chunk for r in sorted(listed, key=lambda r: r.path)] == sorted(r.chunk for r in listed)
        assert _in_order(spark, out) == {n: python_cascade(t) for n, t in texts.items() if t.strip()}
        ck, old = f"{ck}-again", ck
        shutil.copytree(old, ck, ignore=lambda folder, names: names if folder.endswith("commits") else [])


def test_totals_take_many_chunks_at_a_time(spark):
    """The 2.5 MB of sf0.01 are one micro-batch, not one a chunk."""
    from treecut.plans.queries import REGISTRY
    from treecut.session import scratch_path
    before = set(glob.glob(scratch_path(spark, "stream_ck/treecut_stream_totals_*")))
    row = REGISTRY["stream_totals"](spark, "/root/testdata/sf0.01").first()
    (ck,) = set(glob.glob(scratch_path(spark, "stream_ck/treecut_stream_totals_*").removeprefix("file:"))) - before
    assert row.files == 63 and len(glob.glob(f"{ck}/offsets/[0-9]*")) == 1


def test_parts_are_read_back_as_texts(spark, tmp_dir):
    """Every token went through two shuffles and a checkpoint as a row of its own."""
    src, texts = _files(tmp_dir)
    out = f"{tmp_dir}/out"
    write_parts(text_stream(spark, src, max_bytes_per_trigger=1 << 20), out, f"{tmp_dir}/ck", chunk_bytes=300).awaitTermination()
    kept = set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/rdd-*"))
    rows = part_tokens(spark, out)
    assert set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/rdd-*")) == kept
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Tokens are made above all exchanges, whose rows are texts and manifest lines.
    assert plan.index("Generate posexplode") < plan.index("Exchange") and plan.count("split(") == 1
    assert _in_order(spark, out) == {n: python_cascade(t) for n, t in texts.items() if t.strip()}
