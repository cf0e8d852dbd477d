"""File sources and sinks: whole files, manifest, large files by lines, parts."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from treecut.functions.rules import GOLDEN, python_cascade
from treecut.sources.files import (file_token_runs, file_token_table, large_file_tokens, line_ordinals, manifest,
                                   read_corpus, read_lines, read_pieces, read_token_part, read_token_parts,
                                   token_part_runs)
from treecut.sources.sinks import write_token_parts


def _write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_corpus_and_manifest_top_level_only(spark, tmp_dir):
    _write(f"{tmp_dir}/a.txt", "They'll go.")
    _write(f"{tmp_dir}/b.txt", "x,y")
    _write(f"{tmp_dir}/.hidden", "skip me")
    os.makedirs(f"{tmp_dir}/sub")
    _write(f"{tmp_dir}/sub/c.txt", "nested")
    rows = {os.path.basename(r.path): r.text for r in read_corpus(spark, tmp_dir).collect()}
    assert rows == {"a.txt": "They'll go.", "b.txt": "x,y"}
    m = {os.path.basename(r.path): r.length for r in manifest(spark, tmp_dir).collect()}
    assert m == {"a.txt": 11, "b.txt": 3}
    one = read_corpus(spark, f"{tmp_dir}/a.txt").collect()
    assert len(one) == 1 and one[0].text == "They'll go."


def _random_file_text(rng):
    pieces = [g[1] for g in GOLDEN] + ["\n", "\n\n", "\r\n", '"', "it's", ".", "  ", "\t", "end.", "'s\n"]
    return "".join(rng.choice(pieces) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 60)))


def test_large_files_equal_whole_text(spark, tmp_dir):
    rng = random.Random(3)
    texts = {}
    for k in range(40):
        t = _random_file_text(rng)
        if k % 3 == 0:
            t += "\n"
        if k % 7 == 0:
            t = "\n" + t + "\n\n"
        name = f"f{k:03d}.txt"
        if t:
            _write(f"{tmp_dir}/{name}", t)
            texts[name] = t
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # many splits per file
    try:
        table = file_token_table(spark, tmp_dir)
        assert large_file_tokens(spark, tmp_dir).count() == table.count()
        got = {}
        for r in table.collect():
            got.setdefault(os.path.basename(r.path), {})[r.pos] = r.token
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    for name, t in texts.items():
        exp = python_cascade(t)
        toks = got.get(name, {})
        assert [toks[i] for i in range(len(toks))] == exp, name


def test_line_ordinals(spark, tmp_dir):
    _write(f"{tmp_dir}/log.txt", "".join(f"line {i}\n" for i in range(500)))
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = line_ordinals(read_lines(spark, tmp_dir)).select("line", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert sorted((r.line_no, r.line) for r in rows) == [(i, f"line {i}") for i in range(500)]


def test_token_parts_roundtrip(spark, tmp_dir):
    docs = [(k % 3, k, text) for k, (_g, text, _e) in enumerate(GOLDEN)]
    rows = [(b, k, pos, tok) for b, k, text in docs for pos, tok in enumerate(python_cascade(text))]
    df = spark.createDataFrame(docs, "batch_id int, doc_id int, text string").repartition(4)
    out = f"{tmp_dir}/parts"
    write_token_parts(df, out)
    write_token_parts(df, out)      # replaced, not appended
    for b in range(3):
        back = read_token_part(spark, f"{out}/batch_id={b}").collect()
        assert len(back) == 1
        exp = [t for (bb, _d, _p, t) in sorted(rows, key=lambda r: (r[1], r[2])) if bb == b]
        # F5 spaces '...' and '--' inside tokens, as the reference's reader does.
        exp = " ".join(exp).replace("...", " ... ").replace("--", " -- ").split()
        assert back[0].tokens == exp


def test_parts_replace_old_output_under_dynamic_overwrite(spark, tmp_dir):
    out = f"{tmp_dir}/parts"
    a = spark.createDataFrame([(0, 1, "x"), (1, 2, "y")], "batch_id int, doc_id int, text string")
    b = spark.createDataFrame([(0, 1, "z")], "batch_id int, doc_id int, text string")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_token_parts(a, out)
        write_token_parts(b, out)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    import os
    assert sorted(d for d in os.listdir(out) if d.startswith("batch_id=")) == ["batch_id=0"]


EDGE_FILES = ["", "\n", "\n\n", "   ", " \n \n", "a.\n", "it's\n", "it's", "end.\r\n", "end.\r\n\r\n",
              '"quote\n"next', "x\n\"y\" said.\n\n", "one\ntwo.", "'tis\n'twas it.", "a,\nb:\n"]


def test_large_file_edge_cases(spark, tmp_dir):
    for k, text in enumerate(EDGE_FILES):
        _write(f"{tmp_dir}/e{k:02d}.txt", text)
    table = file_token_table(spark, tmp_dir)
    got = {}
    for r in table.collect():
        got.setdefault(os.path.basename(r.path), {})[r.pos] = r.token
    for k, text in enumerate(EDGE_FILES):
        toks = got.get(f"e{k:02d}.txt", {})
        assert [toks[i] for i in range(len(toks))] == python_cascade(text), repr(text)


def test_paths_in_every_form(spark, tmp_dir, monkeypatch):
    import os
    folder = f"{tmp_dir}/a corpus"
    os.makedirs(f"{folder}/below")
    for name in ("a.txt", "b.txt", "below/c.txt"):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write("some text")
    monkeypatch.chdir(tmp_dir)
    # The JVM's working folder is that of the session, so relative paths start there.
    relative = os.path.relpath(folder, spark.sparkContext._jvm.System.getProperty("user.dir"))
    for path in (folder, folder + "/", "file:" + folder, "file://" + folder, "file:///" + folder.lstrip("/"), relative):
        assert read_corpus(spark, path).count() == 2, path
        assert manifest(spark, path).count() == 2, path
        assert read_corpus(spark, f"{path.rstrip('/')}/a.txt").count() == 1, path


def _by_file(table):
    got = {}
    for r in table.collect():
        got.setdefault(os.path.basename(r.path), {})[r.pos] = r.token
    return {name: [toks[i] for i in range(len(toks))] for name, toks in got.items()}


def _long_texts():
    rng = random.Random(11)
    bits = ["word", "it's", "cannot", "wanna", "'tis", "end.", '"', "'", "''", "--", "...", "a,b", "3,4", "(x)", "", "", "\t", "x\ny.", "\r", "``", "...\"", "é", "日本", "can\nnot", "'s", "Gimme"]
    texts = {f"l{k:02d}.txt": " ".join(rng.choice(bits) for _ in range(rng.choice([1, 5, 60, 900]))) for k in range(24)}
    texts["one.txt"] = " ".join(f"w{i}, said \"it's\"." for i in range(2000))
    return texts | {f"g{k:02d}.txt": text + " " + text for k, (_g, text, _e) in enumerate(GOLDEN) if text}


@pytest.mark.parametrize("piece", [1, 1 << 16])
def test_files_cut_at_blanks(spark, tmp_dir, piece):
    """Lines of any length: many pieces, the tokens of the whole text."""
    texts = _long_texts()
    for name, text in texts.items():
        _write(f"{tmp_dir}/{name}", text)
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        pieces = read_pieces(spark, tmp_dir, piece).where(F.col("path").endswith("one.txt"))
        assert pieces.count() >= 8
        got = _by_file(file_token_table(spark, tmp_dir, "blanks", piece))
        plain = {r.path: r.tokens for r in file_token_runs(spark, tmp_dir, "blanks", piece, "whitespace").groupBy("path").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("off", "tokens"))), lambda x: x["tokens"])).alias("tokens")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    for name, text in texts.items():
        assert got.get(name, []) == python_cascade(text), name
    assert {os.path.basename(k): v for k, v in plain.items()} == {name: [t for t in re.split("[ \\t\\n\\x0b\\f\\r]+", text) if t] for name, text in texts.items() if text}


def test_pieces_are_the_text(spark, tmp_dir):
    texts = {"a.txt": "  two  blanks ", "b.txt": " ", "c.txt": "x" * 50, "d.txt": " ".join("abc" for _ in range(100)) + "\n"}
    for name, text in texts.items():
        _write(f"{tmp_dir}/{name}", text)
    rows = read_pieces(spark, tmp_dir, 10).collect()
    for name, text in texts.items():
        own = sorted((r.block, r.lid, r.line) for r in rows if r.path.endswith(name))
        assert " ".join(x[2] for x in own) == (text[:-1] if text.endswith(" ") else text), name
    assert sum(r.path.endswith("d.txt") for r in rows) > 20


def test_edge_files_cut_at_blanks(spark, tmp_dir):
    for k, text in enumerate(EDGE_FILES):
        _write(f"{tmp_dir}/e{k:02d}.txt", text)
    got = _by_file(file_token_table(spark, tmp_dir, "blanks", 1))
    for k, text in enumerate(EDGE_FILES):
        assert got.get(f"e{k:02d}.txt", []) == python_cascade(text), repr(text)


def test_part_runs_are_the_part(spark, tmp_dir):
    docs = [(k % 2, k, f"{text} a...b -- c") for k, (_g, text, _e) in enumerate(GOLDEN)]
    out = f"{tmp_dir}/parts"
    write_token_parts(spark.createDataFrame(docs, "batch_id int, doc_id int, text string"), out)
    for piece in (1, 1 << 16):
        runs = token_part_runs(spark, out, piece=piece).collect()
        for r in read_token_parts(spark, out).collect():
            own = sorted((x.off, x.tokens) for x in runs if x.batch_id == r.batch_id)
            assert [t for _, tokens in own for t in tokens] == r.tokens
            assert [off for off, _ in own] == [sum(len(t) for _, t in own[:i]) for i in range(len(own))]


def test_pieces_of_any_batches(spark, tmp_path):
    """Pieces are cut by the same rule wherever Arrow batches end."""
    from treecut.sources.files import read_pieces
    rng = random.Random(7)
    texts = [" ".join("é" * rng.randrange(9) for _ in range(rng.randrange(1, 60))) + " " * rng.randrange(3) for _ in range(8)]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}.txt").write_text(text, encoding="utf-8")

    def cut(text, least):
        words = text.split(" ")
        out, held, size = [], [], 0
        for word in words[:-1] if text.endswith(" ") else words:
            held.append(word)
            size += len(word) + 1
            if size >= least:
                out.append(" ".join(held))
                held, size = [], 0
        return out + ([" ".join(held)] if held else [])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    try:
        for rows in (1, 3, 7, 10_000):
            spark.conf.set(key, str(rows))
            for least in (1, 6, 40, 5_000):
                got = {}
                for r in read_pieces(spark, str(tmp_path), least).collect():
                    got.setdefault(int(re.search(r"f(\d+)\.txt", r.path).group(1)), []).append((r.lid, r.line, r.file_size))
                for k, text in enumerate(texts):
                    assert [x for _, x, _ in sorted(got.get(k, []))] == cut(text, least), (rows, least, k)
                    assert {size for _, _, size in got.get(k, [])} <= {len(text.encode())}
    finally:
        spark.conf.set(key, was)


def test_long_lines_are_cut_once(spark, tmp_path, monkeypatch):
    """The edge pieces are found among the pieces that were written."""
    from treecut.sources import files
    (tmp_path / "a.txt").write_text("It's one. And two. " * 50, encoding="utf-8")
    seen, edge_lines = [], files._edge_lines
    monkeypatch.setattr(files, "_edge_lines", lambda lines, sep: seen.append(lines) or edge_lines(lines, sep))
    assert files.file_token_table(spark, str(tmp_path), "blanks", 20).count() == 251
    (lines,) = seen
    plan = lines._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Scan text" not in plan and "Scan parquet" in plan


def test_parts_are_tokenised_once(spark):
    """Tokens are made behind the shuffle only, never again in a filter before it (F16)."""
    from treecut.sources.sinks import part_lines
    docs = spark.createDataFrame([(1, 1, "It's one."), (2, 1, " \n "), (3, 2, None), (4, 2, "a b")], "doc_id int, batch_id int, text string")
    rows = part_lines(docs)
    assert sorted(map(tuple, rows.collect())) == [(1, "It\n's\none\n."), (2, "a\nb")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    head, below = plan[:plan.index("RepartitionByExpression")], plan[plan.index("RepartitionByExpression"):]
    assert "split(" in head and "split(" not in below
