"""The command line runs end to end on a folder."""

import contextlib
import glob
import io

from treecut.cli import main
from treecut.functions.rules import GOLDEN, python_cascade


def _corpus(tmp_dir):
    texts = {}
    for k, (_g, text, _e) in enumerate(GOLDEN[:6]):
        with open(f"{tmp_dir}/f{k}.txt", "w", encoding="utf-8") as f:
            f.write(text)
        texts[f"f{k}.txt"] = text
    return texts


def test_tokenize_command(spark, tmp_dir):
    texts = _corpus(tmp_dir)
    out = f"{tmp_dir}_parts"
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["tokenize", tmp_dir, "--limit", "60", "--out", out]) == 0
    text = buf.getvalue()
    all_tokens = [t for name in sorted(texts) for t in python_cascade(texts[name])]
    lines = text.splitlines()
    assert sum(int(x.rpartition("(")[2].split()[0]) for x in lines if x.endswith(" tokens)")) == len(all_tokens)
    assert lines[lines.index("batch 0 tokens:") + 1].startswith(",".join(all_tokens[:5]))
    assert f"(tokens:{len(all_tokens)})" in text
    assert all(x in text for x in ("listing ", "tokenising ", "writing "))
    assert f"tokenize {sum(len(t.encode()) for t in texts.values())}b" in text
    written = []
    for part in sorted(glob.glob(f"{out}/batch_id=*/part-*")):
        with open(part, encoding="utf-8") as f:
            written += [t for t in f.read().split("\n") if t]
    assert written == all_tokens and len(glob.glob(f"{out}/batch_id=*")) > 1


def test_compare_command(spark, tmp_dir):
    _corpus(tmp_dir)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["compare", tmp_dir, "--other", "whitespace"]) == 0
    lines = buf.getvalue().splitlines()
    assert lines[-1].startswith("ptb against whitespace: ") and sum("tokens differ" in ln for ln in lines) == 7


def test_compare_with_parts_and_rows(spark, tmp_dir):
    _corpus(tmp_dir)
    out = f"{tmp_dir}_ws"
    with contextlib.redirect_stdout(io.StringIO()):
        assert main(["tokenize", tmp_dir, "--method", "whitespace", "--limit", "60", "--out", out]) == 0
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["compare", tmp_dir, "--parts", out, "--limit", "60", "--rows", "5"]) == 0
        assert main(["compare", tmp_dir, "--parts", out, "--limit", "60", "--base", "whitespace"]) == 0
    lines = buf.getvalue().splitlines()
    assert sum(" at " in x and " #" in x for x in lines) == 5
    assert lines[-1].split(": ")[1].startswith("0 of ")


def test_no_files(spark, tmp_dir):
    assert main(["tokenize", tmp_dir]) == 1 and main(["compare", tmp_dir]) == 1


def test_tokenize_cap_and_method(spark, tmp_dir):
    texts = _corpus(tmp_dir)
    out = f"{tmp_dir}_capped"
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        assert main(["tokenize", tmp_dir, "--method", "whitespace", "--cap", "4", "--out", out]) == 0
    written = []
    for part in sorted(glob.glob(f"{out}/batch_id=*/part-*")):
        with open(part, encoding="utf-8") as f:
            written += [t for t in f.read().split("\n") if t]
    first = [t for name in sorted(texts) for t in texts[name].split()]
    assert f"(tokens:{len(first)})" in buf.getvalue()      # the cap is for the parts alone
    assert written == first[:4]            # one batch (default limit), first 4 whitespace tokens
