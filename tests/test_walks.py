"""Chunks are walked many at a time in spans; lists longer than a span are linked."""

import random

import pytest
from pyspark.sql import functions as F

from treecut.operators import chunked, walks
from treecut.operators.chunked import Chunked, runs_of, windows
from treecut.operators.compare import diff_rows, diff_table

from test_chunked import _edited, _frame, _pairs

COLUMNS = ["seq", "i", "j", "kind", "cost", "a_context", "b_context"]


def _equal(chunks, df, *keys):
    assert sorted(chunks.diff().collect()) == sorted(diff_table(df, list(keys)).collect())
    got, want = (sorted(x.select(*keys, *COLUMNS).collect()) for x in (chunks.rows(), diff_rows(df, list(keys))))
    assert got == want
    return want


@pytest.mark.parametrize("span", [32, 64, 128])
def test_lists_of_many_spans(spark, monkeypatch, span):
    monkeypatch.setattr(chunked, "SPAN", span)
    df = _frame(spark, _pairs(span, 40))
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 32)
    assert chunks.span == span and chunks.spans.agg(F.max("_s")).first()[0] > 3
    assert len(_equal(chunks, df, "k")) > 100


def test_wrong_guesses_of_spans_only_cost_rounds(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.choice([f"w{i}" for i in range(50)]) for _ in range(900)] + list("ab") * 300
    df = _frame(spark, [(base, _edited(rng, base, 30)), (base[:700], base[:650]), (["a"], ["b"]), ([], ["a"])])
    monkeypatch.setattr(chunked, "SPAN", 128)
    good = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 64)
    plain = Chunked._guesses
    monkeypatch.setattr(Chunked, "_guesses", lambda self: plain(self).withColumn("j", F.when(F.col("c") == 0, 0).otherwise(3).cast("bigint")))
    monkeypatch.setattr(Chunked, "_nudged", lambda self, seen: seen)
    bad = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 64)
    assert bad.rounds > good.rounds
    assert _equal(bad, df, "k") == _equal(good, df, "k")


def test_tokens_that_are_null_or_hold_newlines(spark):
    base = ["a", None, "x\ny", "", "b", "c", "d\n", None, "e"] * 30
    other = [t for k, t in enumerate(base) if k % 41 != 7]
    df = spark.createDataFrame([(1, base, other), (2, base[:20], base[:20]), (3, ["a", "b"], ["a", "b"]), (4, None, ["a"]), (None, ["a"], ["b"])], "k int, a array<string>, b array<string>")
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 32)
    assert [r.k for r in chunks.diff().orderBy("k").collect()] == [1, 2, 3, 4]
    known = df.where("k < 4")
    assert sorted(chunks.diff().where("k < 4").collect()) == sorted(diff_table(known, ["k"]).collect())
    got, want = (sorted(x.select("k", *COLUMNS).collect()) for x in (chunks.rows(), diff_rows(known, ["k"])))
    assert got == want and want


def test_keys_of_any_type_and_rows_walked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(walks, "TOGETHER", 200)
    df = _frame(spark, _pairs(4, 30)).select("k", F.struct(F.col("k").cast("string").alias("x"), F.current_timestamp().alias("t")).alias("s"), "a", "b").cache()
    chunks = Chunked(runs_of(df, ["s", "k"], F.col("a")), runs_of(df, ["s", "k"], F.col("b")), ["s", "k"], 40)
    assert len(_equal(chunks, df, "s", "k")) > 20


def test_short_lists_are_exchanged_once(spark):
    """A chunk was a row that was joined with its tokens in every round; now the chunks of
    a span lie in one row, and a list within its first span is never joined."""
    df = _frame(spark, _pairs(5, 12))
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 50)
    assert chunks.spans.count() == df.count()
    plan = chunks.rows()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan


def test_letters_before_a_token():
    import pyarrow as pa
    tokens = pa.array(["a,b", "..", "", "käse", None, "(x)"])
    assert walks._ink(tokens).tolist() == [0, 2, 2, 2, 6, 6, 7]
    assert walks._ink(tokens.slice(2, 2)).tolist() == [0, 0, 4]
    assert walks._ink(pa.array([], pa.string())).tolist() == [0]


def test_spans_find_their_entries(spark, monkeypatch):
    """The place is looked up among the letters of the span itself: no span is walked again
    although the right list has commas in one half only."""
    monkeypatch.setattr(chunked, "SPAN", 1024)
    rng = random.Random(8)
    base = [rng.choice([f"word{i}" for i in range(300)]) for _ in range(9000)]
    other = [t for k, w in enumerate(base) for t in ([w, ","] if k % 1000 < 500 and k % 2 else [w])]
    df = _frame(spark, [(base, other)])
    chunks = Chunked(runs_of(df, ["k"], F.col("a")), runs_of(df, ["k"], F.col("b")), ["k"], 64)
    assert chunks.rounds <= 5
    _equal(chunks, df, "k")


def test_packed_runs(spark, monkeypatch):
    """Runs that come as one text each are only unpacked where a span takes a part."""
    from treecut.operators.compare import packed
    monkeypatch.setattr(chunked, "SPAN", 128)
    df = _frame(spark, _pairs(7, 20))
    lists = [runs_of(df, ["k"], F.col(x)) for x in "ab"]
    chunks = Chunked(*(x.select("k", "off", F.size("tokens").alias("n"), packed("tokens").alias("tokens")) for x in lists), ["k"], 64)
    assert len(_equal(chunks, df, "k")) > 20
    whole = windows(lists[0].withColumn("tokens", packed("tokens")).withColumn("n", F.col("tokens.n")), ["k"], 40, 2, 16)
    assert sorted(whole.collect()) == sorted(windows(lists[0], ["k"], 40, 2, 16).collect())


def test_small_parts_are_one_piece(spark, tmp_dir, monkeypatch):
    """A part was read token by token whatever its size; only larger ones are now."""
    from treecut.sources import files
    from treecut.sources.sinks import write_token_parts
    docs = [(k % 3, k, f"one two-- three...{k} " * (1 + 40 * (k % 3))) for k in range(12)]
    write_token_parts(spark.createDataFrame(docs, "batch_id int, doc_id int, text string"), tmp_dir)
    want = {r.batch_id: r.tokens for r in files.read_token_parts(spark, tmp_dir).collect()}
    for bound, pieces in ((files.WHOLE_PART, 1), (400, 2), (1, 2)):
        monkeypatch.setattr(files, "WHOLE_PART", bound)
        runs = files.token_part_runs(spark, tmp_dir, piece=100).collect()
        got = {b: sorted((r.off, r.tokens) for r in runs if r.batch_id == b) for b in want}
        assert {b: [t for _, tokens in x for t in tokens] for b, x in got.items()} == want
        assert len(got[2]) >= pieces and (pieces > 1 or len(runs) == 3)
        assert bound != 400 or len(got[0]) == 1


def test_marks_are_spaced_in_batches(spark):
    """Splitting once gives what splitting, joining and splitting again gave."""
    from treecut.functions.rules import GOLDEN
    from treecut.functions.tokenize import normalise_marks, ptb_tokens, split_tokens, token_text
    from treecut.operators.compare import batch_token_runs
    texts = [g[1] for g in GOLDEN] + ["a....b ---- c--\n--d ....", "", " \n", None, 'x ."...', "-- -\t- .. ."]
    docs = spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "batch_id int, doc_id int, text string")
    want = [r.t or [] for r in docs.orderBy("doc_id").select(split_tokens(normalise_marks(token_text(ptb_tokens("text")))).alias("t")).collect()]
    runs = [r for r in batch_token_runs(docs).collect()]
    assert sorted(t for r in runs for t in r.tokens) == sorted(t for x in want for t in x)
    assert [t for r in sorted(runs, key=lambda r: (r.off, r.n)) for t in r.tokens] == [t for x in want for t in x]
    plan = batch_token_runs(docs, as_text=True)
    assert plan.schema["tokens"].dataType.typeName() == "struct" and plan.agg(F.sum("n")).first()[0] == sum(map(len, want))
