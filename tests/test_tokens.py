"""Token tables, previews and caps against plain-Python brute force."""

from treecut.functions.rules import GOLDEN, python_cascade
from treecut.operators import tokens as tok
from treecut.operators.stats import corpus_rollup, corpus_totals


def _docs(spark):
    rows = [(i, i % 3, g[1]) for i, g in enumerate(GOLDEN)] + [(100, 0, " word" * 120)]
    return spark.createDataFrame(rows, "doc_id long, batch long, text string"), rows


def test_token_table_and_previews(spark):
    df, rows = _docs(spark)
    table = {(r.doc_id, r.pos): r.token for r in tok.token_table(df, ["doc_id"]).collect()}
    prev = {r.doc_id: r for r in tok.previews(df, ["doc_id"]).collect()}
    for doc_id, _b, text in rows:
        toks = python_cascade(text)
        assert [table[(doc_id, k)] for k in range(len(toks))] == toks
        assert (doc_id, len(toks)) not in table
        p = prev[doc_id]
        assert p.n_tokens == len(toks)
        assert p.first_tokens == " ".join(toks[:50]) and p.last_tokens == " ".join(toks[-10:])
        line = "".join(t + "," for t in toks[:50]) + tok.PREVIEW_GAP + "".join(t + "," for t in toks[-10:])
        assert p.preview == line + f"({len(toks)} tokens)"


def test_retain_k_and_corpus_head_tail(spark):
    df, rows = _docs(spark)
    kept = {r.doc_id: r for r in tok.retain_k(df, ["doc_id"], k=3).collect()}
    allrows = []
    for doc_id, _b, text in rows:
        toks = python_cascade(text)
        assert kept[doc_id].kept == " ".join(toks[:3]) and kept[doc_id].n_tokens == len(toks)
        allrows += [(doc_id, k, t) for k, t in enumerate(toks)]
    allrows.sort()
    table = tok.token_table(df, ["doc_id"])
    head = [(r.doc_id, r.pos, r.token) for r in tok.corpus_head(table, ["doc_id", "pos"], 7).collect()]
    tail = [(r.doc_id, r.pos, r.token) for r in tok.corpus_tail(table, ["doc_id", "pos"], 4).collect()]
    assert head == allrows[:7] and tail == allrows[-4:]


def test_output_cap(spark):
    df, rows = _docs(spark)
    cap = 9
    got = sorted((r.batch, r.doc_id, r.pos, r.token) for r in tok.output_cap(df, "batch", ["doc_id"], "text", cap).collect())
    exp = []
    for b in range(3):
        n = 0
        for doc_id, bb, text in sorted(rows):
            if bb != b:
                continue
            for k, t in enumerate(python_cascade(text)):
                if n < cap:
                    exp.append((b, doc_id, k, t))
                n += 1
    assert got == sorted(exp)


def test_totals_and_rollup(spark):
    df, rows = _docs(spark)
    t = corpus_totals(df).collect()[0]
    assert t.files == len(rows)
    assert t.bytes == sum(len(x.encode()) for _d, _b, x in rows)
    assert t.tokens == sum(len(python_cascade(x)) for _d, _b, x in rows)
    roll = {(r.batch, r.level): r.tokens for r in corpus_rollup(df, ["batch"]).collect()}
    assert roll[(None, 1)] == t.tokens
    for b in range(3):
        assert roll[(b, 0)] == sum(len(python_cascade(x)) for _d, bb, x in rows if bb == b)


def test_corpus_previews_tokenise_only_the_edges(spark):
    rows = [(i, "   ") for i in range(30)] + [(100 + i, f"w{i} x{i}.") for i in range(40)] + [(500, " "), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    allrows = sorted((d, k, t) for d, text in rows for k, t in enumerate(python_cascade(text)))
    head = [(r.doc_id, r.pos, r.token) for r in tok.corpus_preview_head(df, ["doc_id"], k=7).collect()]
    tail = [(r.doc_id, r.pos, r.token) for r in tok.corpus_preview_tail(df, ["doc_id"], k=5).collect()]
    assert head == allrows[:7] and tail == allrows[-5:]
    tiny = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.token for r in tok.corpus_preview_head(tiny, ["doc_id"], k=50).collect()] == ["a", "b"]


def test_corpus_previews_tokenise_behind_the_top_k(spark):
    df = spark.createDataFrame([(i, f"w{i} x{i}.") for i in range(40)], "doc_id long, text string")
    for preview in (tok.corpus_preview_head(df, ["doc_id"]), tok.corpus_preview_tail(df, ["doc_id"])):
        plan = preview._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        top = [k for k, line in enumerate(lines) if "TakeOrderedAndProject" in line]
        # Nearer the scan than the lower top-k nothing is tokenised; its own projection is.
        assert len(top) >= 2 and not any("regexp_replace" in line or "_t#" in line for line in lines[max(top) + 1 :]), plan
