"""Pipeline: of copies of a document one whole document is left, no fragment."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as C  # noqa: E402


def test_copies_leave_one_whole_document(spark):
    rng = random.Random(7)
    line = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(30))
    texts = ["\n".join(line() for _ in range(n)) for n in range(3, 21) for _ in range(3)]
    docs = [(1000 * copy + i, t, "en", "p", len(t)) for copy in range(3) for i, t in enumerate(texts)]
    # A copy with lines of its own around it keeps those alone.
    docs.append((9000, f"{(before := line())}\n{texts[0]}\n{(after := line())}", "en", "p", 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    stages = dict(C.STAGES)
    for name in ("line_dedup", "near_dedup"):
        df = C.stored(stages[name](spark, df, ""), f"test-{name}")
        got = sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())
        assert got == [*((i, t, len(t)) for i, t in enumerate(texts)), (9000, f"{before}\n{after}", len(before) + len(after) + 1)]
