"""Plan shapes that matter at scale (checked on the physical plan text)."""

import re

from conftest import SF01

from treecut.plans.queries import REGISTRY

# A pattern that occurs once per evaluation of the cascade (T15's hinted form).
MARK = "(?=[^' ]')"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cascade_runs_once_in_token_table(spark):
    p = plan(REGISTRY["token_table"](spark, SF01))
    assert p.count(MARK) == 1, p


def test_tokeniser_stays_on_the_jvm(spark):
    for name in ["ptb_tokens", "token_table", "corpus_totals_by_lang", "previews", "token_diff", "sql_ptb_tokens"]:
        p = plan(REGISTRY[name](spark, SF01))
        assert "EvalPython" not in p and "PythonUDF" not in p, name


def test_scan_reads_only_needed_columns(spark):
    p = REGISTRY["corpus_totals_by_lang"](spark, SF01)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas and all(set(re.findall(r"(\w+):", s)) <= {"doc_id", "text", "lang"} for s in schemas), schemas


def test_rollup_expands_numbers_not_text(spark):
    p = plan(REGISTRY["corpus_rollup"](spark, SF01))
    expand_line = next(line for line in p.splitlines() if "Expand" in line)
    assert "text" not in expand_line and p.count(MARK) == 1, p


def test_totals_build_no_token_array(spark):
    p = plan(REGISTRY["corpus_totals"](spark, SF01))
    assert "array_remove" not in p and "Generate" not in p


def test_cascade_is_codegen_and_jit_sized(spark):
    """The cascade runs inside whole-stage codegen, in methods small enough
    for HotSpot to compile (it skips methods over 8,000 bytes of bytecode)."""
    import contextlib
    import io

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ["ptb_tokens", "token_table", "corpus_totals_by_lang", "previews", "token_diff", "retain_k"]:
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                REGISTRY[name](spark, SF01).explain("codegen")
            out = buf.getvalue()
            assert re.search(r"\*\(\d+\) Project \[.*regexp_replace", out) or "regexp_replace" in out, name
            sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", out)]
            assert sizes and max(sizes) < 8000, (name, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
