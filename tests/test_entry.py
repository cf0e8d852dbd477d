"""Driver contract: entry runs, every query has a name-matched oracle."""

from conftest import SF001

from treecut.plans.queries import REGISTRY

from __spark_entry__ import entry, oracle_sql, queries


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"lang", "files", "bytes", "tokens"}
    assert len(rows) > 0 and all(r.tokens > 0 for r in rows)


def test_every_query_has_an_oracle():
    # The pipeline operators that SQL cannot express are compared by their own tests.
    assert set(REGISTRY) <= set(queries()) and set(REGISTRY) <= set(oracle_sql()) <= set(queries())


def test_small_queries_run(spark):
    qs = queries()
    for name in ["ptb_tokens", "token_table", "corpus_rollup", "previews", "token_diff", "sql_token_rows"]:
        assert qs[name](spark, SF001).count() > 0, name
