"""A representative set of registered queries against their DuckDB oracles
(sf0.001), the same comparison the driver makes (tools/check_oracle.py runs
all of them)."""

import os
import sys

import duckdb
import pytest
from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import TABLES, digest  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

NAMES = ["ptb_stress", "ptb_rule_T15", "token_table", "corpus_rollup", "batch_manifest", "previews",
         "token_diff", "token_diff_rows", "mismatch_rollup", "sql_token_rows", "token_text", "output_cap",
         "long_line_tokens", "token_diff_rows_chunks", "large_file_compare", "stream_part_tokens", "stream_manifest",
         "compare_parts", "preview_first", "preview_last"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
