"""The tokeniser for SQL users, as SQL functions Catalyst inlines.

``ptb_tokens(s STRING) RETURNS ARRAY<STRING>`` and the table function
``ptb_token_rows(s STRING) RETURNS TABLE(pos BIGINT, token STRING)`` (used
with ``LATERAL``) are SQL-bodied temporary functions: no Python runs per row,
and the plan is the same as with the DataFrame API.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .tokenize import FAST_PLAN, PLAIN_PLAN, SPECIAL, WS_RUN


def spark_sql_str(s: str) -> str:
    """A Spark SQL string literal (backslash escapes are processed there)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def cascade_sql(x: str) -> str:
    """The fast plan as Spark SQL text over the expression ``x`` (a column or
    parameter name), with the same choice of plan per row as the Column form."""
    return (f"CASE WHEN {x} RLIKE {spark_sql_str(SPECIAL)} THEN {_steps_sql(x, FAST_PLAN)} "
            f"ELSE {_steps_sql(x, PLAIN_PLAN)} END")


def _steps_sql(x: str, steps: list[tuple]) -> str:
    for step in steps:
        kind = step[0]
        if kind == "first_quote":
            x = f"(CASE WHEN startswith({x}, '\"') THEN concat('``', substring({x}, 2)) ELSE {x} END)"
        elif kind == "replace":
            x = f"replace({x}, {spark_sql_str(step[1])}, {spark_sql_str(step[2])})"
        elif kind == "regex":
            x = f"regexp_replace({x}, {spark_sql_str(step[1])}, {spark_sql_str(step[2])})"
        elif kind == "pad":
            x = f"concat(' ', {x}, ' ')"
        else:
            raise ValueError(kind)
    return x


def tokens_sql(x: str) -> str:
    return f"array_remove(split({cascade_sql(x)}, {spark_sql_str(WS_RUN)}), '')"


def register_sql_functions(spark: SparkSession) -> None:
    """Create (or replace) the temporary SQL functions in this session."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION ptb_tokens(s STRING)
        RETURNS ARRAY<STRING> RETURN {tokens_sql('s')}""")
    # No filter behind the generator: Spark then generates from the rows of the table
    # itself; else it joins the table with the tokens of its distinct texts.
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION ptb_token_rows(s STRING)
        RETURNS TABLE(pos BIGINT, token STRING)
        RETURN SELECT CAST(pos AS BIGINT) AS pos, token
               FROM (SELECT posexplode({tokens_sql('s')}) AS (pos, token))""")
