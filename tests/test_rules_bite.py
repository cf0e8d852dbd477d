"""Every rule's query changes rows of the tables it runs on."""

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from treecut.plans.queries import REGISTRY, RULE_QUERY_IDS
from treecut.plans.tables import load_text, stress_text


@pytest.fixture(scope="module")
def stressed(spark):
    d = load_text(spark, SF001, "documents")
    return d.select("doc_id", stress_text(F.col("text"), F.col("doc_id")).alias("before")).cache()


@pytest.mark.parametrize("rule", RULE_QUERY_IDS)
def test_rule_changes_rows(spark, stressed, rule):
    out = REGISTRY[f"ptb_rule_{rule}"](spark, SF001)
    assert out.join(stressed, "doc_id").where(F.col("before") != F.col("out_text")).count() > 0
