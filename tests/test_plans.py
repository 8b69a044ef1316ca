"""Plan shape of every query key: no pairing operators, no row-at-a-time Python, pruned scans."""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _keys():
    from folio.plans.queries import QUERIES
    return sorted(QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", _keys())
def test_no_pairing_or_row_udfs(spark, key):
    from folio.plans.queries import QUERIES
    plan = _plan(QUERIES[key](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op} in plan"


def test_scans_read_only_needed_columns(spark):
    from folio.plans.queries import QUERIES
    plan = _plan(QUERIES["chat_retrieve"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas, plan
    for s in schemas:
        assert "lang" not in s and "n_chars" not in s  # documents: only the columns used


def test_topk_is_limited_before_the_shuffle(spark):
    from folio.plans.queries import QUERIES
    df = QUERIES["retrieve_topk"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
