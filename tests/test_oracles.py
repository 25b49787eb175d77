"""A cross-section of registered queries against their oracle; all of them with ATTESTRY_ALL=1."""

from __future__ import annotations

import os

import pytest

from attestry import plans
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ["html_to_text", "clean_documents", "exact_duplicates", "vector_topk_cosine", "keyword_topk",
        "fuse_rrf", "match_evidence", "ir_metrics", "latest_baseline", "budget_audit", "usage_rollup"]
NAMES = sorted(plans.oracles()) if os.environ.get("ATTESTRY_ALL") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    problem, *_ = compare(spark, connect(SF), SF, plans.queries()[name], plans.oracles()[name])
    assert not problem


def test_every_oracle_has_a_query():
    assert set(plans.oracles()) <= set(plans.queries())
