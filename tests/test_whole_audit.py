"""The audit queries without a cut: integration pages and hypotheses included."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables are not mounted")


def test_integration_pages_and_hypotheses_count(spark):
    queries = entry.queries()
    facts = {r["classification"]: r["n"] for r in queries["audit_finding_counts"](spark, SF).collect()}["fact"]
    assert facts >= queries["audit_integration_findings"](spark, SF).count() > 0
    kinds = {r["classification"] for r in queries["audit_cross_source"](spark, SF).collect()}
    assert "hypothesis" in kinds
