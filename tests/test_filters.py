from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attesta.operators.filters import RetrievalFilters, allow_list, compile_filters, scopes_within
from attesta.plans import profiles as P
from attesta.plans.search_tools import SearchRequest


def test_normalisation():
    f = RetrievalFilters(domain_ids=("", "a"), limit=0, neighbor_window=-3, principal_domain_id="  ").normalized()
    assert (f.domain_ids, f.limit, f.neighbor_window, f.principal_domain_id) == (("a",), 1, 0, None)


def test_effective_domains():
    assert RetrievalFilters(principal_domain_id="p", delegated_domain_ids=("q", "p"), domain_ids=("z",)).effective_domains == ("p", "q")
    assert RetrievalFilters(delegated_domain_ids=("q",), domains=("d", "d")).effective_domains == ("d",)
    assert RetrievalFilters(domain_ids=("a",), domains=("d",)).effective_domains == ("a",)


def test_empty_acl_is_open_unless_strict(spark):
    df = spark.createDataFrame([("internal",), ("secret",)], "acl_scope string")
    assert df.where(compile_filters(RetrievalFilters())).count() == 2
    assert df.where(compile_filters(RetrievalFilters(strict_acl=True))).count() == 0


def test_time_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 3, 4)], "ingest_ts timestamp")
    assert df.where(compile_filters(RetrievalFilters(since=datetime(2024, 1, 2), until=datetime(2024, 1, 3)))).count() == 2


def test_missing_column_is_an_error():
    with pytest.raises(ValueError):
        compile_filters(RetrievalFilters(environments=("prod",)), columns=["acl_scope"])


def test_predicate_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("internal", "en", "t")], "acl_scope string, domain_id string, text string").write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c")).where(compile_filters(RetrievalFilters(principal_acl_scopes=("internal",), domain_ids=("en", "fr")))).select("acl_scope")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(domain_id" in plan and "text" not in plan.split("ReadSchema")[1]


def test_scope_and_allow_list(spark):
    df = spark.createDataFrame([(["a", "b"],), (["c"],)], "s array<string>")
    assert [r[0] for r in df.select(scopes_within(F.col("s"), ["a", "b"])).collect()] == [True, False]
    events = spark.createDataFrame([("u1", "r1", None, "m1", "internal"), ("u2", "r1", "m1", "m2", "internal"), ("u1", "r1", "m1", "m3", "other")], "actor_id string, conversation_id string, reply_target string, message_id string, auth_scope string")
    assert [r.message_id for r in events.where(allow_list(["u1"], reply_targets=["m1"])).collect()] == ["m1"]


def test_profiles_never_widen():
    admin, judicial = P.PROFILES["contencioso_administrativo"], P.PROFILES["contencioso_judicial"]
    assert P.scoped_filters(admin, RetrievalFilters(system_ids=("sicat",))).system_ids == ("SICAT",)
    assert P.scoped_filters(judicial, RetrievalFilters()).principal_acl_scopes == ("internal",)
    for bad in (RetrievalFilters(principal_domain_id="criminal"), RetrievalFilters(domain_ids=("criminal",)), RetrievalFilters(principal_acl_scopes=("public",)), RetrievalFilters(delegated_domain_ids=("criminal",)), RetrievalFilters(system_ids=("SIGEF",))):
        with pytest.raises(PermissionError):
            P.scoped_filters(admin, bad)
    widened = P.delegated_request(judicial, SearchRequest("q"), ["sigef"])
    assert widened.filters.effective_domains == ("contencioso_judicial", "encargos_sigef")
    with pytest.raises(PermissionError):
        P.delegated_request(judicial, SearchRequest("q"), ["criminal"])


def test_alias_rules():
    assert P.resolve_domain("Sinquer") == "criminal"
    assert P.resolve_domain("criminal-casework") == "criminal"
    assert P.expand_systems(["EF", "sigef"])[:2] == ("ef", "EF")
    with pytest.raises(PermissionError):
        P.expand_systems(["SICJUT"])
    assert P.infer_domains("scope of work") == ("contraordenacional",)
    assert P.infer_domains("scope of work", whole_words=True) == ()
    with pytest.raises(ValueError):
        P.batch_query(" ")
