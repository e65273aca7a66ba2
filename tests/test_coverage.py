"""Coverage of organizations: audits, replaced sources and organizations without any."""

from datetime import datetime, timedelta

import pytest

from jobloom.operators import coverage as C

NOW = datetime(2026, 10, 2, 12)
ORG = "organization_id long, name string, website string, audit string, checked_on date, evidence_url string, notes string"
SOURCE = "organization_id long, source_id long, url string, enabled boolean, has_adapter boolean, superseded_by string, status string, last_attempt timestamp_ntz, last_success timestamp_ntz, partial boolean, open_jobs long, review_jobs long"


def organization(k, audit="not_found", checked=NOW.date(), proof="https://proof.test", notes="n", name=None):
    return (k, name or f"Org {k}", f"https://o{k}.test/", audit, checked, proof, notes)


def source(org, k, success=NOW, status="verified", enabled=True, adapter=True, replaced=None, partial=False, jobs=0, review=0):
    return (org, k, f"https://s{k}.test/jobs", enabled, adapter, replaced, status, success, success, partial, jobs, review)


def rows(spark, orgs, sources=()):
    return C.coverage_rows(spark.createDataFrame(orgs, ORG), spark.createDataFrame(list(sources), SOURCE), NOW)


def test_audits_count_while_current(spark):
    orgs = [organization(1), organization(2, checked=NOW.date() - timedelta(days=91)), organization(3, checked=NOW.date() + timedelta(days=1)), organization(4, proof=""), organization(5, notes=None), organization(6, checked=None), organization(7, "blocked"), organization(8, "")]
    got = {r.organization_id: r.state for r in rows(spark, orgs).collect()}
    assert got == {1: "not_found", 2: "pending", 3: "pending", 4: "pending", 5: "pending", 6: "pending", 7: "unavailable", 8: "pending"}
    one = rows(spark, orgs[:1]).first()
    assert (one.source_id, one.url, one.domain, one.open_jobs, one.audit_current) == (None, "https://o1.test/", "o1.test", 0, True)


def test_health_comes_before_the_audit(spark):
    orgs = [organization(k, "blocked") for k in range(6)]
    found = [source(0, 1), source(1, 2, NOW - timedelta(hours=49)), source(2, 3, jobs=2), source(3, 4, review=1), source(4, 5, partial=True, jobs=3), source(5, 6, None, "discovered", False)]
    assert {r.organization_id: r.state for r in rows(spark, orgs, found).collect()} == {0: "empty", 1: "unavailable", 2: "available", 3: "review", 4: "partial", 5: "unavailable"}


def test_only_replaced_history_is_hidden(spark):
    new = source(1, 1)
    old = [source(1, 2, None, "discovered", False, replaced=new[2]), source(1, 3, None, "discovered", False, replaced="https://other.test"), source(2, 4, None, "discovered", False, replaced=new[2])]
    assert sorted(r.source_id for r in rows(spark, [organization(1), organization(2)], [new, *old]).collect()) == [1, 3, 4]


@pytest.mark.parametrize(("kw", "want"), [
    ({}, {"available": ([9, 8, 7, 6, 5], 10, 5), "not_found": ([10, 11], 2, 0)}),
    ({"bucket": "covered"}, {"available": (list(range(9, -1, -1)), 10, 0)}),
    ({"bucket": "not_found"}, {"not_found": ([10, 11], 2, 0)}),
    ({"search": " ÓRG 1"}, {"available": ([1], 1, 0), "not_found": ([10, 11], 2, 0)}),
    ({"bucket": "what", "preview": 1}, {"available": ([9], 10, 9), "not_found": ([10], 2, 1)}),
])
def test_groups(spark, kw, want):
    made = rows(spark, [organization(k) for k in range(12)], [source(k, k, jobs=k + 1) for k in range(10)])
    got = {}
    for r in C.coverage_groups(made, **kw).orderBy("state", "place").collect():
        got.setdefault(r.state, ([], r.total, r.hidden))[0].append(r.organization_id)
    assert got == want


def test_no_organizations(spark):
    assert rows(spark, []).collect() == []
