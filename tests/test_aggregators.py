"""Payloads of aggregators: the same fields from both shapes, and what is proven of an advert."""

import json
from datetime import date

from pyspark.sql import functions as F

from jobloom.sources import aggregators as A

PAGE = {"title": "Driver", "employer": {"name": "UN"}, "body": "Work.", "dates": {"posted": "2026-03-01T10:00:00+00:00", "closing": "2026-06-01"}, "countries": [{"name": "Bosnia and Herzegovina", "path": "/country/bih"}], "apply": ["https://un.org/x"]}
ITEM = {"item": {"title": "Driver", "description": "Work.", "pubDate": "Sun, 01 Mar 2026 10:00:00 +0000"}, "tags": {"country": "Countries: Bosnia and Herzegovina", "source": "Organization: UN", "closing": "Closing date: 2026-06-01"}, "links": ["https://un.org/x"]}


def read(spark, rows):
    return A.extracted(spark.createDataFrame([(k, f"https://agg.org/{k}", shape, p if isinstance(p, (str, type(None))) else json.dumps(p)) for k, (shape, p) in enumerate(rows)], "id long, url string, shape string, payload string"))


def test_both_shapes_are_the_same(spark):
    one, two = (r.asDict() for r in read(spark, [("page", PAGE), ("item", ITEM)]).orderBy("id").collect())
    assert all(one[c] == two[c] for c in A.FIELDS) and one["error"] is None and one["published"] == date(2026, 3, 1)


def test_what_is_missing(spark):
    rows = [
        ("page", "<html>"), ("page", None), ("other", PAGE), (None, PAGE), ("page", {}), ("page", []), ("page", "null"), ("page", {**PAGE, "employer": "UN"}), ("page", {**PAGE, "countries": "BiH"}), ("page", {**PAGE, "apply": None}),
        ("page", {**PAGE, "dates": {"posted": "soon", "closing": "2026-06-01"}}), ("item", {**ITEM, "tags": {**ITEM["tags"], "source": "Owner: UN"}}), ("item", {**ITEM, "tags": {**ITEM["tags"], "country": "Countries: Korea, Republic of"}}),
    ]
    got = [(r.error, r.countries) for r in read(spark, rows).orderBy("id").collect()]
    assert [e for e, _ in got] == ["no JSON", "no JSON", "unknown shape", "unknown shape", *["fields missing"] * 5, None, None, "fields missing", None]
    assert got[-1][1] == ["Korea", "Republic of"]


def test_several_countries_need_a_sentence(spark):
    two = [{"name": "Serbia", "path": "/country/srb"}, *PAGE["countries"]]
    texts = ["Nice. Residence in BOSNIA & Herzegovina is required. Ask.", "Bosnia and Herzegovina is nice. Work hard.", "We work. Bosnia and Herzegovina!", "The location may be Serbia, Bosnia and Herzegovina or Kosovo.", "Networks of Bosnia and Herzegovina."]
    rows = [("page", {**PAGE, "countries": two, "body": t}) for t in texts] + [("page", {**PAGE, "countries": two[:1], "body": texts[0]}), ("page", PAGE)]
    made = A.candidates(read(spark, rows), date(2026, 5, 1), 2026).orderBy("id").collect()
    assert [r.eligible for r in made] == [True, False, False, True, False, False, True]
    assert made[0].location == "Serbia; Bosnia and Herzegovina. Residence in BOSNIA & Herzegovina is required." and made[1].reason == "no location in the country"


def test_rules_of_candidates(spark):
    rows = [
        ("page", PAGE), ("page", {**PAGE, "dates": {"posted": "2025-12-31", "closing": "2026-06-01"}}), ("page", {**PAGE, "dates": {"closing": "2026-06-01"}}), ("page", {**PAGE, "dates": {"posted": "2026-01-01", "closing": "2026-04-30"}}),
        ("page", {**PAGE, "title": "x" * 900, "apply": ["https://a.org/1", "https://b.org/1"]}), ("page", {**PAGE, "apply": ["ftp://a.org", "https://u:p@a.org/", "HTTPS://A.org/1#f", "https://a.org/1"]}),
    ]
    made = A.candidates(read(spark, rows), date(2026, 5, 1), 2026).orderBy("id").collect()
    assert [(r.eligible, r.in_scope_year, r.year_proven) for r in made] == [(True, True, True), (True, False, False), (True, True, False), (False, True, True), (True, True, True), (True, True, True)]
    assert len(made[4].title) == 400 and made[4].application_url == "" and made[5].application_url == "https://a.org/1" and made[3].reason == "deadline has passed"
    assert len({r.hash for r in made[:4]}) == 4


def test_redirects(spark):
    rows = [("https://un.org/j?b=1&a=2",), ("https://www.agg.org/login",), ("/apply",), (None,), ("https://u:p@un.org",)]
    got = [r.t for r in spark.createDataFrame(rows, "u string").select(A.redirected(F.col("u"), ["agg.org", "www.agg.org"]).alias("t")).collect()]
    assert got == ["https://un.org/j?a=2&b=1", "", "", "", ""]
