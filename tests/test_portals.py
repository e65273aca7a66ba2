"""Small rules of portals: dates, evidence, menus, dry runs, and dates proven by another source."""

from datetime import date

from pyspark.sql import functions as F

from jobloom.operators import admission, registry
from jobloom.sources import payloads


def test_dates(spark):
    rows = [("Sarajevo, 3 de marzo de 2026",), ("31 de Diciembre del 2026 y 1 de enero de 2027",), ("31 de febrero de 2026",), ("3 de march de 2026",), (None,), ("Mar 3, 2026",), ("03/Mar/2026",), ("3.3.2026",)]
    got = [(r.s, r.w) for r in spark.createDataFrame(rows, "t string").select(admission.spanish_date(F.col("t")).alias("s"), admission.worded_date(F.col("t")).alias("w")).collect()]
    day = date(2026, 3, 3)
    assert got == [(day, None), (date(2026, 12, 31), None), (None, None), (None, None), (None, None), (None, day), (None, day), (None, None)]


def test_evidence(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"}), (None, {"x": "y"}), ({"x": "y"}, None), (None, None)], "a map<string,string>, b map<string,string>")
    got = [r.m for r in df.select(registry.evidence_merged(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [{"a": "1", "b": None, "c": "3"}, {"x": "y"}, {"x": "y"}, {}]


def test_menu(spark):
    html = r'<script>x("{\"title\":\"Embassy of A & B\",\"slug\":\"a-b\"},{\"title\":\"\",\"slug\":\"c\"}")</script> {"title":"Embassy of A & B","slug":"a-b"} {"title":"É","slug":"e"}'
    got = [tuple(r) for r in registry.menu_entries(spark.createDataFrame([(1, html), (2, "<p>"), (3, None)], "page_id long, html string")).orderBy("page_id", "title").collect()]
    assert got == [(1, "Embassy of A & B", "a-b", "pending"), (1, "É", "e", "pending"), (2, None, None, None), (3, None, None, None)]


def test_dry_run(spark):
    rows = [(1, "links", "https://x.org/l", "<a href='/2025/03/a'>Old</a><a href='/2026/03/b'>New</a><a href='/c'>No year</a>"), (2, "json", "https://x.org", "{broken"), (2, "links", "https://x.org", "<a href='/d'>D</a>"), (3, "links", "https://x.org", "")]
    found = payloads.listings(spark.createDataFrame(rows, "source_id long, kind string, url string, payload string"))
    got = {r.source_id: (r.reachable, r.leads, r.in_scope) for r in payloads.dry_run(found, 2026).collect()}
    assert got == {1: (True, 3, 2), 2: (False, 0, 0)}


def test_proven_dates(spark):
    day = date(2026, 3, 1)
    own = [("r1", "Driver (G-2)", day, day, True), ("r2", "Cook", day, day, False), ("r3", "Clerk", None, day, True), ("r1", "driver g2", day, date(2026, 2, 1), True), ("r4", "Guard", day, day, None)]
    copies = [(1, "r1", "DRIVER – G2", day), (2, "r2", "Cook", day), (3, "r3", "Clerk", None), (4, "r1", "Driver G2", None), (5, None, "Driver G2", day), (6, "r4", "Guard", day)]
    got = registry.proven_dates(spark.createDataFrame(copies, "job_id long, requisition string, title string, deadline date"), spark.createDataFrame(own, "requisition string, title string, deadline date, published_on date, located boolean"))
    assert {r.job_id: r.published_on for r in got.collect()} == {1: date(2026, 2, 1), 2: None, 3: day, 4: None, 5: None, 6: None}
