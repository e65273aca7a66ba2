"""Admission, editing, display and coverage rules against stated cases."""

from datetime import date, datetime

from pyspark.sql import functions as F

from jobloom.functions import display
from jobloom.operators import admission, board, coverage, editing, ranking, registry

TODAY, NOW = date(2026, 10, 2), datetime(2026, 10, 2, 12)


def test_links(spark):
    found = spark.createDataFrame(
        [(1, "https://a.test/1", "A", 1, True), (1, "https://a.test/1", "A", 0, True), (1, "https://a.test/2025/03/x", "B", 2, True), (1, "https://a.test/2026/3/x", "C", 3, True), (2, "https://b.test/" + "x" * 1000, "D", 4, False)],
        "source_id long, url string, title string, pos long, partial boolean",
    )
    known = spark.createDataFrame([(1, "https://a.test/old", "O"), (1, "https://a.test/1", "A"), (2, "https://b.test/old", "O")], "source_id long, url string, title string")
    got = {(r.source_id, r.url, r.pos, r.known_only) for r in admission.links(found, known, 2026).collect()}
    assert got == {(1, "https://a.test/1", 0, False), (1, "https://a.test/2026/3/x", 3, False), (1, "https://a.test/old", None, True)}
    assert {(r.links, r.error is None) for r in admission.over_limit(admission.links(found, known, 2026), 2).collect()} == {(3, False)}


def test_urls(spark):
    rows = [("https://a.test/x", True), ("https://u:p@a.test/", False), ("ftp://a.test", False), ("https:///x", False), (None, False), ("not a url", False), ("HTTP://A.test", True)]
    df = spark.createDataFrame(rows, "url string, want boolean")
    assert df.where(admission.safe_url(F.col("url")) != F.col("want")).count() == 0
    hosts = spark.createDataFrame([("https://x.a.test/1", "https://a.test/", True), ("https://b.test/1", "https://a.test/", False), ("https://xa.test/1", "https://a.test/", False)], "url string, listing string, want boolean")
    assert hosts.where(admission.same_host(F.col("url"), F.col("listing")) != F.col("want")).count() == 0


def test_archive(spark):
    rows = [(1, "a", date(2026, 1, 1), True, False, False, True, True), (1, "b", date(2027, 1, 1), True, False, False, True, True), (1, "c", None, True, False, True, True, False), (1, "d", date(2026, 1, 1), True, True, False, True, True), (1, "e", date(2026, 1, 1), False, False, False, True, True)]
    df = spark.createDataFrame(rows, "source_id long, url string, deadline date, in_scope_year boolean, excluded boolean, withdrawn boolean, qualified boolean, year_proven boolean")
    known = spark.createDataFrame([(1, "x")], "source_id long, url string")
    assert {(r.url, r.public) for r in admission.backfill(df, known, TODAY).collect()} == {("a", True), ("c", False)}
    assert [tuple(r) for r in admission.backfill_summary(admission.backfill(df, known, TODAY)).collect()] == [(1, 2, 1)]
    assert {r.url for r in admission.admitted(df, spark.createDataFrame([(1, "d")], "source_id long, url string"), TODAY).collect()} == {"b", "d"}


def test_a_failed_source_stays(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "source_id long, v string")
    run = spark.createDataFrame([(1, "new"), (2, "new")], "source_id long, v string")
    got = {(r.source_id, r.v) for r in admission.written(stored, run, run.where("source_id = 2")).collect()}
    assert got == {(1, "new"), (2, "old"), (3, "old")}


def test_portal_fields(spark):
    row = spark.range(1).select(
        admission.us_date(F.lit("Open Period: 6/5/2026 - 7/1/2026")).alias("us"), admission.local_day(F.lit(datetime(2026, 5, 2, 2)), 3).alias("day"),
        admission.evidence(F.lit("T"), F.lit(date(2026, 1, 2)), F.lit(None).cast("date"), F.lit("Body")).alias("text"),
        admission.labelled(F.array(F.lit("Duty Station(s)"), F.lit("X")), F.array(F.lit("Tuzla"), F.lit("y")), "Duty station", "Duty Station(s)").alias("v"),
    ).first()
    assert (row.us, row.day, row.text, row.v) == (date(2026, 6, 5), date(2026, 5, 1), "T. Published 2026-01-02. Body", "Tuzla")


def test_translations(spark):
    base = {"job_id": 1, "text": "Write to hr@a.test or https://a.test/x.", "content_hash": "h", "disabled": False, "exported_hash": "h", "extra": [], "title": "T", "summary": "s", "how_to_apply": None, "responsibilities": None, "requirements": ["r"]}
    cases = [({}, None), ({"disabled": True}, "translation is disabled"), ({"exported_hash": "g"}, "text changed after export"), ({"extra": ["x"]}, "unknown field"), ({"title": "  "}, "empty title"),
             ({"title": "x" * 900}, None), ({"how_to_apply": "HR@a.test."}, None), ({"requirements": ["see https://b.test/x"]}, "contact not in source"), ({"responsibilities": ["a"] * 8 + ["m@b.test"]}, None), ({"text": None, "summary": "m@b.test"}, "contact not in source")]
    schema = "job_id long, text string, content_hash string, disabled boolean, exported_hash string, extra array<string>, title string, summary string, how_to_apply string, responsibilities array<string>, requirements array<string>"
    df = spark.createDataFrame([tuple((base | change | {"job_id": k})[c.split()[0]] for c in schema.split(", ")) for k, (change, _) in enumerate(cases)], schema)
    assert {r.job_id: r.error for r in editing.translation_errors(df).collect()} == dict(enumerate(w for _, w in cases))
    jobs = spark.createDataFrame([(1, "h", "h", None, {"en": "E"}), (2, "h", "g", None, {"en": "E"}), (3, "h", None, True, {"en": "E"})], "job_id long, content_hash string, translated_hash string, disabled boolean, titles map<string,string>")
    assert [r.job_id for r in editing.pending_translations(jobs).collect()] == [2]
    assert [r.t for r in jobs.select(editing.current_title().alias("t")).collect()] == ["E", None, None]


def test_editors_decisions(spark):
    jobs = spark.createDataFrame(
        [(1, "published", "", True, date(2026, 11, 1), None, None), (2, "review", "", True, None, None, None), (3, "published", "", False, None, None, None), (4, "published", "", True, date(2026, 1, 1), None, True)],
        "job_id long, status string, closed_reason string, enabled boolean, deadline date, last_reviewed date, disabled boolean",
    )
    copies = spark.createDataFrame([(1, 9), (2, 9)], "job_id long, duplicate_of long")
    assert {r.job_id: r.error for r in editing.publish_errors(jobs, copies, TODAY).collect()} == {1: "copy of an official record", 2: None, 3: "source is disabled", 4: "deadline has passed"}
    assert editing.review_queue(jobs, copies).count() == 0 and editing.review_queue(jobs, copies.where("job_id = 1")).count() == 1
    chosen = jobs.select("job_id")
    for action, changed in (("close", {1, 2, 3, 4}), ("renew", {1, 3, 4}), ("disable", {1, 2, 3})):
        after, log = editing.bulk(jobs, chosen, action, NOW)
        assert after.columns == jobs.columns and {r.job_id for r in log.collect()} == changed, action
    assert {r.last_reviewed for r in editing.bulk(jobs, chosen, "renew", NOW)[0].where("status = 'published'").collect()} == {TODAY}
    assert {s: editing.by_deadline_state(jobs, s, TODAY).count() for s in ("open", "past", "none", "all")} == {"open": 1, "past": 1, "none": 2, "all": 4}
    stamps = spark.createDataFrame([("open", NOW), ("resolved", None), ("resolved", datetime(2026, 1, 1))], "status string, at timestamp_ntz")
    assert [r.s for r in stamps.select(editing.resolved_at(F.col("status"), F.col("at"), NOW).alias("s")).collect()] == [None, NOW, datetime(2026, 1, 1)]


def test_display(spark):
    row = spark.createDataFrame(
        [(["bachelor", "master"], "bachelor", 2, 2, ["law", "it", "health"], ["en"], ["de"], "required", "eu", "remote", None, "G5", None, None, {"education": "q"})],
        "levels array<string>, education_level string, experience_years int, years int, fields array<string>, required array<string>, desirable array<string>, licence string, citizenship string, remote string, work_time string, grade string, duration string, salary string, quotes map<string,string>",
    ).select(display.tags().alias("tags"), display.requirement_rows().alias("rows"), display.term_rows().alias("terms")).first()
    assert row.tags == ["bachelor", "2+ years", "law", "it", "driving licence", "remote"]
    assert [(r.label, r.value) for r in row.rows] == [("education", "bachelor (also master)"), ("field", "law, it, health"), ("experience", "2 years"), ("languages", "en, de (asset)"), ("licence", "required"), ("citizenship", "eu")]
    assert [r.label for r in row.terms] == ["grade", "remote"] and row.rows[0].quote == "q"
    counts = spark.createDataFrame([(1, "bs", "g"), (3, "bs", "e"), (12, "bs", "a"), (1, "en", "y"), (21, "en-GB", "ys")], "n int, l string, want string")
    assert counts.where(display.plural(F.col("n"), F.col("l"), ("g", "e", "a"), ("y", "ys")) != F.col("want")).count() == 0


def test_sources(spark):
    s = spark.createDataFrame(
        [(1, 1, "u1", True, True, None), (2, 1, "u2", False, True, "u1"), (3, 1, "u3", False, True, "u9"), (4, 2, "u4", False, True, "u1")], "source_id long, organization_id long, url string, enabled boolean, has_adapter boolean, superseded_by string"
    )
    assert {r.source_id for r in coverage.without_superseded(s).collect()} == {1, 3, 4}
    audits = spark.createDataFrame([("blocked", date(2026, 9, 1), "u", "n"), ("blocked", date(2026, 1, 1), "u", "n"), ("blocked", date(2026, 9, 1), "", "n")], "audit string, checked_on date, evidence_url string, notes string")
    rows = audits.selectExpr("*", "'pending' as status", "false as enabled", "cast(null as timestamp_ntz) as last_attempt", "cast(null as timestamp_ntz) as last_success", "false as partial", "0L as open_jobs", "0L as review_jobs")
    assert [r.state for r in coverage.coverage_status(rows, NOW).collect()] == ["unavailable", "pending", "pending"]


def test_matching_titles_and_citizenship(spark):
    jobs = spark.createDataFrame([(1, "Vozač", ["Driver"], "bih"), (2, "Driver", None, None)], "job_id long, title string, translated_titles array<string>, citizenship string")
    jobs = jobs.selectExpr("*", "'' as city", "'x' as opportunity_type", "'' as education_level", "cast(null as int) as experience_years", "date'2026-01-01' as first_seen", "'' as remote", "array('f') as fields", "array('en') as languages")
    profiles = spark.createDataFrame([(1, "driver", "no")], "user_id long, want_role string, want_work string").selectExpr(
        "*", "'' as want_city", "false as want_remote", "'' as want_type", "'' as want_field", "'' as want_education", "cast(null as int) as want_experience", "cast(null as array<string>) as want_languages", "false as must_city", "false as must_remote", "false as must_type"
    )
    got = {r.job_id: (r.score, r.cautions) for r in ranking.matches(jobs, profiles).collect()}
    assert got == {1: (4, ["citizenship"]), 2: (4, ["right to work"])}


def test_limits_across_hours(spark):
    rows = [(1, datetime(2026, 1, 1, 10, 30 + k)) for k in range(5)] + [(1, datetime(2026, 1, 1, 11, 20)), (1, datetime(2026, 1, 1, 11, 50)), (2, datetime(2026, 1, 1, 11, 50))]
    got = sorted((r.client, r.before, r.limited) for r in coverage.limited(spark.createDataFrame(rows, "client long, ts timestamp_ntz")).collect())
    assert got == [(1, 0, False), (1, 1, False), (1, 1, False), (1, 2, False), (1, 3, False), (1, 4, False), (1, 5, True), (2, 0, False)]


def test_registry_columns(spark):
    row = spark.createDataFrame([("Embassy of Italy", None), ("UNICEF - Fund", None), ("Ambasada Italije", ""), ("x", "SN")], "name string, short string")
    assert [r.m for r in row.select(registry.monogram(F.col("name"), F.col("short")).alias("m")).collect()] == ["IT", "UNICEF", "IT", "SN"]
    assert [r.name for r in board.by_name(spark.createDataFrame([("Žuta",), ("alfa",), ("Čista",), ("Beta",)], "name string")).collect()] == ["alfa", "Beta", "Čista", "Žuta"]
    assert row.select(registry.seconds_to_next_hour(F.lit(datetime(2026, 1, 1, 10, 59)).cast("timestamp"))).first()[0] == 60
