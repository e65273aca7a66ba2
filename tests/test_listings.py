"""Lifecycle, coverage, identity, ranking, exchange and payload operators against stated cases."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobloom.operators import board, coverage, dedup, exchange, lifecycle, ranking
from jobloom.plans import fixtures
from jobloom.sources import payloads

DAY = date(2026, 10, 2)


def listing(spark, *rows):
    """job_key, eligible, proven, withdrawn, deadline, hash of what a scan found."""
    return spark.createDataFrame([(k, k, dl, h, e, p, w, "") for k, e, p, w, dl, h in rows], "job_key string, new_title string, new_deadline date, new_hash string, eligible boolean, proven boolean, withdrawn boolean, reason string")


def stored(spark, *rows):
    """job_key, status, closed_reason, deadline, hash, reviewed, misses, protected, ai_fields."""
    return spark.createDataFrame(
        [(k, k, dl, s, c, h, "", p, a, r, m) for k, s, c, dl, h, r, m, p, a in rows],
        "job_key string, title string, deadline date, status string, closed_reason string, hash string, review_reason string, protected array<string>, ai_fields array<string>, reviewed boolean, misses int",
    )


OPEN, OVER = date(2026, 11, 1), date(2026, 9, 1)


@pytest.mark.parametrize(
    "old,found,want",
    [
        (None, ("a", True, True, False, OPEN, "h"), ("published", "", 0)),
        (None, ("a", True, False, False, OPEN, "h"), ("review", "", 0)),
        (("a", "published", "", OPEN, "h", False, 0, [], []), None, ("published", "", 1)),
        (("a", "published", "", OPEN, "h", False, 1, [], []), None, ("closed", "missing", 2)),
        (("a", "published", "", OPEN, "h", False, 1, [], []), ("a", True, True, False, OPEN, "h"), ("published", "", 0)),
        (("a", "closed", "missing", OPEN, "h", False, 2, [], []), ("a", True, True, False, OPEN, "h"), ("published", "", 0)),
        (("a", "closed", "manual", OPEN, "h", False, 0, [], []), ("a", True, True, False, OPEN, "h"), ("closed", "manual", 0)),
        (("a", "closed", "deadline", OVER, "h", False, 0, [], []), ("a", True, True, False, OPEN, "h2"), ("published", "", 0)),
        (("a", "published", "", OPEN, "h", False, 0, [], []), ("a", False, True, False, OVER, "h2"), ("closed", "deadline", 0)),
        (("a", "published", "", OPEN, "h", True, 0, [], []), ("a", False, True, False, OPEN, "h"), ("published", "", 0)),
        (("a", "published", "", OPEN, "h", True, 0, [], []), ("a", False, True, False, OPEN, "h2"), ("review", "", 0)),
        (("a", "published", "", OPEN, "h", False, 0, [], ["city"]), ("a", True, True, False, OPEN, "h2"), ("review", "", 0)),
        (("a", "review", "", OPEN, "h", False, 0, ["title"], []), ("a", True, True, False, OPEN, "h"), ("review", "", 0)),
        (("a", "published", "", OPEN, "h", False, 0, [], []), ("a", True, True, True, OPEN, "h"), ("closed", "withdrawn", 0)),
    ],
)
def test_upsert_rules(spark, old, found, want):
    got = lifecycle.upserted(stored(spark, *([old] if old else [])), listing(spark, *([found] if found else [])), DAY).collect()
    assert [(r.status, r.closed_reason, r.misses) for r in got] == [want]


def test_snapshots_keep_returns(spark):
    rows = [(1, k, t) for k, t in enumerate(["A", "A", "B", "A", None, None])]
    got = lifecycle.changed_snapshots(spark.createDataFrame(rows, "page_id long, scan long, text string"))
    assert [r.scan for r in got.orderBy("scan").collect()] == [0, 2, 3, 4]


def test_misses_reset(spark):
    rows = [(1, k, s) for k, s in enumerate([True, False, True, False, False, False])] + [(2, 0, False), (2, 1, True)]
    got = lifecycle.missed_closures(spark.createDataFrame(rows, "job_id long, scan long, seen boolean")).collect()
    assert [(r.job_id, r.closed_at) for r in got] == [(1, 4)]


def test_winners_are_not_components(spark):
    """A matches B and B matches C, but A does not match C: A and C show."""
    rows = spark.createDataFrame([(1, False, date(2026, 1, 1)), (2, False, date(2026, 1, 2)), (3, False, date(2026, 1, 3)), (4, True, date(2025, 1, 1)), (5, True, date(2024, 1, 1))], "job_id long, aggregator boolean, first_seen date")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a long, b long")
    assert sorted(r.job_id for r in dedup.winners(rows, pairs).collect()) == [1, 3, 5]
    blocked = spark.createDataFrame([(5,)], "job_id long")
    assert sorted(r.job_id for r in dedup.winners(rows, pairs, blocked).collect()) == [1, 3]


def test_winners_equal_the_greedy_walk(spark):
    import random

    rng = random.Random(4)
    rows = [(k, rng.random() < 0.3, date(2026, 1, rng.randint(1, 9))) for k in range(60)]
    pairs = list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)})
    kept: list[int] = []
    for k, _, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if not any((min(k, x), max(k, x)) in pairs for x in kept):
            kept.append(k)
    got = dedup.winners(spark.createDataFrame(rows, "job_id long, aggregator boolean, first_seen date"), spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r.job_id for r in got.collect()) == sorted(kept)


def vacancy(i, source, published, url="", city="Sarajevo", employer="UNICEF", title="Project Officer", deadline=OPEN):
    return (i, source, published, url, "", employer, city, deadline, title)


@pytest.mark.parametrize(
    "right,same",
    [
        (vacancy(2, 2, DAY), True),
        (vacancy(2, 1, DAY), False),
        (vacancy(2, 2, date(2026, 7, 1)), False),
        (vacancy(2, 2, None), True),
        (vacancy(2, 2, DAY, city="Mostar"), False),
        (vacancy(2, 2, DAY, employer="UNICEF u Bosni i Hercegovini", title="PROJECT  officer"), True),
        (vacancy(2, 2, DAY, deadline=None), False),
        (vacancy(2, 2, DAY, url="https://e.test/job/42?utm_source=x", title="Other"), True),
        (vacancy(2, 2, DAY, url="https://e.test/careers", title="Other"), False),
    ],
)
def test_same_vacancy(spark, right, same):
    schema = "job_id long, source_id long, published_on date, canonical_url string, application_url string, employer string, city string, deadline date, title string"
    left = vacancy(1, 1, DAY, url="https://www.e.test/job/42" if "42" in right[3] else "https://e.test/careers")
    got = dedup.same_vacancy(dedup.identity_keys(spark.createDataFrame([left, right], schema))).collect()
    assert [(r.a, r.b) for r in got] == ([(1, 2)] if same else [])


def many_vacancies():
    """Jobs of few keys, days and sources, some without a day, so that many match by one key or by several."""
    import random

    rng = random.Random(11)
    days = [None, *[DAY + timedelta(days=k) for k in (0, 1, 44, 45, 46, 90, 91, 200)]]
    urls = ["", "", "https://e.test/job/1", "https://e.test/job/2"]
    rows = [(i, rng.randint(1, 4), rng.choice(days), rng.choice(urls), rng.choice(urls), rng.choice("EF"), "City", OPEN if rng.random() < 0.8 else None, rng.choice("TU")) for i in range(160)]
    return [(*r, r[1] > 2, r[2] or DAY) for r in rows]


MANY = "job_id long, source_id long, published_on date, canonical_url string, application_url string, employer string, city string, deadline date, title string, aggregator boolean, first_seen date"


def test_links_and_winners_equal_those_of_all_pairs(spark):
    jobs = spark.createDataFrame(many_vacancies(), MANY)
    keys = dedup.identity_keys(jobs).localCheckpoint()
    pairs = dedup.same_vacancy(keys).localCheckpoint()
    both = [(r.a, r.b) for r in pairs.collect()]
    links = {r.job_id: 0 for r in jobs.collect()}
    for pair in both:
        for i in pair:
            links[i] += 1
    got = dedup.vacancy_links(jobs, keys).collect()
    assert {r.job_id: r.links for r in got} == links and max(links.values()) > 40
    near = {i: {b if a == i else a for a, b in both if i in (a, b)} for i in links}
    of = {r.job_id: r.class_id for r in got}
    assert len(set(of.values())) < len(of) and all(c <= i and near[c] == near[i] and of[c] == c for i, c in of.items())
    blocked = spark.createDataFrame([(3,), (10,)], "job_id long")
    for left_out in (None, blocked):
        assert sorted(r.job_id for r in dedup.shown(jobs, keys, left_out).collect()) == sorted(r.job_id for r in dedup.winners(jobs, pairs, left_out).collect())
    kind = {r.job_id: r.aggregator for r in jobs.collect()}
    want = {i: min(k for k in near[i] if not kind[k]) for i in links if kind[i] and any(not kind[k] for k in near[i])}
    assert {r.job_id: r.duplicate_of for r in dedup.official_duplicates(jobs, keys).collect()} == want
    assert {r.job_id: r.duplicate_of for r in dedup.copies_of_official(jobs).collect()} == want


def test_no_pairs_are_made(spark):
    """Two hundred copies of one vacancy and day: no join of theirs makes more rows than there are jobs."""
    rows = [(i, i % 4, DAY, "", "", "E", "City", OPEN, "T", i % 4 > 1, DAY) for i in range(200)]
    keys = dedup.identity_keys(spark.createDataFrame(rows, MANY))
    offered = keys.withColumnRenamed("job_id", "v")
    assert dedup.best_matches(keys, offered).count() == 4
    got = dedup.vacancy_links(spark.createDataFrame(rows, MANY), keys).collect()
    assert {r.links for r in got} == {150} and {r.class_id for r in got} == {0, 1, 2, 3}


def test_streaks_and_waits(spark):
    rows = [(k, 1, datetime(2026, 1, 1, k), s) for k, s in enumerate([True, False, False, True, False])] + [(9, 2, datetime(2026, 1, 1), False)]
    runs = spark.createDataFrame(rows, "run_id long, source_id long, started_at timestamp_ntz, success boolean")
    assert {r.source_id: r.failures for r in coverage.current_failures(runs).collect()} == {1: 1, 2: 1}
    assert [r.failures for r in coverage.streaks(runs).where("source_id = 1").orderBy("run_id").collect()] == [0, 1, 2, 0, 1]
    got = spark.createDataFrame([(0, 1), (1, 1), (3, 1), (9, 1), (2, 24)], "f long, h int").select(coverage.wait_hours(F.col("f"), F.col("h"))).collect()
    assert [r[0] for r in got] == [1, 2, 8, 24, 24]


def test_failure_category(spark):
    rows = [("HTTP 403",), ("Redirect host x",), ("Read timed out",), ("response changed shape",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "e string").select(coverage.failure_category(F.col("e"))).collect()]
    assert got == ["upstream_block", "redirect", "upstream_transient", "parse_or_validation", "parse_or_validation"]


def test_visible_edges(spark):
    rows = [
        (1, "published", True, DAY, date(2026, 1, 1), None), (2, "published", True, date(2026, 10, 1), date(2026, 10, 1), None), (3, "published", True, None, date(2026, 9, 10), None),
        (4, "published", True, None, date(2026, 1, 1), date(2026, 9, 20)), (5, "published", True, None, date(2026, 1, 1), None), (6, "published", False, OPEN, DAY, None), (7, "review", True, OPEN, DAY, None),
    ]
    df = spark.createDataFrame(rows, "job_id long, status string, enabled boolean, deadline date, first_seen date, last_reviewed date")
    assert sorted(r.job_id for r in board.visible(df, DAY).collect()) == [1, 3, 4]
    assert sorted(r.job_id for r in df.where(board.not_before("deadline", DAY)).collect()) == [1, 3, 4, 5, 6, 7]


def test_visible_shows_a_vacancy_once(spark):
    """Copies of shown and of withdrawn official records, and repeats of other sources, do not show."""
    rows = [(1, 1, False, "published", "Role"), (2, 2, True, "published", "role"), (3, 3, False, "published", "Role"), (4, 1, False, "review", "Withdrawn"), (5, 2, True, "published", "Withdrawn"),
            (6, 2, True, "published", "Alone"), (7, 1, False, "published", "Role")]
    df = spark.createDataFrame(
        [(i, s, a, st, True, OPEN, DAY, None, DAY, "Employer", "City", t) for i, s, a, st, t in rows],
        "job_id long, source_id long, aggregator boolean, status string, enabled boolean, deadline date, first_seen date, last_reviewed date, published_on date, employer string, city string, title string",
    )
    assert sorted(r.job_id for r in board.visible(df, DAY).collect()) == [1, 6, 7]


def test_matches_and_digest(spark):
    jobs = spark.createDataFrame(
        [(1, "Urgent Help", "NATION_1", "BUILDING", "bachelor", 3, date(2026, 1, 1), None, ["f1"], ["en"]), (2, "Other", "", "BUILDING", "", None, date(2026, 1, 2), None, [], [])],
        "job_id long, title string, city string, opportunity_type string, education_level string, experience_years int, first_seen date, remote string, fields array<string>, languages array<string>",
    )
    got = {(r.user_id, r.job_id): r for r in ranking.matches(jobs, fixtures.profiles(spark)).collect()}
    assert set(got) == {(1, 1), (1, 2)}
    assert got[1, 1].score == 14 and got[1, 1].strong and got[1, 1].cautions == []
    assert got[1, 2].cautions == ["role"] and set(got[1, 2].unknowns) == {"place", "field", "education", "experience", "languages"} and got[1, 2].score == 2
    sent = spark.createDataFrame([], "user_id long, job_id long")
    found = ranking.matches(jobs, fixtures.profiles(spark))
    assert [(r.user_id, r.job_ids) for r in ranking.digest(found, sent).collect()] == [(1, [1])]
    assert ranking.digest(found, spark.createDataFrame([(1, 1)], "user_id long, job_id long")).collect() == []


def test_exchange_rules(spark):
    got = {r.line: r.error for r in exchange.checked(fixtures.proposals(spark), fixtures.stored(spark)).collect()}
    assert got == {1: None, 2: "city not in its evidence", 3: "deadline evidence not in text", 4: "stale source content", 5: "conflicting city", 6: "unknown job", 7: "unknown field", 8: "conflicting title", 9: None, 10: "bad line"}


def test_payload_parsers(spark):
    rows = payloads.listings(fixtures.bronze(spark)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.source_id, []).append((r.url, r.title))
    assert got[1] == [("https://a.test/jobs/1", "Officer"), ("https://a.test/jobs/2", "Driver")]
    assert got[2] == [("https://b.test/n.pdf", "Clerk")] and got[3] == [("https://c.test/api/a", "A"), ("https://c.test/api/b", "B")]
    assert got[4] == [("https://d.test/1", "Post")] and got[5] == [("https://e.test/vacancy-one", "vacancy one")] and len(got[6]) == 2 and got[7] == [("https://g.test/5", "Nurse")]
    assert next(r.error for r in rows if r.source_id == 8).startswith("JSONDecodeError")
    done = {r.source_id: r.complete for r in payloads.complete(payloads.listings(fixtures.bronze(spark)), fixtures.stated(spark)).collect()}
    assert done == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True, 7: True, 8: False}


def test_html_text():
    assert payloads.html_text("<p>A&amp;B</p><script>x()</script><nav>n</nav> c<br>d") == "A&B c d" and payloads.html_text(None) == ""


def brute_similar(rows, n=3):
    """The best of all pairs, one by one."""
    import re

    from jobloom.functions.text import NOISE, ROLE_STEMS

    def stems(title):
        return {w[:6] for w in re.findall("[a-z]+", title.lower()) if len(w) >= 3 and w not in NOISE}

    out = set()
    for a in rows:
        found = []
        for b in rows:
            common = stems(a["title"]) & stems(b["title"])
            if a["job_id"] == b["job_id"] or a["employer_key"] == b["employer_key"] or not common - set(ROLE_STEMS):
                continue
            score = 3 * len(common - set(ROLE_STEMS)) + len(common & set(ROLE_STEMS)) + 2 * min(2, len(set(a["fields"]) & set(b["fields"])))
            score += (a["opportunity_type"] == b["opportunity_type"]) + (a["education_level"] != "" and a["education_level"] == b["education_level"])
            if score >= 4:
                found.append((-score, b["deadline"] is None, b["deadline"] or date(1, 1, 1), -b["job_id"]))
        out |= {(a["job_id"], -x[3], -x[0], k) for k, x in enumerate(sorted(found)[:n], 1)}
    return out


def test_similar_by_brute_force(spark):
    """Many jobs of one employer, titles alike, and titles of more stems than have keys."""
    import random

    from jobloom.operators import ranking

    rng = random.Random(5)
    words = ["driver", "nurse", "budget", "water", "forest", "engine", "school", "market", "senior", "officer", "manager", "assistant"]
    rows = []
    for k in range(120):
        title = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3, 4, 11])))
        rows.append({"job_id": k, "title": title, "employer_key": rng.choice(["a", "a", "a", "b", "c"]), "fields": sorted(set(rng.choices(["f", "g", "h"], k=rng.randint(0, 3)))),
                     "opportunity_type": rng.choice(["x", "y"]), "education_level": rng.choice(["", "bachelor", "master"]), "deadline": rng.choice([None, date(2026, 1, 1), date(2026, 2, 1)])})
    schema = "job_id long, title string, employer_key string, fields array<string>, opportunity_type string, education_level string, deadline date"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    assert max(len(set(r["title"].split())) for r in rows) > ranking.NARROW + 2
    assert {tuple(r) for r in ranking.similar(df).collect()} == brute_similar(rows)
    assert ranking.similar(df.where("false")).collect() == []


def test_similar_without_employers_or_broadcasts(spark, tmp_path):
    """Jobs without an employer take nobody's place, and what small files grow to is not sent to all executors."""
    schema = "job_id long, title string, employer_key string, fields array<string>, opportunity_type string, education_level string, deadline date"
    rows = [(k, "Water budget", None, ["f"], "x", "", date(2026, 1, 1)) for k in range(10)] + [(10 + k, "Water budget", e, ["f"], "x", "", date(2026, 2, 1)) for k, e in enumerate("aabb")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "jobs"))
    found = ranking.similar(spark.read.parquet(str(tmp_path / "jobs")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {(job, other, 9, rank) for mine, others in (([10, 11], [13, 12]), ([12, 13], [11, 10])) for job in mine for rank, other in enumerate(others, 1)}


def test_small_filters(spark):
    jobs = spark.createDataFrame([(1, "UNICEF u Bosni i Hercegovini", "Tuzla"), (2, "Other", "Mostar")], "job_id long, employer string, city string")
    assert [r.job_id for r in board.of_employer(jobs, "unicef").collect()] == [1]
    assert board.facet(jobs, "city", "Tuzla", ["Tuzla"]).count() == 1 and board.facet(jobs, "city", "Paris", ["Tuzla"]).count() == 2
    seen = spark.createDataFrame([(1, date(2026, 9, 2)), (2, date(2026, 9, 1)), (3, None)], "job_id long, day date")
    assert [r.job_id for r in lifecycle.retained(seen, "day", 30, DAY).collect()] == [1]


def test_configured_sources(spark):
    found = spark.createDataFrame(
        [(1, "https://a.test/jobs", "https://a.test/job/7", "Officer", "", None), (1, "https://a.test/jobs", "https://b.test/job/9", "Officer", "", None), (1, "https://a.test/jobs", "https://a.test/job/3", "Officer", "", None),
         (1, "https://a.test/jobs", "https://a.test/job/8", "Contact", "", None), (1, "https://a.test/jobs", None, None, None, "ValueError: x"), (2, "https://c.test/", "https://d.test/x", "Any", "", None)],
        "source_id long, page string, url string, title string, evidence string, error string",
    )
    config = spark.createDataFrame([(1, True, True, "/job/", 5)], "source_id long, need_words boolean, own_host boolean, pattern string, least_id long")
    got = payloads.configured(found, config)
    assert got.columns == found.columns and {r.url for r in got.collect()} == {"https://a.test/job/7", None, "https://d.test/x"}


def test_lines_written_and_read(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "a", "h", DAY), (2, "b", "g", date(2026, 1, 1))], "job_id long, title string, hash string, first_seen date")
    payloads.write_lines(payloads.exchange_lines(jobs, 1).unionByName(spark.createDataFrame([("{bad",), ("",)], "value string")), str(tmp_path / "lines"))
    got = payloads.read_lines(spark, str(tmp_path / "lines"), "job_id long, title string, hash string")
    assert {(r.record and r.record.job_id) for r in got.collect()} == {1, None} and got.count() == 2


def test_copies_leave_queue_and_board(spark):
    """A copy is closed with its record's id; what is closed for another reason keeps it, and what matches no official record stays."""
    rows = [(1, 1, False, "closed", "manual", "Role"), (2, 9, True, "published", "", "role"), (3, 9, True, "review", "", "Role"), (4, 9, True, "closed", "deadline", "Role"), (5, 9, True, "published", "", "Other"), (6, 2, False, "published", "", "ROLE")]
    df = spark.createDataFrame(
        [(i, s, a, st, why, OPEN, DAY, "Employer", "City", t) for i, s, a, st, why, t in rows],
        "job_id long, source_id long, aggregator boolean, status string, closed_reason string, deadline date, published_on date, employer string, city string, title string",
    )
    found = dedup.copies_of_official(df)
    assert {(r.job_id, r.duplicate_of) for r in found.collect()} == {(2, 1), (3, 1), (4, 1)}
    got = {r.job_id: (r.status, r.closed_reason, r.duplicate_of) for r in dedup.closed_copies(df, found).collect()}
    assert got == {1: ("closed", "manual", None), 2: ("closed", "duplicate", 1), 3: ("closed", "duplicate", 1), 4: ("closed", "deadline", None), 5: ("published", "", None), 6: ("published", "", None)}


def test_standins_have_copies(spark):
    """The board's queries would show more rows without the rule."""
    from jobloom.plans import standins

    rows = standins.jobs(spark, "/root/testdata/sf0.01")
    assert board.visible(rows, standins.AS_OF).count() < rows.where(board.is_open(standins.AS_OF)).count()
