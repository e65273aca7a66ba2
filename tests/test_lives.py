"""Listings that end in a stream: against the batch rules, in any order of arrival and over restarts."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from jobloom.operators import lifecycle
from jobloom.streaming import lives

SCHEMA = "job_id long, at timestamp, seq long, seen boolean, reviewed boolean, status string, deadline date"
START = datetime(2026, 1, 1)


def day(n, hours=0):
    return START + timedelta(days=n, hours=hours)


def run(spark, tmp_path, batches, late="0 seconds", **kw):
    """Ends after each batch of rows; state is kept on disk from one run to the next, as after a restart."""
    got = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        lives.run_available(spark, lives.endings(stream, late, **kw), str(tmp_path / "out"), str(tmp_path / "state"))
        all_ = {(r.job_id, r.at, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        got.append(all_ - set().union(*got))
    return got


def clock(n):
    """A row of another listing that moves the watermark there."""
    return (-1, day(n), 0, False, False, "", None)


def test_ends(spark, tmp_path):
    first = [
        (1, day(0), 1, True, False, "published", None), (1, day(1), 2, False, False, "published", None), (1, day(2), 3, False, False, "published", None),
        (2, day(0), 4, True, False, "published", date(2026, 1, 5)),
        (3, day(0), 5, True, False, "published", None), (3, day(20), 6, True, True, "published", None),
        (4, day(0), 7, True, False, "review", None), (5, day(0), 8, False, False, "published", None), (None, day(0), 9, True, False, "published", None),
        (6, day(0), 10, True, False, "published", None), (6, day(1), 11, False, False, "published", None), (6, day(2), 12, True, False, "published", None), (6, day(3), 13, False, False, "published", None),
    ]
    got = run(spark, tmp_path, [[*first, clock(21)], [clock(45)], [clock(70)], [(1, day(71), 20, True, False, "published", None), clock(200)]])
    assert got[0] == {(1, day(2), "missing"), (2, datetime(2026, 1, 6), "deadline")}
    assert got[1] == {(6, day(30), "stale")}
    assert got[2] == {(3, day(50), "stale"), (4, day(60), "stale")}
    # What ended is forgotten ninety days later, and nothing is held of it any more.
    assert got[3] == {(1, day(92), "forgotten"), (2, datetime(2026, 1, 6) + timedelta(days=90), "forgotten"), (6, day(120), "forgotten"), (3, day(140), "forgotten"), (4, day(150), "forgotten")}


def test_any_order_and_batch_rules(spark, tmp_path):
    """Shuffled within the lateness and cut into batches anywhere, the misses are those that the batch rule finds."""
    rng = random.Random(8)
    rows = [(k % 12, day(0, hours=k), k, k < 12 or rng.random() < 0.6, False, "published", None) for k in range(240)]
    want = lifecycle.missed_closures(spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "job_id long, scan long, seen boolean")).collect()
    shuffled = [r for lot in range(0, 240, 40) for r in rng.sample(rows[lot : lot + 40], 40)]
    batches = [shuffled[:70], shuffled[70:110], shuffled[110:111], [*shuffled[111:], clock(20)]]
    got = set().union(*run(spark, tmp_path, batches, "40 hours"))
    assert {(r.job_id, day(0, hours=r.closed_at), "missing") for r in want} == {x for x in got if x[1] < day(10)}


def test_stale_as_the_batch_rule(spark, tmp_path):
    """On a given day, the same listings are closed as by the expiry pass over the table."""
    rng = random.Random(9)
    rows, as_of = [], date(2026, 3, 20)
    for k in range(60):
        status, at = rng.choice(["published", "review"]), day(rng.randrange(70))
        deadline = rng.choice([None, None, (at + timedelta(days=rng.randrange(1, 40))).date()])
        rows.append((k, at, k, True, False, status, deadline))
        if rng.random() < 0.5:
            rows.append((k, at + timedelta(days=rng.randrange(1, 8)), 100 + k, True, True, status, deadline))
    df = spark.createDataFrame(rows, SCHEMA)
    table = df.groupBy("job_id").agg(F.min("status").alias("status"), F.min("deadline").alias("deadline"), F.to_date(F.min("at")).alias("first_seen"), F.to_date(F.max(F.when(F.col("reviewed"), F.col("at")))).alias("last_reviewed"), F.lit("").alias("closed_reason"))
    want = {(r.job_id, r.closed_reason) for r in lifecycle.expired(table, as_of).collect() if r.status == "closed"}
    moment = (datetime(as_of.year, as_of.month, as_of.day) - START).days
    got = run(spark, tmp_path, [sorted(rows, key=lambda r: r[1]), [clock(moment)]], "90 days", kept_days=1000)
    assert not got[0]
    later = run(spark, tmp_path, [[clock(moment + 90)]], "90 days", kept_days=1000)[0]
    assert {(j, reason) for j, _, reason in later} == want


def test_alike_but_for_a_deadline(spark, tmp_path):
    """Two sightings of one moment that differ in a null only have an order, the one without a deadline being the later; a status may hold commas, and a missing order counts as none."""
    rows = [(1, day(0), 1, True, False, "published", None), (1, day(0), 1, True, False, "published", date(2026, 1, 5)), (2, day(0), None, True, None, "other, status", date(2026, 1, 5))]
    got = set().union(*run(spark, tmp_path, [rows, [clock(9)], [clock(10)], [clock(45)], [clock(46)]]))
    assert got == {(1, day(30), "stale"), (2, datetime(2026, 1, 6), "deadline")}
