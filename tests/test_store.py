"""Runs as files, and an outbox that a batch run again does not fill twice."""

import os
from datetime import date, datetime

import pytest

from jobloom.sources import store
from jobloom.streaming import outbox

RUN, RAN = "source_id long, url string, title string", "source_id long, error string, may_be_empty boolean"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if "source_id=" in d and not f.startswith(".")}


def test_only_good_sources_are_replaced(spark, tmp_path):
    path = str(tmp_path / "stored")
    put = lambda rows, ran: {r.source_id: r.error for r in store.write(spark.createDataFrame(rows, RUN), spark.createDataFrame(ran, RAN), path, 5).collect()}
    first = [(s, f"u{k}", "one") for s in range(9) for k in range(3)]
    assert set(put(first, [(s, None, False) for s in range(10)]).values()) == {None}
    before = files(path)
    second = [(0, "u0", "two"), (1, "u0", "two"), (1, "u0", "two"), (2, None, "two"), (4, "u9", "two"), *[(6, f"v{k}", "two") for k in range(6)], (7, "u1", None), (20, "u", "two")]
    ran = [(0, None, False), (1, None, False), (2, None, False), (3, None, False), (4, "HTTP 500", False), (5, None, True), (6, None, False), (7, None, False), (7, None, False)]
    got = put(second, ran)
    assert got == {0: None, 1: "URL found twice", 2: "row without URL", 3: "suddenly empty", 4: "HTTP 500", 5: None, 6: "too many links", 7: None, 20: "source did not run"}
    rows = {(r.source_id, r.url, r.title) for r in store.stored(spark, path, spark.createDataFrame([], RUN).schema).collect()}
    assert rows == {(0, "u0", "two"), (7, "u1", None)} | {(s, f"u{k}", "one") for s in (1, 2, 3, 4, 6, 8) for k in range(3)}
    after = files(path)
    of = lambda found, ids: {f: t for f, t in found.items() if int(f.split("source_id=")[1].split("/")[0]) in ids}
    # Sources that failed or did not run have the very files that they had, by name and time.
    assert of(before, {1, 2, 3, 4, 6, 8}) == of(after, {1, 2, 3, 4, 6, 8}) and not set(of(before, {0, 5, 7})) & set(after)
    assert put(second, ran) == got and {(r.source_id, r.url, r.title) for r in store.stored(spark, path, spark.createDataFrame([], RUN).schema).collect()} == rows


def test_nothing_stored_and_no_sources(spark, tmp_path):
    path = str(tmp_path / "none")
    assert store.stored(spark, path, spark.createDataFrame([], RUN).schema).collect() == []
    assert store.write(spark.createDataFrame([], RUN), spark.createDataFrame([], RAN), path).collect() == []


def test_batch_again(spark, tmp_path):
    path, schema = str(tmp_path / "outbox"), "user_id long, week date, events long, best long"
    monday, next_ = date(2026, 1, 5), date(2026, 1, 12)
    read = lambda: sorted((r.user_id, r.week, r.events, r.epoch) for r in spark.read.parquet(path).collect())
    one = spark.createDataFrame([(1, monday, 2, 7), (2, monday, 1, 8), (2, monday, 5, 8)], schema)
    for _ in range(2):
        outbox.append_once(one, 0, path)
        assert read() == [(1, monday, 2, 0), (2, monday, 1, 0)]
    two = spark.createDataFrame([(1, monday, 9, 9), (1, next_, 3, 9)], schema)
    for _ in range(2):
        outbox.append_once(two, 1, path)
        assert read() == [(1, monday, 2, 0), (1, next_, 3, 1), (2, monday, 1, 0)]
    outbox.append_once(two.where("false"), 2, path)
    assert len(read()) == 3


def test_crash_between_write_and_commit(spark, tmp_path, monkeypatch):
    """The stream dies after it stored a batch; after a restart the batch comes again, and each digest is there once."""
    schema = "user_id long, at timestamp, event_id long, value double"
    rows = [(u, datetime(2026, 1, d, 12), 100 * u + d, float(d)) for u in (1, 2) for d in (5, 6, 13)] + [(-1, datetime(2026, 3, 1), 0, 0.0), (None, datetime(2026, 1, 5), 0, 0.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: outbox.weekly(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 day")
    whole, left = outbox.append_once, [1]

    def dies(batch, epoch, path):
        whole(batch, epoch, path)
        if os.path.exists(path) and left:
            left.pop()
            raise RuntimeError("lost")

    monkeypatch.setattr(outbox, "append_once", dies)
    with pytest.raises(Exception, match="lost"):
        outbox.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    outbox.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.user_id, r.week, r.events, r.best) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, date(2026, 1, 5), 2, 106), (1, date(2026, 1, 12), 1, 113), (2, date(2026, 1, 5), 2, 206), (2, date(2026, 1, 12), 1, 213)]
