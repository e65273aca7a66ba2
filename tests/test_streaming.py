"""Streams over files: state carries on between batches."""

from datetime import datetime

from jobloom.streaming import runs as R


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streaks_carry_on(spark, tmp_path):
    schema = "source_id long, started_at timestamp, success boolean"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    put(0, [(1, datetime(2026, 1, 1, 1), False), (2, datetime(2026, 1, 1, 1), True)])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = R.failure_streaks(stream).writeStream.format("memory").queryName("streaks").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    out.processAllAvailable()
    put(1, [(1, datetime(2026, 1, 1, 2), False), (2, datetime(2026, 1, 1, 2), False)])
    drain(out)
    got = [(r.source_id, r.failures) for r in spark.table("streaks").collect()]
    assert (1, 1) in got and (1, 2) in got and (2, 0) in got and (2, 1) in got


def test_changed_pages_keep_returns(spark, tmp_path):
    schema = "page_id long, scan long, text string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    put(0, [(1, 0, "A"), (1, 1, "A"), (1, 2, "B")])
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = R.changed_pages(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    out.processAllAvailable()
    put(1, [(1, 3, "B"), (1, 4, "A")])
    drain(out)
    assert sorted(r.scan for r in spark.table("changed").collect()) == [0, 2, 4]


def test_hourly_counts(spark, tmp_path):
    schema = "source_id long, started_at timestamp, success boolean"
    spark.createDataFrame([(1, datetime(2026, 1, 1, 1, 5), False), (1, datetime(2026, 1, 1, 1, 50), True), (1, datetime(2026, 1, 1, 9), True)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = R.hourly_runs(stream).writeStream.format("memory").queryName("hourly").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    drain(out)
    assert sorted((r.runs, r.failed) for r in spark.table("hourly").collect()) == [(1, 0), (2, 1)]
