"""Queries that replay the given tables as streams: written to the shared folder in slices of time, then read as files that come one after the other."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.dedup import _shared
from jobloom.plans.registered import query
from jobloom.plans.standins import NOW, table
from jobloom.streaming import lives, outbox

#: Slices of the replay, and the days after which its listings are stale: the events span thirty days.
SLICES, PUBLISHED_DAYS, REVIEW_DAYS = 3, 2, 9


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of listings, one a user: errors are misses, purchases are reviews, and every fourth listing states a deadline."""
    e = table(spark, sf_dir, "events")
    job = F.col("user_id")
    return e.select(
        job.alias("job_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("seen"),
        (F.col("event_type") == "purchase").alias("reviewed"),
        F.when(job % 3 == 0, "review").otherwise("published").alias("status"),
        F.when(job % 4 == 1, F.date_add(F.lit(NOW).cast("date"), (-(job % 29) - 1).cast("int"))).alias("deadline"),
    )


def replay(spark: SparkSession, rows: DataFrame, path: str, at: str, slices: int) -> None:
    """rows as files in order of time: each slice is written after the one before."""
    ends = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    place = F.coalesce(F.floor((F.unix_micros(at) - F.unix_micros(F.lit(ends["a"]))) * slices / (F.unix_micros(F.lit(ends["b"])) - F.unix_micros(F.lit(ends["a"])) + 1)), F.lit(0))
    for k in range(slices):
        rows.where(place == k).write.mode("append").parquet(path)


@query(f"""
    WITH e AS (
      SELECT user_id AS job_id, ts AS t, event_id AS seq, event_type <> 'error' AS seen, event_type = 'purchase' AS reviewed,
        CASE WHEN user_id % 3 = 0 THEN 'review' ELSE 'published' END AS status,
        CASE WHEN user_id % 4 = 1 THEN CAST(DATE '{NOW:%Y-%m-%d}' + CAST(-(user_id % 29) AS INTEGER) AS TIMESTAMP) END AS over_at
      FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    born AS (SELECT job_id, any_value(status) AS status, any_value(over_at) AS over_at, min(t) AS born_at FROM e WHERE seen GROUP BY job_id),
    lived AS (SELECT e.* FROM e JOIN born USING (job_id) WHERE e.t >= born_at),
    missed AS (
      SELECT job_id, min(t) AS t FROM (SELECT *, lag(seen) OVER (PARTITION BY job_id ORDER BY t, seq) AS before FROM lived) WHERE NOT seen AND NOT before GROUP BY job_id),
    fresh AS (SELECT job_id, born_at AS t FROM born UNION SELECT job_id, t FROM lived WHERE reviewed AND seen),
    stale AS (
      SELECT f.job_id, min(f.t) + INTERVAL {PUBLISHED_DAYS} DAY AS t
      FROM (SELECT *, lead(t) OVER (PARTITION BY job_id ORDER BY t) AS following FROM fresh) f JOIN born USING (job_id)
      WHERE status = 'published' AND (following IS NULL OR following >= f.t + INTERVAL {PUBLISHED_DAYS} DAY) GROUP BY f.job_id
      UNION ALL SELECT job_id, born_at + INTERVAL {REVIEW_DAYS} DAY FROM born WHERE status = 'review'),
    ends AS (
      SELECT job_id, t, t AS told, 'missing' AS reason, 2 AS k FROM missed
      UNION ALL SELECT job_id, greatest(over_at, born_at), over_at, 'deadline', 1 FROM born WHERE over_at IS NOT NULL
      UNION ALL SELECT s.job_id, s.t, s.t, 'stale', 1 FROM stale s JOIN born USING (job_id) WHERE over_at IS NULL)
    SELECT job_id, CAST(epoch_us(told) AS BIGINT) AS at_us, reason FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, k) AS n FROM ends WHERE t < TIMESTAMP '{NOW}') WHERE n = 1""")
def listing_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why and when each listing ended by NOW. A last row without meaning moves the watermark there."""
    path, out, state = (_shared(spark, f"sightings-{x}") for x in ("in", "out", "state"))
    rows = sightings(spark, sf_dir)
    replay(spark, rows, path, "at", SLICES)
    rows.limit(0).unionByName(spark.createDataFrame([(-1, NOW, 0, False, False, "", None)], rows.schema)).coalesce(1).write.mode("append").parquet(path)
    files = spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().count()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // SLICES))).parquet(path)
    # Files of one slice come in any order, so a slice may be late by its own length.
    late = f"{30 * 24 * 3600 // SLICES + 3600} seconds"
    moved = stream.withColumn("at", F.when(F.col("job_id") == -1, F.col("at") + F.expr(f"INTERVAL '{late.split()[0]}' SECOND")).otherwise(F.col("at")))
    lives.run_available(spark, lives.endings(moved, late, PUBLISHED_DAYS, REVIEW_DAYS), out, state)
    return spark.read.schema("job_id long, at timestamp, reason string").parquet(out).select("job_id", F.unix_micros("at").alias("at_us"), "reason")


@query("""
    SELECT user_id, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, count(*) AS events, arg_max(event_id, (coalesce(value, '-inf'::DOUBLE), -event_id)) AS best
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""")
def weekly_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest for each user and week of the events, as a stream stores them when each week is over."""
    path, out, state = (_shared(spark, f"outbox-{x}") for x in ("in", "out", "state"))
    e = table(spark, sf_dir, "events")
    rows = e.select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id", "value")
    replay(spark, rows, path, "at", SLICES)
    # A last row of no user moves the watermark past the last week; its own week is not over. (A null user would be filtered before the watermark sees it.)
    spark.createDataFrame([(-1, NOW + timedelta(days=60), 0, 0.0)], rows.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-spark.read.parquet(path).select(F.col("_metadata.file_path")).distinct().count() // SLICES))).parquet(path)
    outbox.run_available(outbox.weekly(stream, f"{30 // SLICES + 1} days"), out, state)
    return spark.read.schema("user_id long, events long, best long, week date, epoch long").parquet(out).select("user_id", F.col("week").cast("string").alias("week"), "events", "best")
