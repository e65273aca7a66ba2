"""The operators' inputs made from the given tables, once as DataFrames and once as SQL.

jobs from orders and customers, sources from suppliers, runs and reports from events, snapshots from conversations. Dates without
a value are made by rule, so that every null rule has rows.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, NOW = date(2001, 8, 2), datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("employer"), F.col("c_mktsegment").alias("kind"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    k, seen = F.col("o_orderkey"), F.to_date("o_orderdate")
    levels = F.array(*[F.lit(x) for x in ("secondary", "junior_college", "bachelor", "master", "phd")])
    own = o.select(
        k.alias("job_id"),
        "o_custkey",
        F.concat(F.lit("Order "), F.substring("o_orderpriority", 3, 20)).alias("title"),
        F.when(F.col("o_orderstatus") == "O", "published").when(F.col("o_orderstatus") == "P", "review").otherwise("closed").alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.element_at(F.array(F.lit("deadline"), F.lit("missing"), F.lit("manual"), F.lit("duplicate")), (k % 4 + 1).cast("int"))).otherwise("").alias("closed_reason"),
        seen.alias("first_seen"),
        F.when(k % 7 != 0, F.date_add(seen, (k % 120).cast("int"))).alias("deadline"),
        F.when(k % 11 == 0, F.date_add(seen, 40)).alias("last_reviewed"),
        F.when((F.col("o_orderstatus") != "P") & (k % 13 != 0), seen).alias("published_on"),
        (F.col("o_custkey") % 53).alias("source_id"),
        (F.col("o_custkey") % 53 % 10 != 0).alias("enabled"),
        (F.col("o_custkey") % 53 % 9 == 0).alias("aggregator"),
        F.when(k % 5 != 0, F.get(levels, (k % 5).cast("int"))).otherwise("").alias("education_level"),
        F.when(k % 3 != 0, (k % 12).cast("int")).alias("experience_years"),
    )
    own = own.join(c, "o_custkey").join(F.broadcast(n), "c_nationkey").drop("c_nationkey")
    k, later = F.col("job_id"), lambda c, n: F.date_add(c, n.cast("int"))
    copies = own.where(k % 4 == 1).withColumns(
        {
            "job_id": k + COPY, "source_id": 53 + k % 2, "enabled": F.lit(True), "aggregator": F.lit(True), "title": F.when(k % 3 == 0, F.upper("title")).otherwise(F.col("title")), "status": F.lit("published"),
            "closed_reason": F.lit(""), "first_seen": later("first_seen", F.lit(1)), "published_on": F.when(k % 8 != 5, later("published_on", F.lit(3))),
        }
    )
    again = own.where(k % 6 == 2).withColumns({"job_id": k + 2 * COPY, "source_id": F.lit(60).cast("long"), "aggregator": F.lit(False), "first_seen": later("first_seen", F.lit(2)), "published_on": later("published_on", k % 90)})
    return own.unionByName(copies).unionByName(again)


#: What the ids of copies are greater by.
COPY = 10_000_000_000
OWN_JOBS = """
    SELECT o_orderkey AS job_id, o_custkey, 'Order ' || substr(o_orderpriority, 3, 20) AS title,
      CASE o_orderstatus WHEN 'O' THEN 'published' WHEN 'P' THEN 'review' ELSE 'closed' END AS status,
      CASE WHEN o_orderstatus = 'F' THEN ['deadline', 'missing', 'manual', 'duplicate'][o_orderkey % 4 + 1] ELSE '' END AS closed_reason,
      CAST(o_orderdate AS DATE) AS first_seen,
      CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) END AS deadline,
      CASE WHEN o_orderkey % 11 = 0 THEN CAST(o_orderdate AS DATE) + 40 END AS last_reviewed,
      CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS published_on,
      o_custkey % 53 AS source_id, o_custkey % 53 % 10 <> 0 AS enabled, o_custkey % 53 % 9 = 0 AS aggregator,
      CASE WHEN o_orderkey % 5 <> 0 THEN ['secondary', 'junior_college', 'bachelor', 'master', 'phd'][o_orderkey % 5 + 1] ELSE '' END AS education_level,
      CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 12 AS INTEGER) END AS experience_years,
      c_name AS employer, c_mktsegment AS kind, n_name AS city
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey"""
#: Copies of every fourth job by aggregators, and of every sixth by another official source, some of them long after.
JOBS = f"""
    WITH own AS ({OWN_JOBS})
    SELECT * FROM own
    UNION ALL BY NAME SELECT * REPLACE (job_id + {COPY} AS job_id, 53 + job_id % 2 AS source_id, true AS enabled, true AS aggregator, CASE WHEN job_id % 3 = 0 THEN upper(title) ELSE title END AS title, 'published' AS status,
      '' AS closed_reason, first_seen + 1 AS first_seen, CASE WHEN job_id % 8 <> 5 THEN published_on + 3 END AS published_on) FROM own WHERE job_id % 4 = 1
    UNION ALL BY NAME SELECT * REPLACE (job_id + 2 * {COPY} AS job_id, 60 AS source_id, false AS aggregator, first_seen + 2 AS first_seen, published_on + CAST(job_id % 90 AS INTEGER) AS published_on) FROM own WHERE job_id % 6 = 2"""
OPEN = f"""coalesce(status = 'published' AND enabled AND (deadline >= DATE '{AS_OF}' OR deadline IS NULL AND
      (first_seen >= DATE '{AS_OF}' - 30 OR last_reviewed >= DATE '{AS_OF}' - 30)), false)"""
KEYED = f"SELECT *, {OPEN} AS is_open, lower(title) || '|' || employer || '|' || city || '|' || deadline AS vacancy FROM ({JOBS})"
NEAR = "a.vacancy = b.vacancy AND a.source_id <> b.source_id AND coalesce(abs(date_diff('day', a.published_on, b.published_on)) <= 45, true)"
#: The official record that each aggregator copy is one of.
DUPLICATES = f"SELECT a.job_id, min(b.job_id) AS duplicate_of FROM ({KEYED}) a JOIN ({KEYED}) b ON {NEAR} WHERE a.aggregator AND NOT b.aggregator GROUP BY a.job_id"
#: What shows: copies of official records that do not show are left out, then of each vacancy one after the other in order of precedence.
SHOWN = f"""
    WITH RECURSIVE j AS MATERIALIZED ({KEYED}),
    blocked AS (SELECT a.job_id FROM j a JOIN j b ON {NEAR} WHERE a.is_open AND a.aggregator AND NOT b.is_open AND NOT b.aggregator),
    g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY vacancy ORDER BY aggregator, first_seen, job_id) AS n FROM j WHERE is_open AND vacancy IS NOT NULL AND job_id NOT IN (SELECT job_id FROM blocked)),
    w AS (
      SELECT vacancy, n, [struct_pack(s := source_id, p := published_on, id := job_id)] AS won FROM g WHERE n = 1
      UNION ALL SELECT g.vacancy, g.n, CASE WHEN len(list_filter(won, lambda x: x.s <> g.source_id AND coalesce(abs(date_diff('day', x.p, g.published_on)) <= 45, true))) > 0 THEN won
        ELSE list_append(won, struct_pack(s := g.source_id, p := g.published_on, id := g.job_id)) END FROM w JOIN g ON g.vacancy = w.vacancy AND g.n = w.n + 1)
    SELECT job_id FROM j WHERE is_open AND vacancy IS NULL UNION ALL SELECT x.id FROM (SELECT unnest(arg_max(won, n)) AS x FROM w GROUP BY vacancy)"""
VISIBLE = f"job_id IN ({SHOWN})"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.col("user_id").alias("source_id"),
        F.col("ts").alias("started_at"),
        (F.col("event_type") != "error").alias("success"),
        F.floor("value").cast("long").alias("candidates"),
        F.when(
            F.col("event_type") == "error",
            F.element_at(F.array(F.lit("HTTP 403 for page"), F.lit("Redirect host changed"), F.lit("Read timed out"), F.lit("layout changed")), (F.col("event_id") % 4 + 1).cast("int")),
        ).alias("error"),
    )


RUNS = """
    SELECT event_id AS run_id, user_id AS source_id, ts AS started_at, event_type <> 'error' AS success, CAST(floor(value) AS BIGINT) AS candidates,
      CASE WHEN event_type = 'error' THEN ['HTTP 403 for page', 'Redirect host changed', 'Read timed out', 'layout changed'][event_id % 4 + 1] END AS error
    FROM events"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a source that ever ran, with its last attempt and success and its current streak."""
    from jobloom.operators.coverage import current_failures

    r = runs(spark, sf_dir)
    base = r.groupBy("source_id").agg(F.max("started_at").alias("last_attempt"), F.max(F.when(F.col("success"), F.col("started_at"))).alias("last_success"))
    s = F.col("source_id")
    found = base.join(current_failures(r), "source_id", "left")
    return found.select(
        "source_id",
        "last_attempt",
        "last_success",
        F.coalesce("failures", F.lit(0)).cast("long").alias("failures"),
        (s % 6 != 0).alias("enabled"),
        (s % 17 != 0).alias("has_adapter"),
        F.when(s % 5 == 0, 24).otherwise(1).alias("least_hours"),
        F.when(s % 19 == 0, "blocked").when(s % 4 == 0, "unverified").otherwise("verified").alias("status"),
        (s % 23 == 0).alias("partial"),
        (s % 3).cast("long").alias("open_jobs"),
        (s % 2).cast("long").alias("review_jobs"),
        F.when(s % 8 == 0, "not_found").when(s % 8 == 4, "blocked").otherwise("").alias("audit"),
    )


SOURCES = f"""
    SELECT b.source_id, last_attempt, last_success, coalesce(failures, 0) AS failures, b.source_id % 6 <> 0 AS enabled, b.source_id % 17 <> 0 AS has_adapter,
      CASE WHEN b.source_id % 5 = 0 THEN 24 ELSE 1 END AS least_hours,
      CASE WHEN b.source_id % 19 = 0 THEN 'blocked' WHEN b.source_id % 4 = 0 THEN 'unverified' ELSE 'verified' END AS status,
      b.source_id % 23 = 0 AS partial, b.source_id % 3 AS open_jobs, b.source_id % 2 AS review_jobs,
      CASE WHEN b.source_id % 8 = 0 THEN 'not_found' WHEN b.source_id % 8 = 4 THEN 'blocked' ELSE '' END AS audit
    FROM (SELECT source_id, max(started_at) AS last_attempt, max(started_at) FILTER (WHERE success) AS last_success FROM ({RUNS}) GROUP BY source_id) b
    LEFT JOIN (SELECT r.source_id, count(*) AS failures FROM ({RUNS}) r
      LEFT JOIN (SELECT source_id, max(started_at) AS ok FROM ({RUNS}) WHERE success GROUP BY source_id) s ON r.source_id = s.source_id
      WHERE ok IS NULL OR started_at > ok GROUP BY r.source_id) f ON b.source_id = f.source_id"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third turn repeats the text before it, so that unchanged pages occur."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("scan"), F.when(F.col("turn") % 3 == 2, "same").otherwise(F.col("text")).alias("text")).unionByName(
        c.select(F.col("conv_id").alias("page_id"), (F.col("turn") + 1000).alias("scan"), F.lit("same").alias("text"))
    )


SNAPSHOTS = """
    SELECT conv_id AS page_id, turn AS scan, CASE WHEN turn % 3 = 2 THEN 'same' ELSE text END AS text FROM conversations
    UNION ALL SELECT conv_id, turn + 1000, 'same' FROM conversations"""


def parts(spark: SparkSession, sf_dir: str, divisor: int = 1) -> DataFrame:
    """Parts as titled jobs of many employers."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("job_id"),
        F.concat_ws(" ", F.lit("Senior"), "p_name", F.concat(F.lit("lot"), F.translate((k % 997).cast("string"), "0123456789", "abcdefghij"))).alias("title"),
        F.lower("p_brand").alias("employer_key"),
        F.array_sort(F.array_distinct(F.array(F.concat(F.lit("f"), (F.col("p_size") % 4).cast("string")), F.concat(F.lit("f"), (k % 3).cast("string"))))).alias("fields"),
        F.col("p_type").alias("opportunity_type"),
        F.when(k % 4 != 0, F.concat(F.lit("level"), (k % 3).cast("string"))).otherwise("").alias("education_level"),
        F.when(k % 6 != 0, F.date_add(F.lit(AS_OF), (k % 50).cast("int"))).alias("deadline"),
    )


PARTS = f"""
    SELECT p_partkey AS job_id, 'Senior ' || p_name || ' lot' || translate(CAST(p_partkey % 997 AS VARCHAR), '0123456789', 'abcdefghij') AS title, lower(p_brand) AS employer_key,
      list_sort(list_distinct(['f' || CAST(p_size % 4 AS VARCHAR), 'f' || CAST(p_partkey % 3 AS VARCHAR)])) AS fields, p_type AS opportunity_type,
      CASE WHEN p_partkey % 4 <> 0 THEN 'level' || CAST(p_partkey % 3 AS VARCHAR) ELSE '' END AS education_level,
      CASE WHEN p_partkey % 6 <> 0 THEN DATE '{AS_OF}' + CAST(p_partkey % 50 AS INTEGER) END AS deadline
    FROM part"""
