"""Sources: counts, coverage states, runs, failures, schedules and limits."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import fold
from jobloom.operators.board import visible

STALE_HOURS, REVIEW_DAYS, FAILING, PER_HOUR, RECHECK_DAYS = 48, 60, 3, 5, 90
#: What the cards of the page take together.
BUCKETS = {"covered": ("available", "review", "empty"), "partial": ("partial",), "unavailable": ("unavailable",), "untracked": ("integration", "pending", "not_found")}
STATES = ["available", "partial", "review", "empty", "unavailable", "not_found", "integration", "pending"]


def source_counts(jobs: DataFrame, as_of: date) -> DataFrame:
    """(source_id, open_jobs, review_jobs): both zero-filled where the other exists; old undated reviews do not count."""
    open_ = visible(jobs, as_of).groupBy("source_id").agg(F.count(F.lit(1)).alias("open_jobs"))
    fresh = (F.col("deadline") >= F.lit(as_of)) | (F.col("deadline").isNull() & (F.col("first_seen") >= F.date_sub(F.lit(as_of), REVIEW_DAYS)))
    review = jobs.where((F.col("status") == "review") & F.col("enabled") & F.coalesce(fresh, F.lit(False))).groupBy("source_id").agg(F.count(F.lit(1)).alias("review_jobs"))
    return open_.join(review, "source_id", "full").select("source_id", F.coalesce("open_jobs", F.lit(0)).alias("open_jobs"), F.coalesce("review_jobs", F.lit(0)).alias("review_jobs"))


def audit_current(now: datetime) -> Column:
    """Whether an organization's audit still counts: dated within RECHECK_DAYS, with evidence and notes."""
    day = F.to_date(F.lit(now))
    stated = (F.coalesce("evidence_url", F.lit("")) != "") & (F.coalesce("notes", F.lit("")) != "")
    return F.coalesce(F.col("checked_on").between(F.date_sub(day, RECHECK_DAYS), day), F.lit(False)) & stated


def without_superseded(sources: DataFrame) -> DataFrame:
    """sources without disabled ones that name an active source of their organization as what replaced them.

    sources: organization_id, url, enabled, has_adapter, superseded_by.
    """
    active = sources.where("enabled and has_adapter").select(F.col("organization_id").alias("__org"), F.col("url").alias("__url")).distinct()
    gone = ~F.col("enabled") & F.col("superseded_by").isNotNull()
    replaced = sources.where(gone).join(active, (F.col("organization_id") == F.col("__org")) & (F.col("superseded_by") == F.col("__url")), "left_anti")
    return sources.where(~gone).unionByName(replaced)


def coverage_status(sources: DataFrame, now: datetime) -> DataFrame:
    """sources with their state, the first rule that holds. Columns used: status, enabled, last_attempt, last_success, partial, open_jobs, review_jobs, audit.

    An audit's finding counts only while it is current, where its date, evidence and notes are given.
    """
    dated = {"checked_on", "evidence_url", "notes"} <= set(sources.columns)
    audit = F.when(audit_current(now), F.col("audit")) if dated else F.col("audit")
    failed = F.col("last_attempt").isNotNull() & (F.col("last_success").isNull() | (F.col("last_attempt") > F.col("last_success")))
    stale = F.col("enabled") & (F.col("last_success") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {STALE_HOURS} hours"))
    healthy = F.col("enabled") & (F.col("status") == "verified") & F.col("last_success").isNotNull()
    state = (
        F.when(F.col("status").isin("blocked", "failing") | failed | F.coalesce(stale, F.lit(False)), "unavailable")
        .when(healthy & F.col("partial"), "partial")
        .when(healthy & (F.col("open_jobs") > 0), "available")
        .when(healthy & (F.col("review_jobs") > 0), "review")
        .when(healthy, "empty")
        .when(audit == "blocked", "unavailable")
        .when(audit.isin("not_found", "integration"), audit)
        .otherwise("pending")
    )
    return sources.withColumn("state", state)


def coverage_rows(organizations: DataFrame, sources: DataFrame, now: datetime) -> DataFrame:
    """A row for each source of each organization, and one for each organization without any, with its state, counts, address and domain.

    organizations: organization_id, name, website, audit, checked_on, evidence_url, notes; sources: as of coverage_status() and without_superseded(), without an audit of their
    own. Disabled sources that another active one of their organization replaced do not count twice. Where there is no healthy source, the organization's audit
    tells the state while it is current; without a source nothing else does.
    """
    kept = without_superseded(sources).drop("audit", "checked_on", "evidence_url", "notes")
    both = organizations.join(kept.withColumn("__there", F.lit(True)), "organization_id", "left")
    rows = coverage_status(both.withColumn("enabled", F.coalesce("enabled", F.lit(False))), now)
    address = F.when(F.col("__there"), F.col("url")).otherwise(F.coalesce(F.nullif("website", F.lit("")), "evidence_url"))
    return rows.select(
        "organization_id", "name", "source_id", "state", F.coalesce("open_jobs", F.lit(0)).alias("open_jobs"), F.coalesce("review_jobs", F.lit(0)).alias("review_jobs"), address.alias("url"),
        F.lower(F.try_parse_url(address, F.lit("HOST"))).alias("domain"), audit_current(now).alias("audit_current"),
    )


def coverage_groups(rows: DataFrame, preview: int | None = 5, bucket: str | None = None, search: str = "") -> DataFrame:
    """rows of coverage_rows() as a page groups them, with `place` in their group, its `total` and how many are `hidden` of it.

    Available sources are in order of their open jobs, others of their organization; the full list shows the first few of each group. A bucket (BUCKETS), a state or a search for
    words in names chooses rows, and then all are shown; an unknown bucket filters nothing.
    """
    chosen = bucket in BUCKETS or bucket in STATES
    if chosen:
        rows = rows.where(F.col("state").isin(*BUCKETS.get(bucket, (bucket,))))
    if search.strip():
        rows = rows.where(F.contains(fold(F.col("name")), fold(F.lit(search.strip()[:100]))))
    order = [F.when(F.col("state") == "available", -F.col("open_jobs")).otherwise(0), "organization_id", "source_id"]
    totals = rows.groupBy("state").agg(F.count(F.lit(1)).alias("total"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("state").orderBy(*order)))
    trimmed = None if chosen or search.strip() else preview
    if trimmed is not None:
        # With the limit in the plan, no more than so many rows of a group leave a task.
        placed = placed.where(F.col("place") <= trimmed)
    hidden = F.greatest(F.col("total") - F.lit(trimmed), F.lit(0)) if trimmed is not None else F.lit(0).cast("long")
    return placed.join(F.broadcast(totals), "state").withColumn("hidden", hidden)


def state_totals(covered: DataFrame) -> DataFrame:
    """(state, n) for every state, zero-filled."""
    states = covered.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    n = covered.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(states).join(n, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each source by start, then id; partial maxima are taken before the shuffle."""
    last = F.max(F.struct("started_at", "run_id", "success", "candidates")).alias("last")
    return runs.groupBy("source_id").agg(last).select("source_id", "last.*")


def streaks(runs: DataFrame) -> DataFrame:
    """Every run with the length of the failure streak it stands in: successes part the islands."""
    order = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    island = F.sum(F.col("success").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = runs.withColumn("island", island)
    within = Window.partitionBy("source_id", "island").orderBy("started_at", "run_id").rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn("failures", F.sum((~F.col("success")).cast("long")).over(within)).drop("island")


def current_failures(runs: DataFrame) -> DataFrame:
    """(source_id, failures): failed runs since the last success, without sorting: counts after a maximum."""
    success = runs.where("success").groupBy("source_id").agg(F.max(F.struct("started_at", "run_id")).alias("ok"))
    after = runs.join(success, "source_id", "left").where(F.col("ok").isNull() | (F.struct("started_at", "run_id") > F.col("ok")))
    return after.groupBy("source_id").agg(F.count(F.lit(1)).alias("failures"))


def wait_hours(failures: Column, least: Column) -> Column:
    """Hours between attempts: the source's own, or more after failures, up to a day."""
    backoff = F.least(F.lit(24), F.pow(F.lit(2), F.least(failures, F.lit(5))).cast("int"))
    least = F.greatest(F.lit(1), least)
    return F.when(failures > 0, F.greatest(least, backoff)).otherwise(least)


def due(sources: DataFrame, now: datetime) -> DataFrame:
    """sources (failures, least_hours, last_attempt) with hours and due."""
    hours = wait_hours(F.col("failures"), F.col("least_hours"))
    waited = F.col("last_attempt") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=hours)
    return sources.withColumns({"hours": hours, "due": F.coalesce(waited, F.lit(True))})


def health(sources: DataFrame, now: datetime) -> DataFrame:
    """(source_id, problem): stale, else failing, of enabled sources that have an adapter."""
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {STALE_HOURS} hours")
    stale = F.col("has_adapter") & (F.col("last_success").isNull() | (F.col("last_success") < limit))
    problem = F.when(stale, "stale").when(F.col("failures") >= FAILING, "failing")
    return sources.where("enabled").select("source_id", problem.alias("problem")).where("problem is not null")


def failure_category(error: Column) -> Column:
    message = F.lower(error)
    has = lambda *words: F.coalesce(message.rlike("|".join(words)), F.lit(False))
    return (
        F.when(has("http 202", "403", "429"), "upstream_block")
        .when(has("redirect host"), "redirect")
        .when(has("timeout", "timed out", "connection", "502", "503", "504"), "upstream_transient")
        .otherwise("parse_or_validation")
    )


def limited(reports: DataFrame) -> DataFrame:
    """Stored reports with how many the client had in the hour before, and whether that was the limit.

    A client's reports are dealt out by the hour, each hour with the one before it, so that a client of very many reports is
    no single task's. Reports of one second do not count for each other.
    """
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    hour = F.floor(F.col("__at") / 3600)
    both = reports.withColumn("__at", seconds).withColumn("__hour", F.explode(F.array(hour, hour + 1)))
    before = Window.partitionBy("client", "__hour").orderBy("__at").rangeBetween(-3600, -1)
    counted = both.withColumn("before", F.count(F.lit(1)).over(before)).where(F.col("__hour") == hour)
    return counted.drop("__at", "__hour").withColumn("limited", F.col("before") >= PER_HOUR)


def daily_metrics(events: DataFrame) -> DataFrame:
    """(day, kind, job_id, n); events without a job are counted under a null one."""
    return events.groupBy(F.to_date("ts").alias("day"), "kind", "job_id").agg(F.count(F.lit(1)).alias("n"))


def run_summary(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: sources whose last run succeeded, failed (by category of the error) or that were not tried. sources: source_id, enabled, has_adapter."""
    last = runs.groupBy("source_id").agg(F.max(F.struct("started_at", "run_id", "success", "error")).alias("last")).select("source_id", "last.*")
    both = sources.where("enabled and has_adapter").select("source_id").join(last, "source_id", "left")
    failed = F.col("success").isNotNull() & ~F.col("success")
    kinds = {k: F.count_if(failed & (failure_category(F.coalesce("error", F.lit(""))) == k)).alias(k) for k in ("upstream_block", "redirect", "upstream_transient", "parse_or_validation")}
    return both.agg(F.count_if("success").alias("succeeded"), F.count_if(failed).alias("failed"), F.count_if(F.col("success").isNull()).alias("skipped"), *kinds.values())
