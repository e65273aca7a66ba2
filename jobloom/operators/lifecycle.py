"""State of listings over time: snapshots, absence, expiry, upserts and bulk decisions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AI_CHANGED = "source text changed after enrichment"
STALE_PUBLISHED, STALE_REVIEW, MISSES = 30, 60, 2


def changed_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose text differs from the one before of the same page: A, B, A gives three."""
    order = Window.partitionBy("page_id").orderBy("scan")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return snapshots.withColumn("hash", digest).withColumn("before", F.lag("hash").over(order)).where(~F.col("hash").eqNullSafe(F.col("before"))).drop("before")


def to_store(found: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(page_id, scan, text, hash) of what a scan found and its page's latest snapshot does not hold yet: a snapshot is kept per change, not per scan.

    found, snapshots: page_id, scan, text. The latest hash is looked up by a maximum that is taken before the shuffle; a page without
    snapshots is stored; a null text counts as an empty one.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    latest = snapshots.groupBy("page_id").agg(F.max_by(digest, "scan").alias("latest"))
    return found.withColumn("hash", digest).join(latest, "page_id", "left").where(~F.col("hash").eqNullSafe(F.col("latest"))).select("page_id", "scan", "text", "hash")


def last_two(snapshots: DataFrame) -> DataFrame:
    """The last two texts of each page, newest first, and the words that came and went."""
    order = Window.partitionBy("page_id").orderBy(F.desc("scan"))
    ranked = snapshots.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    both = ranked.groupBy("page_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("scan"))).alias("scan"),
        F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("now"),
        F.max(F.when(F.col("rank") == 2, F.col("text"))).alias("before"),
    )
    words = lambda c: F.array_distinct(F.split(F.coalesce(c, F.lit("")), " "))
    return both.select(
        "page_id",
        "scan",
        F.size(F.array_except(words(F.col("now")), words(F.col("before")))).alias("added"),
        F.size(F.array_except(words(F.col("before")), words(F.col("now")))).alias("removed"),
    )


def missed_closures(scans: DataFrame) -> DataFrame:
    """(job_id, closed_at): the first scan at which a job was missing for the MISSES-th time in a row. scans: (job_id, scan, seen)."""
    order = Window.partitionBy("job_id").orderBy("scan")
    island = F.sum(F.col("seen").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    within = Window.partitionBy("job_id", "island").orderBy("scan").rowsBetween(Window.unboundedPreceding, 0)
    missing = scans.withColumn("island", island).withColumn("misses", F.sum((~F.col("seen")).cast("long")).over(within))
    return missing.where(F.col("misses") == MISSES).groupBy("job_id").agg(F.min("scan").alias("closed_at"))


def expired(jobs: DataFrame, as_of: date) -> DataFrame:
    """jobs with status and closed_reason after the expiry pass: passed deadlines, then undated jobs that are stale."""
    today = F.lit(as_of)
    live = F.col("status").isin("published", "review")
    dead = live & F.coalesce(F.col("deadline") < today, F.lit(False))
    fresh = F.greatest(F.col("first_seen"), F.coalesce("last_reviewed", "first_seen"))
    undated = F.col("deadline").isNull()
    stale = (F.col("status") == "published") & undated & (fresh < F.date_sub(today, STALE_PUBLISHED))
    stale |= (F.col("status") == "review") & undated & (F.col("first_seen") < F.date_sub(today, STALE_REVIEW))
    reason = F.when(dead, "deadline").when(stale, "stale").otherwise(F.col("closed_reason"))
    return jobs.withColumns({"status": F.when(dead | stale, "closed").otherwise(F.col("status")), "closed_reason": reason})


def retained(rows: DataFrame, column: str, days: int, as_of: date) -> DataFrame:
    return rows.where(F.col(column) >= F.date_sub(F.lit(as_of), days))


def upserted(old: DataFrame, found: DataFrame, as_of: date) -> DataFrame:
    """The jobs after a scan: one row a key, from what was stored and what was found.

    old: job_key, title, deadline, status, closed_reason, hash, review_reason, protected (array), ai_fields (array), reviewed, misses;
    found: job_key, new_title, new_deadline, new_hash, eligible, proven, withdrawn, reason. The rules hold one after the other,
    each on what those before it left; jobs that were not found miss once more, and close at the second time.
    """
    both = old.withColumn("known", F.lit(True)).join(found.withColumn("seen", F.lit(True)), "job_key", "full")
    known, seen = F.coalesce("known", F.lit(False)), F.coalesce("seen", F.lit(False))
    empty = F.array().cast("array<string>")
    rows = both.select(
        "job_key",
        known.alias("known"),
        seen.alias("seen"),
        "title",
        "new_title",
        "deadline",
        "new_deadline",
        F.coalesce("status", F.lit("")).alias("status"),
        F.coalesce("closed_reason", F.lit("")).alias("closed_reason"),
        F.coalesce("review_reason", F.lit("")).alias("review_reason"),
        F.array_union(F.coalesce("protected", empty), F.coalesce("ai_fields", empty)).alias("kept"),
        F.coalesce("protected", empty).alias("manual"),
        F.coalesce("ai_fields", empty).alias("ai"),
        (~F.col("hash").eqNullSafe(F.col("new_hash"))).alias("changed"),
        F.coalesce("new_hash", "hash").alias("hash"),
        F.coalesce("reviewed", F.lit(False)).alias("reviewed"),
        F.coalesce("misses", F.lit(0)).alias("misses"),
        F.coalesce("eligible", F.lit(False)).alias("eligible"),
        F.coalesce("proven", F.lit(False)).alias("proven"),
        F.coalesce("withdrawn", F.lit(False)).alias("withdrawn"),
        F.coalesce("reason", F.lit("")).alias("reason"),
    )
    take = lambda new, old_, name: F.when(F.col("seen") & ~F.array_contains("kept", name), F.col(new)).otherwise(F.col(old_))
    rows = rows.withColumns({"title": take("new_title", "title", "title"), "deadline": take("new_deadline", "deadline", "deadline")})
    again = F.col("known") & F.col("seen")
    ai_changed = (F.size("ai") > 0) & (F.col("changed") | ((F.col("status") == "review") & (F.col("review_reason") == AI_CHANGED)))
    rows = rows.withColumns(
        {
            "ai_changed": again & ai_changed,
            "expired": F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False)),
            "review_reason": F.when(F.col("seen"), F.when(F.col("reason") != "", F.col("reason")).when(~F.col("proven"), "year not proven").otherwise("")).otherwise(F.col("review_reason")),
        }
    )

    def rule(df: DataFrame, when: Column, status: str, reason: Column | None = None, review: str | None = None) -> DataFrame:
        """Where the condition holds: the new status, and the reason of closing or review if given."""
        df = df.withColumn("hit", again & when)
        out = {"status": F.when(F.col("hit"), status).otherwise(F.col("status"))}
        if reason is not None:
            out["closed_reason"] = F.when(F.col("hit"), reason).otherwise(F.col("closed_reason"))
        if review is not None:
            out["review_reason"] = F.when(F.col("hit"), review).otherwise(F.col("review_reason"))
        return df.withColumns(out).drop("hit")

    s, closed = F.col("status"), F.col("status") == "closed"
    rows = rule(rows, closed & F.col("closed_reason").isin("deadline", "missing") & ~F.col("expired"), "review", F.lit(""))
    rows = rule(rows, F.col("ai_changed") & (s != "closed"), "review", review=AI_CHANGED)
    rows = rule(rows, F.col("eligible") & F.col("proven") & (s == "review") & (F.size("manual") == 0) & ~F.col("ai_changed"), "published")
    rows = rule(rows, ~F.col("proven") & (s == "published") & ~F.col("reviewed"), "review")
    rows = rule(rows, ~F.col("eligible") & (s == "published") & ~F.col("reviewed"), "review")
    rows = rule(rows, ~F.col("eligible") & (s == "published") & F.col("reviewed") & F.col("changed"), "review")
    rows = rule(rows, F.col("expired") & (s != "closed"), "closed", F.lit("deadline"))
    rows = rule(rows, F.col("withdrawn") & (s != "closed"), "closed", F.lit("withdrawn"))
    fresh = F.when(F.col("eligible") & F.col("proven"), "published").otherwise("review")
    rows = rows.withColumn("status", F.when(~F.col("known"), fresh).otherwise(s))
    absent = F.col("known") & ~F.col("seen") & s.isin("published", "review")
    rows = rows.withColumn("misses", F.when(F.col("seen"), 0).when(absent, F.col("misses") + 1).otherwise(F.col("misses")))
    gone = absent & (F.col("misses") >= MISSES)
    rows = rows.withColumns({"closed_reason": F.when(gone, "missing").otherwise(F.col("closed_reason")), "status": F.when(gone, "closed").otherwise(s)})
    return rows.select("job_key", "title", "deadline", "status", "closed_reason", "review_reason", "hash", "misses")


def publish_classes(jobs: DataFrame, as_of: date) -> DataFrame:
    """Why a job can or cannot be published in bulk: the first class that holds."""
    kind = (
        F.when(F.col("duplicate"), "duplicate")
        .when(F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False)), "expired")
        .when(~F.col("enabled"), "source_disabled")
        .when(F.col("status") == "published", "already")
        .otherwise("published")
    )
    return jobs.withColumn("class", kind)


def new_only(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored yet, once each."""
    return rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def reconciled(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("live", "restored")) -> DataFrame:
    """Row counts of two copies side by side."""
    counts = left.agg(F.count(F.lit(1)).alias(names[0])).withColumn("one", F.lit(1)), right.agg(F.count(F.lit(1)).alias(names[1])).withColumn("one", F.lit(1))
    return counts[0].join(F.broadcast(counts[1]), "one").select(*names, (F.col(names[0]) == F.col(names[1])).alias("equal"))
