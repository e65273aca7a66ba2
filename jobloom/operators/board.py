"""The board: which jobs show, how they are searched, filtered, ordered and listed. Every function takes and returns DataFrames or columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.text import all_words, employer_key, fold
from jobloom.operators import dedup

UNDATED_DAYS, NEW_DAYS, PAGE, FEED = 30, 3, 20, 50
HIDDEN_REASONS = ("manual", "duplicate")
#: What tells the same vacancy of several sources; without these columns there is nothing to tell it by. URLs may be missing.
IDENTITY = {"source_id", "aggregator", "published_on", "employer", "city", "title"}
LEVELS = ["secondary", "junior_college", "bachelor", "master", "phd"]


def is_open(as_of: date) -> Column:
    """Whether a job may show: published by an enabled source, and open by deadline, or without one if seen or reviewed lately."""
    lately = F.date_sub(F.lit(as_of), UNDATED_DAYS)
    undated = F.col("deadline").isNull() & ((F.col("first_seen") >= lately) | F.coalesce(F.col("last_reviewed") >= lately, F.lit(False)))
    return F.coalesce((F.col("status") == "published") & F.col("enabled") & (F.coalesce(F.col("deadline") >= F.lit(as_of), F.lit(False)) | undated), F.lit(False))


def visible(jobs: DataFrame, as_of: date) -> DataFrame:
    """Open jobs, each vacancy once."""
    return unique(jobs, is_open(as_of))


def unique(jobs: DataFrame, shown: Column) -> DataFrame:
    """The shown jobs without copies from other sources, and without aggregator copies of official records that are not shown."""
    found = jobs.where(shown)
    if not set(jobs.columns) >= IDENTITY:
        return found
    rows = jobs.withColumn("shown", F.coalesce(shown, F.lit(False)))
    on = dedup._cut(rows.where("shown").select("job_id", "first_seen", "deadline", *IDENTITY, *[c for c in dedup.ADDRESSES if c in jobs.columns]))
    blocked = dedup.copies_of_official(on, rows.where("not shown"))
    keys = dedup._cut(dedup.identity_keys(on))
    winners = dedup._cut(dedup.shown(on, keys, blocked))
    for df in (on, blocked, keys):
        dedup._drop(df)
    return found.join(winners, "job_id", "left_semi")


def public_history(jobs: DataFrame) -> DataFrame:
    """What was ever public: published, or closed after publication for no private reason."""
    closed = (F.col("status") == "closed") & F.col("published_on").isNotNull() & ~F.col("closed_reason").isin(*HIDDEN_REASONS)
    return jobs.where((F.col("status") == "published") | closed)


def past(jobs: DataFrame, as_of: date) -> DataFrame:
    """Public jobs that are over. What is open is told by the row itself, so no other row is looked up."""
    over = (F.col("status") == "closed") & ~F.col("closed_reason").isin(*HIDDEN_REASONS)
    expired = (F.col("status") == "published") & F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False))
    return jobs.where(F.col("published_on").isNotNull() & (over | expired) & ~is_open(as_of))


def by_name(rows: DataFrame, column: str = "name") -> DataFrame:
    """In the order of folded names, whatever their case and marks."""
    return rows.orderBy(fold(F.col(column)), column)


def search(jobs: DataFrame, query: str) -> DataFrame:
    """Jobs whose title, city and employer together have every word of the query."""
    return jobs.where(all_words(F.concat_ws(" ", "title", "city", "employer"), F.lit(query)))


def of_employer(jobs: DataFrame, name: str) -> DataFrame:
    return jobs.where(employer_key(F.col("employer")) == employer_key(F.lit(name)))


def facet(jobs: DataFrame, column: str, value: str, known: list[str]) -> DataFrame:
    """Jobs with a value; an unknown value filters nothing."""
    return jobs.where(F.col(column) == value) if value in known else jobs


def up_to_level(jobs: DataFrame, level: str) -> DataFrame:
    """Jobs that ask for no higher education than the visitor's; unstated ones are left out."""
    return jobs.where(F.col("education_level").isin(*LEVELS[: LEVELS.index(level) + 1]))


def up_to_years(jobs: DataFrame, years: int) -> DataFrame:
    return jobs.where(F.col("experience_years") <= years)


def not_before(column: str, day: date) -> Column:
    """Keeps null dates, as excluding earlier ones should."""
    return ~F.coalesce(F.col(column) < F.lit(day), F.lit(False))


def by_deadline() -> list[Column]:
    return [F.asc_nulls_last("deadline"), F.desc("first_seen"), F.desc("job_id")]


def newest() -> list[Column]:
    return [F.desc("first_seen"), F.desc("job_id")]


def page(jobs: DataFrame, order: list[Column], number: int = 1, size: int = PAGE) -> DataFrame:
    return jobs.orderBy(*order).offset((number - 1) * size).limit(size)


def annotated(jobs: DataFrame, as_of: date) -> DataFrame:
    """With the days left, whether a job is new, and the state of its deadline."""
    days = F.datediff(F.col("deadline"), F.lit(as_of))
    state = F.when(days.isNull(), "undated").when(days < 0, "over").when(days == 0, "today").when(days <= 7, "soon").otherwise("open")
    return jobs.withColumns({"days_left": days, "is_new": F.col("first_seen") >= F.date_sub(F.lit(as_of), NEW_DAYS), "deadline_state": state})


def facet_values(jobs: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, jobs) of every value that occurs; one pass over the jobs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return jobs.select(F.explode(pairs).alias("p")).where("p.value is not null and p.value != ''").groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("jobs"))


def sitemap(paths: DataFrame, languages: list[str], base: str) -> DataFrame:
    """A URL for each path and language; the languages are a literal, so no join is made."""
    langs = F.explode(F.array(*[F.lit(x) for x in languages]))
    return paths.select("path", langs.alias("lang")).select("lang", F.concat(F.lit(base), F.lit("/"), F.col("lang"), F.col("path")).alias("url"))
