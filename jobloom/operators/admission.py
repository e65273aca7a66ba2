"""Which links of a listing become candidates, what an archive adds, and what a run may write."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_URL, MOST_LINKS = 1000, 100


def path_year(url: Column) -> Column:
    """The year of a link's archive: of a year and a month next to each other in its path; null where there is none."""
    parts = F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/")
    month = lambda x: F.coalesce(x.rlike("^[0-9]{1,2}$") & x.try_cast("int").between(1, 12), F.lit(False))
    dated = F.transform(parts, lambda x, i: F.when(x.rlike("^20[0-9]{2}$") & month(F.get(parts, i + 1)), x))
    return F.get(F.array_compact(dated), 0).cast("int")


def in_scope(url: Column, year: int) -> Column:
    """Whether a link is in no archive of another year; undated ones stay leads."""
    first = path_year(url)
    return first.isNull() | (first == year)


def same_host(url: Column, listing: Column) -> Column:
    """Whether a link stays on the host of its listing, or below it."""
    host, own = (F.lower(F.try_parse_url(u, F.lit("HOST"))) for u in (url, listing))
    return F.coalesce((host == own) | host.endswith(F.concat(F.lit("."), own)), F.lit(False))


def safe_url(url: Column) -> Column:
    """Whether a URL may be stored: web address with a host, without credentials, of a length that fits."""
    at = F.coalesce(F.try_parse_url(url, F.lit("USERINFO")), F.lit(""))
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (host != "") & (at == "") & (F.length(url) <= LONGEST_URL), F.lit(False))


def links(found: DataFrame, known: DataFrame, year: int) -> DataFrame:
    """(source_id, url, title, pos, known_only) of the links to look at, once each: those in scope, then for partial listings published jobs.

    found: source_id, url, title, pos, partial; known: source_id, url, title of published jobs. Too long URLs are left out.
    """
    kept = found.where(in_scope(F.col("url"), year) & (F.length("url") <= LONGEST_URL))
    first = kept.groupBy("source_id", "url", "title").agg(F.min("pos").alias("pos"))
    partial = found.where("partial").select("source_id").distinct()
    absent = known.join(partial, "source_id", "left_semi").join(kept.select("source_id", "url").distinct(), ["source_id", "url"], "left_anti")
    absent = absent.groupBy("source_id", "url", "title").agg(F.lit(None).cast("long").alias("pos"))
    return first.withColumn("known_only", F.lit(False)).unionByName(absent.withColumn("known_only", F.lit(True)))


def over_limit(chosen: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(source_id, links, error) of every source: one with too many links fails as a whole, and none of its links counts."""
    n = F.count(F.lit(1))
    return chosen.groupBy("source_id").agg(n.alias("links"), F.when(n > most, F.concat(F.lit(f"More than {most} possible links: "), n.cast("string"))).alias("error"))


def admitted(candidates: DataFrame, known: DataFrame, as_of: date) -> DataFrame:
    """Candidates worth an entry: known jobs always, others if in scope and neither excluded, closed nor over.

    candidates: source_id, url, deadline, in_scope_year, excluded, withdrawn; known: source_id, url of all jobs.
    """
    skip = F.col("excluded") | F.col("withdrawn") | F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False))
    seen = known.select("source_id", "url", F.lit(True).alias("is_known")).distinct()
    both = candidates.join(seen, ["source_id", "url"], "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    return both.where(F.col("is_known") | (F.col("in_scope_year") & ~skip))


def backfill(candidates: DataFrame, known: DataFrame, as_of: date) -> DataFrame:
    """Ended adverts of the archive's year that are not known yet, as closed jobs; public ones pass all checks but an open deadline.

    candidates: source_id, url, deadline, in_scope_year, excluded, withdrawn, qualified, year_proven.
    """
    ended = F.col("withdrawn") | F.coalesce(F.col("deadline") < F.lit(as_of), F.lit(False))
    new = candidates.where(F.col("in_scope_year") & ended & ~F.col("excluded")).join(known.select("source_id", "url").distinct(), ["source_id", "url"], "left_anti")
    return new.dropDuplicates(["source_id", "url"]).select("source_id", "url", "deadline", F.lit("closed").alias("status"), F.lit("deadline").alias("closed_reason"), (F.col("qualified") & F.col("year_proven")).alias("public"))


def backfill_summary(rows: DataFrame) -> DataFrame:
    """(source_id, created, public)."""
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("created"), F.count_if("public").alias("public"))


def written(stored: DataFrame, run: DataFrame, failed: DataFrame) -> DataFrame:
    """The stored rows after a run: of a source that failed as they were, of the others as the run has them. All have a source_id.

    A source is replaced whole or not at all, as with one partition a source that is overwritten.
    """
    bad = failed.select("source_id").distinct()
    ran = run.select("source_id").distinct().join(bad, "source_id", "left_anti")
    kept = stored.join(ran, "source_id", "left_anti")
    return kept.unionByName(run.join(ran, "source_id", "left_semi").select(*stored.columns))


def with_missions(jobs: DataFrame, missions: DataFrame) -> DataFrame:
    """jobs with the mission that their symbol names, and an error where it names none: a listing with such a job is incomplete."""
    named = missions.groupBy("symbol").agg(F.min("mission").alias("mission"))
    out = jobs.join(named, "symbol", "left")
    return out.withColumn("error", F.when(F.col("mission").isNull(), F.concat(F.lit("no mission for "), F.coalesce("symbol", F.lit("nothing")))))


def us_date(text: Column) -> Column:
    """A month-first date."""
    return F.try_to_date(F.regexp_extract(text, r"\d{1,2}/\d{1,2}/\d{4}", 0), "M/d/y")


#: Months in Spanish.
SPANISH_MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def spanish_date(text: Column) -> Column:
    """The first date written out in Spanish; null where its month is none or the day does not exist."""
    part = lambda k: F.regexp_extract(text, r"(?i)(\d{1,2})\s+de\s+(\w+)\s+(?:de|del)?\s*(20\d{2})", k)
    month = F.array_position(F.array(*[F.lit(m) for m in SPANISH_MONTHS]), F.lower(part(2)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(3), month.cast("string"), part(1)), "y-M-d"))


def worded_date(text: Column) -> Column:
    """A date with an English month's short name: month first with a comma, or day first with slashes."""
    return F.coalesce(F.try_to_date(F.trim(text), "MMM d, y"), F.try_to_date(F.trim(text), "d/MMM/y"))


def local_day(stamp: Column, turns_at_hour: int) -> Column:
    """The day of a UTC stamp of a portal whose day turns at that hour: earlier hours belong to the day before."""
    return F.when(F.hour(stamp) < turns_at_hour, F.date_sub(F.to_date(stamp), 1)).otherwise(F.to_date(stamp))


def evidence(title: Column, published: Column, closing: Column, body: Column) -> Column:
    """The text that a listing's fields stand for: title, dates as far as known, body."""
    dated = lambda label, day: F.when(day.isNotNull(), F.concat(F.lit(f"{label} "), day.cast("string")))
    return F.concat_ws(". ", title, dated("Published", published), dated("Closing date", closing), body)


def labelled(labels: Column, values: Column, *names: str) -> Column:
    """Of a label/value table the first value under any of the names, tried in order."""
    found = F.map_from_entries(F.filter(F.arrays_zip(labels.alias("k"), values.alias("v")), lambda x: x["k"].isNotNull()))
    return F.coalesce(*[F.try_element_at(found, F.lit(n)) for n in names])
