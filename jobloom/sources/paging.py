"""Listings over several recorded pages: next links are followed, and a source counts only if its pages are all there and agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.operators.dedup import _cut

MOST_PAGES, MOST_LINKS = 10, 100
WALKED = ["source_id", "pages", "links", "end", "error"]


def below(url, base):
    """Whether a link stays on its listing: same scheme and host, and a path that begins with the listing's."""
    part = lambda u, name: F.coalesce(F.try_parse_url(u, F.lit(name)), F.lit(""))
    same = (part(url, "PROTOCOL") == part(base, "PROTOCOL")) & (F.lower(part(url, "AUTHORITY")) == F.lower(part(base, "AUTHORITY")))
    return same & part(url, "PATH").startswith(F.regexp_replace(part(base, "PATH"), "/+$", ""))


def followed(pages: DataFrame, starts: DataFrame, most_pages: int = MOST_PAGES, most_links: int = MOST_LINKS) -> DataFrame:
    """(source_id, pages, links, end, error) of each source of starts: what its pages list, and why reading them stopped.

    pages: source_id, url, next_url, total (as stated, else null), items (array of URLs), older (all of it is from before what is wanted);
    of a page recorded twice, the one with the least content counts. starts: source_id, url.

    All sources go a page further in each round, of which there are at most most_pages: a round joins one row a source with the pages,
    and is written before the next, so that no lineage piles up. A source ends well when it has as many links as its total says, at an
    older page, at a page that repeats what was there where no total is stated, or at one without a next link. It fails, and then none of its
    links counts, if a page is missing, if totals differ or are not met, if a next link repeats a page or leaves the listing, with too many links, or too many pages.
    """
    first = F.min(F.struct("next_url", "total", F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>")))).alias("items"), F.coalesce("older", F.lit(False)).alias("older")))
    known = _cut(pages.where("source_id is not null and url is not null").groupBy("source_id", "url").agg(first.alias("page")))
    nothing = F.array().cast("array<string>")
    front = starts.groupBy("source_id").agg(F.min("url").alias("base")).where("base is not null").select(
        "source_id", "base", F.col("base").alias("url"), F.lit(0).alias("pages"), nothing.alias("links"), F.lit(None).cast("long").alias("stated"), nothing.alias("seen")
    )
    done = []
    for _ in range(most_pages):
        # The files of known pages are small for what they hold: without the hint, all of it went through the driver in each round.
        step = front.join(known.hint("merge"), ["source_id", "url"], "left").withColumn("before", F.size("links"))
        items = F.coalesce(F.col("page.items"), nothing)
        step = step.withColumns({"links": F.array_union("links", items), "pages": F.col("pages") + 1, "seen": F.array_append("seen", F.col("url")), "next": F.col("page.next_url"), "said": F.col("page.total").cast("long")})
        n, later = F.size("links"), F.col("pages") > 1
        error = (
            F.when(F.col("page").isNull(), "page missing")
            .when(later & ~F.col("said").eqNullSafe(F.col("stated")), "total changed between pages")
            .when((n > most_links) | F.coalesce(F.col("said") > most_links, F.lit(False)), "too many links")
            .when(F.col("said").isNotNull() & (n > F.col("said")), "more links than stated")
        )
        end = (
            F.when(F.col("said").isNotNull() & (n == F.col("said")), "total met")
            .when(F.col("page.older"), F.when(F.col("said").isNull(), "older page"))
            .when(F.col("said").isNull() & later & (n == F.col("before")), "repeated items")
            .when(F.col("said").isNull() & F.col("next").isNull(), "last page")
        )
        stuck = (
            F.when(F.col("next").isNull() | (later & (n == F.col("before"))), "total not met")
            .when(F.array_contains("seen", F.col("next")) | ~below(F.col("next"), F.col("base")), "next link repeats or leaves")
            .when(F.col("pages") >= most_pages, "too many pages")
        )
        step = _cut(step.withColumn("error", error).withColumn("end", F.when(F.col("error").isNull(), end)).withColumn("error", F.coalesce("error", F.when(F.col("end").isNull(), stuck))))
        over = "error is not null or end is not null"
        done.append(step.where(over).select("source_id", "pages", F.when(F.col("error").isNull(), F.col("links")).otherwise(nothing).alias("links"), "end", "error"))
        front = step.where(f"not ({over})").select("source_id", "base", F.col("next").alias("url"), "pages", "links", F.col("said").alias("stated"), "seen")
        if not front.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done).select(*WALKED)
