"""Adverts of aggregators: payloads of two shapes to the same fields, and what may be said of an advert that others copied."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import vocabulary as V
from jobloom.functions.extract import city, opportunity_type, says, scope
from jobloom.functions.text import canonical_url, fold
from jobloom.operators.admission import evidence, safe_url
from jobloom.operators.revisions import sentences
from jobloom.sources.xml import mail_date

HOME, HOME_PATH = "Bosnia and Herzegovina", "/country/bih"
FIELDS = ["title", "employer", "text", "published", "closing", "countries", "in_country", "apply_links"]
LONGEST_TITLE, LONGEST_EMPLOYER = 400, 240


def field(document: Column, path: str, kind: str, default=None) -> Column:
    """The value at a path of a VARIANT as a type; the default where the path leads nowhere, holds null, or holds what is not of the type."""
    found = F.try_variant_get(document, path, kind)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def _day(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10))


def from_page(document: Column) -> dict[str, Column]:
    """Of a job page: title, employer, body, dates, tagged countries with their paths, and links to apply."""
    tags = field(document, "$.countries", "array<struct<name:string,path:string>>", F.array().cast("array<struct<name:string,path:string>>"))
    return {
        "title": field(document, "$.title", "string", ""), "employer": field(document, "$.employer.name", "string", ""), "text": field(document, "$.body", "string", ""),
        "published": _day(field(document, "$.dates.posted", "string")), "closing": _day(field(document, "$.dates.closing", "string")),
        "countries": F.transform(tags, lambda t: t["name"]), "in_country": F.exists(tags, lambda t: F.coalesce(t["path"] == HOME_PATH, F.lit(False))),
        "apply_links": field(document, "$.apply", "array<string>", F.array().cast("array<string>")),
    }


def from_item(document: Column) -> dict[str, Column]:
    """Of a feed's item, whose description states the rest in labelled lines. A country with a comma in its name counts as two, which only asks for more evidence."""
    labelled = lambda path, label: F.regexp_extract(field(document, path, "string", ""), rf"(?s)^\s*{label}:\s*(.*?)\s*$", 1)
    names = F.filter(F.transform(F.split(labelled("$.tags.country", "Countries"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return {
        "title": field(document, "$.item.title", "string", ""), "employer": labelled("$.tags.source", "Organization"), "text": field(document, "$.item.description", "string", ""),
        "published": mail_date(field(document, "$.item.pubDate", "string")), "closing": _day(labelled("$.tags.closing", "Closing date")),
        "countries": names, "in_country": F.array_contains(names, HOME), "apply_links": field(document, "$.links", "array<string>", F.array().cast("array<string>")),
    }


EXTRACTORS = {"page": from_page, "item": from_item}


def extracted(payloads: DataFrame) -> DataFrame:
    """(id, url, shape, FIELDS, error) of payloads (id, url, shape, payload), JSON texts of either shape.

    Both extractors give the same eight fields, each row by the one of its shape; what is no JSON, of no known shape, or without one of
    title, employer, closing date and countries is an error, as the aggregator has changed then.
    """
    read = payloads.select("id", "url", "shape", F.try_parse_json("payload").alias("v"))
    by_shape = {shape: extract(F.col("v")) for shape, extract in EXTRACTORS.items()}

    def chosen(name: str) -> Column:
        out = F.when(F.lit(False), next(iter(by_shape.values()))[name])
        for shape, columns in by_shape.items():
            out = out.when(F.col("shape") == shape, columns[name])
        return out.alias(name)

    rows = read.select("id", "url", "shape", F.col("v").isNull().alias("unread"), *[chosen(c) for c in FIELDS])
    lacks = (F.trim("title") == "") | (F.trim("employer") == "") | F.col("closing").isNull() | (F.size("countries") == 0)
    error = F.when(F.col("unread"), "no JSON").when(~F.coalesce(F.col("shape").isin(*EXTRACTORS), F.lit(False)), "unknown shape").when(lacks, "fields missing")
    return rows.withColumn("error", error).drop("unread")


def residence(text: Column) -> Column:
    """The first sentence that says that one may live or work in the country: a word of residence or work, and soon after it the country. Lines end sentences too."""
    plain = lambda x: F.replace(fold(x), F.lit("&"), F.lit("and"))
    word = r"(^|[^a-z])(resid[a-z]*|work[a-z]*|based|location)[^a-z].{0,250}bosnia and herzegovina"
    parts = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), lambda line: sentences(line)))
    return F.get(F.filter(parts, lambda x: plain(x).rlike(word)), F.lit(0))


def application(links: Column) -> Column:
    """The employer's own address, if the links name but one that may be stored; else empty, as nothing tells them apart."""
    good = F.array_distinct(F.filter(F.transform(links, lambda u: F.when(safe_url(u), canonical_url(u))), lambda u: u.isNotNull()))
    return F.when(F.size(good) == 1, F.get(good, F.lit(0))).otherwise("")


def redirected(target: Column, own_hosts: list[str]) -> Column:
    """Where an aggregator's link to apply leads, if that is another's page: a login wall or a link to itself proves no employer."""
    host = F.lower(F.coalesce(F.try_parse_url(target, F.lit("HOST")), F.lit("")))
    return F.when(safe_url(target) & ~host.isin(*own_hosts), canonical_url(target)).otherwise("")


def candidates(found: DataFrame, as_of: date, year: int) -> DataFrame:
    """What extracted() found as candidates: id, url, title, employer, city, location, application_url, published, deadline, eligible, in_scope_year, year_proven, reason, hash.

    Tags of several countries do not prove that the work may be done in the country: a sentence must say so, and is then part of the
    location. The year is proven by the publication date alone; without one, a deadline only keeps an advert in scope. Errors are left out.
    """
    rows = found.where("error is null").withColumns(
        {
            "title": F.substring(F.trim("title"), 1, LONGEST_TITLE), "employer": F.substring(F.trim("employer"), 1, LONGEST_EMPLOYER), "several": F.size("countries") > 1,
            "proof": F.when(F.size("countries") > 1, residence(F.col("text"))), "today": F.lit(as_of),
        }
    )
    rows = rows.withColumns(
        {
            "inside": F.col("in_country") & (~F.col("several") | F.col("proof").isNotNull()),
            "excluded": says(F.col("title"), V.LEFT_OUT) | says(F.col("text"), V.UNPAID),
            "fresh": F.col("closing") >= F.col("today"),
            "proven": F.coalesce(F.year("published") == year, F.lit(False)),
        }
    )
    location = F.concat_ws(". ", F.array_join("countries", "; "), F.when(F.col("inside"), F.col("proof")))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("inside"), "no location in the country"), F.when(~F.col("fresh"), "deadline has passed"), F.when(F.col("excluded"), "excluded kind"), F.when(~F.col("proven"), "year not proven")
        )
    )
    whole = evidence(F.concat(F.lit("Employer: "), "employer", F.lit(". Location: "), location), F.col("published"), F.col("closing"), F.col("text"))
    return rows.select(
        "id", "url", "title", "employer", F.when(F.col("several"), "").otherwise(city(F.col("text"))).alias("city"), location.alias("location"), application(F.col("apply_links")).alias("application_url"), "published",
        F.col("closing").alias("deadline"), opportunity_type(F.col("title")).alias("type"), scope(F.col("title"), F.col("text")).alias("scope"),
        (F.col("inside") & F.col("fresh") & ~F.col("excluded")).alias("eligible"), F.coalesce(F.year("published") == year, F.year("closing") >= year).alias("in_scope_year"),
        F.col("proven").alias("year_proven"), F.array_join(reasons, "; ").alias("reason"), F.sha2(whole, 256).alias("hash"),
    )
