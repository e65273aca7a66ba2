"""Queries on aggregators' payloads, which are made of the given documents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.plans.registered import query
from jobloom.plans.standins import table
from jobloom.sources import aggregators

TODAY, YEAR = date(2026, 5, 1), 2026
SENTENCE = "Staff will be based in Sarajevo, Bosnia & Herzegovina."


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as payloads of both shapes: countries, dates and links by number, some without an employer, some no JSON at all."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    k = F.col("doc_id")
    posted, closing = F.date_add(F.lit("2025-11-01").cast("date"), (k % 300).cast("int")), F.date_add(F.lit("2026-01-01").cast("date"), (k % 365).cast("int"))
    home, away = F.lit("Bosnia and Herzegovina"), F.lit("Serbia")
    names = F.when(k % 3 == 0, F.array(home)).when(k % 3 == 1, F.array(away, home)).otherwise(F.array(away))
    body = F.concat(F.coalesce("text", F.lit("")), F.when(k % 5 == 0, F.lit(f"\n{SENTENCE} Apply soon.")).otherwise(""))
    title = F.concat(F.when(k % 17 == 0, "Volunteer ").otherwise("Officer "), k)
    employer = F.when(k % 19 != 7, F.concat(F.lit("Agency "), "source"))
    links = F.when(k % 4 == 0, F.array(F.lit("https://Jobs.example.org/1?b=2&a=1"))).when(k % 4 == 1, F.array(F.lit("https://a.example.org/1"), F.lit("https://b.example.org/1"))).when(k % 4 == 2, F.array(F.lit("javascript:void(0)"), F.lit("https://a.example.org/1")))
    page = F.to_json(
        F.struct(
            title.alias("title"), F.struct(employer.alias("name")).alias("employer"), body.alias("body"), F.struct(F.when(k % 7 != 1, posted).cast("string").alias("posted"), closing.cast("string").alias("closing")).alias("dates"),
            F.transform(names, lambda n: F.struct(n.alias("name"), F.when(n == home, "/country/bih").otherwise("/country/srb").alias("path"))).alias("countries"), links.alias("apply"),
        )
    )
    item = F.to_json(
        F.struct(
            F.struct(title.alias("title"), body.alias("description"), F.when(k % 7 != 1, F.concat(F.lit("Fri, "), F.date_format(posted, "dd MMM yyyy"), F.lit(" 00:30:00 +0000"))).alias("pubDate")).alias("item"),
            F.struct(F.concat(F.lit("Countries: "), F.array_join(names, ", ")).alias("country"), F.concat(F.lit("Organization: "), employer).alias("source"), F.concat(F.lit("Closing date: "), closing.cast("string")).alias("closing")).alias("tags"),
            links.alias("links"),
        )
    )
    return d.select(k.alias("id"), F.concat(F.lit("https://agg.example.org/job/"), k).alias("url"), F.when(k % 2 == 0, "page").otherwise("item").alias("shape"), F.when(k % 23 == 11, "<html>").when(k % 2 == 0, page).otherwise(item).alias("payload"))


ADVERTS = rf"""
    SELECT doc_id AS id, doc_id % 2 = 0 AS page, doc_id % 3 AS c, coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '{SENTENCE} Apply soon.' ELSE '' END AS body,
      CASE WHEN doc_id % 17 = 0 THEN 'Volunteer ' ELSE 'Officer ' END || doc_id AS title, CASE WHEN doc_id % 19 <> 7 THEN 'Agency ' || source END AS employer,
      CASE WHEN doc_id % 7 <> 1 THEN DATE '2025-11-01' + CAST(doc_id % 300 AS INTEGER) END AS published, DATE '2026-01-01' + CAST(doc_id % 365 AS INTEGER) AS deadline,
      doc_id % 23 = 11 AS broken, doc_id % 4 AS l, doc_id % 5 = 0 AS stated
    FROM documents WHERE doc_id IS NOT NULL"""


@query(f"""
    SELECT id, CASE WHEN page THEN 'page' ELSE 'item' END AS shape, CASE WHEN NOT broken THEN title END AS title, CASE WHEN NOT broken THEN coalesce(employer, '') END AS employer,
      CASE WHEN NOT broken THEN sha256(body) END AS text_sha256, CASE WHEN NOT broken THEN CAST(published AS VARCHAR) END AS published, CASE WHEN NOT broken THEN CAST(deadline AS VARCHAR) END AS closing,
      CASE WHEN NOT broken THEN array_to_string([['Bosnia and Herzegovina'], ['Serbia', 'Bosnia and Herzegovina'], ['Serbia']][c + 1], '|') END AS countries, CASE WHEN NOT broken THEN c < 2 END AS in_country,
      CASE WHEN broken THEN 'no JSON' WHEN employer IS NULL THEN 'fields missing' END AS error
    FROM ({ADVERTS})""")
def aggregator_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes to the same fields."""
    found = aggregators.extracted(payloads(spark, sf_dir))
    known = F.col("error").isNull() | (F.col("error") != "no JSON")
    day = lambda c: F.when(known, F.col(c).cast("string")).alias(c)
    return found.select("id", "shape", day("title"), day("employer"), F.when(known, F.sha2("text", 256)).alias("text_sha256"), day("published"), day("closing"), F.when(known, F.array_join("countries", "|")).alias("countries"), F.when(known, F.col("in_country")).alias("in_country"), "error")


@query(f"""
    SELECT id, employer, CASE l WHEN 0 THEN 'https://jobs.example.org/1?a=1&b=2' WHEN 2 THEN 'https://a.example.org/1' ELSE '' END AS application_url, CAST(published AS VARCHAR) AS published, CAST(deadline AS VARCHAR) AS deadline,
      CASE c WHEN 0 THEN 'Bosnia and Herzegovina' WHEN 1 THEN 'Serbia; Bosnia and Herzegovina' || CASE WHEN stated THEN '. {SENTENCE}' ELSE '' END ELSE 'Serbia' END AS location,
      (c = 0 OR c = 1 AND stated) AND deadline >= DATE '{TODAY}' AND title NOT LIKE 'Volunteer%' AS eligible,
      coalesce(year(published) = {YEAR}, year(deadline) >= {YEAR}) AS in_scope_year, coalesce(year(published) = {YEAR}, false) AS year_proven,
      concat_ws('; ', CASE WHEN NOT (c = 0 OR c = 1 AND stated) THEN 'no location in the country' END, CASE WHEN deadline < DATE '{TODAY}' THEN 'deadline has passed' END,
        CASE WHEN title LIKE 'Volunteer%' THEN 'excluded kind' END, CASE WHEN NOT coalesce(year(published) = {YEAR}, false) THEN 'year not proven' END) AS reason
    FROM ({ADVERTS}) WHERE NOT broken AND employer IS NOT NULL""")
def aggregator_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = aggregators.candidates(aggregators.extracted(payloads(spark, sf_dir)), TODAY, YEAR)
    return made.select("id", "employer", "application_url", F.col("published").cast("string").alias("published"), F.col("deadline").cast("string").alias("deadline"), "location", "eligible", "in_scope_year", "year_proven", "reason")
