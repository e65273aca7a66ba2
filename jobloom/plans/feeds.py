"""Queries on sitemaps and feeds made of the given pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.dedup import _shared
from jobloom.plans.registered import query
from jobloom.plans.standins import table
from jobloom.sources import xml


def escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def sitemaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as sitemaps of a hundred locations, ten sitemaps an index. Every seventh sitemap is missing, every eleventh is no XML."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    url = F.concat(F.lit("<url><loc> "), escaped(F.col("url")), F.lit("</loc>"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<lastmod>2026-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T01:02:03Z</lastmod>"))).otherwise(""), F.lit("</url>"))
    k = F.expr("page_id div 100")
    per = p.groupBy(k.alias("k")).agg(F.array_join(F.array_sort(F.collect_list(url)), "").alias("urls"))
    address = F.concat(F.lit("https://x.org/map-"), "k", F.lit(".xml"))
    source = F.expr("k div 10").alias("source_id")
    made = per.select(source, "k", address.alias("url"), F.concat(F.lit('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "urls", F.lit("</urlset>")).alias("payload"))
    maps = made.where("k % 7 != 3").withColumn("payload", F.when(F.col("k") % 11 == 5, "<html>moved</html>").otherwise(F.col("payload"))).drop("k")
    named = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>")))), "")
    index = made.groupBy("source_id").agg(named.alias("m")).select("source_id", F.concat(F.lit("https://x.org/index-"), "source_id").alias("url"), F.concat(F.lit("<s:sitemapindex xmlns:s='u'>"), F.replace(F.replace("m", F.lit("<"), F.lit("<s:")), F.lit("<s:/"), F.lit("</s:")), F.lit("</s:sitemapindex>")).alias("payload"))
    return index, maps


@query("""
    WITH p AS (SELECT page_id // 100 AS k, page_id // 1000 AS source_id, url, CASE WHEN page_id % 3 <> 0 THEN '2026-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod FROM pages WHERE url IS NOT NULL)
    SELECT source_id, 'https://x.org/map-' || k || '.xml' AS page, url, lastmod, NULL AS error FROM p WHERE k % 7 <> 3 AND k % 11 <> 5
    UNION ALL SELECT DISTINCT source_id, 'https://x.org/map-' || k || '.xml', NULL, NULL, CASE WHEN k % 7 = 3 THEN 'sitemap missing' ELSE 'no sitemap' END FROM p WHERE k % 7 = 3 OR k % 11 = 5""")
def sitemap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.through_index(*sitemaps(spark, sf_dir)).withColumn("lastmod", F.col("lastmod").cast("string"))


@query("SELECT url, CASE WHEN page_id % 3 <> 0 THEN '2026-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS lastmod FROM pages WHERE url IS NOT NULL AND (page_id // 100) % 7 <> 3 AND (page_id // 100) % 11 <> 5")
def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sitemaps written to compressed files, and read by Spark's XML source."""
    path = _shared(spark, "sitemaps")
    maps = sitemaps(spark, sf_dir)[1].select(F.xxhash64("url").alias("map"), F.col("payload").alias("value"))
    maps.write.partitionBy("map").option("compression", "gzip").text(path)
    return xml.read_sitemap_files(spark, path).select("url", F.col("lastmod").cast("string").alias("lastmod"))


#: What is left of a text that may stand in XML, with its spaces made one.
CLEAN = r"[\x00-\x20\x7F-\xA0\u0085\u2028\u2029\uFFFE\uFFFF]+"


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feeds of twenty entries, RSS and Atom by turns."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), CLEAN, " "))
    k, page = F.col("doc_id"), F.expr("doc_id div 20")
    title = F.when(k % 10 == 9, "").otherwise(F.concat(F.lit("No "), k))
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 300).cast("int"))
    rss = F.concat(F.lit("<item><title>"), title, F.lit(" &amp; Co</title><link>https://x.org/"), k, F.lit("</link><c:encoded>"), escaped(text), F.lit("</c:encoded><pubDate>Mon, "), F.date_format(day, "d MMM yyyy"), F.lit(" 23:30:00 -0100</pubDate></item>"))
    atom = F.concat(F.lit("<entry><title type='text'>"), title, F.lit("</title><link rel='self' href='no'/><link href='https://x.org/"), k, F.lit("'/><content type='html'>"), escaped(text), F.lit("</content><updated>"), day.cast("string"), F.lit("T00:00:00Z</updated></entry>"))
    per = d.select(page.alias("page"), k.alias("k"), F.when(page % 2 == 0, rss).otherwise(atom).alias("item")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]), "\n").alias("items"))
    whole = F.when(F.col("page") % 3 == 0, "<fh:complete/>").otherwise("")
    payload = F.when(F.col("page") % 13 == 7, "<html/>").when(F.col("page") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:c="c" xmlns:fh="f"><channel><title>T</title>'), whole, "items", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:fh="f"><title>T</title>'), whole, "items", F.lit("</feed>"))
    )
    return per.select(F.col("page").alias("source_id"), F.lit("https://x.org/feed").alias("url"), payload.alias("payload"))


@query(r"""
    WITH d AS (
      SELECT doc_id, doc_id // 20 AS source_id, trim(regexp_replace(coalesce(text, ''), '[\x{00}-\x{20}\x{7F}-\x{A0}\x{2028}\x{2029}\x{FFFE}\x{FFFF}]+', ' ', 'g')) AS body, DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER) AS day
      FROM documents WHERE doc_id IS NOT NULL)
    SELECT source_id, 'https://x.org/' || doc_id AS url, CASE WHEN source_id % 2 = 0 THEN CASE WHEN doc_id % 10 = 9 THEN '& Co' ELSE 'No ' || doc_id || ' & Co' END WHEN doc_id % 10 = 9 THEN NULL ELSE 'No ' || doc_id END AS title,
      sha256(body) AS body_sha256, CAST(CASE WHEN source_id % 2 = 0 THEN day + 1 ELSE day END AS VARCHAR) AS published, source_id % 3 = 0 AS complete,
      CASE WHEN source_id % 2 = 1 AND doc_id % 10 = 9 THEN 'entry without title' END AS error
    FROM d WHERE source_id % 13 <> 7
    UNION ALL SELECT DISTINCT source_id, NULL, NULL, sha256(''), NULL, false, 'no feed' FROM d WHERE source_id % 13 = 7""")
def feed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = xml.feed_items(feeds(spark, sf_dir))
    return found.select("source_id", "url", F.nullif("title", F.lit("")).alias("title"), F.sha2("body", 256).alias("body_sha256"), F.col("published").cast("string").alias("published"), "complete", "error")
