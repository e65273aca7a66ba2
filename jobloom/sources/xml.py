"""Sitemaps, their indexes, and feeds, parsed by Spark's own XML functions: no worker but the executor's own reads a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "ignoreNamespace": "true"}
URLS = "url array<struct<loc:string,lastmod:string>>, bad string"
MAPS = "sitemap array<struct<loc:string,lastmod:string>>, bad string"
LINK = "link:array<struct<_VALUE:string,_href:string,_rel:string>>"
RSS = f"channel struct<item:array<struct<title:string,{LINK},description:string,encoded:string,pubDate:string>>,complete:string>, bad string"
ATOM = f"entry array<struct<title:struct<_VALUE:string,_type:string>,{LINK},summary:struct<_VALUE:string,_type:string>,content:struct<_VALUE:string,_type:string>,updated:string,published:string>>, complete string, bad string"


def rooted(payload: Column, *roots: str) -> Column:
    """Whether the first element of a document is one of these, with or without a prefix."""
    return F.coalesce(payload.rlike(r"^\s*(<\?[^>]*>\s*)*(<!--.*?-->\s*)*(<!DOCTYPE[^>]*>\s*)?<([\w.-]+:)?(" + "|".join(roots) + r")[\s>/]"), F.lit(False))


def sitemap_urls(bronze: DataFrame) -> DataFrame:
    """(source_id, page, url, lastmod, error): a row for each location of each sitemap, or one with the error of what is none. bronze: source_id, url, payload."""
    read = bronze.withColumn("x", F.from_xml("payload", URLS, OPTIONS))
    error = F.when(~rooted(F.col("payload"), "urlset"), "no sitemap").when(F.col("x.bad").isNotNull(), "broken XML")
    each = read.select("source_id", F.col("url").alias("page"), error.alias("error"), F.explode_outer("x.url").alias("u"))
    return each.where("error is not null or trim(u.loc) != ''").select("source_id", "page", F.when(F.col("error").isNull(), F.trim("u.loc")).alias("url"), F.when(F.col("error").isNull(), F.try_to_date(F.substring(F.trim("u.lastmod"), 1, 10))).alias("lastmod"), "error")


def through_index(indexes: DataFrame, bronze: DataFrame) -> DataFrame:
    """(source_id, page, url, lastmod, error): the locations of all sitemaps that the sources' indexes name.

    indexes, bronze: source_id, url, payload, of the indexes and of the sitemaps as fetched. A sitemap that is named but not there is an
    error, so that a source with half of its sitemaps is not taken for one that lists less; one that no index names is not read.
    """
    read = indexes.withColumn("x", F.from_xml("payload", MAPS, OPTIONS))
    error = F.when(~rooted(F.col("payload"), "sitemapindex"), "no sitemap index").when(F.col("x.bad").isNotNull(), "broken XML")
    named = read.select("source_id", F.col("url").alias("index"), error.alias("error"), F.explode_outer("x.sitemap").alias("m"))
    bad = named.where("error is not null").select("source_id", F.col("index").alias("page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("date").alias("lastmod"), "error")
    wanted = named.where("error is null and trim(m.loc) != ''").select("source_id", F.trim("m.loc").alias("page")).distinct()
    there = bronze.select("source_id", F.col("url").alias("page"), "payload").dropDuplicates(["source_id", "page"])
    both = wanted.join(there.withColumn("there", F.lit(True)), ["source_id", "page"], "left")
    lost = both.where("there is null").select("source_id", "page", F.lit(None).cast("string").alias("url"), F.lit(None).cast("date").alias("lastmod"), F.lit("sitemap missing").alias("error"))
    found = sitemap_urls(both.where("there").select("source_id", F.col("page").alias("url"), "payload"))
    return found.unionByName(lost).unionByName(bad)


def as_listings(found: DataFrame) -> DataFrame:
    """Locations as listings: the last part of the path is the title, and nothing else is known of them."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "/+$", "")
    title = F.nullif(F.trim(F.translate(F.substring_index(path, "/", -1), "-_", "  ")), F.lit(""))
    return found.select("source_id", "page", "url", F.when(F.col("url").isNotNull(), F.coalesce(title, F.col("url"))).alias("title"), F.lit("").alias("evidence"), "error")


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod, file) of each location in files of one sitemap each, compressed ones too."""
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", True).schema("loc string, lastmod string").load(path)
    return rows.where("trim(loc) != ''").select(F.trim("loc").alias("url"), F.try_to_date(F.substring(F.trim("lastmod"), 1, 10)).alias("lastmod"), F.col("_metadata.file_name").alias("file"))


def mail_date(text: Column) -> Column:
    """The day of a date as mail has it, in UTC; the weekday is left out, as it is sometimes wrong."""
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^[A-Za-z]{2,9},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")))


def feed_items(bronze: DataFrame) -> DataFrame:
    """(source_id, page, n, url, title, body, published, complete, error) of each entry of RSS and Atom feeds, or one row with the error of what is none.

    complete: the feed says itself that it holds all there is. An entry's link is the one that is no other kind of link, or its only
    one. An entry without title or link is an error, as the feed has changed then. bronze: source_id, url, payload.
    """
    rss, atom = rooted(F.col("payload"), "rss"), rooted(F.col("payload"), "feed")
    # Each document is read once, as the one or the other.
    read = bronze.withColumns({"r": F.from_xml(F.when(rss, F.col("payload")), RSS, OPTIONS), "a": F.from_xml(F.when(~rss, F.col("payload")), ATOM, OPTIONS)})
    link = lambda x: F.trim(F.coalesce(F.get(F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"], F.get(F.filter(x["link"], lambda k: k["_VALUE"].isNotNull()), F.lit(0))["_VALUE"]))
    day = lambda x: F.try_to_date(F.substring(F.trim(x), 1, 10))
    of_rss = F.transform("r.channel.item", lambda x: F.struct(link(x).alias("url"), F.trim(x["title"]).alias("title"), F.coalesce(x["encoded"], x["description"]).alias("body"), mail_date(x["pubDate"]).alias("published")))
    of_atom = F.transform("a.entry", lambda x: F.struct(link(x).alias("url"), F.trim(x["title"]["_VALUE"]).alias("title"), F.coalesce(x["content"]["_VALUE"], x["summary"]["_VALUE"]).alias("body"), F.coalesce(day(x["published"]), day(x["updated"])).alias("published")))
    broken = F.when(~rss & ~atom, "no feed").when(F.coalesce(F.when(rss, F.col("r.bad")), F.when(atom, F.col("a.bad"))).isNotNull(), "broken XML")
    whole = F.when(rss, F.col("r.channel.complete").isNotNull() | F.col("payload").rlike(r"<([\w.-]+:)?complete\s*/>")).otherwise(F.col("a.complete").isNotNull() | F.col("payload").rlike(r"<([\w.-]+:)?complete\s*/>"))
    # What holds for a feed is found before its entries are dealt out, or the whole document would be searched for each of them.
    whole_feed = read.select("source_id", F.col("url").alias("page"), F.coalesce(whole, F.lit(False)).alias("complete"), broken.alias("broken"), F.when(broken.isNull(), F.when(rss, of_rss).otherwise(of_atom)).alias("entries"))
    each = whole_feed.select("source_id", "page", "complete", "broken", F.posexplode_outer("entries").alias("n", "e"))
    lacks = F.when(F.col("e").isNotNull() & (F.coalesce("e.url", F.lit("")) == ""), "entry without link").when(F.col("e").isNotNull() & (F.coalesce("e.title", F.lit("")) == ""), "entry without title")
    return each.where("broken is not null or e is not null").select("source_id", "page", "n", "e.url", "e.title", F.coalesce("e.body", F.lit("")).alias("body"), "e.published", "complete", F.coalesce("broken", lacks).alias("error"))
