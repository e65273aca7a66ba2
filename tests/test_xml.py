"""Sitemaps, indexes and feeds: as they should be, and as they are."""

from datetime import date

from pyspark.sql import functions as F

from jobloom.sources import payloads, xml

BRONZE = "source_id long, url string, payload string"
MAP = '<?xml version="1.0" encoding="UTF-8"?>\n<!-- made -->\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="n"><url><loc> https://x.org/job/driver-one/ </loc><lastmod>2026-02-03T04:05:06+01:00</lastmod><n:news>1</n:news></url><url><loc>https://x.org/a?b=1&amp;c=2</loc></url><url><loc></loc></url></urlset>'


def test_sitemaps(spark):
    rows = [(1, "m1", MAP), (2, "m2", "<html><body/></html>"), (3, "m3", "<urlset><url><loc>x"), (4, "m4", None), (5, "m5", "<urlset/>"), (6, "m6", ""), (7, "m7", "<s:urlset xmlns:s='u'><s:url><s:loc>https://y.org/</s:loc></s:url></s:urlset>")]
    found = xml.sitemap_urls(spark.createDataFrame(rows, BRONZE))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted([
        (1, "m1", "https://x.org/job/driver-one/", date(2026, 2, 3), None), (1, "m1", "https://x.org/a?b=1&c=2", None, None), (2, "m2", None, None, "no sitemap"), (3, "m3", None, None, "broken XML"),
        (4, "m4", None, None, "no sitemap"), (6, "m6", None, None, "no sitemap"), (7, "m7", "https://y.org/", None, None),
    ], key=repr)
    titles = {r.url: r.title for r in xml.as_listings(found).collect()}
    assert titles["https://x.org/job/driver-one/"] == "driver one" and titles["https://y.org/"] == "https://y.org/" and titles[None] is None


def test_index(spark):
    index = [(1, "i", "<sitemapindex><sitemap><loc>m1</loc></sitemap><sitemap><loc>m2</loc></sitemap><sitemap><loc>m1</loc></sitemap></sitemapindex>"), (2, "i", "<nothing/>")]
    maps = [(1, "m1", MAP), (1, "m1", MAP), (1, "m9", MAP), (2, "m1", MAP)]
    got = [(r.source_id, r.page, r.error) for r in xml.through_index(spark.createDataFrame(index, BRONZE), spark.createDataFrame(maps, BRONZE)).orderBy("source_id", "page", "url").collect()]
    assert got == [(1, "m1", None), (1, "m1", None), (1, "m2", "sitemap missing"), (2, "i", "no sitemap index")]


def test_sitemap_as_configured(spark):
    """A floor of ids and a pattern, as for any listing."""
    rows = [(1, "https://x.org/map", "<urlset>" + "".join(f"<url><loc>https://x.org/jobs/{k}-driver</loc></url>" for k in range(5)) + "<url><loc>https://x.org/news/9</loc></url></urlset>")]
    found = xml.as_listings(xml.sitemap_urls(spark.createDataFrame(rows, BRONZE)))
    config = spark.createDataFrame([(1, None, True, "/jobs/", 3)], "source_id long, need_words boolean, own_host boolean, pattern string, least_id long")
    assert sorted(r.url for r in payloads.configured(found, config).collect()) == ["https://x.org/jobs/3-driver", "https://x.org/jobs/4-driver"]


def test_compressed_files(spark, tmp_path):
    for k, codec in enumerate(("gzip", "none")):
        spark.createDataFrame([(MAP,)], "value string").coalesce(1).write.option("compression", codec).text(str(tmp_path / f"in/{k}"))
    got = sorted((r.url, str(r.lastmod)) for r in xml.read_sitemap_files(spark, str(tmp_path / "in/*")).collect())
    assert got == [("https://x.org/a?b=1&c=2", "None")] * 2 + [("https://x.org/job/driver-one/", "2026-02-03")] * 2


def test_feeds(spark):
    rss = """<rss version="2.0" xmlns:content="c"><channel><title>T</title><link>https://x.org</link>
      <item><title>Driver &amp; Cook</title><link>https://x.org/1</link><description>&lt;p&gt;short&lt;/p&gt;</description><content:encoded><![CDATA[<p>long</p>]]></content:encoded><pubDate>Tue, 3 Mar 2026 23:30:00 -0200</pubDate></item>
      <item><title>No link</title></item><item><title> </title><link>https://x.org/3</link><pubDate>soon</pubDate></item></channel></rss>"""
    atom = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:fh="http://purl.org/syndication/history/1.0"><fh:complete/>
      <entry><title type="html">One</title><link rel="self" href="no"/><link rel="alternate" href="https://x.org/1"/><updated>2026-02-03T04:05:06Z</updated><summary>s</summary></entry>
      <entry><title>Two</title><link href="https://x.org/2"/><published>2026-01-01T00:00:00Z</published><updated>2026-02-03T04:05:06Z</updated></entry></feed>"""
    rows = [(1, "f", rss), (2, "f", atom), (3, "f", "{}"), (4, "f", None), (5, "f", "<rss><channel/></rss>"), (6, "f", "<rss><channel><item>")]
    found = xml.feed_items(spark.createDataFrame(rows, BRONZE))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.source_id, r.url, r.title, r.body, str(r.published), r.complete, r.error) for r in found.orderBy("source_id", F.col("n")).collect()]
    assert got == [
        (1, "https://x.org/1", "Driver & Cook", "<p>long</p>", "2026-03-04", False, None), (1, None, "No link", "", "None", False, "entry without link"), (1, "https://x.org/3", got[2][2], "", "None", False, "entry without title"),
        (2, "https://x.org/1", "One", "s", "2026-02-03", True, None), (2, "https://x.org/2", "Two", "", "2026-01-01", True, None),
        (3, None, None, "", "None", False, "no feed"), (4, None, None, "", "None", False, "no feed"), (6, None, None, "", "None", False, "broken XML"),
    ]


def test_feeds_are_not_searched_for_each_entry(spark):
    """Nothing above the step that deals out entries looks at a document."""
    bronze = spark.createDataFrame([(1, "u", "<rss><channel/></rss>")], "source_id long, url string, payload string")
    plan = xml.feed_items(bronze)._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" not in plan[: plan.index("Generate")]
