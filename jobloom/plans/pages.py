"""Queries on pages: revisions, recorded listings and their files, and the inputs made for them from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators import lifecycle, revisions
from jobloom.plans.registered import query
from jobloom.plans.standins import JOBS, jobs, table
from jobloom.operators.dedup import _shared
from jobloom.sources import paging, recorded, sections, store


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages that show two turns at a time: (page_id, scan, text). Each next snapshot drops a turn and adds one."""
    c = table(spark, sf_dir, "conversations")
    both = c.select(F.col("conv_id").alias("page_id"), "turn", "text", F.explode(F.array(F.col("turn"), F.col("turn") + 1)).alias("scan"))
    # A turn may be there twice; what a page shows is bounded by its two turns, so each list is short.
    parts = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    shown = both.groupBy("page_id", "scan").agg(parts.alias("p"), F.count_distinct("turn").alias("n")).where("n = 2")
    return shown.select("page_id", "scan", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


TALKS = r"""
    SELECT conv_id AS page_id, scan, string_agg(coalesce(text, ''), ' ' ORDER BY turn, text) AS text
    FROM (SELECT *, unnest([turn, turn + 1]) AS scan FROM conversations) GROUP BY conv_id, scan HAVING count(DISTINCT turn) = 2"""
LAST_TALKS = rf"""
    SELECT page_id, max(scan) FILTER (WHERE k = 2) AS before_scan, max(scan) FILTER (WHERE k = 1) AS now_scan,
      max(cut) FILTER (WHERE k = 2) AS a, max(cut) FILTER (WHERE k = 1) AS b
    FROM (SELECT *, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)) AS cut, row_number() OVER (PARTITION BY page_id ORDER BY scan DESC) AS k FROM ({TALKS}))
    WHERE k <= 2 GROUP BY page_id HAVING count(*) = 2"""


@query(f"""
    WITH RECURSIVE p AS MATERIALIZED ({LAST_TALKS}),
    t AS (
      SELECT page_id, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS l FROM p
      UNION ALL
      SELECT page_id, i, [0] || list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])) FROM (
        SELECT t.page_id, t.i + 1 AS i, list_transform(range(1, len(b) + 1), lambda j: greatest(l[j + 1], l[j] + CASE WHEN a[t.i + 1] = b[j] THEN 1 ELSE 0 END)) AS c
        FROM t JOIN p USING (page_id) WHERE t.i < len(a)))
    SELECT p.page_id, before_scan, now_scan, CAST(len(a) - l[len(l)] AS INTEGER) AS removed, CAST(len(b) - l[len(l)] AS INTEGER) AS added, a = b AS same,
      sha256(array_to_string(b, chr(10))) AS now_sha256
    FROM p JOIN t ON t.page_id = p.page_id AND t.i = len(a)""")
def revision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed last in each page. The SQL finds the length of a longest common subsequence row by row, and takes the hash of the newer text itself."""
    return revisions.counted(revisions.with_edits(revisions.last_two(talks(spark, sf_dir))))


@query()
def revision_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.hunks(revisions.with_edits(revisions.last_two(talks(spark, sf_dir))))


@query(f"""
    WITH t AS ({TALKS}), l AS (SELECT page_id, arg_max(text, scan) AS text FROM t GROUP BY page_id),
    f AS (SELECT page_id, 9999 AS scan, CASE page_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' More.' END AS text FROM l UNION ALL SELECT DISTINCT -conv_id - 1, 9999, 'first' FROM conversations)
    SELECT f.page_id, CAST(f.scan AS BIGINT) AS scan, sha256(coalesce(f.text, '')) AS hash FROM f LEFT JOIN l USING (page_id) WHERE l.page_id IS NULL OR coalesce(f.text, '') <> l.text""")
def snapshots_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of all pages, of which some changed, some are empty now and some are new."""
    old = talks(spark, sf_dir)
    last = old.groupBy("page_id").agg(F.max_by("text", "scan").alias("text"))
    text = F.when(F.col("page_id") % 3 == 0, F.col("text")).when(F.col("page_id") % 3 == 1, F.concat("text", F.lit(" More.")))
    new = table(spark, sf_dir, "conversations").select((-F.col("conv_id") - 1).alias("page_id"), F.lit("first").alias("text")).distinct()
    found = last.select("page_id", text.alias("text")).unionByName(new).withColumn("scan", F.lit(9999).cast("long"))
    return lifecycle.to_store(found, old).select("page_id", "scan", "hash")


# --- sections

LANGUAGES = ("de", "en", "es", "fr")


def title_of(text: str) -> str:
    """SQL that both sides know: the beginning of a text as a title."""
    return f"trim(regexp_replace(substr(coalesce({text}, ''), 1, 60), '[^A-Za-z0-9&<]+', ' ', 'g'))"


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of vacancies, eight to a page: a heading a language, with a table or words that there is none; some pages break the rule."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    plain = F.expr(title_of("text").replace(", 'g'", ""))
    safe = F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page, k = F.expr("doc_id div 8"), F.col("doc_id")
    cells = [
        F.concat(F.lit("<td><a href='/job/"), k, F.lit("'><b>"), safe, F.lit("</b></a>")),
        F.concat(F.lit("<td>"), F.coalesce("source", F.lit("")), F.lit("</td>")),
        F.when(page % 9 == 4, "").otherwise(F.concat(F.lit("<td>"), k % 12 + 1, F.lit("/"), k % 28 + 1, F.lit("/2026</td>"))),
    ]
    row = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    lists = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lang") == x, F.struct(k.alias("k"), row.alias("row"))))), lambda r: r["row"]), "").alias(x) for x in LANGUAGES]
    per = d.groupBy(page.alias("page_id")).agg(*lists)
    head = F.lit("<table><thead><tr><th>Title<th>Place<th>Closing</tr></thead><tbody>")
    none = F.when(F.col("page_id") % 7 == 3, "<p>Soon.").otherwise("<p>There is <i>no active</i> vacancy.")
    parts = [F.concat(F.lit(f"<div><h4>Section {x} &amp; more</h4></div>"), F.when(F.col(x) == "", none).otherwise(F.concat(head, F.col(x), F.lit("</table>")))) for x in LANGUAGES]
    html = F.concat(F.lit("<html><nav><h4>Menu</h4><p>x</nav><main><h1>Vacancies</h1>"), *parts, F.lit("</main><footer><table><tr><td>a</table></footer>"))
    return per.select("page_id", F.lit("https://jobs.example.org/list/").alias("url"), html.alias("html"))


SECTIONED = f"""
    SELECT doc_id, doc_id // 8 AS page_id, lang, {title_of('text')} AS title, coalesce(source, '') AS place, (doc_id // 8) % 9 = 4 AS short,
      make_date(2026, CAST(doc_id % 12 + 1 AS INTEGER), CAST(doc_id % 28 + 1 AS INTEGER)) AS closing
    FROM documents WHERE doc_id IS NOT NULL"""


@query(f"""
    SELECT page_id, 'Section ' || lang || ' & more' AS section, title, place, CASE WHEN NOT short THEN CAST(closing AS VARCHAR) END AS closing,
      'https://jobs.example.org/job/' || doc_id AS url, CASE WHEN short THEN 'row changed shape' END AS error
    FROM ({SECTIONED}) WHERE lang IN {LANGUAGES}""")
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.rows(sections.blocks(section_pages(spark, sf_dir)))
    return found.select("page_id", "section", "title", "place", F.col("closing").cast("string").alias("closing"), "url", "error")


@query(f"""
    WITH s AS ({SECTIONED}),
    p AS (SELECT DISTINCT page_id, short FROM s),
    l AS (SELECT page_id, short, unnest({list(LANGUAGES)}) AS lang, unnest([1, 2, 3, 4]) AS k FROM p),
    n AS (SELECT l.page_id, l.short, l.lang, l.k, count(s.doc_id) AS n FROM l LEFT JOIN s ON s.page_id = l.page_id AND s.lang = l.lang GROUP BY ALL)
    SELECT page_id, CAST(4 AS BIGINT) AS sections, CAST(sum(n) AS BIGINT) AS rows,
      coalesce(CASE WHEN short AND sum(n) > 0 THEN 'row changed shape' END,
        CASE WHEN page_id % 7 = 3 THEN 'section without table: Section ' || min(lang) FILTER (WHERE n = 0) || ' & more' END) AS error
    FROM n GROUP BY page_id, short""")
def section_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.listings(sections.blocks(section_pages(spark, sf_dir)))


@query(r"""
    SELECT page_id, CAST(count(*) AS BIGINT) AS texts, any_value(h) AS heading, CAST(1 AS BIGINT) AS headings, CAST(0 AS BIGINT) AS links FROM (
      SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS h,
        unnest(list_filter(string_split(regexp_extract(html, '<article>.*?</h1>(.*)</article>', 1, 's'), '<p>'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> '')) AS p
      FROM pages) GROUP BY page_id""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands under the heading of each page as it is: navigation, footers and what comes before the heading are not it."""
    found = sections.blocks(table(spark, sf_dir, "pages")).where("section > 0")
    kind = lambda x: F.count_if(F.col("kind") == x)
    return found.groupBy("page_id").agg(kind("text").alias("texts"), F.max(F.get("path", F.lit(0))).alias("heading"), kind("heading").alias("headings"), F.sum(F.size("links")).alias("links"))


# --- paging


def page_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as recorded listings, sixteen to a source, and the sources' first pages. Lengths, ends and totals follow the source's number; the links are those of the pages' navigation."""
    p = table(spark, sf_dir, "pages")
    s, k = F.expr("page_id div 16"), F.col("page_id") % 16
    long = s % 13 + 1
    base = F.concat(F.lit("https://s"), s, F.lit(".example.org/jobs"))
    page = lambda n: F.when(n == 0, base).otherwise(F.concat(base, F.lit("/page-"), n))
    last = F.when(s % 4 == 1, page(F.lit(0))).when(s % 4 == 2, F.lit("https://other.example.org/jobs/page-2")).when(s % 4 == 3, F.concat(base, F.lit("/gone")))
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    rows = p.select(
        s.alias("source_id"), page(k).alias("url"), F.when(k + 1 < long, page(k + 1)).when(k + 1 == long, last).alias("next_url"),
        F.when(s % 3 == 0, 5 * long + F.when((s % 5 == 1) & (k == 2), 1).otherwise(0)).alias("total"),
        F.when((s % 6 == 5) & (k == 3), F.array(F.lit("/The"))).otherwise(links).alias("items"), ((s % 7 == 2) & (k == 2)).alias("older"),
    )
    return rows, rows.select("source_id", F.regexp_extract("url", "^[^/]+//[^/]+/jobs", 0).alias("url")).distinct()


GRAPH = """
    SELECT s AS source_id, k, length, CASE WHEN s % 3 = 0 THEN 5 * length + CASE WHEN s % 5 = 1 AND k = 2 THEN 1 ELSE 0 END END AS total,
      CASE WHEN s % 6 = 5 AND k = 3 THEN ['/The'] ELSE regexp_extract_all(html, '<a href="([^"]*)"', 1) END AS items, s % 7 = 2 AND k = 2 AS older,
      CASE WHEN k + 1 < length THEN k + 1 WHEN k + 1 = length THEN [NULL, -1, -2, -3][s % 4 + 1] END AS next
    FROM (SELECT page_id // 16 AS s, page_id % 16 AS k, (page_id // 16) % 13 + 1 AS length, html FROM pages)"""


@query(f"""
    WITH RECURSIVE g AS MATERIALIZED ({GRAPH}),
    there AS (SELECT source_id, k, any_value(length) AS length, any_value(total) AS total, any_value(items) AS items, bool_or(older) AS older, any_value(next) AS next FROM g GROUP BY ALL),
    w AS (
      SELECT DISTINCT source_id, 0 AS k, 0 AS pages, CAST([] AS VARCHAR[]) AS links, CAST(NULL AS BIGINT) AS stated, 0 AS n0, CAST(NULL AS VARCHAR) AS verdict, false AS ok FROM g
      UNION ALL
      SELECT source_id, next, pages + 1, all_links, total, len(all_links),
        CASE WHEN missing THEN 'page missing'
          WHEN pages > 0 AND total IS DISTINCT FROM stated THEN 'total changed between pages'
          WHEN len(all_links) > 100 OR total > 100 THEN 'too many links'
          WHEN len(all_links) > total THEN 'more links than stated'
          WHEN len(all_links) = total THEN 'total met'
          WHEN total IS NULL AND older THEN 'older page'
          WHEN total IS NULL AND pages > 0 AND len(all_links) = n0 THEN 'repeated items'
          WHEN total IS NULL AND next IS NULL THEN 'last page'
          WHEN next IS NULL OR (pages > 0 AND len(all_links) = n0) THEN 'total not met'
          WHEN next IN (-1, -2) THEN 'next link repeats or leaves'
          WHEN pages + 1 >= 10 THEN 'too many pages' END,
        NOT missing
      FROM (
        SELECT w.source_id, w.pages, w.stated, w.n0, t.total, t.older, t.next, t.k IS NULL AS missing, list_distinct(w.links || coalesce(t.items, [])) AS all_links
        FROM w LEFT JOIN there t ON t.source_id = w.source_id AND t.k = w.k WHERE w.verdict IS NULL))
    SELECT source_id, CAST(pages AS INTEGER) AS pages, CAST(CASE WHEN good THEN len(links) ELSE 0 END AS INTEGER) AS links, CASE WHEN good THEN verdict END AS end, CASE WHEN NOT good THEN verdict END AS error
    FROM (SELECT *, verdict IN ('total met', 'older page', 'repeated items', 'last page') AS good FROM w WHERE verdict IS NOT NULL)""")
def paged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.followed(*page_graph(spark, sf_dir)).withColumn("links", F.size("links"))


# --- runs as files

FIRST_RUN = f"SELECT source_id, '/job/' || job_id AS url, title, CAST(1 AS INTEGER) AS run FROM ({JOBS})"


@query(f"""
    WITH a AS ({FIRST_RUN}), b AS (SELECT source_id, url, title || ' again' AS title, CAST(2 AS INTEGER) AS run FROM a WHERE source_id % 7 <> 3 AND source_id % 11 <> 2)
    SELECT * FROM a WHERE source_id % 5 = 0 OR source_id % 7 = 3 AND source_id % 11 <> 2 OR source_id % 13 = 6 AND source_id % 11 <> 2
    UNION ALL SELECT * FROM b WHERE NOT (source_id % 5 = 0 OR source_id % 13 = 6)""")
def source_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after two runs. In the second, every fifth source fails, others are suddenly or rightly empty, and some have a URL twice."""
    path = _shared(spark, "stored")
    found = jobs(spark, sf_dir).select("source_id", F.concat(F.lit("/job/"), "job_id").alias("url"), "title", F.lit(1).alias("run"))
    s = F.col("source_id")
    ran = found.select("source_id").distinct().withColumns({"error": F.when(s % 5 == 0, "HTTP 503"), "may_be_empty": s % 11 == 2})
    store.write(found, ran.withColumn("error", F.lit(None).cast("string")), path, most_links=1 << 40)
    again = found.where((s % 7 != 3) & (s % 11 != 2)).withColumns({"title": F.concat("title", F.lit(" again")), "run": F.lit(2)})
    store.write(again.unionByName(again.where(s % 13 == 6)), ran, path, most_links=1 << 40)
    return store.stored(spark, path, found.schema)


@query(f"SELECT job_id, year(first_seen) + 20 AS seen FROM ({JOBS}) WHERE job_id % 3 = 0 OR year(first_seen) = 2001")
def links_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored links of one year and undated ones, read back without opening other years' files."""
    path = _shared(spark, "links")
    j = jobs(spark, sf_dir).select("job_id", "first_seen")
    year = F.year("first_seen") + 20
    dated = F.concat(F.lit("/"), year, F.lit("/"), F.month("first_seen"))
    url = F.concat(F.lit("https://x.org"), F.when(F.col("job_id") % 3 == 0, "/jobs").otherwise(dated), F.lit("/"), "job_id")
    store.write_links(j.select("job_id", url.alias("url"), year.alias("seen")), path)
    return store.links_of(spark, path, 2021).select("job_id", "seen")


# --- recorded responses


@query(r"""
    SELECT page_id AS source_id, url, CAST(CASE WHEN page_id % 11 = 3 THEN 503 ELSE 200 END AS INTEGER) AS status, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size,
      CASE WHEN page_id % 5 <> 0 THEN '2026-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS last_modified,
      CASE WHEN page_id % 11 = 3 THEN 'HTTP 503' WHEN page_id % 7 = 1 THEN 'redirected to another host' WHEN page_id % 13 = 2 THEN 'unusable content' WHEN strlen(coalesce(html, '')) > 8000 THEN 'larger than 8000 bytes' END AS error,
      CASE WHEN NOT (page_id % 11 = 3 OR page_id % 7 = 1 OR page_id % 13 = 2 OR strlen(coalesce(html, '')) > 8000) THEN sha256(coalesce(html, '')) END AS payload_sha256
    FROM pages WHERE url IS NOT NULL""")
def recorded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as recorded responses: written as JSON lines, read through the source of the library, with the guards' reasons."""
    path = _shared(spark, "recorded")
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").where("url is not null")
    p.select(
        k.alias("source_id"), "url", F.when(k % 11 == 3, 503).otherwise(200).alias("status"), F.when(k % 13 == 2, "image/png").otherwise("Text/HTML; charset=utf-8").alias("content_type"),
        F.when(k % 7 == 1, "https://elsewhere.test/").when(k % 7 == 2, "/moved").alias("final_url"),
        F.when(k % 5 != 0, F.concat(F.lit("Sun, "), k % 28 + 1, F.lit(" Mar 2026 10:00:00 GMT"))).alias("last_modified"), F.col("html").alias("body"),
    ).write.json(path)
    recorded.register(spark)
    found = spark.read.format("recorded").option("largest", 8000).load(path)
    return found.select("source_id", "url", "status", "size", F.col("last_modified").cast("string").alias("last_modified"), "error", F.sha2("payload", 256).alias("payload_sha256"))
