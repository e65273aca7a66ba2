"""Listing payloads to rows: each parser turns one raw payload into (url, title, evidence), and a scan proves that it is complete.

A bronze table holds what was fetched: source_id, kind, url, payload. Parsers are generators over one payload; listings()
runs them over the table by batches, and complete() compares what was found with what each page states.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions import vocabulary as V
from jobloom.functions.extract import says
from jobloom.operators.admission import in_scope, same_host

MOST_LINKS = 100
SKIPPED = {"script", "style", "noscript", "nav", "footer"}
Row = tuple[str, str, str]


class _Text(HTMLParser):
    """Visible text, and the text and target of each link and table cell."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.parts, self.links, self.rows, self.open = 0, [], [], [], None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "a":
            self.open = [dict(attrs).get("href") or "", []]
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(["", []])

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        elif tag == "a" and self.open:
            self.links.append((self.open[0], " ".join("".join(self.open[1]).split())))
            if self.rows and self.rows[-1]:
                self.rows[-1][-1][0] = self.open[0]
            self.open = None

    def handle_data(self, data):
        if self.skip:
            return
        if data.strip():
            self.parts.append(" ".join(data.split()))
        if self.open:
            self.open[1].append(data)
        if self.rows and self.rows[-1]:
            self.rows[-1][-1][1].append(data)


def parsed(html: str) -> _Text:
    found = _Text()
    found.feed(html or "")
    found.close()
    return found


def html_text(html: str | None) -> str:
    """The text of a page on one line, without what is not content."""
    return " ".join(parsed(html or "").parts)


def from_links(payload: str, url: str) -> Iterator[Row]:
    """Links of a page; the first title of a target counts."""
    seen = set()
    for href, title in parsed(payload).links:
        target = urljoin(url, href)
        if href and title and target not in seen:
            seen.add(target)
            yield target, title, title


def from_table(payload: str, url: str) -> Iterator[Row]:
    """Rows of a table under a header row: the first cell is the title, all cells the evidence."""
    rows = [[(h, " ".join("".join(t).split())) for h, t in r] for r in parsed(payload).rows]
    if rows:
        names = [t for _, t in rows[0]]
        for r in rows[1:]:
            href = next((h for h, _ in r if h), "")
            yield urljoin(url, href), r[0][1], ". ".join(f"{n}: {t}" for n, (_, t) in zip(names, r, strict=False))


def from_json(payload: str, url: str) -> Iterator[Row]:
    """Objects of the first list in a document that have a title."""
    data = json.loads(payload)
    lists = [data] if isinstance(data, list) else [v for v in data.values() if isinstance(v, list)] + [w for v in data.values() if isinstance(v, dict) for w in v.values() if isinstance(w, list)]
    if not lists:
        raise ValueError("response changed shape")
    for x in lists[0]:
        title = next((x[k] for k in ("title", "postingTitle", "jobOpeningName", "name") if k in x), None)
        title = title.get("rendered") if isinstance(title, dict) else title
        target = next((str(x[k]) for k in ("link", "externalPath", "url", "jobId", "id", "slug") if k in x), "")
        if not title:
            raise ValueError("response changed shape")
        yield urljoin(url, target), html_text(title), html_text(json.dumps(x, ensure_ascii=False))


def from_feed(payload: str, url: str) -> Iterator[Row]:
    """Items of an RSS or Atom feed."""
    root = ET.fromstring(payload)
    name = lambda x: x.tag.rpartition("}")[2]
    for item in (x for x in root.iter() if name(x) in ("item", "entry")):
        got = {name(x): x for x in item}
        link = (got["link"].text or got["link"].get("href") or "").strip() if "link" in got else ""
        body = next((got[k].text or "" for k in ("description", "content", "summary") if k in got), "")
        yield urljoin(url, link), (got["title"].text or "").strip() if "title" in got else "", html_text(body)


def from_sitemap(payload: str, url: str) -> Iterator[Row]:
    """Locations of a sitemap; the last part of the path is the title."""
    for x in ET.fromstring(payload).iter():
        if x.tag.rpartition("}")[2] == "loc" and x.text:
            yield x.text.strip(), x.text.strip().rstrip("/").rpartition("/")[2].replace("-", " "), ""


def from_fields(payload: str, url: str) -> Iterator[Row]:
    """A field list joined by !|!: number, title and place by turns."""
    parts = payload.split("!|!")
    for k in range(0, len(parts) - 2, 3):
        yield urljoin(url, parts[k]), parts[k + 1], parts[k + 2]


def from_script(payload: str, url: str) -> Iterator[Row]:
    """Arrays that a script hands to JSON.parse as text; the script itself is never run."""
    for m in re.finditer(r"JSON\.parse\('((?:[^'\\]|\\.)*)'\)", payload):
        yield from from_json(m[1].replace("\\'", "'").replace("\\\\", "\\"), url)


PARSERS: dict[str, Callable[[str, str], Iterator[Row]]] = {
    "links": from_links, "table": from_table, "json": from_json, "feed": from_feed, "sitemap": from_sitemap, "fields": from_fields, "script": from_script,
}


def listings(bronze: DataFrame) -> DataFrame:
    """(source_id, page, url, title, evidence, error): a row for each listing, or one with the error of a page that cannot be read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, kind, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = list(PARSERS[kind](payload or "", url or ""))
                    out += [(source, url, *r, None) for r in rows]
                except (KeyError, ValueError, ET.ParseError) as e:
                    out.append((source, url, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 5), strict=True)], ["source_id", "page", "url", "title", "evidence", "error"]
            )

    return bronze.select(F.col("source_id").cast("long"), "kind", "url", "payload").mapInArrow(
        each, "source_id long, page string, url string, title string, evidence string, error string"
    )


def configured(found: DataFrame, config: DataFrame) -> DataFrame:
    """Listings that their source's configuration takes; rows with an error stay, so that a failed scan is seen.

    config: source_id, and what links must have: words of adverts in the title (need_words), the page's host (own_host), a pattern in the
    URL (pattern), a number in the URL of at least least_id. Null or false asks for nothing; a source without configuration takes all.
    """
    number = F.try_to_number(F.nullif(F.regexp_extract("url", r"(\d{1,18})(?!.*\d)", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    both = found.join(F.broadcast(config), "source_id", "left")
    keep = (
        (~F.coalesce("need_words", F.lit(False)) | says(F.coalesce("title", F.lit("")), V.ADVERT))
        & (~F.coalesce("own_host", F.lit(False)) | same_host(F.col("url"), F.col("page")))
        & (F.col("pattern").isNull() | F.coalesce(F.expr("url rlike pattern"), F.lit(False)))
        & (F.col("least_id").isNull() | F.coalesce(number >= F.col("least_id"), F.lit(False)))
    )
    return both.where(F.col("error").isNotNull() | keep).select(*found.columns)


def complete(found: DataFrame, stated: DataFrame) -> DataFrame:
    """(source_id, listed, total, complete): a scan counts only if every page was read, the total is right, and not over the limit."""
    listed = found.groupBy("source_id").agg(F.count_distinct("url").alias("listed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    ok = (F.coalesce("failed", F.lit(0)) == 0) & (F.coalesce("listed", F.lit(0)) >= F.col("total")) & (F.coalesce("listed", F.lit(0)) <= MOST_LINKS)
    return stated.join(listed, "source_id", "left").select("source_id", F.coalesce("listed", F.lit(0)).alias("listed"), "total", ok.alias("complete"))


def dry_run(found: DataFrame, year: int) -> DataFrame:
    """(source_id, reachable, leads, in_scope, error) of each source of listings(): what a run would find, without writing anything. One error makes a source fail, and hides no other."""
    lead = F.col("error").isNull()
    per = found.groupBy("source_id").agg(
        F.count_distinct(F.when(lead, F.col("url"))).alias("leads"), F.count_distinct(F.when(lead & in_scope(F.col("url"), year), F.col("url"))).alias("in_scope"), F.min(F.substring("error", 1, 200)).alias("error")
    )
    ok = F.col("error").isNull()
    return per.select("source_id", ok.alias("reachable"), F.when(ok, F.col("leads")).otherwise(0).alias("leads"), F.when(ok, F.col("in_scope")).otherwise(0).alias("in_scope"), "error")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) of raw pages."""

    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array([html_text(x) for x in html.to_pylist()], pa.string())

    return pages.select("page_id", text("html").alias("text"))


def exchange_lines(jobs: DataFrame, limit: int) -> DataFrame:
    """One JSON line for each of the newest jobs, for review elsewhere; the limit is the batch's size, 500 at most."""
    return jobs.orderBy(F.desc("first_seen"), F.desc("job_id")).limit(max(0, min(500, limit))).select(F.to_json(F.struct("job_id", "title", "hash")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines (column value) as files of text, one record a line."""
    lines.write.mode("error").text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(value, record) of each line of files of JSON lines: a line that is no record has a null one and stays, so that it can be told."""
    return spark.read.text(path).where("trim(value) != ''").withColumn("record", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
