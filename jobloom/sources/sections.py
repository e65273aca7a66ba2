"""Pages as blocks under headings: which heading a table row, list item or paragraph stands under, and what each section states."""

from __future__ import annotations

from collections import Counter
from collections.abc import Container, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.text import fold
from jobloom.operators.admission import us_date

SKIPPED = {"script", "style", "noscript", "nav", "footer", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
KINDS = {"td": "cell", "th": "cell", "tr": "row", "li": "item", "dt": "item", "dd": "item", "p": "text", "pre": "text", "blockquote": "text", "caption": "text", **dict.fromkeys(HEADINGS, "heading")}
#: Elements that end what stands loose, and an open paragraph.
BREAKS = set(KINDS) | {"address", "article", "aside", "body", "div", "dl", "fieldset", "footer", "form", "head", "header", "hr", "html", "main", "nav", "ol", "section", "table", "tbody", "tfoot", "thead", "title", "ul"}
#: An element of the left kind ends an open one of the right kinds, looked for no further out than the last ones.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: What a section says that has nothing to offer.
NOTHING = ("no active vacancy", "no current vacancies", "no open positions", "nema otvorenih", "no hay ofertas")
BLOCK = "page_id long, n int, section int, path array<string>, kind string, cells array<string>, links array<struct<label:string,url:string>>"


class _Block:
    def __init__(self, n: int, tag: str, depth: int):
        self.n, self.tag, self.kind, self.depth = n, tag, KINDS.get(tag, "text"), depth
        self.parts, self.cells, self.links = [], [], []
        self.lays_out, self.head = False, True

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Page(HTMLParser):
    """Follows the open elements of a page; each element of KINDS is a block, and so is text outside of any, which has no depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.out, self.path = [], [], [], []
        self.section = self.hidden = self.n = 0
        self.count: Counter[str] = Counter()
        self.link = None

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.end_loose()
            self.end("p", {"td", "th", "li", "table"})
        kinds, within = ENDS.get(tag, ((), ()))
        for kind in kinds:
            self.end(kind, within)
        if tag in BREAKS or tag in VOID:
            self.add(" ")
        if tag in VOID:
            return
        self.open.append(tag)
        self.count[tag] += 1
        self.hidden += tag in SKIPPED
        if self.hidden:
            return
        inside = any(b.kind in ("cell", "item", "heading") for b in self.blocks)
        if tag == "table":
            for b in self.blocks:
                b.lays_out = True
        elif tag in KINDS and (KINDS[tag] not in ("text", "heading") or not inside):
            self.begin(tag, len(self.open))
            if tag == "td":
                for b in self.blocks[-2:-1]:
                    b.head = False
        elif tag == "a":
            self.end_link()
            if not self.blocks:
                self.begin("", 0)
            self.link = (self.blocks[-1], dict(attrs).get("href") or "", [])

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.end_loose()
        self.end(tag, ())

    def handle_data(self, data):
        if self.hidden:
            return
        if not self.blocks and data.strip():
            self.begin("", 0)
        self.add(data)
        if self.link:
            self.link[2].append(data)

    def close(self):
        super().close()
        self.end_loose()
        while self.open:
            self.end(self.open[-1], ())

    def begin(self, tag: str, depth: int) -> None:
        self.n += 1
        self.blocks.append(_Block(self.n, tag, depth))

    def add(self, data: str) -> None:
        if self.blocks and not self.hidden:
            self.blocks[-1].parts.append(data)

    def end_loose(self) -> None:
        if self.blocks and not self.blocks[-1].depth:
            self.finish()

    def end_link(self) -> None:
        if self.link:
            block, url, parts = self.link
            block.links.append((" ".join("".join(parts).split()), url))
            self.link = None

    def end(self, tag: str, within: Container[str]) -> None:
        """Ends the innermost open element of a tag and all in it, unless one of `within` is between them."""
        if not self.count[tag]:
            return
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k] == tag or self.open[k] in within), None)
        if at is None or self.open[at] != tag:
            return
        while len(self.open) > at:
            if self.blocks and self.blocks[-1].depth == len(self.open):
                self.finish()
            name = self.open.pop()
            self.count[name] -= 1
            self.hidden -= name in SKIPPED
            if name == "a":
                self.end_link()

    def finish(self) -> None:
        """The innermost block is over: a cell goes to its row, a heading holds from now on, and all but rows that lay out a page are kept."""
        self.end_link()
        b = self.blocks.pop()
        if b.kind == "cell" and self.blocks and self.blocks[-1].kind == "row":
            self.blocks[-1].cells.append(b.text())
            self.blocks[-1].links += b.links
            return
        if b.kind == "heading" and b.text():
            self.path = [*[p for p in self.path if p[0] < HEADINGS[b.tag]], (HEADINGS[b.tag], b.text())]
            self.section += 1
        cells = b.cells if b.kind == "row" else [b.text()]
        if not b.lays_out and (any(cells) or b.links):
            kind = "head" if b.kind == "row" and b.head else "text" if b.kind == "cell" else b.kind
            self.out.append((b.n, self.section, [t for _, t in self.path], kind, cells, b.links))


def blocks_of(html: str | None) -> list[tuple]:
    """(n, section, path, kind, cells, links) of one page, in the order in which blocks begin.

    kind: heading, row, head (a row of header cells), item or text. path: the headings that hold, outermost first; one holds until the
    next of its level or a higher one, whatever elements are around it. Elements that are not closed end as HTML says they do.
    """
    page = _Page()
    page.feed(html or "")
    page.close()
    return sorted(page.out, key=lambda b: b[0])


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, n, section, path, kind, cells, links) of all blocks of all pages: page_id, url, html. Links are made absolute.

    A page without any block, or a null one, has one row of kind empty.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("url", pa.string())]))]
        names = ["page_id", "n", "section", "path", "kind", "cells", "links"]
        for batch in batches:
            for page_id, url, html in zip(*batch.columns, strict=True):
                rows = [
                    (page_id.as_py(), n, section, path, kind, cells, [{"label": label, "url": absolute(url.as_py(), to)} for label, to in links])
                    for n, section, path, kind, cells, links in blocks_of(html.as_py())
                ]
                rows = rows or [(page_id.as_py(), 0, 0, [], "empty", [], [])]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(each, BLOCK)


def absolute(base: str | None, url: str) -> str:
    try:
        return urljoin(base or "", url)
    except ValueError:
        return url


def says_nothing(text: Column) -> Column:
    """Whether a text states that there is nothing to offer."""
    return F.coalesce(fold(text).rlike("|".join(NOTHING)), F.lit(False))


def sections(found: DataFrame) -> DataFrame:
    """(page_id, section, path, rows, nothing, error) of every section: a table, or words that there is nothing; anything else means that the page changed.

    Headings with headings below them are no sections of their own as long as nothing stands under them but those.
    """
    text = F.array_join("cells", " ")
    per = found.groupBy("page_id", "section").agg(
        F.first("path").alias("path"),
        F.count_if(F.col("kind") == "row").cast("int").alias("rows"),
        F.max(says_nothing(F.when(F.col("kind").isin("text", "item"), text))).alias("nothing"),
        F.count_if(F.col("kind") != "heading").alias("blocks"),
        F.max(F.when(F.col("kind") == "heading", F.size("path"))).alias("depth"),
    )
    deeper = Window.partitionBy("page_id").orderBy("section")
    outer = (F.col("blocks") == 0) & F.coalesce(F.lead("depth").over(deeper) > F.col("depth"), F.lit(False))
    error = F.when((F.col("rows") == 0) & ~F.col("nothing"), F.concat(F.lit("section without table: "), F.element_at("path", -1)))
    return per.withColumn("outer", outer).where("section > 0 and not outer").select("page_id", "section", "path", "rows", "nothing", error.alias("error"))


def rows(found: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, n, section, title, place, closing, url, error) of every table row that stands under a heading: title, place and closing date are its first cells."""
    bad = (F.size("cells") < least) | (F.size("links") == 0)
    return found.where("kind = 'row' and section > 0").select(
        "page_id", "n", F.element_at("path", -1).alias("section"), F.get("cells", F.lit(0)).alias("title"), F.get("cells", F.lit(1)).alias("place"),
        us_date(F.get("cells", F.lit(2))).alias("closing"), F.get("links", F.lit(0))["url"].alias("url"), F.when(bad, "row changed shape").alias("error"),
    )


def listings(found: DataFrame) -> DataFrame:
    """(page_id, sections, rows, error) of every page: it counts as a whole or, with the first error of its sections or rows, not at all."""
    parts = sections(found).select("page_id", "section", F.lit(1).alias("sections"), F.lit(0).alias("rows"), "error")
    lines = rows(found).select("page_id", F.col("n").alias("section"), F.lit(0).alias("sections"), F.lit(1).alias("rows"), "error")
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("sections", "section", "error")))["error"]
    none = F.when(F.sum("sections") == 0, "sections missing")
    pages = found.where("section = 0").select("page_id", F.lit(0).alias("section"), F.lit(0).alias("sections"), F.lit(0).alias("rows"), F.lit(None).cast("string").alias("error"))
    return parts.unionByName(lines).unionByName(pages).groupBy("page_id").agg(F.sum("sections").alias("sections"), F.sum("rows").alias("rows"), F.coalesce(none, first).alias("error"))


def dated(found: DataFrame, stamp: str, role: str) -> DataFrame:
    """(page_id, process, day_text, role, text, links) of each dated update of a page that has no headings for them.

    An update begins at a block that matches `stamp`, whose first group is its date, and goes on to the next; `role` has the role in its first group.
    """
    text = F.array_join("cells", " ")
    starts = F.when((F.col("kind") != "heading") & (F.length(text) < 100), F.nullif(F.regexp_extract(text, stamp, 1), F.lit("")))
    order = Window.partitionBy("page_id").orderBy("n")
    step = found.withColumns({"day_text": starts, "text": text}).withColumn("process", F.count("day_text").over(order)).where("process > 0")
    whole = F.array_sort(F.collect_list(F.struct("n", "text", "links")))
    per = step.groupBy("page_id", "process").agg(F.max("day_text").alias("day_text"), whole.alias("parts"))
    body = F.array_join(F.transform("parts", lambda x: x["text"]), "\n")
    return per.select("page_id", "process", "day_text", F.nullif(F.upper(F.trim(F.regexp_extract(body, role, 1))), F.lit("")).alias("role"), body.alias("text"), F.flatten(F.transform("parts", lambda x: x["links"])).alias("links"))
