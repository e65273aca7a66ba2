"""Blocks under headings, against a walk over the element tree of well-formed pages and by hand for the others."""

import random
import xml.etree.ElementTree as ET
from datetime import date

from jobloom.sources import sections


def walk(root):
    """(path, kind, cells, links) by recursion over a whole tree, as a reader would see it."""
    out, path = [], []

    def words(x):
        return " ".join("".join(x.itertext()).split())

    def links(x):
        return [(words(a), a.get("href")) for a in x.iter("a")]

    def visit(x):
        for c in x:
            if c.tag in ("nav", "footer", "script"):
                continue
            if c.tag in sections.HEADINGS:
                level = sections.HEADINGS[c.tag]
                path[:] = [p for p in path if p[0] < level] + [(level, words(c))]
                out.append(([t for _, t in path], "heading", [words(c)], links(c)))
            elif c.tag == "tr":
                cells = [k for k in c if k.tag in ("td", "th")]
                kind = "head" if all(k.tag == "th" for k in cells) else "row"
                out.append(([t for _, t in path], kind, [words(k) for k in cells], [y for k in cells for y in links(k)]))
            elif c.tag in ("li", "p"):
                if words(c) or links(c):
                    out.append(([t for _, t in path], "item" if c.tag == "li" else "text", [words(c)], links(c)))
            else:
                visit(c)

    visit(root)
    return out


def made(rng, depth=0):
    word = lambda: rng.choice(["alpha", "beta &amp; co", "<b>gamma</b>", "<a href='/x'>delta</a>", "é"])
    text = lambda: " ".join(word() for _ in range(rng.randrange(1, 4)))
    kind = rng.choice(["h", "h", "p", "ul", "table", "div", "nav"]) if depth < 4 else "p"
    if kind == "h":
        level = rng.randrange(1, 7)
        return f"<h{level}>{text()}</h{level}>"
    if kind == "p":
        return f"<p>{text()}</p>"
    if kind == "ul":
        return "<ul>" + "".join(f"<li>{text()}</li>" for _ in range(rng.randrange(4))) + "</ul>"
    if kind == "table":
        cell = lambda t: "".join(f"<{t}>{text()}</{t}>" for _ in range(rng.randrange(1, 4)))
        return f"<table><thead><tr>{cell('th')}</tr></thead><tbody>" + "".join(f"<tr>{cell('td')}</tr>" for _ in range(rng.randrange(3))) + "</tbody></table>"
    return f"<{kind}>" + "".join(made(rng, depth + 1) for _ in range(rng.randrange(4))) + f"</{kind}>"


def test_against_a_walk():
    rng = random.Random(4)
    for _ in range(300):
        page = "<main>" + "".join(made(rng) for _ in range(8)) + "</main>"
        got = [(path, kind, cells, links) for _, _, path, kind, cells, links in sections.blocks_of(page)]
        assert got == walk(ET.fromstring(page)), page


def test_pages_as_they_are():
    of = lambda html: [(path, kind, cells) for _, _, path, kind, cells, _ in sections.blocks_of(html)]
    assert of("<h1>A<p>one<p>two<b> three<br>four") == [(["A one two three four"], "heading", ["A one two three four"])]
    assert of("<h1>A</h1><p>one<p>two<b>three<br>four")[1:] == [(["A"], "text", ["one"]), (["A"], "text", ["twothree four"])]
    assert of("<h1>A</h1><ul><li>one<li>two<ul><li>in</ul>more<li>three</ul>loose") == [
        (["A"], "heading", ["A"]), (["A"], "item", ["one"]), (["A"], "item", ["two more"]), (["A"], "item", ["in"]), (["A"], "item", ["three"]), (["A"], "text", ["loose"]),
    ]
    assert of("<table><tr><td>a<td>b<tr><td>c</table>") == [([], "row", ["a", "b"]), ([], "row", ["c"])]
    # A table that lays out a page: its rows are none, what stands in it is.
    assert [x for x in of("<table><tr><td><table><tr><td>x<td>y</table></table>") if x[1] == "row"] == [([], "row", ["x", "y"])]
    assert of("</p></div><script>var x='<h1>no</h1>'</script><nav><p>menu</nav><div>text <i>in</i> a div<div>own</div></div>") == [([], "text", ["text in a div"]), ([], "text", ["own"])]
    assert of("") == of(None) == [] and of("<") in ([], [([], "text", ["<"])])
    assert len(of("<div>" * 50_000 + "deep")) == 1


def test_sections(spark):
    table = "<table><tr><th>T<th>P<th>C</tr><tr><td><a href='j/1'>Driver</a><td>Sarajevo<td>03/14/2026</table>"
    pages = [
        (1, "https://x.org/list/", f"<h2>All</h2><h4>Open</h4>{table}<h4>Other</h4><p>There is no active vacancy</p>"),
        (2, "https://x.org/list/", f"<h4>Open</h4>{table}<h4>Other</h4><p>Come back</p>"),
        (3, None, "<h4>Open</h4><table><tr><td>no link<td>a<td>b</table>"),
        (4, None, "<p>no heading"), (5, None, None), (6, None, "<h4>Last</h4>"),
    ]
    found = sections.blocks(spark.createDataFrame(pages, "page_id long, url string, html string"))
    got = {r.page_id: (r.sections, r.rows, r.error) for r in sections.listings(found).collect()}
    assert got == {1: (2, 1, None), 2: (2, 1, "section without table: Other"), 3: (1, 1, "row changed shape"), 4: (0, 0, "sections missing"), 5: (0, 0, "sections missing"), 6: (1, 0, "section without table: Last")}
    row = sections.rows(found).where("page_id = 1").first()
    assert (row.section, row.title, row.place, row.closing, row.url) == ("Open", "Driver", "Sarajevo", date(2026, 3, 14), "https://x.org/list/j/1")


def test_dated_updates(spark):
    html = """<div><p>Sarajevo, 3 de marzo de 2026</p><p>CATEGORIA DE Auxiliar. Convocatoria <a href='/a.pdf'>bases</a></p>
      <p>Sarajevo, 9 de abril de 2026</p><ul><li>CATEGORIA DE Oficial</ul><p>lista <a href='/b.pdf'>lista</a></div>"""
    found = sections.dated(sections.blocks(spark.createDataFrame([(1, "https://x.org", html)], "page_id long, url string, html string")), r"^Sarajevo, (.*\d{4})", r"CATEGORIA DE\s+([^\n.]+)")
    got = [(r.process, r.day_text, r.role, [x.url for x in r.links]) for r in found.orderBy("process").collect()]
    assert got == [(1, "3 de marzo de 2026", "AUXILIAR", ["https://x.org/a.pdf"]), (2, "9 de abril de 2026", "OFICIAL", ["https://x.org/b.pdf"])]
