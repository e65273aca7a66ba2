"""Next links followed over recorded pages, against a loop over a dictionary."""

import random

from jobloom.sources import paging

PAGE = "source_id long, url string, next_url string, total long, items array<string>, older boolean"


def follow(pages, base, most_pages=10, most_links=100):
    links, seen, stated, url = [], [], None, base
    while True:
        seen.append(url)
        if url not in pages:
            return len(seen), 0, None, "page missing"
        nxt, total, items, older = pages[url]
        before = len(links)
        links += [x for x in dict.fromkeys(items) if x not in links]
        later = len(seen) > 1
        if later and total != stated:
            return len(seen), 0, None, "total changed between pages"
        stated = total
        if len(links) > most_links or (total or 0) > most_links:
            return len(seen), 0, None, "too many links"
        if total is not None and len(links) > total:
            return len(seen), 0, None, "more links than stated"
        if total is not None and len(links) == total:
            return len(seen), len(links), "total met", None
        if total is None and (older or (later and len(links) == before) or nxt is None):
            return len(seen), len(links), "older page" if older else "repeated items" if later and len(links) == before else "last page", None
        if nxt is None or (later and len(links) == before):
            return len(seen), 0, None, "total not met"
        if nxt in seen or not nxt.startswith(base):
            return len(seen), 0, None, "next link repeats or leaves"
        if len(seen) >= most_pages:
            return len(seen), 0, None, "too many pages"
        url = nxt


def test_random_graphs(spark):
    rng = random.Random(5)
    rows, starts, want = [], [], {}
    for s in range(400):
        base, n = f"https://s{s}.org/jobs", rng.randrange(1, 13)
        urls = [base] + [f"{base}/{k}" for k in range(1, n)]
        fresh, per = 0, rng.choice([1, 3, 12])
        pages, items = {}, []
        total = rng.choice([None, n * per, n * per - 1, None])
        for k, url in enumerate(urls):
            new = [f"{base}#{fresh + j}" for j in range(per)]
            fresh += per
            items = items if rng.random() < 0.05 else new
            nxt = urls[k + 1] if k + 1 < n else None
            odd = rng.random()
            nxt = rng.choice(urls) if odd < 0.05 else "https://else.org/jobs/2" if odd < 0.08 else f"{base}/gone" if odd < 0.1 else nxt
            pages[url] = (nxt, total + 1 if total and rng.random() < 0.03 else total, items, rng.random() < 0.04)
        rows += [(s, url, *p) for url, p in pages.items()]
        starts.append((s, base))
        want[s] = follow(pages, base)
    got = paging.followed(spark.createDataFrame(rows, PAGE).repartition(4), spark.createDataFrame(starts, "source_id long, url string")).collect()
    assert {r.source_id: (r.pages, len(r.links), r.end, r.error) for r in got} == want
    assert len({(e, x) for _, _, e, x in want.values()}) >= 9


def test_nothing_and_nulls(spark):
    pages = spark.createDataFrame([(1, "https://a.org/j", None, None, None, None), (1, "https://a.org/j", None, None, None, None), (None, None, None, None, [], False)], PAGE)
    starts = spark.createDataFrame([(1, "https://a.org/j"), (1, "https://a.org/j"), (2, "https://b.org"), (3, None)], "source_id long, url string")
    got = {(r.source_id, r.pages, r.end, r.error) for r in paging.followed(pages, starts).collect()}
    assert got == {(1, 1, "last page", None), (2, 1, None, "page missing")}
    assert paging.followed(pages, starts.where("false")).collect() == []


def test_more_pages_than_may_be(spark):
    rows = [(1, f"https://a.org/j/{k}" if k else "https://a.org/j", f"https://a.org/j/{k + 1}", None, [f"x{k}"], False) for k in range(30)]
    got = paging.followed(spark.createDataFrame(rows, PAGE), spark.createDataFrame([(1, "https://a.org/j")], "source_id long, url string")).first()
    assert (got.pages, got.error, got.links) == (10, "too many pages", [])


def test_pages_do_not_pass_the_driver(spark, monkeypatch):
    plans, cut = [], paging._cut
    monkeypatch.setattr(paging, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = [(1, f"https://a.org/j/{k}" if k else "https://a.org/j", f"https://a.org/j/{k + 1}" if k < 2 else None, None, [f"x{k}"], False) for k in range(3)]
    got = paging.followed(spark.createDataFrame(rows, PAGE), spark.createDataFrame([(1, "https://a.org/j")], "source_id long, url string")).first()
    assert (got.pages, got.end, len(got.links)) == (3, "last page", 3)
    assert len(plans) == 4 and not any("Broadcast" in p for p in plans)
