"""What changed between two revisions of a page, sentence by sentence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a reviewer is shown of one page: so many edits, so many characters of each.
SHOWN, SHOWN_CHARS = 60, 600
EDITS = "array<struct<op:string,before_at:int,now_at:int,text:string>>"


def sentences(text: Column) -> Column:
    """A text cut after each full stop, exclamation or question mark that space follows."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\n\r\f]+")


def last_two(snapshots: DataFrame) -> DataFrame:
    """(page_id, before_scan, now_scan, before, now) of pages with two snapshots or more. At most two rows a page and task are shuffled."""
    order = Window.partitionBy("page_id").orderBy(F.desc("scan"))
    ranked = snapshots.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    of = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    both = ranked.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), of(2, "scan").alias("before_scan"), of(1, "scan").alias("now_scan"), of(2, "text").alias("before"), of(1, "text").alias("now"))
    return both.where("n = 2").drop("n")


def _split(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """A stretch of equal items (from, to in a and b) on a shortest way from a to b, about half way. Searches from both ends at once, so memory is linear."""
    n, m = len(a), len(b)
    off, odd = n - m, (n - m) % 2
    most = (n + m + 1) // 2
    ahead, back = [0] * (2 * most + 3), [0] * (2 * most + 3)
    for d in range(most + 1):
        low, high = -(d - 2 * max(0, d - m)), d - 2 * max(0, d - n)
        for front in (True, False):
            mine, other = (ahead, back) if front else (back, ahead)
            for k in range(low, high + 1, 2):
                x = mine[k + 1] if k == -d or (k != d and mine[k - 1] < mine[k + 1]) else mine[k - 1] + 1
                x0, y0 = x, x - k
                if front:
                    while x < n and x - k < m and a[x] == b[x - k]:
                        x += 1
                else:
                    while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                        x += 1
                mine[k] = x
                reach = d - 1 if front else d
                if front == bool(odd) and -reach <= off - k <= reach and x + other[off - k] >= n:
                    return (x0, y0, x, x - k) if front else (n - x, m - x + k, n - x0, m - y0)
    raise AssertionError("two ways from both ends always meet")


def common(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order."""
    found, boxes = [], [(0, len(a), 0, len(b))]
    while boxes:
        i, i1, j, j1 = boxes.pop()
        while i < i1 and j < j1 and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < i1 and j < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i < i1 and j < j1:
            x, y, u, v = _split(a[i:i1], b[j:j1])
            found += [(i + x + k, j + y + k) for k in range(u - x)]
            boxes += [(i, i + x, j, j + y), (i + u, i1, j + v, j1)]
    return sorted(found)


def edits(before: Sequence[str], now: Sequence[str]) -> list[tuple[str, int | None, int | None, str]]:
    """The fewest removals and additions of whole items that turn one list into the other, in order: (op, place before, place now, item).

    What stands on one side only is an edit in any case, so only the rest is compared: time grows with the number of shared
    items times the number of edits among them.
    """
    both = set(before) & set(now)
    number = {s: k for k, s in enumerate(both)}
    left, right = [i for i, s in enumerate(before) if s in both], [j for j, s in enumerate(now) if s in both]
    met = [(left[i], right[j]) for i, j in common([number[before[i]] for i in left], [number[now[j]] for j in right])]
    out, i, j = [], 0, 0
    for to_i, to_j in [*met, (len(before), len(now))]:
        out += [("-", k, None, before[k]) for k in range(i, to_i)]
        out += [("+", None, k, now[k]) for k in range(j, to_j)]
        i, j = to_i + 1, to_j + 1
    return out


def with_edits(pairs: DataFrame) -> DataFrame:
    """pairs (before, now) with before and now as lists of sentences, and `edits` between them. Null texts count as empty ones."""

    @F.arrow_udf(EDITS)
    def find(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("op", pa.string()), ("before_at", pa.int32()), ("now_at", pa.int32()), ("text", pa.string())]))
        for old, new in columns:
            names = ("op", "before_at", "now_at", "text")
            rows = [[dict(zip(names, e, strict=True)) for e in edits(a.as_py(), b.as_py())] for a, b in zip(old, new, strict=True)]
            yield pa.array(rows, kind)

    step = pairs.withColumns({"before": sentences(F.col("before")), "now": sentences(F.col("now"))})
    return step.withColumn("edits", find("before", "now"))


def applied(before: Column, made: Column) -> Column:
    """What a list of sentences becomes by its edits."""
    removed = F.transform(F.filter(made, lambda e: e["op"] == "-"), lambda e: e["before_at"])
    added = F.filter(made, lambda e: e["op"] == "+")
    places = F.transform(added, lambda e: e["now_at"])
    texts = F.map_from_entries(F.transform(added, lambda e: F.struct(e["now_at"], e["text"])))
    kept = F.filter(before, lambda x, i: ~F.array_contains(removed, i))
    size = F.size(kept) + F.size(added)
    at = lambda j: F.coalesce(F.try_element_at(texts, j), F.get(kept, j - F.size(F.filter(places, lambda p: p < j))))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), at)).otherwise(F.array().cast("array<string>"))


def hunks(compared: DataFrame) -> DataFrame:
    """(page_id, place, op, before_at, now_at, text): all edits of each page, in order."""
    return compared.select("page_id", F.posexplode("edits").alias("place", "e")).select("page_id", "place", "e.op", "e.before_at", "e.now_at", "e.text")


def shown(found: DataFrame, most: int = SHOWN, chars: int = SHOWN_CHARS) -> DataFrame:
    """What a reviewer is shown of hunks(): the first edits of each page, with the beginning of each."""
    return found.where(F.col("place") < most).withColumn("text", F.substring("text", 1, chars))


def counted(compared: DataFrame) -> DataFrame:
    """(page_id, before_scan, now_scan, removed, added, same, now_sha256): how much changed, and the hash of what the edits make of the older text."""
    n = lambda op: F.size(F.filter("edits", lambda e: e["op"] == op))
    made = F.array_join(applied(F.col("before"), F.col("edits")), "\n")
    return compared.select("page_id", "before_scan", "now_scan", n("-").alias("removed"), n("+").alias("added"), (F.size("edits") == 0).alias("same"), F.sha2(made, 256).alias("now_sha256"))
