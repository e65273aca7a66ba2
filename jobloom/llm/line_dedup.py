"""Removal of repeated runs of lines by winnowing (operator 2).

A window is the shortest run of non-blank lines from a given line that has at least WORDS words. Its fingerprint is the least
hash of its lines, so that any repeated run of a window's length is certain to share a fingerprint. Only fingerprints
are shuffled; where one is seen again the windows it was chosen by meet by content, each later one is extended as far as any
earlier run goes on alike (before its start by the windows that begin there, past its end by further lines), and deleted.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, cut, drop, maybe_among, meet, small_batches, text_column, tidied

WORDS = 30
SEEDS = (11, 29)


def lines_of(text: bytes) -> tuple[list[int], list[bytes], list[int]]:
    """Numbers, contents (outer white space gone) and words of the lines that have any."""
    numbers, contents, sizes = [], [], []
    for i, line in enumerate(text.split(b"\n")):
        if n := len(line.split()):
            numbers.append(i)
            contents.append(line.strip())
            sizes.append(n)
    return numbers, contents, sizes


def windows(hashes: list[int], sizes: list[int], words: int = WORDS) -> list[tuple[int, int, int]]:
    """(first line, end line, position of the least hash) of each window."""
    out, least, end, held = [], deque(), 0, 0
    for start in range(len(hashes)):
        while end < len(hashes) and held < words:
            while least and hashes[least[-1]] > hashes[end]:
                least.pop()
            least.append(end)
            held += sizes[end]
            end += 1
        if held < words:
            break
        while least[0] < start:
            least.popleft()
        out.append((start, end, least[0]))
        held -= sizes[start]
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


WINDOW = "struct<x:long,y:long,start:long,end:long,next:array<long>>"


def fingerprints(rows: DataFrame) -> DataFrame:
    """(d, k, fp, windows): each chosen line's hash with the windows that chose it."""
    kind = pa.struct([("x", pa.int64()), ("y", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("next", pa.list_(pa.int64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            which, fps, lists = [], [], []
            for i, t in enumerate(as_bytes(batch.column(2))):
                _, contents, sizes = lines_of(t)
                hashes = [xxhash.xxh64_intdigest(c) for c in contents]
                upto = np.cumsum([0, *sizes])
                tail = np.searchsorted(upto, upto + WORDS).tolist()
                chosen: dict[int, list[dict]] = {}
                for start, end, at in windows(hashes, sizes):
                    content = b"\n".join(contents[start:end])
                    x, y = (signed(xxhash.xxh64_intdigest(content, s)) for s in SEEDS)
                    after = [signed(h) for h in hashes[end : tail[end]]]
                    chosen.setdefault(at, []).append({"x": x, "y": y, "start": start, "end": end, "next": after})
                for at, found in chosen.items():
                    which.append(i)
                    fps.append(signed(hashes[at]))
                    lists.append(found)
            i = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(i), batch.column(1).take(i), pa.array(fps, pa.int64()), pa.array(lists, pa.list_(kind))], ["d", "k", "fp", "windows"]
            )

    return rows.select("d", "k", "text").mapInArrow(tidied(each), f"d long, k long, fp long, windows array<{WINDOW}>")


PLACE = ("d", "k", "start")


def prefixes(lines):
    """Hashes of the first line, of the first two, and so on."""
    return F.aggregate(lines, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(F.concat(F.array(F.lit(0).cast("long")), acc), -1), x))))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(d, k, start, end): runs of non-blank lines, counted from 0, that repeat an earlier run."""
    chosen = cut(fingerprints(rows), "fingerprints")
    again = chosen.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max(F.size("windows")).alias("many"))
    again = cut(again.where("c > 1 or many > 1").select("fp", "c"), "again")
    met = cut(meet(chosen, again, ["fp"], ["d", "k"]).select("d", "k", F.explode("windows").alias("w")).select("d", "k", "w.*"), "windows")
    drop(chosen)
    drop(again)
    first = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*PLACE)).alias("first"))
    first = cut(first.where("c > 1"), "first")
    both = cut(meet(met, first, ["x", "y"], [*PLACE]).drop("c"), "twice")
    drop(met)
    later = both.where(F.struct(*PLACE) != F.col("first"))
    # What a window and the next one go on with is found at the next: only the last of windows that begin line by line goes on by itself.
    order = Window.partitionBy("d", "k").orderBy("start")
    last = later.withColumn("after", F.lead("start").over(order)).where("after is null or after > start + 1")
    # A window with its following lines, one, two and so on, meets the earliest run that has them too.
    longer = lambda df: df.select("x", "y", *PLACE, "end", F.posexplode(prefixes(F.col("next"))).alias("n", "h"))
    keys = ["x", "y", "n", "h"]
    met_on = longer(both).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*PLACE)).alias("first"))
    met_on = cut(met_on.where("c > 1"), "longer")
    gone_on = meet(longer(last), met_on, keys, [*PLACE]).where(F.struct(*PLACE) > F.col("first")).groupBy(*PLACE, "end").agg(F.max("n").alias("n"))
    return later.select(*PLACE, "end").unionByName(gone_on.select(*PLACE, (F.col("end") + F.col("n") + 1).alias("end")))


def without(text: bytes, runs: list[dict]) -> tuple[bytes, int]:
    """The text without the lines of the runs, and how many lines went. Blank lines stay."""
    numbers = lines_of(text)[0]
    gone = {numbers[i] for r in runs for i in range(r["start"], r["end"])}
    return b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone), len(gone)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `text` without repeated runs, and a column n_lines_removed (replaced if it exists).

    Every window that equals an earlier one goes, with what follows it as long as it follows any earlier one too (of words, up to
    those of one more window). Earlier means a smaller id, then a smaller line; a null id comes before all, and of different texts
    under one id that of smaller hash. Rows alike in id and text are one document
    twice, and are treated alike; copies under different ids lose their lines to the first, and are left empty. Null texts stay
    null; a text without repeats is left as it is; an empty table gives no rows. Ids must be integers.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), text_column(text).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text"))
    runs = repeated_runs(rows).groupBy("d", "k").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    runs = cut(runs.select(F.col("d").alias("__d"), F.col("k").alias("__k"), F.col("runs").alias("__runs")), "runs")

    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out, counts = [], []
            for t, r in zip(as_bytes(texts), found.to_pylist(), strict=True):
                x, n = without(t, r) if r else (t, 0)
                out.append(x)
                counts.append(n)
            yield pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32())], ["text", "n"])

    @F.arrow_udf("struct<text:string,n:int>")
    def cleaned(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from tidied(each)(batches)

    named = docs.drop("n_lines_removed").withColumns(
        {"__d": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "__k": F.xxhash64(text_column(text))}
    )
    # Only texts that may have runs are shuffled and go to Python; what is removed grows with the corpus, and is never broadcast.
    split = maybe_among(named, runs, ("__d", "__k"))
    joined = split.where("maybe").join(runs.hint("merge"), ["__d", "__k"], "left")
    has = F.col("__runs").isNotNull()
    joined = joined.withColumn("__new", cleaned(F.when(has, F.col(text)), F.col("__runs")))
    joined = joined.withColumns({text: F.when(has, F.col("__new.text")).otherwise(F.col(text)), "n_lines_removed": F.when(has, F.col("__new.n")).otherwise(0)})
    columns = [*[c for c in docs.columns if c != "n_lines_removed"], "n_lines_removed"]
    return joined.select(*columns).unionByName(split.where("not maybe").withColumn("n_lines_removed", F.lit(0)).select(*columns))


def oracle() -> str:
    """Each window and each of its continuations by content: what stands earlier too is gone. For ids that are not repeated."""
    return f"""
    WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS raw, x, len(regexp_extract_all(x, '[^ \\t-\\r]+')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    b AS (SELECT doc_id, raw, regexp_replace(regexp_replace(x, '^[ \\t-\\r]+', ''), '[ \\t-\\r]+$', '') AS x, row_number() OVER o - 1 AS k, sum(w) OVER o AS upto, w FROM l WHERE w > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY raw)),
    s AS (SELECT doc_id, list(x ORDER BY k) AS xs, list(upto ORDER BY k) AS u FROM b GROUP BY doc_id),
    st AS (SELECT doc_id, k, xs, u, (SELECT min(e) FROM unnest(range(k + 1, len(xs) + 1)) t(e) WHERE u[e] - before >= {WORDS}) AS e FROM (SELECT doc_id, xs, u, k, CASE WHEN k = 0 THEN 0 ELSE u[k] END AS before FROM (SELECT doc_id, xs, u, unnest(range(0, len(xs))) AS k FROM s))),
    w AS (SELECT doc_id, k, xs, e, unnest(range(e, coalesce((SELECT min(f) FROM unnest(range(e, len(xs) + 1)) t(f) WHERE u[f] - u[e] >= {WORDS}), len(xs)) + 1)) AS f FROM st WHERE e IS NOT NULL),
    m AS (SELECT doc_id, k, f, min((doc_id, k)) OVER (PARTITION BY e - k, md5(array_to_string(xs[k + 1:f], chr(10)))) AS first FROM w),
    gone AS (SELECT DISTINCT doc_id, unnest(range(k, f)) AS k FROM m WHERE (doc_id, k) <> first)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN (
      SELECT l.doc_id, count(g.k) AS n, string_agg(l.x, chr(10) ORDER BY l.raw) FILTER (WHERE g.k IS NULL) AS t
      FROM l LEFT JOIN b ON l.doc_id = b.doc_id AND l.raw = b.raw LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.k = b.k GROUP BY l.doc_id) USING (doc_id)"""
