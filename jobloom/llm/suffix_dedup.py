"""Removal of repeated byte strings with suffix arrays (operator 9).

A byte goes if a LENGTH-byte string that covers it also starts anywhere else. Every such string contains an anchor: the
window minimum of its GRAM-byte hashes, which depends on nothing but the string. So equal strings have equal anchors at equal
offsets, and

1. only anchors are shuffled, each with the segment of strings it stands for;
2. an anchor seen once settles its strings as unique, a segment seen twice settles them as repeated;
3. the segments of the other anchors meet by anchor, in batches of bounded size. Each batch is sorted in two stages: suffixes
   smaller than their successors directly, the others induced from them by bucket scans. Neighbours
   whose common prefix, which is computed then, has LENGTH bytes are repeats;
4. the segments of an anchor that has very many are dealt out by further anchors and by hashes instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, cut, drop, maybe_among, meet, small_batches, text_column, tidied

LENGTH, GRAM = 200, 40
WINDOW = LENGTH - GRAM + 1
#: Strings of a text that are looked at together; bytes of a batch that is sorted together; segments of a dealt-out anchor.
CHUNK, BATCH_BYTES, MANY = 1 << 20, 1 << 20, 1000
#: Suffixes are compared to this depth, which is enough to bring equal strings together.
DEPTH = LENGTH + 8
FURTHER = 4
#: Bits for a place in a chunk, behind those of a hash.
PLACE_BITS = 21
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    at = 1
    while at < n:
        more = min(at, n - at)
        out[at : at + more] = out[:more] * np.uint64(pow(base, at, 1 << 64))
        at += more
    return out


class Rolling:
    """Polynomial hashes of substrings modulo 2**64, each byte standing for an odd random number."""

    def __init__(self, n: int, seed: int = 1):
        self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        self.byte = np.random.default_rng(seed).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)

    def fits(self, n: int) -> None:
        """Powers for texts of n bytes."""
        if n > len(self.up):
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.fits(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(data: np.ndarray, rolling: Rolling) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, segment hash, first string, strings) of a text, in chunks.

    A string's anchor is the least hash of its grams. Strings that follow each other and share it form a segment.
    """
    for begin in range(0, len(data) - LENGTH + 1, CHUNK):
        part = data[begin : begin + CHUNK + LENGTH - 1]
        sums = rolling.sums(part)
        at = np.arange(len(part) - GRAM + 1)
        gram = rolling.of(sums, at, at + GRAM)
        place = least_places(gram)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        many = np.diff(np.concatenate([first, [len(place)]]))
        yield gram[place[first]], rolling.of(sums, first, first + many + LENGTH - 1), first + begin, many


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs as (doc_id, text, d, k): d and k name a row by its content, so that every scan names it alike."""
    chosen = docs.select(F.col(key).alias("doc_id"), text_column(text).alias("text"))
    return chosen.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "k": F.xxhash64("text")})


def all_anchors(rows: DataFrame) -> DataFrame:
    """(d, k, a, s, p, n): a segment of n strings from byte p with anchor a and segment hash s."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(1 << 16)
        for batch in small_batches(batches):
            found, which = [], []
            for i, t in enumerate(as_bytes(batch.column(2))):
                if len(t) >= LENGTH:
                    for x in anchors(np.frombuffer(t, np.uint8), rolling):
                        found.append(x)
                        which.append(np.full(len(x[0]), i))
            if found:
                a, s, p, n = (np.concatenate(x) for x in zip(*found, strict=True))
                i = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(i), batch.column(1).take(i), pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(p), pa.array(n.astype(np.int32))],
                    ["d", "k", "a", "s", "p", "n"],
                )

    return rows.select("d", "k", "text").mapInArrow(tidied(each), "d long, k long, a long, s long, p long, n int")


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes in order, as far as DEPTH bytes tell them apart; sorted in two stages.

    A suffix smaller than its successor is sorted directly. Any other begins with a byte no smaller than its successor's first, so
    scanning the buckets of first bytes upwards, each suffix placed tells the place of the one before it.
    """
    t = np.frombuffer(text, np.uint8).astype(np.int64)
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    # Equal neighbours take the type of what follows their run; the end counts as the smallest.
    turn = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]]))
    rises = np.zeros(len(turn), bool)
    rises[:-1] = t[turn[:-1]] < t[turn[:-1] + 1]
    direct = np.repeat(rises, np.diff(np.concatenate([[-1], turn])))
    starts = np.flatnonzero(direct)
    first = t[starts]
    starts = starts[np.argsort(first, kind="stable")]
    edges = np.searchsorted(np.sort(first), np.arange(257))
    # A bucket after the other: the keys of all suffixes would take more than two hundred times the text.
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            keys = [text[i : i + DEPTH] for i in starts[a:b].tolist()]
            starts[a:b] = starts[a:b][sorted(range(len(keys)), key=keys.__getitem__)]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if not direct[n - 1]:
        waiting[t[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def place(placed: np.ndarray, c: int) -> np.ndarray:
        """Hand on the predecessors that wait to be induced; returns those of the same bucket."""
        before = placed[placed > 0] - 1
        before = before[~direct[before]]
        byte = t[before]
        same = before[byte == c]
        other, byte = before[byte != c], byte[byte != c]
        if len(other):
            order = np.argsort(byte, kind="stable")
            other, byte = other[order], byte[order]
            cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
            for piece, b in zip(np.split(other, cuts), byte[np.concatenate([[0], cuts])].tolist(), strict=True):
                waiting[b].append(piece)
        return same

    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(now):
            out.append(now)
            now = place(now, c)
        rest = starts[edges[c] : edges[c + 1]]
        out.append(rest)
        place(rest, c)
    return np.concatenate(out)


def common_prefixes(text: bytes, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place of an order but the first, how many bytes (up to `most`) it has in common with the place before it; eight are compared at once."""
    t = np.frombuffer(text + bytes(most + 8), np.uint8).astype(np.uint64)
    eight = t[: len(text) + most].copy()
    for k in range(1, 8):
        eight |= t[k : k + len(eight)] << np.uint64(8 * k)
    low, high = order[:-1], order[1:]
    out, live = np.full(len(low), most, np.int64), np.arange(len(low))
    for k in range(0, most, 8):
        x = eight[low[live] + k] ^ eight[high[live] + k]
        differ = x != 0
        out[live[differ]] = k + (np.bitwise_count((x[differ] & -x[differ]) - np.uint64(1)).astype(np.int64) >> 3)
        live = live[~differ]
        if not len(live):
            break
    return np.minimum(np.minimum(out, most), len(text) - np.maximum(low, high))


def repeated_starts(text: bytes, chosen: np.ndarray) -> np.ndarray:
    """Of the chosen starts, marked as booleans over the text, those whose LENGTH bytes stand at another chosen start too."""
    order = suffix_array(text)
    order = order[chosen[order]]
    alike = common_prefixes(text, order) >= LENGTH
    found = np.zeros(len(text), bool)
    found[order[:-1][alike]] = True
    found[order[1:][alike]] = True
    return found


SEGMENT = "a long, s long, c long, d long, k long, p long, n int, bytes binary"
SPAN = "d long, k long, start long, end long"


def span_batch(d: list, k: list, start: list, end: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, k, start, end)], ["d", "k", "start", "end"])


def compare(segments: DataFrame) -> DataFrame:
    """Spans of the repeated strings of segments seen once, from all distinct segments of their anchors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush(rows: list[dict]) -> pa.RecordBatch:
            text = b"".join(r["bytes"] for r in rows)
            at, chosen = 0, np.zeros(len(text), bool)
            for r in rows:
                chosen[at : at + r["n"]] = True
                at += len(r["bytes"])
            found, at = repeated_starts(text, chosen), 0
            out: tuple[list, list, list, list] = ([], [], [], [])
            for r in rows:
                if r["c"] == 1:
                    hit = np.flatnonzero(found[at : at + r["n"]])
                    new = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
                    for x, y in zip(hit[new].tolist(), hit[np.append(new[1:], len(hit)) - 1].tolist() if len(hit) else [], strict=True):
                        for column, value in zip(out, (r["d"], r["k"], r["p"] + x, r["p"] + y + LENGTH), strict=True):
                            column.append(value)
                at += len(r["bytes"])
            return span_batch(*out)

        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["a"], r["s"]) == (held[-1]["a"], held[-1]["s"]):
                    continue  # the same segment, of a row that is repeated whole
                if size > BATCH_BYTES and r["a"] != held[-1]["a"]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield flush(held)

    return segments.repartition("a").sortWithinPartitions("a", "s").mapInArrow(tidied(each), SPAN)


def least_places(gram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each run of `window` hashes, the place of the least; of equal ones the first."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = gram & ~low | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span < window:
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & low).astype(np.int64)


RUN = "t long, u long, x long, y long, c long, d long, k long, p long, n int, bytes binary"


def runs(segments: DataFrame) -> DataFrame:
    """Segments cut into runs of strings that agree in FURTHER more anchors, under other hashes.

    (t, u) names the anchors, (x, y) the run's bytes. Strings that differ in an anchor differ, so that most of a large
    group is settled by a few rows a segment.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(1 << 16), Rolling(1 << 16, 2)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                data = np.frombuffer(r["bytes"], np.uint8)
                sums, other = one.sums(data), two.sums(data)
                at = np.arange(len(data) - GRAM + 1)
                gram = one.of(sums, at, at + GRAM)
                names, cuts = [np.full(r["n"], r["a"], np.int64).view(np.uint64)], np.zeros(r["n"], bool)
                cuts[0] = True
                for j in range(FURTHER):
                    seeded = mix(gram ^ np.uint64((BASE * (2 * j + 3)) % (1 << 64)))
                    place = least_places(seeded)
                    cuts[1:] |= place[1:] != place[:-1]
                    names.append(gram[place])
                first = np.flatnonzero(cuts)
                many = np.diff(np.append(first, r["n"]))
                t, u = np.zeros(len(first), np.uint64), np.ones(len(first), np.uint64)
                for name in names:
                    t, u = mix(t * np.uint64(BASE) ^ name[first]), mix(u * np.uint64(BASE + 2) ^ name[first])
                end = first + many + LENGTH - 1
                x, y = one.of(sums, first, end), two.of(other, first, end)
                signed = [v.view(np.int64).tolist() for v in (t, u, x, y)]
                for *key, f, m in zip(*signed, first.tolist(), many.tolist(), strict=True):
                    out.append((*key, r["c"], r["d"], r["k"], r["p"] + f, m, r["bytes"][f : f + m + LENGTH - 1]))
            columns = list(zip(*out, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 8 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), z) for c, z in zip(columns, kinds, strict=True)], [c.split()[0] for c in RUN.split(", ")])

    return segments.mapInArrow(tidied(each), RUN)


def strings(kinds: DataFrame) -> DataFrame:
    """(x, y, m, c, d, k, start): every string of the runs by two hashes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(1 << 16), Rolling(1 << 16, 2)
        for batch in batches:
            for r in batch.to_pylist():
                data, at = np.frombuffer(r["bytes"], np.uint8), np.arange(r["n"])
                x, y = (h.of(h.sums(data), at, at + LENGTH).view(np.int64) for h in (one, two))
                same = [pa.array(np.full(len(at), r[v], np.int64)) for v in ("m", "c", "d", "k")]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), *same, pa.array(at + r["p"])], ["x", "y", "m", "c", "d", "k", "start"])

    return kinds.mapInArrow(tidied(each), "x long, y long, m long, c long, d long, k long, start long")


def compare_by_hash(segments: DataFrame) -> DataFrame:
    """The same for anchors with very many segments, without bringing them together.

    Runs alike in all anchors and bytes are repeats; runs that share their anchors with no other are unique; only of the others
    are the single strings counted, once for each kind of run.
    """
    cuts = cut(runs(segments), "runs")
    kinds = cuts.groupBy("t", "u", "x", "y").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("d", "k", "p", "n", "c", "bytes")).alias("at"))
    kinds = cut(kinds.select("t", "u", "x", "y", "m", "at.*"), "kinds")
    whole = meet(cuts.where("c = 1"), kinds.where("m > 1").select("t", "u", "x", "y", "m"), ["t", "u", "x", "y"], ["d", "k", "p"], "m")
    whole = whole.select("d", "k", F.col("p").alias("start"), (F.col("p") + F.col("n") + LENGTH - 1).alias("end"))
    mixed = cut(kinds.groupBy("t", "u").agg(F.count(F.lit(1)).alias("among")).where("among > 1"), "mixed")
    # Dealt out anew by place, as the runs of one large group came to one task.
    open_ = meet(kinds, mixed, ["t", "u"], ["d", "k", "p"], "among").select("m", "c", "d", "k", "p", "n", "bytes").repartition("d", "k", "p")
    single = strings(open_)
    twice = cut(single.groupBy("x", "y").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"), "strings")
    # Most strings of near copies are their own: those that cannot be among the repeated ones stay out of the join.
    maybe = maybe_among(single.where("c = 1 and m = 1"), twice, ("x", "y")).where("maybe").drop("maybe")
    found = meet(maybe, twice, ["x", "y"], ["d", "k", "start"], "seen")
    return whole.unionByName(found.select("d", "k", "start", (F.col("start") + LENGTH).alias("end")))


def with_bytes(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """segments with their bytes, read from the texts."""
    wanted = segments.groupBy("d", "k").agg(F.collect_list(F.struct("a", "s", "c", "p", "n")).alias("want"))
    texts = maybe_among(rows.select("d", "k", "text"), segments).where("maybe").drop("maybe").join(wanted, ["d", "k"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            d, k = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (t, want) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                pick = lambda c: pa.array([w[c] for w in want], pa.int64())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pick("a"), pick("s"), pick("c"), pa.array([d[i]] * len(want), pa.int64()), pa.array([k[i]] * len(want), pa.int64()), pick("p"),
                     pick("n").cast(pa.int32()), pa.array([t[w["p"] : w["p"] + w["n"] + LENGTH - 1] for w in want], pa.binary())],
                    ["a", "s", "c", "d", "k", "p", "n", "bytes"],
                )

    return texts.mapInArrow(tidied(each), SEGMENT)


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(d, k, start, end): runs of bytes that repeated strings cover, in any order and overlapping."""
    all_ = cut(all_anchors(rows), "anchors")
    # Partial counts at the map side keep an anchor of many copies down to a row a task.
    again = all_.groupBy("a").agg(F.count(F.lit(1)).alias("seen"), F.min("s").alias("low"), F.max("s").alias("high"))
    again = cut(again.where("seen > 1").select("a", "seen", (F.col("low") != F.col("high")).alias("mixed")), "repeated")
    found = cut(meet(all_, again, ["a"], ["d", "k", "p"], "seen").drop("seen"), "again")
    drop(all_)
    whole = found.where("not mixed").select("d", "k", F.col("p").alias("start"), (F.col("p") + F.col("n") + LENGTH - 1).alias("end"))
    unsure = found.where("mixed")
    classes = unsure.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "k", "p", "n")).alias("at"))
    classes = cut(classes.select("a", "s", "c", "at.*"), "classes")
    twice = meet(unsure, classes.where("c > 1").select("a", "s", "c"), ["a", "s"], ["d", "k", "p"])
    twice = twice.select("d", "k", F.col("p").alias("start"), (F.col("p") + F.col("n") + LENGTH - 1).alias("end"))
    segments = cut(with_bytes(rows, classes), "segments")
    many = cut(classes.groupBy("a").count().where(F.col("count") > MANY).select("a"), "many")
    if many.limit(1).count():
        close = compare(segments.join(many, "a", "left_anti")).unionByName(compare_by_hash(segments.join(many, "a", "left_semi")))
    else:
        close = compare(segments)
    return whole.unionByName(twice).unionByName(close)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs: the removed runs as (start, end), and what is left as bytes.

    Strings are judged on the input, so every copy of a repeated string goes. Null texts are empty; texts shorter than
    LENGTH bytes stay whole; repeated rows repeat each other's strings; an empty table gives no rows.
    What is left may begin or end within a character, and so is binary.
    """
    rows = keyed(docs, key, text)
    spans = repeated_spans(rows).groupBy("d", "k").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    spans = cut(spans, "spans")
    split = maybe_among(rows, spans)
    touched = split.where("maybe").drop("maybe").join(spans, ["d", "k"], "left").select("doc_id", "text", "found")
    kind = docs.schema[key].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes, runs, kept = [], [], []
            for t, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                merged: list[dict] = []
                for s in sorted(found or (), key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                at, left = 0, []
                for s in merged:
                    left.append(t[at : s["start"]])
                    at = s["end"]
                sizes.append(len(t))
                runs.append(merged)
                kept.append(b"".join([*left, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, run), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    changed = touched.mapInArrow(tidied(each), f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    same = split.where("not maybe").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return changed.unionByName(same)


def digest(removed: DataFrame) -> DataFrame:
    """One row per document: how many bytes and runs went, and a digest of the rest."""
    return removed.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def oracle() -> str:
    """Every string of a text by its bytes in hexadecimal digits; what two share is covered, and joined to spans where it meets."""
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    p AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS s FROM (SELECT r, h, unnest(range(0, n - {LENGTH - 1})) AS i FROM d WHERE n >= {LENGTH})),
    t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM p) WHERE c > 1),
    o AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM t),
    g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM o),
    span AS (SELECT r, g, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY r, g),
    sums AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY r),
    edges AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY r ORDER BY a) AS next FROM span),
    kept AS (SELECT e.r, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN next IS NULL THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS k FROM edges e JOIN d USING (r) GROUP BY e.r)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
    FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""
