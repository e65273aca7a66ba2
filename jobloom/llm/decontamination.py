"""Benchmark decontamination by a distributed positional index (operator 7).

Of each 13-word window of a benchmark item the term that is rarest in the documents is its anchor. Only anchors
are indexed: a posting is a document, a position and the benchmark's terms around it, stored where enough of these stand
around the term in an item too. Postings meet the anchors of their term, offsets are lined up, and the lists
around both are intersected outwards from the anchor. For nearness a window has as many anchors, its rarest terms that
occur, that NEAR_PERCENT of its terms cannot stand anywhere without one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import WORD_OR_SPACE, as_bytes, cut, small_batches, text_column, tidied

WINDOW, NEAR_PERCENT, SHARE = 13, 75, 20
SIDE = WINDOW - 1
#: Benchmark text whose terms one block may hold; larger benchmarks are taken in blocks.
BLOCK_BYTES = 16 << 20
#: Anchor rows of at most this number are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Postings of one term that one task may get where the anchors are joined by shuffle.
POSTINGS = 1_000_000
#: Bytes of text whose postings are made together, and postings whose surroundings are looked at together.
POSTING_BYTES, TOGETHER = 4 << 20, 1 << 14
#: Bits of the filter of terms that stand around an anchor's term, as a power of two, and what a pair's place in it follows from.
PAIR_BITS, PAIR = 24, (0x9E3779B1, 0x85EBCA6B)
#: Stands for what is no term of the benchmark or lies outside a document, and for what lies outside an item: never equal. Terms follow.
NO_TERM, OUTSIDE_ITEM = 0, 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_OR_SPACE).split()


def terms_of(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The terms of a text's words; NO_TERM for words that are none of the vocabulary."""
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, repeat(NO_TERM)), np.int32, len(words))


def item_words(bench: DataFrame, item: str, text: str) -> DataFrame:
    """(item_id, words) with words as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [words_of(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "words"])

    chosen = bench.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(each, f"item_id {bench.schema[item].dataType.simpleString()}, words array<binary>")


def term_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(term, n): how often each term of the broadcast vocabulary stands in docs.text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        found = np.zeros(len(known) + OUTSIDE_ITEM + 1, np.int64)
        for batch in small_batches(batches, most=POSTING_BYTES):
            at = [terms_of(t, known) for t in as_bytes(batch.column(0))]
            found += np.bincount(np.concatenate(at), minlength=len(found))
        found[NO_TERM] = 0
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(found[seen])], ["term", "n"])

    return docs.select("text").mapInArrow(tidied(each), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def anchors_of(words: list[bytes], terms: list[int], counts: list[int]) -> Iterator[tuple[int, int, int, int, int, list[int]]]:
    """(term, position, first and last window start, window's length, surrounding terms) of an item's anchors."""
    n, size = len(words), min(WINDOW, len(words))
    if not n:
        return
    around = [OUTSIDE_ITEM] * SIDE + terms + [OUTSIDE_ITEM] * SIDE
    ranked = list(zip(counts, words, range(n), strict=True))
    start = 0
    least = [min(ranked[s : s + size])[2] for s in range(n - size + 1)]
    for s in range(1, len(least) + 1):
        if s == len(least) or least[s] != least[start]:
            q = least[start]
            yield terms[q], q, start, s - 1, size, around[q : q + WINDOW + SIDE]
            start = s


def near_anchors_of(words: list[bytes], terms: list[int], counts: list[int]) -> Iterator[tuple[int, int, int, int, int, list[int], int]]:
    """(term, position, first and last window start, window's length, surrounding terms, least terms needed) of an item's anchors for nearness."""
    n, size = len(words), min(WINDOW, len(words))
    around = [OUTSIDE_ITEM] * SIDE + terms + [OUTSIDE_ITEM] * SIDE
    found: dict[int, list[tuple[int, int]]] = {}
    for s in range(n - size + 1 if n else 0):
        known = dict(zip(words[s : s + size], counts[s : s + size], strict=True))
        needed = -(-NEAR_PERCENT * len(known) // 100)
        occurring = sorted((c, w) for w, c in known.items() if c)
        for _, w in occurring[: max(0, len(occurring) - needed + 1)]:
            found.setdefault(words.index(w, s), []).append((s, needed))
    for q, at in found.items():
        start = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k][0] != at[k - 1][0] + 1:
                yield terms[q], q, at[start][0], at[k - 1][0], size, around[q : q + WINDOW + SIDE], min(x for _, x in at[start:k])
                start = k


def item_anchors(items: DataFrame, counts: DataFrame, vocabulary) -> DataFrame:
    """(item_id, term, q, s0, s1, size, around, needed) of all items' anchors; needed is null for those of exact matches."""
    kind = items.schema["item_id"].dataType.simpleString()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(map(vocabulary.value.__getitem__, words)) for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], ["row", "item_id", "words", "terms"])

    keyed = items.select(F.monotonically_increasing_id().alias("row"), "item_id", "words")
    keyed = keyed.mapInArrow(named, f"row long, item_id {kind}, words array<binary>, terms array<int>")
    spread = keyed.select("row", "item_id", F.posexplode(F.arrays_zip("words", "terms")).alias("pos", "w"))
    spread = spread.select("row", "item_id", "pos", F.col("w.words").alias("word"), F.col("w.terms").alias("term")).join(counts, "term", "left")
    at = F.struct("pos", "word", "term", F.coalesce("n", F.lit(0)).alias("n"))
    gathered = spread.groupBy("row", "item_id").agg(F.sort_array(F.collect_list(at)).alias("at"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, terms, n = ([x[name] for x in at] for name in ("word", "term", "n"))
                out += [(item, *a, None) for a in anchors_of(words, terms, n)] + [(item, *a) for a in near_anchors_of(words, terms, n)]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (batch.column(0).type, *[pa.int32()] * 5, pa.list_(pa.int32()), pa.int32()), strict=True)],
                ["item_id", "term", "q", "s0", "s1", "size", "around", "needed"],
            )

    return gathered.select("item_id", "at").mapInArrow(each, f"item_id {kind}, term int, q int, s0 int, s1 int, size int, around array<int>, needed int")


def pair_place(term, other):
    """The place in the filter of an anchor's term and one around it: numbers below 2^31, or columns or arrays of them."""
    x = term * PAIR[0] + other * PAIR[1]
    return x.bitwiseAND(F.lit((1 << PAIR_BITS) - 1)) if isinstance(x, Column) else x & ((1 << PAIR_BITS) - 1)


def pair_filter(anchors: DataFrame) -> np.ndarray:
    """The bits of pair_place of all terms around all anchors; of a fixed size."""
    pairs = anchors.select("term", F.explode(F.array_distinct("around")).alias("other")).where(F.col("other") != OUTSIDE_ITEM)
    at = pairs.select(pair_place(F.col("term").cast("long"), F.col("other").cast("long")).alias("at"))
    found = at.groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (PAIR_BITS - 5), "<u4")
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return bits.view(np.uint8)


def postings(docs: DataFrame, kind: str, vocabulary, anchors) -> DataFrame:
    """(doc_id, d, k, n_words, postings) for each row; a posting is an anchor's term, its part of those, its position and the terms around it.

    anchors: by term, the parts that its postings are dealt out in (0: no anchor), and the least number of terms that a window
    of it needs; and a filter of the pairs of terms of which one is an anchor's and one stands around it. Where fewer of the
    latter stand, no window can match, and no posting is stored. The filter may let through too much, never too little.
    """
    width = WINDOW + SIDE

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (parts, least), pairs = vocabulary.value, *anchors.value
        for batch in small_batches(batches, most=POSTING_BYTES):
            # The texts' terms lie behind one another with SIDE places between them.
            found = [terms_of(t, known) for t in as_bytes(batch.column(1))]
            sizes = np.array([len(x) for x in found])
            starts = SIDE + np.concatenate([[0], np.cumsum(sizes + SIDE)])
            padded = np.full(starts[-1] + 1, NO_TERM, np.int32)
            for x, at in zip(found, starts.tolist(), strict=False):
                padded[at : at + len(x)] = x
            around = np.lib.stride_tricks.sliding_window_view(padded, width)
            places = np.flatnonzero(parts[padded])
            stay = [np.empty(0, places.dtype)]
            for some in (places[i : i + TOGETHER] for i in range(0, len(places), TOGETHER)):
                bits = pair_place(padded[some].astype(np.int64)[:, None], around[some - SIDE].astype(np.int64))
                stand = (pairs[bits >> 3] >> (bits & 7).astype(np.uint8) & np.uint8(1)).sum(axis=1, dtype=np.int32)
                stay.append(some[stand >= least[padded[some]]])
            places = np.concatenate(stay)
            ends = np.searchsorted(places, starts)
            term, pos = padded[places], places - np.repeat(starts[:-1], np.diff(ends))
            part = (np.repeat(batch.column(3).to_numpy(), np.diff(ends)) + pos) % parts[term]
            near = around[places - SIDE]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, width), pa.int32()), pa.array(near.ravel()))
            columns = [pa.array(term), pa.array(part.astype(np.int32)), pa.array(pos.astype(np.int64)), lists]
            held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["term", "part", "pos", "around"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), held], ["doc_id", "d", "k", "n_words", "postings"])

    return docs.mapInArrow(tidied(each), f"doc_id {kind}, d long, k long, n_words long, postings array<struct<term:int,part:int,pos:long,around:array<int>>>")


def run_length(step: int):
    """How many terms next to the anchor, going one way, are equal in `around` and `item_around`."""
    differ = F.transform(
        F.sequence(F.lit(1), F.lit(SIDE)),
        lambda d: F.get(F.col("around"), F.lit(SIDE) + step * d) != F.get(F.col("item_around"), F.lit(SIDE) + step * d),
    )
    first = F.array_position(differ, True)
    return F.when(first == 0, F.lit(SIDE)).otherwise(first - 1).cast("int")


def block_matches(docs: DataFrame, items: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """The documents' rows, and the matches of their texts with one block of items."""
    context = docs.sparkSession.sparkContext
    terms = {bytes(r[0]): k for k, r in enumerate(items.select(F.explode("words")).distinct().toLocalIterator(), OUTSIDE_ITEM + 1)}
    vocabulary = context.broadcast(terms)
    counts = cut(term_counts(docs, vocabulary), "terms")
    anchors = cut(item_anchors(items, counts, vocabulary), "anchors")
    side = anchors.withColumnRenamed("around", "item_around")
    # A frequent term's postings are dealt out in parts where they are shuffled; its anchors go to each part.
    parts = F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(1)) / POSTINGS)).cast("int")
    # An exact window needs all of its words, one for nearness its least number of terms.
    named = anchors.groupBy("term").agg(F.min(F.coalesce("needed", "size")).alias("least"))
    if anchors.count() <= BROADCAST_ROWS:
        named, side = named.withColumn("parts", F.lit(1)), F.broadcast(side.withColumn("part", F.lit(0)))
    else:
        named = named.join(counts, "term", "left").select("term", "least", parts.alias("parts"))
        side = side.join(named.drop("least"), "term").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    by_term = np.zeros((2, len(terms) + OUTSIDE_ITEM + 1), np.int32)
    for r in named.toLocalIterator():
        by_term[:, r["term"]] = r["parts"], r["least"]
    index = cut(postings(docs, kind, vocabulary, context.broadcast((by_term, pair_filter(anchors)))), "postings")
    met = index.select("d", "k", F.explode("postings").alias("p")).select("d", "k", "p.*").join(side, ["term", "part"])
    met = met.withColumns({"left": run_length(-1), "right": run_length(1)})
    met = met.withColumns(
        {"lo": F.greatest("s0", F.col("q") - F.col("left")), "hi": F.least("s1", F.col("q") + F.col("right") - F.col("size") + 1)}
    )
    common = F.array_intersect("item_around", "around")

    def stands(s):
        phrase = F.slice("item_around", SIDE - F.col("q") + s + 1, F.col("size"))
        return 100 * F.size(F.array_intersect(phrase, F.col("around"))) >= NEAR_PERCENT * F.size(F.array_distinct(phrase))

    # Most places fail for all windows of the anchor at once.
    near = F.when(F.col("needed").isNotNull() & (F.size(common) >= F.col("needed")), F.exists(F.sequence("s0", "s1"), stands)).otherwise(False)
    found = met.select(
        "d",
        "k",
        "item_id",
        (F.col("needed").isNull() & (F.col("lo") <= F.col("hi"))).alias("exact"),
        near.alias("near"),
        (F.col("pos") - F.col("q") + F.col("lo")).alias("start"),
        (F.col("pos") - F.col("q") + F.col("hi") + F.col("size")).alias("end"),
    )
    return index.select("doc_id", "d", "k", "n_words"), found.where("exact or near")


def search(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, d, k, n_words, spans, items, near_items) for each row of docs; d and k are the hashes of its id and text.

    spans: array of (start, end) word runs in which benchmark windows stand, merged; items: the items of those windows;
    near_items: items of which a window's terms stand, at least NEAR_PERCENT of them, within 12 words of one of its anchors.
    An item of fewer than 13 words is one window; an item without words is none; one without an id covers words, but is not
    named. Null texts have no words; null ids are carried along; rows alike in id and text are matched alike; empty tables
    give no rows or no matches.
    """
    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    chosen = chosen.withColumns({"d": F.xxhash64("doc_id"), "k": F.xxhash64(text_column("text"))})
    size = bench.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    items = cut(item_words(bench, item, item_text), "items")
    out: DataFrame | None = None
    rows: DataFrame | None = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == k) if blocks > 1 else items
        now, found = block_matches(chosen, part, kind)
        if blocks > 1:
            found = cut(found, "matches")
        rows, out = rows or now, found if out is None else out.unionByName(found)
    # What is not named has a null item, which collect_set passes over, as it does null spans.
    exact = F.when(F.col("exact"), F.struct("start", "end"))
    matches = out.groupBy("d", "k").agg(
        F.sort_array(F.collect_set(exact)).alias("spans"),
        F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string"))).alias("items"),
        F.collect_set(F.when(F.col("near"), F.col("item_id").cast("string"))).alias("near_items"),
    )
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    none = F.array().cast("array<string>")
    return (
        rows.join(matches, ["d", "k"], "left")
        .select(
            "doc_id",
            "d",
            "k",
            "n_words",
            F.coalesce(merged, F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
            F.coalesce("items", none).alias("items"),
            F.coalesce("near_items", none).alias("near_items"),
        )
    )


def digest(found: DataFrame) -> DataFrame:
    """One row per searched document, with the hashes of its id and text: how many of its words benchmark windows cover, and whether that contaminates it."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("*", hit.alias("n_hit")).select(
        "doc_id",
        "d",
        "k",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS words FROM documents),
    i AS (SELECT item_id, {words} AS words FROM benchmark),
    w AS (SELECT DISTINCT item_id, list_slice(words, k, k + least(len(words), {WINDOW}) - 1) AS win
      FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 2))) AS k FROM i WHERE len(words) > 0)),
    m AS (SELECT DISTINCT len(win) AS size FROM w),
    p AS (SELECT r, size, k, list_slice(words, k, k + size - 1) AS win FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS k FROM d, m)),
    f AS (SELECT r, item_id, k, size FROM p JOIN w USING (win)),
    hit AS (SELECT r, count(DISTINCT k + j) AS n FROM (SELECT r, k, unnest(range(size)) AS j FROM f) GROUP BY r),
    items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM f) GROUP BY r)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
      coalesce(h.n, 0) > 0 AND {SHARE} * coalesce(h.n, 0) >= len(words) AS contaminated
    FROM d LEFT JOIN hit h USING (r) LEFT JOIN items t USING (r)"""
