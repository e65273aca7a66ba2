"""Mixing sources to target weights by a low-discrepancy schedule (operator 12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.llm.common import SPACE_PATTERN, cut, text_column

#: Sources weigh in turn so much; together they take so much of all words, and each at most so many times its own.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words of a block at most, and slots that are numbered together.
BLOCK, CHUNK = 512, 4096


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, s, size, h): s names the source with null told apart, h is the place in the shuffled order.

    h comes of key and text, so that rows without an id or with a repeated one are spread too. Written once: texts are read no more.
    """
    whole = text_column(text)
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(whole))), 1, 15), 16, 10)
    words = F.size(F.filter(F.split(whole, SPACE_PATTERN), lambda w: w != ""))
    return cut(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source))).alias("s"),
            words.cast("long").alias("size"),
            h.cast("long").alias("h"),
        ),
        "sizes",
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(s, source, source_size, n_rows, target, start, stop, total) for each source, start and stop being its part of the cumulative targets.

    A source stops at `passes` times its size and the others share the rest by weight. With sources in the order in which they fill
    (size per weight), the level "what is left per weight that is left" rises as long as sources are full and falls after, so
    its greatest value is the level of all others. One row a source, ordered in one task: sources are far fewer than documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    out = sizes.groupBy("s", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")).withColumn("w", w)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fills = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"cap": passes * F.col("source_size"), "all": F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything)})
    left = F.lit(share) * F.col("all") - F.coalesce(F.sum("cap").over(fills), F.lit(0))
    out = out.withColumn("level", left / (F.col("all_w") - F.coalesce(F.sum("w").over(fills), F.lit(0))))
    out = out.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(everything)))
    so_far = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("stop", so_far).withColumn("start", F.coalesce(F.lag("stop").over(by_name), F.lit(0.0)))
    return out.select("s", "source", "source_size", "n_rows", "target", "start", "stop", F.sum("target").over(everything).alias("total"))


def running(rows: DataFrame, key: str, bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of the same key that come earlier in the order of bucket, then `order`.

    Sums are made in buckets and carried from bucket to bucket, so that no task holds a whole key, however large.
    """
    sums = rows.groupBy(key, bucket).agg(F.sum(value).alias("__in"))
    earlier = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, bucket, F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # By shuffle, which the window needs too: rows made by explode are many more than Spark thinks, and would be broadcast.
    out = rows.join(sums.hint("merge"), [key, bucket]).withColumn(name, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("__before")


def bits_for(n: int) -> int:
    """The least k with 2^k >= n."""
    return max(0, int(n - 1).bit_length())


def streams(sizes: DataFrame) -> DataFrame:
    """The documents that have words, with `at`: how many words of their source come earlier in its shuffled order.

    An order of n rows is summed in about sqrt(n) buckets by the upper bits of h. (s, at) names a row.
    """
    rows = sizes.where("size > 0")
    bits = bits_for(rows.count()) // 2 + 1
    bucketed = rows.withColumn("__bucket", F.shiftright("h", 60 - bits))
    return running(bucketed, "s", "__bucket", ["h", "doc_id"], F.col("size"), "at").drop("__bucket")


def schedule(shares: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """((s, rank, slot), words a block): which source's turn each slot is, and which of its blocks it takes.

    There are N = 2^k slots, slot t standing at van der Corput's point, the reversed bits of t as a fraction. As the N points are
    all multiples of 1/N, a source is met at the multiples j/N between its cumulative targets, and t is j with its bits reversed:
    no slot is compared with any source. A source's number of slots is thus right to one block at any length. What a
    source lacks then is taken by a closing slot after the N, what it has too much is left out of its last slot.
    """
    total = shares.agg(F.max("total").alias("t")).first()["t"] or 0.0
    k = bits_for(-int(-total // block)) if total else 0
    slots = 1 << k
    words = max(1, -int(-total // slots))
    first = F.ceil(F.col("start") * slots / F.col("total")).cast("long")
    # Rounding may carry the last sum past or short of the total; the last source ends at the last multiple.
    last = F.when(F.col("stop") >= F.col("total"), F.lit(slots)).otherwise(F.ceil(F.col("stop") * slots / F.col("total"))).cast("long")
    parts = shares.where("target > 0").withColumns({"j0": first, "j1": last})
    pieces = parts.where("j1 > j0").select("s", "j0", "j1", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("j1") - F.col("j0") - 1) / CHUNK))).alias("c"))
    pieces = pieces.repartition("s", "c")
    at = F.col("j0") + F.col("c") * CHUNK
    points = pieces.select("s", F.explode(F.sequence(at, F.least(at + CHUNK, F.col("j1")) - 1)).alias("j"))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("j"), k, "0")), 2, 10).cast("long") if k else F.lit(0).cast("long")
    points = points.withColumn("slot", reversed_bits)
    bucket = F.shiftright("slot", k - (k // 2))
    taken = running(points.withColumn("__bucket", bucket), "s", "__bucket", ["slot"], F.lit(1).cast("long"), "rank").select("s", "rank", "slot")
    n = F.greatest(F.col("j1") - F.col("j0"), F.lit(0))
    closing = parts.where(n * words < F.floor("target")).select("s", n.alias("rank"), (F.lit(slots) + F.row_number().over(Window.orderBy("s")) - 1).cast("long").alias("slot"))
    return taken.unionByName(closing), words


def mix(stream: DataFrame, shares: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """(slot, s, at, doc_id, size, round, first_word, n_words): the mixed order, slot by slot, as spans of documents.

    The documents of a source in their shuffled order, gone through up to `passes` times, are a stream of words; block b of it, which
    may begin and end inside a document, is taken by the source's slot of rank b. Each block is one small group, whatever its source.
    """
    slots, words = schedule(shares, block)
    wanted = shares.select("s", "source_size", F.floor("target").cast("long").alias("__end"))
    rounds = stream.join(wanted, "s").select("*", F.explode(F.array(*[F.lit(r) for r in range(passes)])).alias("round"))
    rounds = rounds.withColumn("__from", F.col("at") + F.col("round") * F.col("source_size"))
    rounds = rounds.withColumn("__to", F.least(F.col("__from") + F.col("size"), F.col("__end"))).where("__to > __from")
    blocks = F.sequence(F.floor(F.col("__from") / words), F.floor((F.col("__to") - 1) / words))
    spans = rounds.withColumn("rank", F.explode(blocks))
    start = F.greatest(F.col("__from"), F.col("rank") * words)
    spans = spans.select(
        "s", "rank", "at", "doc_id", "size", "round",
        (start - F.col("__from")).alias("first_word"),
        (F.least(F.col("__to"), (F.col("rank") + 1) * words) - start).alias("n_words"),
    )
    return spans.join(slots.hint("merge"), ["s", "rank"]).select("slot", "s", "at", "doc_id", "size", "round", "first_word", "n_words")


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target (of its source) and taken, the words of it that the mix holds.

    Null texts have no words; a null source is a source, the last; documents without words take nothing; repeated rows are each
    placed; a source or table without words has target 0; an empty table gives no rows; other columns are not read. Order depends on
    ids and texts alone, so reruns agree.
    """
    sizes = sized(docs, key, source, text)
    shares = cut(targets(sizes), "targets")
    stream = cut(streams(sizes), "streams")
    spans = mix(stream, shares).select("s", "at", "doc_id", "size", "n_words")
    placed = spans.unionByName(stream.select("s", "at", "doc_id", "size", F.lit(0).cast("long").alias("n_words")))
    sums = placed.groupBy("s", "at", "doc_id", "size").agg(F.sum("n_words").alias("taken")).drop("at")
    rows = sums.unionByName(sizes.where("size = 0").select("s", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(shares.select("s", "source_size", "target"), "s").select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    """By the stream alone: a document is taken as far as the target reaches in the first round and in the second."""
    return rf"""
    WITH sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
               CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
    sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (
        SELECT *, {list(WEIGHTS)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS w, {PASSES} * source_size AS cap,
               (SELECT sum(source_size) FROM sums) AS everything FROM sums),
    levels AS (
        SELECT *, ({SHARE}::DOUBLE * everything::DOUBLE - coalesce(sum(cap) OVER filled, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER filled, 0))::DOUBLE AS level
        FROM weighed WINDOW filled AS (ORDER BY cap::DOUBLE / w::DOUBLE, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    aimed AS (SELECT source, source_size, least(cap::DOUBLE, w::DOUBLE * (SELECT max(level) FROM levels)) AS target FROM levels),
    placed AS (
        SELECT z.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM sized z)
    SELECT p.doc_id, p.size, a.source_size, a.target,
           CAST(greatest(0, least(p.size, CAST(floor(a.target) AS BIGINT) - p.at)) + greatest(0, least(p.size, CAST(floor(a.target) AS BIGINT) - a.source_size - p.at)) AS BIGINT) AS taken
    FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source"""
