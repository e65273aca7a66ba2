"""Compression of vectors to codes of parts, by weighted Lloyd rounds over distinct parts (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.common import cut, meet, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held to this, so that squared distances and sums of rows stay within 64 bits.
LARGEST = 1 << 28
#: Distances computed at a time are those of so many parts to all entries.
STEP = 4096

Codebooks = list[np.ndarray]


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """(row, id, label, ints): the vectors that can be coded, with their components as integers; `row` numbers the rows, as ids may repeat.

    Dropped are null vectors, those with a null or non-finite component, and those that cannot be cut: of no component, of a number
    that `parts` does not divide, or of another length than the kept vector of smallest id.
    """
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    step = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), wide.alias("x"))
    fits = F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    step = step.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0)).where(fits)
    held = lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x * SCALE))).cast("int")
    rows = cut(step.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("x", held).alias("ints")), "integers")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints").alias("n")).first()
    return rows.where(F.size("ints") == F.lit(first["n"] if first else 0))


def by_part(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """rows with a row for each part position: part, v."""
    width = F.size("ints") / parts
    cutting = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(F.col("ints"), (p * width + 1).cast("int"), width.cast("int")))
    return rows.select(*[c for c in rows.columns if c != "ints"], F.posexplode(cutting).alias("part", "v"))


def distinct_parts(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """(part, v, c): the distinct integer parts of each position and how many vectors have them. Equal ones are counted before the shuffle."""
    return cut(by_part(rows, parts).groupBy("part", "v").agg(F.count(F.lit(1)).alias("c")), "parts")


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the vectors of smallest ids, ties in order of their integers; at most `entries` vectors reach the driver."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(entries).collect()
    if not found:
        return []
    return [np.array(x, np.int64) for x in np.split(np.array([f["ints"] for f in found], np.int64), parts, axis=1)]


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each row of v, the lower one of equal distance, and the squared distance. Exact, in integers."""
    code, error = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for at in range(0, len(v), STEP):
        piece = v[at : at + STEP]
        square = np.zeros((len(piece), len(book)), np.int64)
        for k in range(v.shape[1]):
            square += (piece[:, k, None] - book[None, :, k]) ** 2
        best = square.argmin(axis=1)
        code[at : at + STEP], error[at : at + STEP] = best, square[np.arange(len(piece)), best]
    return code, error


def assigned(found: DataFrame, books: Codebooks) -> DataFrame:
    """Distinct parts with code and error against their position's codebook. The codebooks have parts x entries rows, whatever the input."""
    shared = found.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([*found.schema.fields, T.StructField("code", T.IntegerType()), T.StructField("error", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(part), -1)
            code, error = np.empty(len(part), np.int32), np.empty(len(part), np.int64)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                code[at], error[at] = nearest(v[at], shared.value[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=[*batch.schema.names, "code", "error"])

    return found.mapInArrow(assign, schema)


def fit(found: DataFrame, books: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after so many rounds of weighted Lloyd over distinct parts: each counts as often as vectors have it.

    Only sums of parts x entries groups reach the driver. An entry that no part chose stays as it is.
    """
    books = [b.copy() for b in books]
    for _ in range(rounds if books else 0):
        width = books[0].shape[1]
        sums = assigned(found, books).groupBy("part", "code").agg(F.sum("c").alias("n"), *[F.sum(F.col("c") * F.get("v", F.lit(k))).alias(f"s{k}") for k in range(width)])
        for r in sums.collect():
            books[r["part"]][r["code"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def encoded(rows: DataFrame, found: DataFrame, books: Codebooks) -> DataFrame:
    """(row, id, label, code, error): two hex digits a part, and the squared distances summed.

    Distinct parts are coded once and joined back to the vectors; what many vectors share is dealt out in parts. Codes of eight
    parts make one sum, as each is a byte of its own, so the way back is an aggregation that begins before its shuffle.
    """
    if not books:
        return rows.select("row", "id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = cut(assigned(found, books), "codes")
    met = meet(by_part(rows, len(books)), coded, ["part", "v"], ["row"])
    words = -(-len(books) // 8)
    byte = "shiftleft(cast(code as bigint), 8 * (7 - part % 8))"
    sums = met.groupBy("row", "id", "label").agg(*[F.expr(f"sum(if(part div 8 = {k}, {byte}, 0L))").alias(f"w{k}") for k in range(words)], F.sum("error").alias("error"))
    code = F.lower(F.concat(*[F.lpad(F.hex(f"w{k}"), 16, "0") for k in range(words)]))
    return sums.select("row", "id", "label", F.substring(code, 1, 2 * len(books)).alias("code"), "error")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors summed over equal labels; null labels are equal."""
    named = coded.withColumns({"__null": F.col("label").isNull(), "__label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    named = cut(named, "coded")
    sums = cut(named.groupBy("__null", "__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("c")), "labels")
    return meet(named, sums, ["__null", "__label"], ["row"]).drop("__null", "__label", "c")


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with `vector`: the vectors that the codes stand for, as doubles."""
    flat = [F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for entry in b.tolist()]) for b in books]
    one = lambda p: F.element_at(flat[p], F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1)
    empty: Column = F.array().cast("array<double>")
    return coded.withColumn("vector", F.concat(*[one(p) for p in range(len(books))]) if books else empty)


def digest_of(books: Codebooks) -> str:
    """SHA-256 of all entries' integers by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector that can be coded: vec_id, code, error, label_error, codebooks_sha256.

    With fewer vectors than entries, the codebooks are as short. Repeated rows are each coded; null ids come last in the order of
    ids; components beyond 2^20 count as 2^20; an empty table gives no rows; other columns are not read.
    """
    with scratch() as made:
        rows = integers(vectors, key, vector, label)
        found = distinct_parts(rows)
        books = fit(found, first_codebooks(rows))
        out = with_label_errors(encoded(rows, found, books))
        del made[-2:]
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def oracle() -> str:
    """By all vectors' parts against all entries, with no parts taken together."""
    rounds, last = [], "books0"
    for k in range(ROUNDS + 1):
        rounds.append(f"""
    near{k} AS (
        SELECT r, part, code, error FROM (
            SELECT p.r, p.part, b.code, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS error,
                   row_number() OVER (PARTITION BY p.r, p.part ORDER BY list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.code) AS place
            FROM parts p JOIN {last} b USING (part)) WHERE place = 1)""")
        if k < ROUNDS:
            rounds.append(f"""
    sums{k} AS (
        SELECT n.part, n.code, p.k, CAST(floor(sum(p.x)::DOUBLE / count(*)) AS BIGINT) AS x
        FROM near{k} n JOIN (SELECT r, part, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM parts) p USING (r, part) GROUP BY ALL),
    books{k + 1} AS (
        SELECT b.part, b.code, coalesce(s.v, b.v) AS v FROM {last} b
        LEFT JOIN (SELECT part, code, list(x ORDER BY k) AS v FROM sums{k} GROUP BY ALL) s USING (part, code))""")
            last = f"books{k + 1}"
    body = ",".join(rounds)
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, ints) AS r FROM (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE}::DOUBLE * x::DOUBLE) AS BIGINT)) AS ints FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    parts AS MATERIALIZED (
        SELECT r, part, ints[CAST(part * len(ints) / {PARTS} + 1 AS BIGINT):CAST((part + 1) * len(ints) / {PARTS} AS BIGINT)] AS v FROM kept, range({PARTS}) t(part)),
    books0 AS (SELECT part, r - 1 AS code, v FROM parts WHERE r <= {ENTRIES}),{body},
    coded AS (
        SELECT r, string_agg(lpad(lower(to_hex(code)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
    books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, code)) AS h FROM {last})
    SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
    FROM coded c JOIN kept k USING (r), books"""
