"""Near duplicates by 64-bit similarity fingerprints (operator 3).

Fingerprints are embedded as the bit counts of 32 two-bit segments. The Manhattan distance of two embeddings is never
above the Hamming distance of the fingerprints, and is read off as the Hamming distance of unary codes. The segments form six
blocks; within a distance of four at least two blocks agree, so the grid cells of the fifteen pairs of blocks meet
every link. Pairs within a cell are verified, and each cell returns only a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER, as_bytes, components, cut, small_batches, text_column, tidied

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Segments (of two bits each) of the blocks; one block more than DISTANCE must agree besides the first.
BLOCKS = (6, 6, 5, 5, 5, 5)
#: Fingerprints of a cell that one task compares with as many others; larger cells are dealt out as pairs of parts.
PART = 4096
SMALL = 256
EVEN = 0x5555555555555555


def block_masks() -> list[int]:
    masks, at = [], 0
    for n in BLOCKS:
        masks.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


CELL_MASKS = [signed(a | b) for a, b in combinations(block_masks(), len(BLOCKS) - DISTANCE)]


def fingerprint(text: bytes) -> int:
    """The fingerprint of a whole text; zero if it has no words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter((b" ".join(words),)), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)), len(words) - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for start in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8), bitorder="little")
        total += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k, fp) for each row of docs, k being the text's hash; null texts have no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "k", "fp"])

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("k", F.xxhash64(text_column("text")))
    return chosen.mapInArrow(tidied(each), f"doc_id {docs.schema[key].dataType.simpleString()}, k long, fp long")


def unary(fp):
    """The embedding as one number: each two-bit segment's count written as 00, 01 or 11."""
    even, odd = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def within(fp: np.ndarray, code: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs are links: the Manhattan bound first, then the exact distance of what it leaves."""
    near = np.flatnonzero(np.bitwise_count(code[i] ^ code[j]) <= DISTANCE)
    return near[np.bitwise_count(fp[i[near]] ^ fp[j[near]]) <= DISTANCE]


def forest(fp: np.ndarray, code: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a large cell's links: breadth first, each fingerprint against those not yet reached."""
    left, out = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(code[left] ^ code[at]) <= DISTANCE
            hit[hit] = np.bitwise_count(fp[left[hit]] ^ fp[at]) <= DISTANCE
            reached = left[hit]
            out += [(at, x) for x in reached]
            queue += list(reached)
            left = left[~hit]
    return out


def pruned(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join two parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for a, b in pairs:
        if (x := root(a)) != (y := root(b)):
            parent[x] = y
            out.append((a, b))
    return out


def cell_links(fp: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forests of the cells [bounds[k], bounds[k+1]), as positions."""
    sizes = np.diff(bounds)
    ends = np.repeat(bounds[1:], sizes)
    small = np.flatnonzero(np.repeat(sizes, sizes) <= SMALL)
    found: list[tuple[int, int]] = []
    step = 1
    while len(small := small[small + step < ends[small]]):
        hit = within(fp, code, small, small + step)
        found += zip(small[hit].tolist(), (small[hit] + step).tolist(), strict=True)
        step += 1
    found = pruned(found)
    for k in np.flatnonzero(sizes > SMALL):
        a, b = int(bounds[k]), int(bounds[k + 1])
        found += [(a + int(x), a + int(y)) for x, y in forest(fp[a:b], code[a:b])]
    return found


def links(prints: DataFrame) -> DataFrame:
    """(a, b) edges among the distinct values of prints.fp that join all fingerprints within DISTANCE of each other."""
    cells = prints.select("fp", unary(F.col("fp")).alias("code")).select(
        "fp", "code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in CELL_MASKS])).alias("grid", "cell")
    )
    large = cut(cells.groupBy("grid", "cell").count().where(F.col("count") > PART), "cells")
    if large.limit(1).count():
        # A large cell is cut into parts by hash; every pair of parts meets in one group of at most two parts.
        parts = F.ceil(F.col("count") / (PART // 2)).cast("int")
        dealt = cells.join(large, ["grid", "cell"], "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
        cells = dealt.select("fp", "code", "grid", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        cells = cells.select("fp", "code", "grid", "cell", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    else:
        cells = cells.withColumns({"x": F.lit(0), "y": F.lit(0)})
    keys = ["grid", "cell", "x", "y"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(columns: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
            """Links of the complete cells; the last cell is held back, as its rows may go on in the next batch."""
            fp, code, *key = columns
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            bounds = np.concatenate([[0], new, [len(fp)]])
            if not last:
                bounds = bounds[:-1]
            done = int(bounds[-1])
            found = cell_links(fp[:done], code[:done], bounds) if len(bounds) > 1 else []
            i = np.array(found, np.int64).reshape(-1, 2)
            out = pa.RecordBatch.from_arrays([pa.array(fp[i[:, 0]].view(np.int64)), pa.array(fp[i[:, 1]].view(np.int64))], ["a", "b"])
            return [c[done:] for c in columns], out

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            now[:2] = [c.view(np.uint64) for c in now[:2]]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            held, out = flush(held, False)
            if out.num_rows:
                yield out
        if held and len(held[0]):
            _, out = flush(held, True)
            if out.num_rows:
                yield out

    ordered = cells.select("fp", "code", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(tidied(each), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k, fp, root, component_id) for each row of docs: the smallest doc_id linked with it, directly or through others.

    k is the text's hash, root the smallest fingerprint of the group, which names it where ids are missing or repeated.

    Equal texts share a fingerprint and are linked through it, so copies are never expanded into pairs. Null and empty
    texts have fingerprint zero and are linked like any other; repeated rows stay; a null doc_id gets its group's
    smallest id (null if it has none); an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, key, text), "prints")
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "first")
    roots = cut(components(links(first.select("fp"))), "roots")
    grouped = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "root").join(least, "root")
    return prints.join(named, "fp").select("doc_id", "k", "fp", "root", "component_id")
