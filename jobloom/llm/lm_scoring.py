"""Language-model scores by deleted interpolation (operator 1).

A bigram model: P(b | a) mixes the maximum-likelihood estimates of the bigram and the word with a uniform one. The
weights depend on how often the context was seen (buckets by its binary logarithm) and are learned by expectation
maximisation on held-out counts: one fold of the training documents, scored with counts of the other folds. A context is
the previous word itself; a document's first word has its end as context, so that a word is as often a context as it
stands in the texts. Everything about one word is gathered in one shard, which asks the shards of its contexts for their
counts; so neither the vocabulary nor the bigrams nor the contexts are ever held whole anywhere. After a first look at the words
all is one query, whose steps share one shuffle of the occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER, as_bytes, cut, drop, small_batches, text_column

FOLDS, TEST_FOLD, EM_FOLD = 5, 1, 2
BUCKETS, BINS = 24, 64
#: Tokens of a shard, about; and the fewest shards.
SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 12
ROUNDS, FLOOR = 200, 1e-7
#: Among so many keys the rows that are no occurrences are dealt out.
SIDES = 1 << 12
#: One over the share of all tokens from which on a word is dealt out over the shards.
FREQUENT = 20_000
#: Words that a worker's cache of hashes holds before it is emptied.
CACHE = 150_000
#: Bytes of text that are dealt out together.
BATCH_BYTES = 6 << 20
END = np.uint64(0x9E3779B97F4A7C15)
#: Parts of a document's fold that the counts tell apart.
KEPT, HELD, TEST = 0, 1, 2


class Hashes(dict):
    """Word to 64-bit hash, made when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an array, like bytes next to each other."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(x: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_names(names: np.ndarray, often: np.ndarray) -> bytes:
    """Sorted hashes: the frequent words among them as steps between their places, the others in full."""
    known = np.isin(names, often)
    places = pack(np.diff(np.searchsorted(often, names[known]), prepend=0).astype(np.uint32))
    return len(places).to_bytes(4, "little") + places + pack(names[~known])


def unpack_names(x: bytes, often: np.ndarray) -> np.ndarray:
    end = 4 + int.from_bytes(x[:4], "little")
    return np.sort(np.concatenate([often[np.cumsum(unpack(x[4:end], np.uint32))], unpack(x[end:], np.uint64)]))


def tokens(texts: list[bytes], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of the context of each, and each text's number of tokens (its end included)."""
    words, sizes = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = t.translate(LOWER).split()
        sizes[i] = len(found) + 1
        words.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
        words.append(np.array([END]))
    b = np.concatenate(words) if words else np.empty(0, np.uint64)
    return b, np.concatenate([[END], b[:-1]]) if len(b) else b, sizes


def stretches(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys; only keys that occur, however many there could be."""
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist() if len(keys) else []
    return list(zip(edges, edges[1:], strict=False))


def survey(docs: DataFrame, frequent: int = FREQUENT) -> tuple[int, int, int, np.ndarray]:
    """The number of tokens of the kept folds, of all training folds and of all, and the frequent words.

    A batch names the words that make up 1/frequent of it, and those that it named for 1/frequent of all tokens are
    frequent: at most so many, and every word that makes up 2/frequent of all tokens is one. They only
    decide how the work is dealt out: what is left in one piece is below that share.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums, often = Hashes(), [0, 0, 0], {}
        for batch in small_batches(batches, most=BATCH_BYTES):
            b, _, sizes = tokens(as_bytes(batch.column(2)), hashes)
            part = batch.column(1).to_numpy(zero_copy_only=False)
            for k, chosen in enumerate((part == KEPT, part != TEST, part >= 0)):
                sums[k] += int(sizes[chosen].sum())
            least = max(1, len(b) // frequent)
            low = (b & np.uint64(0xFFFF)).astype(np.int64)
            words, n = np.unique(b[np.bincount(low, minlength=1 << 16)[low] >= least], return_counts=True)
            for w, c in zip(words[n >= least].tolist(), n[n >= least].tolist(), strict=True):
                often[w] = often.get(w, 0) + c
        rows = [("total", k, n) for k, n in enumerate(sums)] + [("word", w - (1 << 64) if w >> 63 else w, c) for w, c in often.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "id", "n"])

    found = cut(docs.mapInArrow(each, "kind string, id long, n long"), "survey")
    plain = found.groupBy("kind", "id").agg(F.sum("n").alias("n"))
    sums = {r["id"]: r["n"] for r in plain.where("kind = 'total'").collect()}
    kept, trained, total = (sums.get(k, 0) for k in range(3))
    often = plain.where("kind = 'word'").where(F.col("n") >= total // frequent).select("id").toPandas()["id"].to_numpy(np.int64)
    drop(found)
    return kept, trained, total, np.sort(often.view(np.uint64))


def shards_for(total: int) -> int:
    return max(LEAST_SHARDS, -(-total // SHARD_TOKENS))


COLUMNS = "shard int, batch long, words binary, counts binary, contexts binary, codes binary, docs binary"


def deal(docs: DataFrame, shards: int, often: np.ndarray) -> DataFrame:
    """Compressed occurrences by shard; shards -1 - 2k name the documents, shards -2 - 2k count the frequent words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, number = Hashes(), TaskContext.get().partitionId() << 20
        for batch in small_batches(batches, most=BATCH_BYTES):
            rows = []
            b, context, sizes = tokens(as_bytes(batch.column(2)), hashes)
            part = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            doc = np.repeat(np.arange(len(sizes), dtype=np.uint32) * np.uint32(4) + part, sizes)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append((-1 - 2 * (number % SIDES), number, pack(ids), pack(known.astype(np.uint8)), b"", b"", pack(part)))
            words, code = np.unique(b, return_inverse=True)
            frequent = np.isin(words, often)
            shard = (mix(words) % np.uint64(shards))[code]
            salted = frequent[code]
            shard[salted] = mix(words[code[salted]] ^ mix(context[salted])) % np.uint64(shards)
            if frequent.any():
                at = np.flatnonzero(frequent)
                n = [np.bincount(code[salted & (np.repeat(part, sizes) != x)], minlength=len(words))[at].astype(np.int64) for x in (TEST,)]
                k = np.bincount(code[salted & (np.repeat(part, sizes) == KEPT)], minlength=len(words))[at].astype(np.int64)
                rows.append((-2 - 2 * (number % SIDES), number, pack(words[at]), pack(k), pack(n[0]), b"", b""))
            order = np.argsort(shard << np.uint64(32) | code.astype(np.uint64))
            shard, code, context, doc = shard[order], code[order], context[order], doc[order]
            for x, y in stretches(shard):
                new = np.flatnonzero(np.concatenate([[True], code[x + 1 : y] != code[x : y - 1]]))
                runs = np.diff(np.concatenate([new, [y - x]])).astype(np.uint32)
                contexts, at = np.unique(context[x:y], return_inverse=True)
                rows.append((int(shard[x]), number, pack_names(words[code[x:y][new]], often), pack(runs), pack_names(contexts, often), pack(at.astype(np.uint32)), pack(doc[x:y])))
            number += 1
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])

    return docs.mapInArrow(each, COLUMNS).repartition(shards, "shard").sortWithinPartitions("shard")


class Shard:
    """All occurrences of a shard's words, with what was counted of them; in the order of the blobs they came in."""

    def __init__(self, rows: list[dict], often: np.ndarray, paired: bool = True):
        self.batches = [r["batch"] for r in rows]
        words, inverse = np.unique(np.concatenate([unpack_names(r["words"], often) for r in rows]), return_inverse=True)
        self.words = words
        self.code = np.repeat(inverse.astype(np.int32), np.concatenate([unpack(r["counts"], np.uint32) for r in rows]))
        named = [unpack_names(r["contexts"], often) for r in rows]
        self.contexts, inverse = np.unique(np.concatenate(named), return_inverse=True)
        inverse, at, context = inverse.astype(np.int32), 0, []
        for r, x in zip(rows, named, strict=True):
            context.append(inverse[at : at + len(x)][unpack(r["codes"], np.uint32)])
            at += len(x)
        self.ends = np.cumsum([len(x) for x in context])
        self.context = np.concatenate(context)
        del named, inverse, context
        doc = np.concatenate([unpack(r["docs"], np.uint32) for r in rows])
        self.part, self.doc = (doc & np.uint32(3)).astype(np.uint8), doc >> np.uint32(2)
        if not paired:
            return
        pair = (self.code.astype(np.uint64) << np.uint64(32)) | self.context.astype(np.uint64)
        order = np.argsort(pair).astype(np.int32)
        pair = pair[order]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        del pair
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new, dtype=np.int32) - 1
        self.pairs = int(new.sum())

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Among the chosen occurrences: of each word, and of each pair."""
        return np.bincount(self.code[chosen], minlength=len(self.words)), np.bincount(self.pair[chosen], minlength=self.pairs)

    def by_home(self, shards: int, often: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The contexts whose counts are asked for, those that are not frequent, as places in `contexts` by their shard."""
        at = np.flatnonzero(~np.isin(self.contexts, often))
        home = (mix(self.contexts[at]) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        return [(int(home[order[x]]), at[order[x:y]]) for x, y in stretches(home[order])]


def names_and_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that are no occurrences."""
    return batch.filter(pc.less(batch.column(0), 0))


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows of the same key."""
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and rows[0][key] != r[key]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def looked_up(names: np.ndarray, values: np.ndarray, asked: np.ndarray, other: np.ndarray | int = 0) -> np.ndarray:
    """The value of each asked name in the sorted names, and `other` for those that are not there."""
    if not len(names):
        return np.zeros(len(asked), np.int64) + other
    at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return np.where(names[at] == asked, values[at], other)


ANSWERS = "shard int, home int, kept binary, trained binary"


def context_counts(dealt: DataFrame, shards: int, frequent) -> DataFrame:
    """For each shard and shard of contexts: the contexts' counts, in the order in which by_home() names them. Frequent contexts are not asked for."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for group in by_key(batches, "shard"):
            if group[0]["shard"] < 0:
                continue
            shard = Shard(group, often, paired=False)
            own = ~np.isin(shard.words, often)
            kept, trained = (np.bincount(shard.code[shard.part == KEPT], minlength=len(own)), np.bincount(shard.code[shard.part != TEST], minlength=len(own)))
            rows = [(group[0]["shard"], -1, pack(shard.words[own]), pack(kept[own]), pack(trained[own]))] if own.any() else []
            rows += [(k, group[0]["shard"], pack(shard.contexts[at]), None, None) for k, at in shard.by_home(shards, often)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["home", "shard", "words", "kept", "trained"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = kept = trained = np.empty(0, np.int64)
        home = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["home"] != home:
                    home, names, kept, trained = r["home"], np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
                words = unpack(r["words"], np.uint64)
                if r["shard"] < 0:
                    names, kept, trained = words, unpack(r["kept"], np.int64), unpack(r["trained"], np.int64)
                else:
                    rows.append((r["shard"], home, pack(looked_up(names, kept, words)), pack(looked_up(names, trained, words))))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "home", "kept", "trained"]
            )

    questions = dealt.mapInArrow(asked, "home int, shard int, words binary, kept binary, trained binary")
    return questions.repartition(shards, "home").sortWithinPartitions("home", "shard").mapInArrow(answered, ANSWERS)


def frequent_counts(dealt: DataFrame, frequent) -> DataFrame:
    """One row: the counts of all frequent words, packed in their order."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(names_and_counts, batches):
            for r in batch.to_pylist():
                if r["shard"] % 2 == 0:
                    columns = unpack(r["words"], np.uint64).view(np.int64), unpack(r["counts"], np.int64), unpack(r["contexts"], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "kept", "trained"])

    def together(found: pa.Table) -> pa.Table:
        names = found["word"].to_numpy().view(np.uint64)
        order = np.argsort(names)
        packed = [pack(looked_up(names[order], found[c].to_numpy()[order], frequent.value)) for c in ("kept", "trained")]
        return pa.table({"f": pa.array([{"kept": packed[0], "trained": packed[1]}], pa.struct([("kept", pa.binary()), ("trained", pa.binary())]))})

    sums = dealt.mapInArrow(named, "word long, kept long, trained long").groupBy("word").agg(F.sum("kept").alias("kept"), F.sum("trained").alias("trained"))
    none = dealt.sparkSession.createDataFrame([(0, 0, 0)], "word long, kept long, trained long")
    return sums.unionByName(none).groupBy(F.lit("all")).applyInArrow(together, "f struct<kept:binary,trained:binary>")


def level(x: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Bin of a probability: 0 for zero, else by its logarithm, five bins a decade."""
    return np.where(x > 0, np.clip(BINS + np.floor(5 * np.log10(np.maximum(x, least))), 1, BINS - 1), 0).astype(np.int64)


def bucket(n: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen contexts."""
    return np.where(n > 0, np.minimum(np.floor(np.log2(np.maximum(n, 1))) + 1, BUCKETS - 1), 0).astype(np.int64)


def learn(cells: np.ndarray, vocabulary: int) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket from rows (bucket, n, bigram estimate, word estimate).

    A bucket with fewer than 100 held-out tokens takes the weights of all buckets together.
    """

    def fit(n: np.ndarray, p: np.ndarray, seen: bool) -> np.ndarray:
        weight = np.array([0.3, 0.5, 0.2]) if seen else np.array([0.0, 0.7, 0.3])
        for _ in range(ROUNDS if n.sum() else 0):
            share = weight * p
            share *= (n / share.sum(axis=1))[:, None]
            weight = share.sum(axis=0) / n.sum()
        weight = np.maximum(weight, [FLOOR if seen else 0.0, FLOOR, FLOOR])
        return weight / weight.sum()

    estimates = np.column_stack([cells[:, 2], cells[:, 3], np.full(len(cells), 1 / (vocabulary + 1))]) if len(cells) else np.empty((0, 3))
    n = cells[:, 1] if len(cells) else np.empty(0)
    which = cells[:, 0].astype(int) if len(cells) else np.empty(0, int)
    pooled = {s: fit(n[(which > 0) == s], estimates[(which > 0) == s], s) for s in (False, True)}
    return np.array([fit(n[which == k], estimates[which == k], k > 0) if n[which == k].sum() >= 100 else pooled[k > 0] for k in range(BUCKETS)])


class Answers:
    """What a shard is told: the frequent words' counts, those of its contexts by their shards, and (when scoring) the model."""

    def __init__(self, found: pa.Table, often: np.ndarray):
        self.often, self.told, self.counts, self.model = often, {}, {}, None
        for r in found.to_pylist():
            if r["home"] < 0:
                self.counts = {c: unpack(r[c], np.int64) for c in ("kept", "trained")}
                self.model = r.get("model")
            else:
                self.told[r["home"]] = r

    def words(self, shard: Shard, n: np.ndarray, which: str) -> np.ndarray:
        """A shard's word counts, those of frequent words taken from all shards."""
        return looked_up(self.often, self.counts[which], shard.words, n)

    def contexts(self, shard: Shard, shards: int, which: str) -> np.ndarray:
        n = looked_up(self.often, self.counts[which], shard.contexts)
        for k, at in shard.by_home(shards, self.often):
            n[at] = unpack(self.told[k][which], np.int64)
        return n


MODEL = "struct<weights:array<double>,vocabulary:long>"


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has the end token only; a null id is a training document and is carried along; repeated rows
    count and are scored each; an empty table gives no rows; ids must be integers.
    """
    spark = docs.sparkSession
    fold = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS, F.lit(0))
    part = F.when(fold == TEST_FOLD, TEST).when(fold == EM_FOLD, HELD).otherwise(KEPT).cast("int")
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), part.alias("part"), text_column(text).alias("text"))
    n_kept, n_trained, total, often = survey(chosen, frequent)
    shards = shards_for(total)
    # All uses of `dealt` take it whole, without a filter or projection of their own, so that the query has its shuffle once.
    dealt = deal(chosen, shards, often)
    frequent = spark.sparkContext.broadcast(often)
    answers = context_counts(dealt, shards, frequent)
    counted = frequent_counts(dealt, frequent).scalar()
    each_shard = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(-1).alias("home"), counted.alias("f"))
    each_shard = each_shard.select("shard", "home", "f.kept", "f.trained")

    def held(occurrences: pa.Table, found: pa.Table) -> pa.Table:
        kinds = pa.schema({"cell": pa.int64(), "n": pa.int64(), "two": pa.float64(), "one": pa.float64()})
        told = Answers(found, frequent.value) if len(found) else None
        new = int((told.counts["trained"] > 0).sum()) if told and found["shard"][0].as_py() == 0 else 0
        if told is None or not len(occurrences):
            return pa.Table.from_pydict({"cell": [-1], "n": [new], "two": [0.0], "one": [0.0]}, kinds)
        shard = Shard(occurrences.to_pylist(), frequent.value)
        words, pairs = shard.counts(shard.part == KEPT)
        words = told.words(shard, words, "kept")
        here = np.flatnonzero(shard.part == HELD)
        seen = told.contexts(shard, shards, "kept")[shard.context[here]]
        two = pairs[shard.pair[here]] / np.maximum(seen, 1)
        one = words[shard.code[here]] / max(n_kept, 1)
        cell = (bucket(seen) * BINS + level(two)) * BINS + level(one)
        cells, code = np.unique(cell, return_inverse=True)
        trained_words = shard.counts(shard.part != TEST)[0]
        new += int(((trained_words > 0) & ~np.isin(shard.words, frequent.value)).sum())
        sums = [np.bincount(code, x, minlength=len(cells)) for x in (None, two, one)]
        columns = [np.append(cells, -1), np.append(sums[0], new).astype(np.int64), np.append(sums[1], 0.0), np.append(sums[2], 0.0)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=kinds)

    def learned(found: pa.Table) -> pa.Table:
        """The weights and the number of distinct training words from the sums of all cells, of which there is a fixed number."""
        cell, n, two, one = (found[c].to_numpy() for c in ("cell", "n", "two", "one"))
        vocabulary, real = int(n[cell < 0].sum()), cell >= 0
        cells = np.column_stack([cell[real] // (BINS * BINS), n[real], two[real] / n[real], one[real] / n[real]]).astype(float)
        kind = pa.struct([("weights", pa.list_(pa.float64())), ("vocabulary", pa.int64())])
        return pa.table({"model": pa.array([{"weights": learn(cells, vocabulary).ravel().tolist(), "vocabulary": vocabulary}], kind)})

    asking = dealt.groupBy("shard")
    statistics = asking.cogroup(answers.unionByName(each_shard).groupBy("shard")).applyInArrow(held, "cell long, n long, two double, one double")
    sums = statistics.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one"))
    model = sums.groupBy(F.lit("all")).applyInArrow(learned, f"model {MODEL}").scalar()
    told = answers.withColumn("model", F.lit(None).cast(MODEL)).unionByName(each_shard.withColumn("model", model))

    def scored(occurrences: pa.Table, found: pa.Table) -> pa.Table:
        """A shard's sums for the documents of each batch, packed."""
        kinds = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("docs", "n", "known", "base", "model"))])
        if not len(occurrences) or not len(found):
            return kinds.empty_table()
        answer, shard = Answers(found, frequent.value), Shard(occurrences.to_pylist(), frequent.value)
        weights, vocabulary = np.array(answer.model["weights"]).reshape(BUCKETS, 3), answer.model["vocabulary"]
        floor = np.log10(n_trained + 0.5 * (vocabulary + 1))
        words, pairs = shard.counts(shard.part != TEST)
        words = answer.words(shard, words, "trained")
        often_before = answer.contexts(shard, shards, "trained")
        start, out = 0, []
        for number, end in zip(shard.batches, shard.ends.tolist(), strict=True):
            here, start = slice(start, end), end
            n, seen = words[shard.code[here]], often_before[shard.context[here]]
            weight = weights[bucket(seen)]
            p = weight[:, 0] * pairs[shard.pair[here]] / np.maximum(seen, 1) + weight[:, 1] * n / max(n_trained, 1) + weight[:, 2] / (vocabulary + 1)
            doc = shard.doc[here]
            count = np.bincount(doc)
            rows = np.flatnonzero(count)
            sums = [np.bincount(doc, x)[rows] for x in (n > 0, np.log10(n + 0.5) - floor, np.log10(p))]
            out.append((number, pack(rows.astype(np.uint32)), pack(count[rows].astype(np.int32)), pack(sums[0].astype(np.int32)), pack(sums[1]), pack(sums[2])))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(names_and_counts, batches):
            chosen = batch.filter(pc.equal(pc.bit_wise_and(batch.column(0), 1), 1))
            yield pa.RecordBatch.from_arrays([chosen.column(k) for k in (1, 2, 3, 6)], ["batch", "ids", "known", "parts"])

    def summed(names: pa.Table, sums: pa.Table) -> pa.Table:
        """The documents of a batch, each with the sums of all shards."""
        kinds = pa.schema({"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()})
        if not len(names):
            return kinds.empty_table()
        name = names.to_pylist()[0]
        ids, missing = unpack(name["ids"], np.int64), unpack(name["known"], np.uint8) == 0
        n, known, base, model = (np.zeros(len(ids), t) for t in (np.int64, np.int64, np.float64, np.float64))
        for r in sums.to_pylist():
            at = unpack(r["docs"], np.uint32)
            for to, c, t in ((n, "n", np.int32), (known, "known", np.int32), (base, "base", np.float64), (model, "model", np.float64)):
                to[at] += unpack(r[c], t)
        held = unpack(name["parts"], np.uint32) == TEST
        return pa.Table.from_arrays([pa.array(ids, mask=missing), pa.array(held), *map(pa.array, (n, known, base, model))], schema=kinds)

    sums = asking.cogroup(told.groupBy("shard")).applyInArrow(scored, "batch long, docs binary, n binary, known binary, base binary, model binary")
    names = dealt.mapInArrow(named, "batch long, ids binary, known binary, parts binary")
    found = names.groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    train = F.lit(n_trained).cast("long").alias("train_tokens")
    return cut(found.select("doc_id", "held_out", "n_tokens", "n_known", train, "base_score", "score"), "scores")
