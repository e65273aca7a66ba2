"""Toxicity scores after noisy-channel deobfuscation (operator 10).

Suspicious stretches (letters mixed with look-alike digits and symbols, spelled-out words, letters held down) become
lattices of what they may stand for; Viterbi decoding under a trigram model of letters, counted over the whole corpus, picks
the most likely reading. The text and its readings are then scored by letter n-grams that are typical of toxic documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER, as_bytes, cut, small_batches, text_column, tidied

FOLDS, TEST_FOLD, THRESHOLD = 4, 2, 0.3
#: Labelled documents of a class that the classifier is fitted on, about: the bound of its sample.
SAMPLE = 15_000
#: Letters of a feature, word ends included; the least toxic texts with it; how much likelier it is there; features at most.
GRAMS, LEAST_TEXTS, LEAST_RATIO, FEATURES = (5, 6), 4, 30.0, 20_000
EVIDENCE = 40.0
#: What a look-alike may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
#: Costs, in natural logarithms: of a look-alike, of dropping it, of a letter held down, of reading through a separator or keeping it.
LOOK_COST, DROP_COST, HELD_COST, THROUGH_COST, APART_COST = 0.5, 6.0, 0.7, 0.5, 3.0
#: Steps of a stretch after which what is settled of it is written out; bytes of text taken together; readings that a worker keeps before it forgets them.
PIECE, BATCH_BYTES, CACHE = 512, 4 << 20, 30_000

#: Letters stay, all else is a word's end. Look-alikes and separators are only read within suspicious stretches.
LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
LOOK_ALIKE = re.compile(rb"[0-9@$!|+]")
MIXED = re.compile(rb"(?=[0-9@$!|+]*[a-z\x80-\xff])(?=[a-z\x80-\xff]*[0-9@$!|+])[a-z0-9@$!|+\x80-\xff]+")
TRAILING = re.compile(rb"[@$!|+]+$")
HELD_DOWN = re.compile(rb"([a-z])\1\1")
SPELLED = re.compile(rb"(?<![a-z0-9@$!|+\x80-\xff])(?:[a-z0-9@$!|+][ ._*-]){3,}[a-z0-9@$!|+](?![a-z0-9@$!|+\x80-\xff])")
TOKEN = re.compile(rb"[a-z0-9@$!|+\x80-\xff]+")
#: Classes of the letter model: a word's end, a to z, and any other letter.
CLASS = np.array([c - 0x60 if 0x61 <= c <= 0x7A else 27 if c >= 0x80 else 0 for c in range(256)], np.int32)
SIZE = 28


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over all texts, as SIZE x SIZE x SIZE."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in small_batches(batches, most=BATCH_BYTES):
            for t in as_bytes(batch.column(0)):
                x = CLASS[np.frombuffer(b"  " + t.translate(LETTERS) + b" ", np.uint8)]
                total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3) if len(t) > 1 << 14 else 0
                if len(t) <= 1 << 14:
                    np.add.at(total, (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["gram", "n"])

    sums = docs.select("text").mapInArrow(tidied(each), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3, np.int64)
    out[sums["gram"]] = sums["n"]
    return out.reshape(SIZE, SIZE, SIZE)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b): trigrams backed by bigrams and letters."""
    one = (counts.sum(axis=(0, 1)) + 1.0) / (counts.sum() + SIZE)
    two = (counts.sum(axis=0) + 5 * one) / (counts.sum(axis=(0, 2))[:, None] + 5)
    return np.log((counts + 5 * two[None]) / (counts.sum(axis=2)[:, :, None] + 5))


def lattice(token: bytes) -> list[list[tuple[str, float]]]:
    """For each step, the readings (text, cost) of one run of equal characters."""
    steps = []
    for run in re.finditer(r"(.)\1*", token.decode("latin-1"), re.DOTALL):
        c, n = run[1], len(run[0])
        if "a" <= c <= "z":
            steps.append([(c, 0.0)] if n == 1 else [(c, HELD_COST), (c + c, 0.0 if n == 2 else HELD_COST)])
        elif c in LOOKS:
            read = [(x, LOOK_COST) for x in LOOKS[c]] + [("", DROP_COST)]
            steps.append(read + [(x + x, LOOK_COST * 2) for x in LOOKS[c]] if n > 1 else read)
        elif ord(c) >= 0x80:
            steps.append([(c * n, 0.0)])
        else:
            steps.append([("", THROUGH_COST), (" ", APART_COST)])
    return steps


def decode(token: bytes, model: np.ndarray) -> str:
    """The most likely reading of a stretch, by Viterbi over its lattice; states are the last two letters.

    Ways are chains of [way before, text], of which states share the older part. From time to time, what all of them share is
    written out and cut off: no later step can change it, so the reading is the best one of the whole stretch however long it is.
    """
    states, out, look = {(0, 0): (0.0, [None, ""])}, [], PIECE
    for k, step in enumerate(lattice(token), 1):
        new: dict[tuple[int, int], tuple[float, list]] = {}
        for (a, b), (p, way) in states.items():
            for text, cost in step:
                x, y, q = a, b, p - cost
                for c in text:
                    z = int(CLASS[ord(c)])
                    q += model[x][y][z]
                    x, y = y, z
                if (x, y) not in new or q > new[x, y][0]:
                    new[x, y] = (q, [way, text])
        states = new
        if k >= look:
            found = settled([way for _, way in states.values()])
            out.append(found)
            # Looking back costs as much as what is not settled is long, so the next look is as far away.
            look = k + max(PIECE, 0 if found else k)
    _, way = max(((p + model[a][b][0], way) for (a, b), (p, way) in states.items()), key=lambda s: s[0])
    return "".join([*out, spelled(way)])


def spelled(way: list | None) -> str:
    out = []
    while way:
        way, text = way
        out.append(text)
    return "".join(reversed(out))


def settled(ways: list[list]) -> str:
    """The text that all ways begin with, which is cut off them."""
    places, way = {}, ways[0]
    while way:
        places[id(way)] = (len(places), way)
        way = way[0]
    depth, shared = 0, ways[0]
    for way in ways[1:]:
        while way and id(way) not in places:
            way = way[0]
        if not way:
            return ""
        if places[id(way)][0] > depth:
            depth, shared = places[id(way)]
    text = spelled(shared)
    shared[:] = [None, ""]
    return text


def suspicious(text: bytes) -> list[bytes]:
    """Stretches of a lower-cased text that may hide a word: letters mixed with look-alikes, letters held down, words spelled out.

    Symbols at a stretch's end may as well be punctuation, so without them it is a stretch of its own.
    """
    found = []
    for pattern in (LOOK_ALIKE, HELD_DOWN):
        end = 0
        for m in pattern.finditer(text):
            if (start := m.start()) < end:
                continue
            while start and TOKEN.match(text, start - 1, start):
                start -= 1
            end = TOKEN.match(text, start).end()
            token = text[start:end]
            if pattern is LOOK_ALIKE and not MIXED.fullmatch(token):
                continue
            found.append(token)
            bare = TRAILING.sub(b"", token)
            if bare != token and (MIXED.fullmatch(bare) or HELD_DOWN.search(bare)):
                found.append(bare)
    found += [m[0] for m in SPELLED.finditer(text)]
    return found


class Restorer:
    """Texts as letters only, with the readings of their suspicious stretches added behind."""

    def __init__(self, model: np.ndarray):
        self.model, self.cache = model.tolist(), {}

    def __call__(self, text: bytes) -> str:
        lower = text.translate(LOWER)
        readings = []
        for token in suspicious(lower):
            if token not in self.cache:
                if len(self.cache) > CACHE:
                    self.cache.clear()
                self.cache[token] = decode(token, self.model)
            readings.append(self.cache[token])
        return f" {b' '.join(text.translate(LETTERS).split()).decode('latin-1')} {' '.join(readings)} "


def features(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(text.split()):
        ended = f" {word} "
        for n in GRAMS:
            out.update(ended[k : k + n] for k in range(len(ended) - n + 1))
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct labelled training texts (text, toxic, weight), about SAMPLE of a class; weight: documents each stands for.

    A document, or a text, labelled both ways is toxic.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(fold != TEST_FOLD).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {k: min(1.0, SAMPLE / n) for k, n in sizes.items()}
    of = lambda k: share.get(k, 0.0)
    pick = lambda f: F.when(F.col("toxic") == 1, F.lit(f(1))).otherwise(F.lit(f(0)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < pick(of) * (1 << 20))
    chosen = chosen.withColumn("weight", pick(lambda k: 1 / share.get(k, 1.0)))
    met = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight", F.xxhash64("text").alias("h"))
    # Of texts alike, one counts, and is toxic if any of them is.
    one = met.groupBy("h").agg(F.max(F.struct("toxic", "weight", "text")).alias("m"))
    return cut(one.select("m.text", "m.toxic", "m.weight"), "labelled")


def learn(labelled: DataFrame, restore_model: np.ndarray) -> dict[str, float]:
    """Log-likelihood ratios of the features that are typical of toxic texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, seen = Restorer(restore_model), (Counter(), Counter())
        for batch in small_batches(batches, most=BATCH_BYTES):
            for t, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(features(restore(t)))
        names = list(seen[1] | seen[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([seen[0][x] for x in names], pa.int64()), pa.array([seen[1][x] for x in names], pa.int64())], ["f", "clean", "toxic"]
        )

    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {}
    found = labelled.mapInArrow(tidied(each), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = (F.col("toxic") / sizes[1]) / ((F.col("clean") + 0.5) / sizes[0])
    best = found.where(F.col("toxic") >= LEAST_TEXTS).select("f", F.log(ratio).alias("w")).where(F.col("w") >= math.log(LEAST_RATIO))
    return {r["f"]: r["w"] for r in best.orderBy(F.desc("w"), "f").limit(FEATURES).collect()}


def matcher(weights: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for f, w in weights.items():
        found.add_word(f, (f, w))
    found.make_automaton()
    return found


def evidence(text: str, found: ahocorasick.Automaton) -> float:
    """Sum of the weights of the distinct features in a text, no more than EVIDENCE."""
    return min(EVIDENCE, sum(w for _, w in {x for _, x in found.iter(text)})) if len(found) else 0.0


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of y on log1p(x), with a little shrinkage."""
    z = np.column_stack([np.log1p(x), np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        curve = z.T @ (z * (weight * p * (1 - p))[:, None]) + np.diag([1.0, 1e-3])
        step = np.linalg.solve(curve, z.T @ (weight * (y - p)) - np.array([1.0, 1e-3]) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Model:
    """What the workers need: the letter model, the features' weights and the calibration; all of bounded size."""

    def __init__(self, letters: np.ndarray, weights: dict[str, float], slope: float, intercept: float):
        self.letters, self.weights, self.slope, self.intercept = letters, weights, slope, intercept

    def scorer(self):
        restore, found = Restorer(self.letters), matcher(self.weights)

        def score(text: bytes) -> float:
            z = self.slope * math.log1p(evidence(restore(text), found)) + self.intercept
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: (doc_id, text). Without labels of both classes every score is the share of toxic ones, or 0 without any."""
    letters = letter_model(letter_counts(docs))
    labelled = sample(docs, labels)
    weights = learn(labelled, letters)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, found = Restorer(letters), matcher(weights)
        for batch in small_batches(batches, most=BATCH_BYTES):
            x = [evidence(restore(t), found) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1), batch.column(2)], ["x", "toxic", "weight"])

    seen = labelled.mapInArrow(tidied(each), "x double, toxic int, weight double").toPandas()
    if not len(seen) or not seen["toxic"].any():
        return Model(letters, {}, 0.0, -30.0)
    slope, intercept = calibrate(seen["x"].to_numpy(), seen["toxic"].to_numpy(float), seen["weight"].to_numpy())
    return Model(letters, weights, slope, intercept)


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with held_out, score and predicted (replaced if they exist).

    Null and empty texts have no evidence and get the score of that; null ids are no held-out documents; repeated rows are each
    scored; an empty table gives no rows. Labels of the held-out fold are never read.
    """
    plain = docs.select(F.col(key).alias("doc_id"), text_column(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(plain, labels))

    def each(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.value.scorer()
        for texts in arrays:  # a few texts at a time become bytes
            found = [of(t) for i in range(0, len(texts), 500) for t in as_bytes(texts.slice(i, 500))]
            yield pa.array(found, pa.float64())

    @F.arrow_udf("double")
    def score(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(each)(arrays)

    held = F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == TEST_FOLD, F.lit(False))
    out = docs.withColumns({"held_out": held, "score": score(F.col(text))})
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
