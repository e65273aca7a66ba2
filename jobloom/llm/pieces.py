"""SentencePiece encoding and decoding (operator 5): unigram Viterbi over a double-array trie of pieces.

The pieces come from a public vocabulary file, which is read on the driver and sent to the workers; its size is fixed. That file's
model is a merge list, whose scores are ranks; the unigram scores are derived from them by Zipf's law. A space is written
as the marker that pieces have for it; a marker in the text itself is spelled in bytes, so that decoding always gives the
text back.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import as_bytes, give_back, tidied

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: How much worse than the worst piece a character is that has none.
UNKNOWN_PENALTY = 10.0
#: A stretch that no piece can leave: white space, and what follows it.
STRETCH = re.compile(rb" *[^ ]+| +")
#: Stretches in a worker's cache before it is emptied; the longest that it takes; bytes of text that are cut up together.
CACHE, SHORT, TOGETHER = 100_000, 48, 2 << 20
#: Bytes of a character, by its first.
CHARACTER = np.array([1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4 for c in range(256)])


@lru_cache(4)
def read(path: str = VOCABULARY) -> tuple[list[bytes], list[float], list[int]]:
    """Each id's bytes (markers as spaces; empty for control pieces), log score (none for bytes and control), and the 256 byte ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    raw, scores, of_byte = [b""] * n, [-math.inf] * n, [-1] * 256
    ranked = []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:5], 16)] = i
            raw[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            raw[i] = piece.replace(MARKER, " ").encode()
            ranked.append((-model.get_score(i), i))
    if min(of_byte) < 0:
        raise ValueError("the vocabulary has no piece for some byte")
    if any(re.search(rb"[^ ] ", x) for x in raw):
        raise ValueError("a piece has a space after another character")
    total = math.log(sum(1 / (rank + 2) for rank in range(len(ranked))))
    for rank, (_, i) in enumerate(sorted(ranked)):
        scores[i] = -math.log(rank + 2) - total
    return raw, scores, of_byte


class Trie:
    """A double-array trie over bytes: from state s, byte c leads to base[s] + c + 1 where check names s; value is a piece's id or -1."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        entries = sorted(entries)
        size = 1 << 18
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free, top, work = 257, 257, [(0, 0, len(entries), 0)]  # below, no child could stand at the first free slot
        while work:
            state, lo, hi, depth = work.pop()
            if lo < hi and len(entries[lo][0]) == depth:
                self.value[state] = entries[lo][1]
                lo += 1
            if lo == hi:
                continue
            groups, at = [], lo
            while at < hi:
                c, start = entries[at][0][depth], at
                while at < hi and entries[at][0][depth] == c:
                    at += 1
                groups.append((c, start, at))
            # An only child takes the first free slot; several take a near place of the first few tried, or new slots at the top.
            while self.check[free] >= 0:
                free += 1
            base = free - groups[0][0] - 1
            tries = 1024 if len(groups) == 1 else 32
            while tries and any(self.check[base + c + 1] >= 0 for c, _, _ in groups):
                base, tries = base + 1, tries - 1
            if not tries:
                base = top - groups[0][0]
            top = max(top, base + groups[-1][0] + 1)
            if top + 600 > len(self.check):
                for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                    x.extend([fill] * len(x))
            self.base[state] = base
            for c, _, _ in groups:
                self.check[base + c + 1] = state
            work += [(base + c + 1, x, y, depth + 1) for c, x, y in groups]

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, id) of each piece that begins at start."""
        base, check, value, state = self.base, self.check, self.value, 0
        for at in range(start, len(text)):
            to = base[state] + text[at] + 1
            if check[to] != state:
                return
            state = to
            if value[state] >= 0:
                yield at + 1, value[state]


class Codec:
    """Encodes and decodes; made from what read() gives."""

    def __init__(self, raw: list[bytes], scores: list[float], of_byte: list[int]):
        self.raw, self.scores, self.of_byte = raw, scores, of_byte
        self.trie = Trie([(x, i) for i, x in enumerate(raw) if scores[i] > -math.inf])
        self.longest = max(len(x) for x, s in zip(raw, scores, strict=True) if s > -math.inf)
        self.unknown = min(s for s in scores if s > -math.inf) - UNKNOWN_PENALTY
        self.cache: dict[bytes, bytes] = {}
        self.arrays = (*(np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(scores))

    def best(self, text: bytes) -> list[int]:
        """The ids of highest total score; of equal ones, the one whose last piece is longest, and so on backwards."""
        n = len(text)
        score, start, last = array("d", [-math.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        score[0] = 0.0
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        for at in range(n):
            here = score[at]
            if here == -math.inf:
                continue
            lead = text[at]
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            covered, state, end = False, 0, at
            for c in text[at : at + self.longest]:
                to = base[state] + c + 1
                if check[to] != state:
                    break
                state = to
                end += 1
                if (piece := value[to]) >= 0:
                    covered = covered or end == after
                    if (s := here + scores[piece]) > score[end]:
                        score[end], start[end], last[end] = s, at, piece
            if not covered and (s := here + self.unknown) > score[after]:
                score[after], start[after], last[after] = s, at, -1
        out: list[int] = []
        while n:
            at, piece = start[n], last[n]
            out += [piece] if piece >= 0 else [self.of_byte[b] for b in reversed(text[at:n])]
            n = at
        return out[::-1]

    def best_many(self, words: list[bytes]) -> list[bytes]:
        """best() of many short words at once, as packed ids: each step takes the same position and depth of all words."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        score = np.full((len(words), width + 5), -np.inf)
        start, last = np.zeros(score.shape, np.int16), np.full(score.shape, -1, np.int32)
        score[:, 0] = 0
        base, check, value, scores = self.arrays

        def improve(rows: np.ndarray, end, s: np.ndarray, at: int, piece) -> None:
            better = s > score[rows, end]
            rows, end = rows[better], end[better] if isinstance(end, np.ndarray) else end
            score[rows, end] = s[better]
            start[rows, end] = at
            last[rows, end] = piece[better] if isinstance(piece, np.ndarray) else piece

        for at in range(width):
            rows = np.flatnonzero((sizes > at) & (score[:, at] > -np.inf))
            here, after = score[rows, at], at + CHARACTER[text[rows, at]]
            covered, state, live = np.zeros(len(rows), bool), np.zeros(len(rows), np.int32), np.arange(len(rows))
            for k in range(at, min(width, at + self.longest)):
                inside = sizes[rows[live]] > k
                live, state = live[inside], state[inside]
                to = base[state] + text[rows[live], k] + 1
                known = check[to] == state
                live, state = live[known], to[known]
                if not len(live):
                    break
                piece = value[state]
                ends = piece >= 0
                which, piece = live[ends], piece[ends]
                improve(rows[which], k + 1, here[which] + scores[piece], at, piece)
                covered[which] |= after[which] == k + 1
            bare = ~covered
            improve(rows[bare], after[bare], here[bare] + self.unknown, at, -1)
        out, left, pos = np.zeros((len(words), width), np.int32), np.full(len(words), width), sizes.copy()
        of_byte = np.array(self.of_byte, np.int32)
        while len(rows := np.flatnonzero(pos > 0)):
            begin, piece = start[rows, pos[rows]].astype(np.int64), last[rows, pos[rows]]
            for j in range(4):  # a piece is one id, a character without one is an id a byte, from the last on
                some = (piece < 0) & (pos[rows] - begin > j) | (piece >= 0) & (j == 0)
                r = rows[some]
                left[r] -= 1
                out[r, left[r]] = np.where(piece[some] >= 0, piece[some], of_byte[text[r, pos[r] - 1 - j]])
            pos[rows] = begin
        packed, line = out.tobytes(), 4 * width
        return [packed[i * line + 4 * x : (i + 1) * line] for i, x in enumerate(left.tolist())]

    def learn(self, stretches: set[bytes]) -> None:
        """Put stretches that are not in the cache there; long ones are left out."""
        new = sorted((x for x in stretches if len(x) <= SHORT and x not in self.cache), key=len)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = sorted((x for x in stretches if len(x) <= SHORT), key=len)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.cache.update(zip(part, self.best_many(part), strict=True))

    def forget(self) -> None:
        """Empty the cache at a task's end: the worker goes on to other stages, where it would only take memory."""
        self.cache.clear()
        give_back()

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """encode() of texts, a few at a time, so that their new stretches are worked out together."""
        out, i = [], 0
        while i < len(texts):
            size, j = 0, i
            while j < len(texts) and (j == i or size + len(texts[j]) <= TOGETHER):
                size += len(texts[j])
                j += 1
            cut = [STRETCH.findall(b" " + t) if t else [] for t in texts[i:j]]
            self.learn(set().union(*cut))
            for stretches in cut:
                parts = [self.cache.get(x) or np.array(self.best(x), np.int32).tobytes() for x in stretches]
                out.append(np.frombuffer(b"".join(parts), np.int32))
            i = j
        return out

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a text; no ids for an empty one. A space is set before it, as the pieces expect of a word."""
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))[1:]


def codec(spark, path: str = VOCABULARY):
    """A function that gives the workers' codec; the vocabulary goes out once by broadcast."""
    sent = spark.sparkContext.broadcast(read(path))
    return lambda: _local(path, sent)


_made: dict[str, Codec] = {}


def _local(path: str, sent) -> Codec:
    """One codec of a vocabulary for a worker, made when first asked for."""
    if path not in _made:
        _made[path] = Codec(*sent.value)
    return _made[path]


def encoded(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """docs with a column ids (array of int; replaced if it exists). A null text has null ids, an empty one none."""
    make = codec(docs.sparkSession, path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        use = make()
        try:
            for texts in batches:
                valid, found = texts.is_valid().to_numpy(zero_copy_only=False), use.encode_many(as_bytes(texts))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int32))
                yield pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~valid, False)), flat)
        finally:
            use.forget()

    return docs.withColumn("ids", encode(F.col(text)))


def decoded(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str = VOCABULARY) -> DataFrame:
    """df with the texts of its ids in column `to` (replaced if it exists); null ids give null."""
    make = codec(df.sparkSession, path)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        use = make()
        for lists in batches:
            out = [use.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists]
            yield pa.array(out, pa.binary()).cast(pa.string())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(each)(batches)

    return df.withColumn(to, decode(F.col(ids)))


def digest(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per encoded and decoded document: how many ids and byte pieces, a hash of the ids, and whether the text came back."""
    first, last = (f(read()[2]) for f in (min, max))
    return df.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.coalesce(F.size(F.filter("ids", lambda x: x.between(first, last))), F.lit(0)).cast("long").alias("n_byte_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        F.col(text).eqNullSafe(F.col("decoded")).alias("restored"),
    )
