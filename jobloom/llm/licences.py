"""Licence notices and identifier tags in texts (operator 6)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import LOWER, WORD_OR_SPACE, as_bytes, small_batches

#: The base phrases with their labels, further notice phrases, and how much each label restricts use.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "cc",
    "creative commons attribution": "cc-by",
    "public domain": "public-domain",
    "unlicense": "public-domain",
    "proprietary and confidential": "proprietary",
}
TAG = "spdx-license-identifier:"
FAMILIES = ("agpl", "lgpl", "gpl", "mit", "apache", "bsd", "mpl", "cc0", "cc-by", "isc", "unlicense")
RESTRICTS = {
    "public-domain": 0.05, "cc0": 0.05, "unlicense": 0.05, "mit": 0.1, "isc": 0.1, "bsd": 0.1, "apache": 0.1, "cc-by": 0.2, "cc": 0.3,
    "mpl": 0.4, "lgpl": 0.5, "gpl": 0.8, "agpl": 0.9, "reserved": 1.0, "proprietary": 1.0,
}
UNKNOWN = 0.5
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: What an expression is made of, on one line, and all it may go on over: reading ends where neither follows.
TOKEN = re.compile(rb"[^\r\na-z0-9()]*([a-z0-9][a-z0-9.+-]*|[()])")
#: Bytes that belong to words.
IN_WORD = np.array([c != 0x20 for c in WORD_OR_SPACE])


def family(identifier: str) -> str:
    """The label of an identifier: its family's, or itself."""
    return next((f for f in FAMILIES if identifier == f or identifier.startswith(f + "-") or identifier.startswith(f + "+")), identifier)


def expression(tokens: Iterable[str]) -> list[tuple[str, float]] | None:
    """Evaluate a licence expression with two stacks: (label, restriction) of what must be kept to, None if malformed.

    `or` leaves the choice to the user, so the less restrictive side holds; `and` joins both; `with` keeps
    the licence on its left. Reading stops at the first token that cannot continue a complete expression.
    """
    values: list[list[tuple[str, float]]] = []
    pending: list[str] = []
    weight = lambda side: max(r for _, r in side)

    def apply() -> None:
        op, right, left = pending.pop(), values.pop(), values.pop()
        values.append(left + right if op == "and" else left if op == "with" else min(left, right, key=weight))

    operand = True
    for t in tokens:
        if operand and t == "(":
            pending.append(t)
        elif operand and t not in OPERATORS and t != ")":
            label = family(t)
            values.append([(label, RESTRICTS.get(label, UNKNOWN))])
            operand = False
        elif not operand and t in OPERATORS:
            while pending and pending[-1] != "(" and OPERATORS[pending[-1]] >= OPERATORS[t]:
                apply()
            pending.append(t)
            operand = True
        elif not operand and t == ")" and "(" in pending:
            while pending[-1] != "(":
                apply()
            pending.pop()
        else:
            break
    if operand or "(" in pending:
        return None
    while pending:
        apply()
    return values[0]


@lru_cache(2)
def automaton(tags: bool) -> ahocorasick.Automaton:
    """Finds identifier tags in lower-cased text, or phrases between word boundaries, each set in single spaces."""
    found = ahocorasick.Automaton()
    if tags:
        found.add_word(TAG, len(TAG))
    else:
        for kind, phrases in (("base", BASE), ("notice", NOTICES)):
            for phrase, label in phrases.items():
                found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def line_tokens(text: bytes, at: int) -> Iterator[str]:
    """What an expression may be made of from a place on, as far as it is asked for: to the end of the line or another tag."""
    while (m := TOKEN.match(text, at)) and (token := m[1].decode()) != TAG[:-1]:
        yield token
        at = m.end()


def scan_text(text: bytes) -> tuple[int, list[tuple[str, str, int, int]], float]:
    """Number of words; (kind, label, first word, words) of each hit; the score. kind: base, notice or tag.

    A tag's words are counted up to its expression. Each byte is looked at a fixed number of times, however many tags there are.
    """
    words = text.translate(WORD_OR_SPACE).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    hits, at, index = [], 0, 0
    found = sorted((end - size + 1, kind, label, n) for end, (kind, label, size, n) in automaton(False).iter(joined))
    for start, kind, label, n in found:
        index, at = index + joined.count(" ", at, start), start
        hits.append((kind, label, index, n))
    score = max((RESTRICTS[label] for _, label, _, _ in hits), default=0.0)
    lower = text.translate(LOWER)
    tags = [end + 1 for end, _ in automaton(True).iter(lower.decode("latin-1"))]
    if tags:
        inside = IN_WORD[np.frombuffer(text, np.uint8)]
        begun = np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))
        for end in tags:
            for label, weight in expression(line_tokens(lower, end)) or ():
                hits.append(("tag", label, int(begun[end - 1]), 1))
                score = max(score, weight)
    return len(words), hits, score


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, score) for each row of docs; hits: array of (kind, label, start, words), words counted from 0.

    score is the restriction of the strictest notice, 0 without any. Null and empty texts have no words and no hits;
    repeated rows are each scanned; an empty table gives no rows; other columns are not read.
    """
    hit = pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [scan_text(t) for t in as_bytes(batch.column(1))]
            hits = pa.array([[dict(zip(("kind", "label", "start", "words"), h, strict=True)) for h in x[1]] for x in found], pa.list_(hit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), hits, pa.array([x[2] for x in found], pa.float64())],
                ["doc_id", "n_words", "hits", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(
        each, f"doc_id {kind}, n_words long, hits array<struct<kind:string,label:string,start:long,words:long>>, score double"
    )


def digest(scanned: DataFrame) -> DataFrame:
    """One row per scanned document: how many base phrases, where the first and last start, and the labels."""
    base = F.filter("hits", lambda h: h["kind"] == "base")
    labels = lambda hits: F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    starts = F.transform(base, lambda h: h["start"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        "score",
    )
