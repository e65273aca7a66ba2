"""Fill-in-the-middle rearrangement of texts by sparse events (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import text_column

#: The characters at which words end, and the sentinels of prefix, suffix and middle.
SPACES = "\t\n\v\f\r "
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts as many are rearranged, and of 100 rearranged ones as many have the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, "42"
#: Added by `rearranged`.
COLUMNS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Finds, in one pass, the characters that end a word or a gap (1) and the sentinels (0)."""
    found = ahocorasick.Automaton()
    for c in SPACES:
        found.add_word(c, 1)
    for s in (PREFIX, SUFFIX, MIDDLE):
        found.add_word(s, 0)
    found.make_automaton()
    return found


def unit_ends(text: str) -> tuple[np.ndarray, bool]:
    """Where each unit ends, and whether a sentinel occurs.

    Units are words together with the space before them; space after the last word is a unit of its own. Only the events
    of the automaton are kept: wherever the gap between two spaces is longer than one character a word ended, and so
    the k-th such gap is the k-th unit, without a look at what stands between.
    """
    events = np.fromiter((at if space else -1 for at, space in automaton().iter(text)), np.int64)
    spaces = events[events >= 0]
    bounds = np.concatenate(([-1], spaces, [len(text)]))
    ends = bounds[1:][np.diff(bounds) > 1]
    if len(spaces) and spaces[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(spaces) < len(events)


def cut_points(text: str, draws: tuple[int, int, int, int], rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None]:
    """(units, form, characters of the prefix, of the middle) of one text."""
    ends, marked = unit_ends(text)
    n = len(ends)
    if not text or marked or draws[2] % 100 >= rate:
        return n, "plain", None, None
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    at = lambda units: int(ends[units - 1]) if units else 0
    return n, "spm" if draws[3] % 100 < suffix_first else "psm", at(first), at(second) - at(first)


def rearranged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """docs with n_units, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output; columns of these names are replaced.

    Places and forms are drawn from the SHA-256 of seed, colon and key, so that each row is decided by itself, reruns
    agree, and nothing is shuffled. Texts go to Python a batch at a time and only four small values come back: the
    output is put together by Spark. Null texts count as empty ones and are plain, null keys as empty text;
    repeated rows have equal results; an empty table stays empty.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)

    @F.arrow_udf("n_units long, form string, prefix_chars long, middle_chars long")
    def cuts(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, digests in columns:
            found = []
            for x, d in zip(texts, digests):
                d = d.as_py()
                found.append(cut_points(x.as_py(), tuple(int(d[k : k + 8], 16) for k in (0, 8, 16, 24)), rate, suffix_first))
            kinds = (("n_units", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()))
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], t) for k, (_, t) in enumerate(kinds)], names=[name for name, _ in kinds])

    whole = text_column(text)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in COLUMNS]
    # The text goes along under a name of its own, as a column named like a result may be the one that is read.
    step = docs.select(*kept, whole.alias("__text"), cuts(whole, digest).alias("__cuts"))
    out = step.select(*kept, "__text", *[F.col(f"__cuts.{c}").alias(c) for c in COLUMNS[:-1]])
    return out.withColumn("output", joined(F.col("__text"))).drop("__text")


def joined(text: Column) -> Column:
    """The output of a text whose form, prefix_chars and middle_chars stand beside it."""
    start, length = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = text.substr(F.lit(1), start), text.substr(start + 1, length), text.substr(start + length + 1, F.char_length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text with a sentinel of its own is always plain, so each sentinel stands once."""
    size = F.char_length(output)
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    between = lambda start, end: output.substr(start + 3, F.greatest(end - start - 3, F.lit(0)))
    middle = output.substr(m + 3, size)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns of what `rearranged` made."""
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        key, F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


def oracle() -> str:
    """By all units of a text instead of its events, and without the outputs' way back: the text itself is what must come out."""
    group = lambda k: f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT)"
    return rf"""
    WITH drawn AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
               regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
        FROM documents),
    placed AS (
        SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, {group(0)} % (len(u) + 1) AS a, {group(1)} % (len(u) + 1) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {group(2)} % 100 >= {RATE} THEN 'plain'
                    WHEN {group(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
        FROM drawn),
    parts AS (
        SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
               array_to_string(u[greatest(a, b) + 1:], '') AS s FROM placed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts"""
