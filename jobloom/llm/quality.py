"""Quality rules for documents and their hosts (operator 8), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.common import SPACE_PATTERN, cut, text_column

#: Limits of the rules. The first two are the base rules; the others are judged together with the host.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINE_PERCENT, MIN_WORD_CHARS, MAX_WORD_CHARS = 0.1, 30, 2.0, 15.0
HOST_RATE = 0.5
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_size")
WINDOW = 5


def window_hashes(words: Column, size: Column) -> Column:
    """A hash of each WINDOW-word window, in order.

    Hashes of 64 bits, chained over the words, are only compared within one text, where a chance collision is out of the question.
    """
    return F.when(
        size >= WINDOW,
        F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<long>"))


def with_places(windows: Column) -> Column:
    """Hashes with their places, equal ones next to each other."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def features(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: key, host and the counts of the rules; no shuffle. A null text has no words."""
    step = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), text_column(text).alias("text"))
    step = step.withColumn("words", F.filter(F.split("text", SPACE_PATTERN), lambda w: w != ""))
    step = step.select(
        "doc_id",
        "host",
        "words",
        F.size("words").alias("n"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    step = step.select(
        "doc_id",
        "host",
        "n",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("words"), F.col("n")).alias("windows"),
    )
    step = step.withColumn(
        "ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), with_places(F.col("windows")))
    )
    again = F.filter(
        "ordered",
        lambda x, k: (F.get(F.col("ordered"), k - 1)["h"] == x["h"]) | (F.get(F.col("ordered"), k + 1)["h"] == x["h"]),
    )
    step = step.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    total = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"), p.alias("last")),
    )["total"]
    return step.select(
        "doc_id",
        "host",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def failures(counts: DataFrame) -> DataFrame:
    """counts with a boolean column for each of RULES."""
    n = F.col("n_words")
    return counts.withColumns(
        {
            "few_words": n < MIN_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
            "symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n,
            "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
            "word_size": (F.col("word_chars") < MIN_WORD_CHARS * n) | (F.col("word_chars") > MAX_WORD_CHARS * n),
        }
    )


def host_verdicts(failed: DataFrame) -> DataFrame:
    """(host, n_docs, shrunk_<rule>..., condemned) for each host; a null host is a host of its own.

    Each rule's host rates get a beta prior by the method of moments (over hosts, each counted once); a host's rate is
    the posterior mean, so that hosts of a few documents are judged mostly by the prior. Only the ten moments
    of the prior reach the driver. condemned: any shrunk rate above HOST_RATE.
    """
    sums = cut(
        failed.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(r).alias(f"n_{r}") for r in RULES]), "hosts"
    )
    rate = lambda r: F.col(f"n_{r}") / F.col("n_docs")
    found = sums.agg(*[f(rate(r)).alias(f"{k}_{r}") for r in RULES for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    shrunk = {}
    for r in RULES:
        mean, var = found[f"m_{r}"] or 0.0, found[f"v_{r}"] or 0.0
        weight = min(1e6, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else 1e6
        shrunk[f"shrunk_{r}"] = (F.col(f"n_{r}") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    out = sums.withColumns(shrunk)
    return out.select(
        "host", "n_docs", *shrunk, F.greatest(*[F.col(x) for x in shrunk], F.lit(0.0)).alias("worst")
    ).withColumn("condemned", F.col("worst") > HOST_RATE)


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs with its counts, base_failed, host_condemned and kept.

    A document is dropped if a base rule fails, or if its host is condemned and it fails any rule itself: a clean
    document of a bad host stays. Null texts have no words and fail; null hosts form one host; repeated rows are each
    judged; an empty table gives no rows; other columns of docs are not read.
    """
    failed = failures(cut(features(docs, key, host, text), "counts"))
    hosts = host_verdicts(failed).select(F.col("host").alias("__host"), "condemned")
    joined = failed.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left")
    base = F.col("few_words") | F.col("repeats")
    soft = F.col("symbols") | F.col("dup_lines") | F.col("word_size")
    return joined.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        F.coalesce("condemned", F.lit(False)).alias("host_condemned"),
        (~base & ~(F.coalesce("condemned", F.lit(False)) & soft)).alias("kept"),
    )


def oracle() -> str:
    shrunk = ", ".join(
        f"CASE WHEN v_{r} > 0 THEN least(1e6, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 1e6 END AS w_{r}" for r in RULES
    )
    return f"""
    WITH split AS (
      SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, i, list_slice(words, i, i + 4) AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM split)),
    twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
    spread AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM twice, range(5) r(k) WHERE n > 1 GROUP BY doc_id),
    counts AS (
      SELECT s.doc_id, source AS host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
      FROM split s LEFT JOIN spread p USING (doc_id)),
    failed AS (
      SELECT *, n_words < {MIN_WORDS} AS few_words, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS repeats,
        n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words AS symbols, 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines AS dup_lines,
        word_chars < {MIN_WORD_CHARS} * n_words OR word_chars > {MAX_WORD_CHARS} * n_words AS word_size
      FROM counts),
    sums AS (SELECT host, count(*) AS n_docs, {", ".join(f"count(*) FILTER (WHERE {r}) AS n_{r}" for r in RULES)} FROM failed GROUP BY host),
    moments AS (SELECT {", ".join(f"avg(n_{r} / n_docs) AS m_{r}, var_pop(n_{r} / n_docs) AS v_{r}" for r in RULES)} FROM sums),
    prior AS (SELECT *, {shrunk} FROM moments),
    hosts AS (
      SELECT host, greatest({", ".join(f"(n_{r} + m_{r} * w_{r}) / (n_docs + w_{r})" for r in RULES)}) > {HOST_RATE} AS condemned
      FROM sums, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeats AS base_failed,
      NOT (few_words OR repeats) AND NOT (condemned AND (symbols OR dup_lines OR word_size)) AS kept
    FROM failed JOIN hosts ON failed.host IS NOT DISTINCT FROM hosts.host"""
