"""Validated exchange: proposed facts are applied only where the text bears them out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROPOSAL = "id long, content_hash string, proposed map<string,string>, evidence map<string,string>"
FIELDS = ("city", "deadline", "title")


def checked(lines: DataFrame, jobs: DataFrame) -> DataFrame:
    """(line, id, error) for each line: null error where it can be applied, else the first rule that it breaks.

    lines: line, value (JSON text); jobs: id, content_hash, text, city, title. Every quote must stand in the text and every value in its quote; a
    value must not contradict a stored one, and the text must be the one that was read.
    """
    parsed = lines.select("line", F.from_json("value", PROPOSAL, {"mode": "PERMISSIVE"}).alias("p")).select("line", "p.*")
    joined = parsed.join(jobs.select("id", F.col("content_hash").alias("now"), "text", *[F.col(c).alias(f"has_{c}") for c in ("city", "title")]), "id", "left")
    within = lambda part, whole: F.contains(F.lower(whole), F.lower(part))
    quote_of = lambda f: F.try_element_at("evidence", F.lit(f))
    value_of = lambda f: F.try_element_at("proposed", F.lit(f))
    error = F.when(F.col("id").isNull() | F.col("proposed").isNull(), "bad line").when(F.col("now").isNull(), "unknown job").when(F.col("now") != F.col("content_hash"), "stale source content")
    for f in FIELDS:
        error = error.when(value_of(f).isNotNull() & ~F.coalesce(within(quote_of(f), F.col("text")), F.lit(False)), f"{f} evidence not in text")
        error = error.when(value_of(f).isNotNull() & ~F.coalesce(within(value_of(f), quote_of(f)), F.lit(False)), f"{f} not in its evidence")
    for f in ("city", "title"):
        error = error.when(value_of(f).isNotNull() & (F.coalesce(F.col(f"has_{f}"), F.lit("")) != "") & (F.col(f"has_{f}") != value_of(f)), f"conflicting {f}")
    unknown = F.size(F.filter(F.map_keys("proposed"), lambda k: ~k.isin(*FIELDS))) > 0
    return joined.select("line", "id", "proposed", error.when(unknown, "unknown field").alias("error"))
