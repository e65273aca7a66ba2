"""The corpus pipeline: documents to encoded training text, in five stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import decontamination, line_dedup, pieces, simhash, toxicity
from jobloom.llm.common import bound_batches, cut, drop, maybe_among, scratch, table, text_column


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 10 does not reject. A null text is scored as an empty one."""
    bound_batches(spark)
    judged = toxicity.judged(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that stand earlier already; n_chars follows the text."""
    bound_batches(spark)
    cleaned = line_dedup.remove(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def row_keys(docs: DataFrame) -> DataFrame:
    """docs with the hashes of id and text: what an operator found is joined back by both, since ids may be missing or repeated."""
    return docs.withColumns({"__d": F.xxhash64("doc_id"), "__k": F.xxhash64(text_column("text"))})


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, once: of smallest id, then of smallest text hash; without an id only if none has one."""
    bound_batches(spark)
    found = simhash.near_duplicates(docs).select(F.xxhash64("doc_id").alias("__d"), F.col("k").alias("__k"), "doc_id", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__k")
    rows = cut(found.groupBy("root", "__d", "__k").agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n")), "groups")
    best = rows.groupBy("root").agg(F.min("rank").alias("best"))
    # Groups of one row need no look; what is judged grows with the corpus, and is never broadcast.
    judged = rows.join(best.hint("merge"), "root").select("__d", "__k", (F.col("rank") == F.col("best")).alias("__kept"), "n")
    judged = cut(judged.where("not __kept or n > 1").select("__d", "__k", "__kept"), "judged")
    split = maybe_among(row_keys(docs), judged, ("__d", "__k"))
    looked_at = split.where("maybe").join(judged.hint("merge"), ["__d", "__k"], "left").where("coalesce(__kept, true)")
    order = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = f"row_number() over (partition by __d, __k order by {', '.join(f'`{c}`' for c in order) or '1'})"
    return split.where("not maybe").select(*docs.columns).unionByName(looked_at.withColumn("__n", F.expr(first)).where("__n = 1").select(*docs.columns))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 7 does not call contaminated."""
    bound_batches(spark)
    found = decontamination.digest(decontamination.search(docs, table(spark, sf_dir, "benchmark")))
    bad = cut(found.where("contaminated").select(F.col("d").alias("__d"), F.col("k").alias("__k")).distinct(), "contaminated")
    split = maybe_among(row_keys(docs), bad, ("__d", "__k"))
    left = split.where("maybe").join(bad.hint("merge"), ["__d", "__k"], "left_anti")
    return split.where("not maybe").unionByName(left).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and its text as decoded from them."""
    bound_batches(spark)
    out = pieces.decoded(pieces.encoded(docs))
    return out.select(
        "doc_id",
        F.col("decoded").alias("text"),
        "lang",
        "source",
        "ids",
        F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("restored"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmarks),
    ("pieces", encoded),
]

#: The stages are trained models, graph components and a tokenizer, which SQL does not state; tests check planted cases, and each operator by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way is deleted when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as made:
            new = cut(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(new)
        if docs is not new and hasattr(docs, "cut_path"):
            drop(docs)
        docs = new
    return docs
