"""What a stream has to send, written once: each batch under its own number, so that a batch that is run again replaces itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.sources.store import exists

#: Weeks begin on Mondays; the first day of Unix time was a Thursday.
MONDAY = "4 days"


def weekly(events: DataFrame, late: str) -> DataFrame:
    """(user_id, week, events, best) as soon as a week is over for the watermark: how many events each user had, and the one of highest value.

    events, a stream: user_id, at, event_id, value. Held are a count and the best event a user and week, however many there are.
    """
    span = F.window("at", "7 days", startTime=MONDAY)
    best = F.max_by("event_id", F.struct(F.coalesce("value", F.lit(float("-inf"))), -F.col("event_id")))
    per = events.withWatermark("at", late).groupBy(span.alias("span"), "user_id").agg(F.count(F.lit(1)).alias("events"), best.alias("best"))
    return per.where("user_id is not null").select("user_id", F.to_date("span.start").alias("week"), "events", "best")


def append_once(batch: DataFrame, epoch: int, path: str, keys: tuple[str, ...] = ("user_id", "week")) -> None:
    """For foreachBatch: stores what no earlier batch stored, under week and epoch.

    A batch run again after a failure sees what others stored, not what it stored itself, and replaces that, file for file. Only weeks that
    the batch has are looked up, so that the cost does not grow with the years. Of equal keys in a batch the least row counts.
    """
    spark = batch.sparkSession
    values = [c for c in batch.columns if c not in keys]
    rows = batch.groupBy(*keys).agg(F.min(F.struct(*values)).alias("row")).select(*keys, "row.*").persist()
    try:
        first = rows.agg(F.min("week").alias("w")).first()["w"]
        if first is None:
            return
        if exists(spark, path):
            others = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("epoch", T.LongType())])).parquet(path).where((F.col("epoch") != epoch) & (F.col("week") >= F.lit(first)))
            new = rows.join(others.select(*keys), list(keys), "left_anti")
        else:
            new = rows
        new.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week", "epoch").parquet(path)
    finally:
        rows.unpersist()


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of weekly() over all that is there into the outbox."""
    stream.writeStream.foreachBatch(lambda batch, epoch: append_once(batch, epoch, path)).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
