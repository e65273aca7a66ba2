"""The stored listings as files, a folder a source: a run replaces the sources that it read well, and no file of any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.operators.admission import path_year
from jobloom.operators.dedup import _cut
from jobloom.sources.paging import MOST_LINKS


def exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(conf).exists(found)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All stored rows; none where nothing was stored yet. The schema is that of the runs: source_id, url and more."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where("url is not null").select(*schema.names)


def judged(run: DataFrame, ran: DataFrame, held: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(source_id, rows, held, error) of each source of ran: whether what a run found of it may replace what is held.

    run: source_id, url, ...; ran: source_id, error (of reading it, else null), may_be_empty; held: the stored rows. A source keeps what it has if reading
    it failed, if a row has no URL or two have the same, if there are more than most_links, or if it is suddenly empty without a word
    that there is nothing. Rows of sources that did not run are refused as a whole, as something is wrong with the run.
    """
    keys = run.groupBy("source_id", "url").agg(F.count(F.lit(1)).alias("n"))
    found = keys.groupBy("source_id").agg(F.sum("n").alias("rows"), F.count_if(F.col("url").isNull()).alias("without"), F.count_if(F.col("n") > 1).alias("repeated"))
    had = held.groupBy("source_id").agg(F.count(F.lit(1)).alias("held"))
    # A source that is named twice counts once, and has failed if one of its rows says so.
    once = ran.groupBy("source_id").agg(F.max("error").alias("error"), F.min(F.coalesce("may_be_empty", F.lit(False))).alias("may_be_empty"), F.lit(True).alias("ran"))
    both = once.join(found, "source_id", "full").join(had, "source_id", "left")
    rows, held_ = F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("held", F.lit(0)).alias("held")
    error = (
        F.when(F.col("ran").isNull(), "source did not run")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("without") > 0, "row without URL")
        .when(F.col("repeated") > 0, "URL found twice")
        .when(F.col("rows") > most_links, "too many links")
        .when((F.coalesce("rows", F.lit(0)) == 0) & (F.coalesce("held", F.lit(0)) > 0) & ~F.col("may_be_empty"), "suddenly empty")
    )
    return both.where("source_id is not null").select("source_id", rows, held_, error.alias("error"))


def write(run: DataFrame, ran: DataFrame, path: str, most_links: int = MOST_LINKS) -> DataFrame:
    """Stores a run and returns judged(): only the folders of sources without an error are replaced, each as a whole.

    A source that is rightly empty gets one row without a URL, which stored() leaves out, since a folder is replaced only by rows. Rows are
    dealt out by source and large ones split, so that a source is few files and none is one task's burden. A run that was written
    before may be written again, with the same result.
    """
    spark = run.sparkSession
    verdicts = _cut(judged(run, ran, stored(spark, path, run.schema), most_links))
    good = verdicts.where("error is null")
    kept = run.join(good.select("source_id"), "source_id", "left_semi")
    blank = [F.col(f.name) if f.name == "source_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in run.schema]
    rows = kept.unionByName(good.where("rows = 0").select(*blank)).hint("rebalance", "source_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)
    return verdicts


def write_links(links: DataFrame, path: str) -> None:
    """Stores links by the year of their archive, those without one apart, so that a run of one year reads no other."""
    links.withColumn("year", path_year(F.col("url"))).hint("rebalance", "year").write.mode("append").partitionBy("year").parquet(path)


def links_of(spark: SparkSession, path: str, year: int) -> DataFrame:
    """The stored links in scope of a year: its own and undated ones. Other years' folders are not opened."""
    return spark.read.parquet(path).where((F.col("year") == year) | F.col("year").isNull()).drop("year")
