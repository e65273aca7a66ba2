"""What the operators share: cutting lineage in the shared folder, texts as bytes, and components of a graph."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed classes of the word definitions: white space, and everything that is not a letter, digit or non-ASCII byte.
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD_OR_SPACE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


#: Bytes of an Arrow batch that goes to a worker, and the setting that bounds it.
ARROW_BYTES, BATCH_BOUND = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Frequent keys of one join, of which a part of the rows goes to each task; bits of a filter, as a power of two.
HOT_KEYS, FILTER_BITS = 2048, 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local one, if there is but one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    for made in _open:
        made.append(out)
    return out


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes at its end the tables that cut() wrote since its begin; those taken out of the list stay."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)
        for df in made:
            drop(df)


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(conf).delete(path, True)


def meet(rows: DataFrame, found: DataFrame, keys: list[str], by: list[str], count: str = "c") -> DataFrame:
    """Inner join of rows with a table of one row a key that has the number of rows of each.

    A key of at least 1/HOT_KEYS of all rows, of which there are at most HOT_KEYS, would fill a task: its rows are dealt out in parts by
    the columns `by`, and its row of `found` goes to each part. The keys must not be null.
    """
    total = found.agg(F.sum(count).alias("n")).first()["n"] or 0
    least = max(2, total // HOT_KEYS + 1)
    hot = found.where(F.col(count) >= least).select(*keys, F.ceil(F.col(count) / least).cast("int").alias("__parts"))
    if not hot.limit(1).count():
        return rows.join(found, keys)
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__part", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("__parts"))).cast("int"))
    parts = F.when(F.col(count) >= least, F.sequence(F.lit(0), F.ceil(F.col(count) / least).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    return dealt.drop("__parts").join(found.withColumn("__part", F.explode(parts)), [*keys, "__part"]).drop("__part")


def maybe_among(rows: DataFrame, keys: DataFrame, names: tuple[str, ...] = ("d", "k")) -> DataFrame:
    """rows with a column `maybe`: whether they may be among the keys. The filter has a fixed size, and lets too many rows through at worst."""
    place = lambda: F.pmod(F.xxhash64(*names), F.lit(1 << FILTER_BITS))
    at = keys.select(place().alias("at"))
    words = at.groupBy(F.shiftright("at", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    bits = rows.sparkSession.sparkContext.broadcast(bits.astype(np.uint32))

    @F.arrow_udf("boolean")
    def set_(places: pa.Array) -> pa.Array:
        x = places.to_numpy(zero_copy_only=False)
        return pa.array((bits.value[x >> 5] >> (x & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    return rows.withColumn("maybe", set_(place()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches that go to workers at ARROW_BYTES, unless the session sets its own bound.

    By default a batch has 10,000 rows and up to 64 MB; executors and workers hold several at once, and keep that memory between stages.
    """
    if spark.conf.get(BATCH_BOUND, None) is None:
        spark.conf.set(BATCH_BOUND, str(ARROW_BYTES))


def text_column(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null gives empty bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, so that very long texts do not meet in one batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Return to the system what this worker has freed: it lives on between tasks and stages, beside others that need memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches whose worker gives back its memory at a task's end, when nothing of the function is held any more."""

    def run(batches: Iterator) -> Iterator:
        yield from each(batches)
        give_back()

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of the undirected edges, root being the smallest node reachable.

    Alternates the large-star and small-star steps on DataFrames; each round is written to the shared folder, and
    only the number of changed edges reaches the driver. Null nodes are dropped; no edges give no rows.
    """
    now = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c")), "least")
        large = meet(both.where("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_m, "u")
            .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        new = cut(small, "edges")
        changed = new.join(now, ["u", "v"], "left_anti").limit(1).count() + now.join(new, ["u", "v"], "left_anti").limit(1).count()
        drop(now)
        drop(least)
        now = new
        if not changed:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
