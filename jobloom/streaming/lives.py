"""The lives of listings as a stream of sightings: closed after misses, after their deadline or when stale, and forgotten in the end.

State is kept by key and leaves by timers in event time, so what is held grows with the listings that live, not with all that ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobloom.operators.lifecycle import MISSES, STALE_PUBLISHED, STALE_REVIEW

KEPT_DAYS, DAY = 90, 86_400_000_000
#: What is known of a listing, times in microseconds: first sighting, last sign of being fresh, misses in a row, when closed and why.
LIFE = "first long, fresh long, misses int, closed long, reason string, status string, deadline long"
SIGHTING = "at: long, seq: long, seen: boolean, reviewed: boolean, status: string, deadline: long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lives:
    """Holds sightings until the watermark has passed them, so that they count in the order of their times whatever order they come in."""

    def __init__(self, published_days: int, review_days: int, misses: int, kept_days: int):
        self.stale = {"published": published_days * DAY, "review": review_days * DAY}
        self.misses, self.kept = misses, kept_days * DAY

    def turn(self, key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """What new sightings or a timer bring to one listing. Its state comes and goes with the rows, many listings at a time."""
        *known, waiting = state.get if state.exists else (None, [])
        life = list(known) if known[0] is not None else None
        rows = [tuple(r) for r in waiting]
        for chunk in chunks:
            for text in chunk["sighting"].tolist():
                at, seq, seen, reviewed, deadline, status = text.split(",", 5)
                rows.append((int(at), int(seq), seen == "true", reviewed == "true", status, int(deadline) if deadline else None))
        now = state.getCurrentWatermarkMs()
        until, out = now * 1000, []
        due, rest = [r for r in rows if r[0] < until], [r for r in rows if r[0] >= until]
        for r in sorted(due, key=lambda r: (*r[:5], r[5] is None, r[5] or 0)):
            life = self.passed(life, r[0] + 1, out)
            life = self.sighted(life, r, out)
        life = self.passed(life, until, out)
        if life or rest:
            state.update((*(life or [None] * 7), rest))
            ends = [e for e in (min((r[0] for r in rest), default=None), self.end(life)[0] if life else None) if e is not None]
            if ends:
                # It goes off when the watermark is past its millisecond, and has to be later than the watermark is.
                state.setTimeoutTimestamp(max(min(ends) // 1000, now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"job_id": [key[0]] * len(out), "at_us": [at for at, _ in out], "reason": [reason for _, reason in out]})

    def end(self, life: list) -> tuple[int | None, str]:
        """When a listing ends by itself, and why: forgotten if it is closed, else past its deadline or, without one, stale."""
        first, fresh, _, closed, _, status, deadline = life
        if closed is not None:
            return closed + self.kept, "forgotten"
        if deadline is not None:
            return (deadline + 1) * DAY, "deadline"
        days = self.stale.get(status)
        return (None, "") if days is None else ((fresh if status == "published" else first) + days, "stale")

    def passed(self, life: list | None, until: int, out: list) -> list | None:
        """The life after all that ends before a time."""
        while life:
            at, reason = self.end(life)
            if at is None or at >= until:
                break
            out.append((at, reason))
            life = None if reason == "forgotten" else [*life[:3], at, reason, *life[5:]]
        return life

    def sighted(self, life: list | None, row: tuple, out: list) -> list | None:
        """The life after one sighting. What was never seen is not missed; a closed listing that comes back is only remembered."""
        at, _, seen, reviewed, status, deadline = row
        if life is None:
            return [at, at, 0, None, "", status, deadline] if seen else None
        first, fresh, misses, closed, reason, _, _ = life
        if closed is not None:
            return life
        if seen:
            return [first, max(fresh, at) if reviewed else fresh, 0, None, "", status, deadline]
        if misses + 1 >= self.misses:
            out.append((at, "missing"))
            return [first, fresh, misses + 1, at, "missing", *life[5:]]
        return [first, fresh, misses + 1, *life[3:]]


def endings(
    sightings: DataFrame, late: str = "0 seconds", published_days: int = STALE_PUBLISHED, review_days: int = STALE_REVIEW, misses: int = MISSES, kept_days: int = KEPT_DAYS
) -> DataFrame:
    """(job_id, at, reason) of each listing that ends, as soon as the watermark is past it: missing, deadline, stale, and in the end forgotten.

    sightings, a stream: job_id, at, seq (order at one time), seen, reviewed, status, deadline. Sightings later than `late` are left
    out, as are those without a job or a time. A listing's state is one row, with the sightings that wait: it is rewritten when any come.
    run_available keeps state in Spark's RocksDB store.
    """
    none = lambda c, x: F.coalesce(F.col(c).cast("string"), F.lit(x))
    # One text a sighting: each column would be turned into a pandas one for each listing, which takes longer than all else.
    fields = [F.unix_micros("at"), none("seq", "0"), none("seen", "false"), none("reviewed", "false"), F.coalesce(F.unix_date("deadline").cast("string"), F.lit("")), none("status", "")]
    rows = sightings.where("job_id is not null and at is not null").select("job_id", "at", F.concat_ws(",", *fields).alias("sighting"))
    lives = Lives(published_days, review_days, misses, kept_days)
    made = rows.withWatermark("at", late).groupBy("job_id").applyInPandasWithState(
        lives.turn, "job_id long, at_us long, reason string", f"{LIFE}, waiting array<struct<{SIGHTING}>>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return made.select("job_id", F.timestamp_micros("at_us").alias("at"), "reason")


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there, in append mode into files, and returns when it is done. Run again, it goes on where it was."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, PROVIDER)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
