"""The run log as a stream: failure streaks kept as state, snapshots kept only on change, hourly counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def failure_streaks(runs: DataFrame) -> DataFrame:
    """(source_id, failures, last_started): after each batch, the streak of each source that ran. runs: source_id, started_at, success."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, last = state.get if state.exists else (0, None)
        # A key's rows of one batch may come in several chunks, in any order between them.
        rows = pd.concat([batch[["started_at", "success"]] for batch in batches])
        for started, success in rows.sort_values("started_at", kind="stable").itertuples(index=False):
            failures, last = 0 if success else failures + 1, started
        state.update((failures, last))
        yield pd.DataFrame({"source_id": [key[0]], "failures": [failures], "last_started": [last]})

    return runs.groupBy("source_id").applyInPandasWithState(
        step, "source_id long, failures long, last_started timestamp", "failures long, last_started timestamp", "update", GroupStateTimeout.NoTimeout
    )


def changed_pages(snapshots: DataFrame) -> DataFrame:
    """(page_id, scan, hash) of snapshots that differ from the page's last one: A, B, A gives three. snapshots: page_id, scan, text."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, out = state.get[0] if state.exists else None, []
        rows = pd.concat([batch[["scan", "hash"]] for batch in batches])
        for scan, digest in rows.sort_values("scan", kind="stable").itertuples(index=False):
            if digest != last:
                out.append((key[0], scan, digest))
                last = digest
        state.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["page_id", "scan", "hash"])

    hashed = snapshots.select("page_id", "scan", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return hashed.groupBy("page_id").applyInPandasWithState(step, "page_id long, scan long, hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def hourly_runs(runs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Runs and failures by hour; later ones than the watermark are left out."""
    hour = F.window("started_at", "1 hour")
    return runs.withWatermark("started_at", late).groupBy(hour).agg(F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("success")).alias("failed"))
