"""Live counterparts: windowed class counts behind a watermark, late rows aside, and recurrence as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, cell: str, cls: str, *, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window, cell and class; rows later than the watermark are dropped by the engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), F.col(cell).alias("cell"), F.col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def late_rows(events: DataFrame, time: str, registered: str) -> DataFrame:
    """Rows with a flag where the registration is later than the first observation; they are kept, not dropped."""
    return events.withColumn("registered_late", F.col(registered) > F.col(time))


_OUT = "unit string, class string, state long, recurrence string"
_STATE = "seen boolean, absent boolean, gap boolean, last long"


def _recur(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, absent, gap, last = state.get if state.exists else (False, False, False, None)
    rows = pd.concat(frames).sort_values("state")
    out = []
    for s, o in zip(rows["state"], rows["observed"], strict=True):
        if last is not None and s <= last:
            out.append((s, "out_of_order"))
            continue
        last = int(s)
        if pd.isna(o):
            gap = gap or seen
            out.append((s, "gap"))
        elif not o:
            absent = absent or seen
            out.append((s, "absent"))
        else:
            out.append((s, "first_observed" if not seen else "observed_reappearance" if absent else "observed_after_gap" if gap else "observed"))
            seen, absent, gap = True, False, False
    state.update((seen, absent, gap, last))
    yield pd.DataFrame([(str(key[0]), str(key[1]), s, r) for s, r in out], columns=["unit", "class", "state", "recurrence"])


def live_recurrence(slots: DataFrame) -> DataFrame:
    """Recurrence [W7] of slots (unit, class, state, observed); one small state for each (unit, class).

    Slots of a batch are taken in the order of their states. One that comes after a later state, or again, is flagged
    out_of_order and changes nothing, since what was emitted before cannot be taken back.
    """
    return slots.groupBy("unit", "class").applyInPandasWithState(_recur, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def idempotent_sink(path: str):
    """A foreachBatch sink that writes each batch under its number, so that a replay replaces and never repeats it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return write
