"""Recurrence over a stream whose slots come late and out of order, held back until the watermark has passed them [W7].

Slots wait in an ordered buffer of their (unit, class). A timer at each slot's time fires when the watermark reaches it;
then all slots up to that time are taken in order and their states emitted, once and for good. Whatever order slots come
in, within the watermark the emitted history is that of the batch operator. A slot from behind the watermark can change
nothing any more: ``split_late`` routes it aside before, and one that slips through is emitted as ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "unit string, class string, state long, time timestamp, recurrence string"
_COLUMNS = ["unit", "class", "state", "time", "recurrence"]


class _Recurrence(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", "seen boolean, absent boolean, gap boolean, upto long")
        self.waiting = handle.getMapState("waiting", "at long, state long", "observed int")

    def _known(self) -> tuple[bool, bool, bool, int]:
        return tuple(self.history.get()) if self.history.exists() else (False, False, False, -(1 << 62))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, late = self._known()[3], []
        for frame in rows:
            for state, time, observed in zip(frame["state"], frame["time"], frame["observed"], strict=True):
                at = int(pd.Timestamp(time).value // 1_000_000)
                if at <= upto:
                    late.append((int(state), time))
                    continue
                self.waiting.updateValue((at, int(state)), (-1 if pd.isna(observed) else int(observed),))
                self.handle.registerTimer(at)
        yield pd.DataFrame([(str(key[0]), str(key[1]), s, t, "late") for s, t in late], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        seen, absent, gap, upto = self._known()
        ready = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
        out = []
        for at, state, observed in ready:
            if observed < 0:
                gap, said = gap or seen, "gap"
            elif not observed:
                absent, said = absent or seen, "absent"
            else:
                said = "first_observed" if not seen else "observed_reappearance" if absent else "observed_after_gap" if gap else "observed"
                seen, absent, gap = True, False, False
            out.append((str(key[0]), str(key[1]), state, pd.Timestamp(at, unit="ms"), said))
            self.waiting.removeKey((at, state))
        self.history.update((seen, absent, gap, max(upto, now)))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def repaired_recurrence(slots: DataFrame, *, late: str = "1 day") -> DataFrame:
    """unit, class, state, time, recurrence of a stream of slots (unit, class, state, time, observed), in their true order.

    States of a (unit, class) grow with their time. The state store must be one that holds timers and maps (RocksDB).
    """
    return slots.withWatermark("time", late).groupBy("unit", "class").transformWithStateInPandas(statefulProcessor=_Recurrence(), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def split_late(batch: DataFrame, seen_upto) -> tuple[DataFrame, DataFrame]:
    """(timely, late) rows of a micro-batch, against the watermark that the query last reported."""
    behind = F.col("time") <= F.lit(seen_upto).cast("timestamp")
    return batch.where(~behind), batch.where(behind)
