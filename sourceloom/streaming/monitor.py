"""Runs watched as a stream: what stage each is in, and which have gone quiet, from keyed state with timers.

Stages only move on: an event of an earlier stage, or a late one, is a sign of life but doesn't take a run back. A run that hasn't ended
and shows no sign of life for six minutes is reported stale by its timer, without a further event; if it comes back, it is
reported again. A run that has ended keeps its state, so that stragglers are told from new runs, until `keep` has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..functions import lexicon as L
from ..operators.store import STALE_MS, TERMINAL

REPORT = "research_id string, kind string, stage string, at timestamp"
#: How long the state of an ended run is kept.
KEEP_MS = 24 * 60 * 60 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rank(stage: str) -> int:
    """completed and failed are both the end."""
    return L.STATUSES.index("completed" if stage in TERMINAL else stage)


class RunMonitor(StatefulProcessor):
    """Rows of REPORT: kind is stage (a run has moved on), stale, alive (it is back), or ended."""

    def __init__(self, stale_ms: int = STALE_MS, keep_ms: int = KEEP_MS) -> None:
        self.stale_ms, self.keep_ms = stale_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "stage string, seen long, quiet boolean")

    def close(self) -> None:
        pass

    def wait(self, at: int) -> None:
        """One timer a run: the earlier ones go."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    @staticmethod
    def told(key, kind: str, stage: str, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"research_id": [key[0]], "kind": [kind], "stage": [stage], "at": [pd.Timestamp(ms, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((int(ts.timestamp() * 1000), stage) for pdf in rows for ts, stage in zip(pdf["created_at"], pdf["stage"], strict=True) if stage in L.STATUSES)
        if not events:
            return
        stage, seen, quiet = self.run.get() if self.run.exists() else (None, 0, False)
        for ms, new in events:
            if stage in TERMINAL:
                break
            if quiet and ms > seen:
                quiet = False
                yield self.told(key, "alive", stage, ms)
            seen = max(seen, ms)
            if stage is None or rank(new) > rank(stage):
                stage = new
                yield self.told(key, "ended" if new in TERMINAL else "stage", new, ms)
        self.run.update((stage, seen, quiet))
        self.wait(seen + (self.keep_ms if stage in TERMINAL else self.stale_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        stage, seen, quiet = self.run.get()
        if stage in TERMINAL:
            self.run.clear()
        elif not quiet:
            self.run.update((stage, seen, True))
            yield self.told(key, "stale", stage, expiredTimerInfo.getExpiryTimeInMs())


def watch_runs(events: DataFrame, late: str = "1 minute", stale_ms: int = STALE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """REPORT rows of a stream of events (research_id, stage, created_at), by event time: a run is quiet when the events of others say so much time has passed."""
    timed = events.select("research_id", "stage", "created_at").where("research_id IS NOT NULL AND created_at IS NOT NULL").withWatermark("created_at", late)
    return timed.groupBy("research_id").transformWithStateInPandas(RunMonitor(stale_ms, keep_ms), REPORT, "append", "EventTime")


def use_state_store(spark: SparkSession) -> None:
    """Timers need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
