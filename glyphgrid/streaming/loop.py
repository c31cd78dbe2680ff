"""The refinement loop as keyed state: one state a segment, advanced by triggers, ended by convergence or a deadline.

A trigger row (seg_id, step, changed) says that a step of a segment's loop has ended and how much the map changed, as `refine` or any
other step gives it. The state holds the version, the last changes and the time at which the loop must end; a processing-time
timer ends segments that no trigger reaches any more. The state is in the stream's checkpoint, so that a loop that is stopped
goes on at the same version.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "seg_id string, version int, changed double, status string"


@dataclass(frozen=True)
class LoopSettings:
    """most: steps at most. calm: changes below this are calm; patience: calm steps in a row that end the loop. seconds: time from the
    first trigger to the deadline, None for none."""

    most: int = 10
    calm: float = 0.005
    patience: int = 2
    seconds: float | None = None


def decided(changes: list[float], version: int, s: LoopSettings) -> str:
    """What follows a step: `running`, `converged` or `finished` (no steps are left)."""
    last = changes[-s.patience :]
    if len(last) == s.patience and all(c < s.calm for c in last):
        return "converged"
    return "finished" if version >= s.most else "running"


class RefinementLoop(StatefulProcessor):
    """Emits a log row for each step that counts: version, change and status. Steps come in any order and more than once; those up to
    the state's version are over, those beyond the next one wait for it. A segment that has ended takes no more steps."""

    def __init__(self, settings: LoopSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "version int, status string, deadline long")
        self.changes = handle.getListState("changes", "changed double")
        self.waiting = handle.getMapState("waiting", "step int", "changed double")

    def _state(self) -> tuple[int, str, int]:
        if self.now.exists():
            version, status, deadline = self.now.get()
            return version, status, deadline
        return 0, "running", 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self.settings, []
        version, status, deadline = self._state()
        new = not self.now.exists()
        if new and s.seconds is not None:
            deadline = timerValues.getCurrentProcessingTimeInMs() + int(s.seconds * 1000)
            self.handle.registerTimer(deadline)
        changes = [c for (c,) in self.changes.get()] if self.changes.exists() else []
        for pdf in rows:
            for step, changed in zip(pdf["step"].tolist(), pdf["changed"].tolist(), strict=True):
                if status == "running" and step > version and not self.waiting.containsKey((step,)):
                    self.waiting.updateValue((step,), (float(changed),))
        while status == "running" and self.waiting.containsKey((version + 1,)):
            version += 1
            (changed,) = self.waiting.getValue((version,))
            self.waiting.removeKey((version,))
            changes = [*changes, changed][-s.patience :]
            status = decided(changes, version, s)
            out.append((key[0], version, changed, status))
        if status != "running":
            self._ended(deadline)
        self.changes.put([(c,) for c in changes])
        self.now.update((version, status, deadline))
        yield pd.DataFrame(out, columns=["seg_id", "version", "changed", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, status, deadline = self._state()
        if status == "running":
            self._ended(0)
            self.now.update((version, "deadline", deadline))
            yield pd.DataFrame([(key[0], version, None, "deadline")], columns=["seg_id", "version", "changed", "status"])

    def _ended(self, deadline: int) -> None:
        if deadline:
            self.handle.deleteTimer(deadline)
        self.waiting.clear()

    def close(self) -> None:
        pass


def loop_log(triggers: DataFrame, settings: LoopSettings | None = None) -> DataFrame:
    """The log (LOG) of the loops that a stream of triggers (seg_id, step from 1, changed) drives. Needs the RocksDB state store."""
    grouped = triggers.select("seg_id", "step", "changed").groupBy("seg_id")
    return grouped.transformWithStateInPandas(RefinementLoop(settings or LoopSettings()), LOG, outputMode="Append", timeMode="ProcessingTime")
