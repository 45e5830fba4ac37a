"""The state of a subnet: lines gather until their batch is full or due."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LINE = "us long, logline_id string, value string, arrival_us long"
#: What goes in: kind is line, failed or drain; us and arrival_us are -1 where they are absent.
INPUT = ("kind", "us", "logline_id", "value", "arrival_us", "reason")
OUTPUT = f"kind string, subnet_id string, {LINE}, b long, part int, reason string"
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Keys that lines of no subnet are dealt to.
APART = "#"


class Gather(StatefulProcessor):
    """Finishes a batch at `most` new lines, or `timeout_ms` after the last batch or the first line; each batch repeats the
    one before as part 0.

    Lines of one trigger count in order of us and logline_id. A timer that finds no new line drops what was kept of the
    batch before. A line is late, and goes out as such, if it is more than `late_us` older than the newest line that its
    subnet had in earlier triggers. A drain row finishes what is held and drops the rest; the batches' numbers go on.
    State: the lines of the open batch, which only grow by appending, those of the batch before, and three numbers.
    """

    def __init__(self, most: int, timeout_ms: int, late_us: int | None = None):
        self.most, self.timeout_ms, self.late_us = most, timeout_ms, late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", LINE)
        self.before = handle.getListState("before", LINE)
        self.meta = handle.getValueState("meta", "n long, b long, newest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (subnet,), out, came, drain = key, [], [], False
        for frame in rows:
            for kind, us, line, value, arrival, reason in frame[list(INPUT)].itertuples(index=False, name=None):
                if kind == "failed":
                    out.append(("failed", None, None, line, value, arrival, None, None, reason))
                elif kind == "drain":
                    drain = True
                else:
                    came.append((us, line, value, arrival))
        if came or drain:
            yield from self.gathered(subnet, sorted(came, key=lambda r: (r[0], r[1])), drain, out, timerValues.getCurrentProcessingTimeInMs())
        elif out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def gathered(self, subnet: str, came: list, drain: bool, out: list, now: int) -> Iterator[pd.DataFrame]:
        n, b, newest = self.meta.get() if self.meta.exists() else (0, 0, None)
        limit = None if newest is None or self.late_us is None else newest - self.late_us
        pending, flushed = [], False
        for row in came:
            if limit is not None and row[0] < limit:
                out.append(("late", subnet, *row, None, None, "late"))
                continue
            pending.append(row)
            newest = row[0] if newest is None else max(newest, row[0])
            n += 1
            if n == self.most:
                yield self.finished(subnet, b, pending)
                pending, n, b, flushed = [], 0, b + 1, True
        if pending:
            self.held.appendList(pending)
        if drain:
            if n:
                yield self.finished(subnet, b, [])
                n, b = 0, b + 1
            yield from self.dropped(subnet, newest)
        self.meta.update((n, b, newest))
        timers = list(self.handle.listTimers())
        if flushed or drain:
            for t in timers:
                self.handle.deleteTimer(t)
            timers = []
        if not timers and not drain:
            self.handle.registerTimer(now + self.timeout_ms)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, b, newest = self.meta.get()
        if n:
            yield self.finished(key[0], b, [])
            self.meta.update((0, b + 1, newest))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        else:
            yield from self.dropped(key[0], newest)

    def finished(self, subnet: str, b: int, pending: list) -> pd.DataFrame:
        """The rows of a batch: what is held and pending, and the batch before, whose place it takes."""
        own = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        own += pending
        before = [tuple(r) for r in self.before.get()] if self.before.exists() else []
        self.before.put(own)
        self.held.clear()
        by_time = lambda rows: sorted(rows, key=lambda r: r[0])
        rows = [("line", subnet, *r, b, 0, None) for r in by_time(before)] + [("line", subnet, *r, b, 1, None) for r in by_time(own)]
        return pd.DataFrame(rows, columns=COLUMNS)

    def dropped(self, subnet: str, newest: int | None) -> Iterator[pd.DataFrame]:
        gone = sum(1 for _ in self.before.get()) if self.before.exists() else 0
        self.before.clear()
        if gone:
            yield pd.DataFrame([("dropped", subnet, newest, None, None, None, None, gone, None)], columns=COLUMNS)

    def close(self) -> None:
        pass
