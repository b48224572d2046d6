"""State of one scan in a stream: the finding locations it has reported."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def milliseconds(span: str) -> int:
    """A span such as '10 minutes' or '3 days'."""
    number, unit = span.split()
    return int(timedelta(**{f"{unit.removesuffix('s')}s": float(number)}).total_seconds() * 1000)


class FirstOfScan(StatefulProcessor):
    """Passes a location on when it is new, and forgets all of them `idle` after the last new row.

    A state is read and added to as a whole, once per batch: a call per location would cost far
    more than the locations of one slot."""

    def __init__(self, idle: str, keys: list[str]):
        self.idle, self.keys = milliseconds(idle), keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "file_path string, function_name string, start_line int")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, known, added = 0, {tuple(place) for place in self.seen.get()}, []
        for frame in rows:
            frame = frame.sort_values("at", kind="stable").drop_duplicates(self.keys)
            newest = max(newest, int(frame["at"].max()))
            places = [(p, n, None if pd.isna(i) else int(i)) for p, n, i in zip(frame.file_path, frame.function_name, frame.start_line, strict=True)]
            new = [place not in known for place in places]
            added += [place for place, is_new in zip(places, new, strict=True) if is_new]
            known.update(added)
            yield frame.loc[new, [*self.keys, "created_at"]]
        if added:
            self.seen.appendList(added)
        before = self.last.get()[0] if self.last.exists() else -1
        if newest > before:
            self.last.update((newest,))
            if before >= 0:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(newest + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass
