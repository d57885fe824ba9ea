"""Keyed state of the streams. What a key knows is kept in the state store under the stream's checkpoint: a batch asks for the keys it
holds and reads nothing that earlier batches wrote. A retried batch starts from the state before it and gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from strandline.operators.features import HORIZONS

BARS = "ticker string, date date, close double, ingest_seq long"
WINDOWS = BARS + ", changed boolean, " + ", ".join(f"date{h} date, close{h} double" for h in HORIZONS)
EPOCH = dt.date(1970, 1, 1)
BUCKETS = 16_384  # of stored ids: a call to the state store costs as much as many rows, so a bucket is asked, not an id
FOLDED = 32  # entries of a bucket's list before they are folded


def combine_bars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per ticker and date of each Arrow batch, the last arrival: a ticker with most of the rows leaves its calendar, not its
    rows, to the shuffle."""
    for batch in batches:
        yield batch.sort_values(["ingest_seq", "close"], na_position="first").drop_duplicates(["ticker", "date"], keep="last")


class Sessions(StatefulProcessor):
    """The sessions of one ticker as a list linked from its newest backward: day -> (close, arrival, day before it).

    A batch walks back from the newest session to its own earliest day and the longest horizon further; in-order bars walk that
    horizon only. It returns the walked sessions whose own bar or one of whose later bars within the horizons changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "day int")
        self.sessions = handle.getMapState("sessions", "day int", "close double, seq long, before int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[int, tuple] = {}
        for row in rows:
            day, bar = (row.date - EPOCH).days, (row.ingest_seq, row.close)
            if day not in arrived or _later(bar, arrived[day]):
                arrived[day] = bar
        known, before = self._walk(min(arrived))
        changed = {day for day, bar in arrived.items() if day not in known or _later(bar, known[day])}
        bars = known | {day: arrived[day] for day in changed}
        days = sorted(bars)
        for i, day in enumerate(days):
            previous = days[i - 1] if i else before.get(day)
            if day in changed or before.get(day) != previous:
                self.sessions.updateValue((day,), (bars[day][1], bars[day][0], previous))
        if not self.newest.exists() or self.newest.get()[0] < days[-1]:
            self.newest.update((days[-1],))
        reach = max(HORIZONS)
        for i, day in enumerate(days):
            if not changed.isdisjoint(days[i:i + reach + 1]):
                yield self._window(key[0], days, bars, i, day in changed)

    def _walk(self, earliest: int) -> tuple[dict[int, tuple], dict[int, int]]:
        """Stored sessions from the newest back to `earliest` and the longest horizon beyond, each with the day before it."""
        known, before, beyond = {}, {}, 0
        day = self.newest.get()[0] if self.newest.exists() else None
        while day is not None and beyond < max(HORIZONS):
            close, seq, previous = self.sessions.getValue((day,))
            known[day], before[day] = (seq, close), previous
            beyond += day < earliest
            day = previous
        return known, before

    @staticmethod
    def _window(ticker: str, days: list[int], bars: dict[int, tuple], i: int, changed: bool) -> Row:
        later = {}
        for h in HORIZONS:
            at = days[i + h] if i + h < len(days) else None
            later[f"date{h}"] = None if at is None else EPOCH + dt.timedelta(days=at)
            later[f"close{h}"] = None if at is None else bars[at][1]
        seq, close = bars[days[i]]
        return Row(ticker=ticker, date=EPOCH + dt.timedelta(days=days[i]), close=close, ingest_seq=seq, changed=changed, **later)

    def close(self) -> None:
        pass


def _later(bar: tuple, other: tuple) -> bool:
    """Whether (arrival, close) replaces another: nulls come first, equal arrivals go by the greater close."""
    return tuple((v is not None, v or 0) for v in bar) > tuple((v is not None, v or 0) for v in other)


class FirstOfId(StatefulProcessor):
    """Rows of the ids of one bucket with a verdict: the first of an id by recording time and content is stored unless the id is stored
    already or the row knows of later than its recording; every other row repeats the id. Holds one row per id of a batch, however
    often it comes.

    The ids stored in a bucket are a list, one entry per batch that added some, folded to one beyond FOLDED. A bucket is asked once a
    batch, and reads its own ids only."""

    def __init__(self, schema: StructType):
        self.names = [f for f in schema.names if f not in ("_late", "_bucket", "code")]
        self.kept = f"ids array<{schema['id'].dataType.simpleString()}>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getListState("stored_ids", self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first: dict[object, Row] = {}
        for row in rows:
            held = first.get(row.id)
            if held is None:
                first[row.id] = row
            elif _order(row) < _order(held):
                first[row.id] = row
                yield self._judged(held, "RECORD_ID_CONFLICT")
            else:
                yield self._judged(row, "RECORD_ID_CONFLICT")
        known, entries = set(), 0
        for (ids,) in self.stored.get():
            entries += 1
            known.update(i for i in ids if i in first)
        fresh = []
        for i, row in first.items():
            if i in known:
                yield self._judged(row, "RECORD_ID_CONFLICT")
            elif row._late:
                yield self._judged(row, "RECORD_FROM_FUTURE")
            else:
                fresh.append(i)
                yield self._judged(row, None)
        if fresh and entries >= FOLDED:
            self.stored.put([([i for (ids,) in self.stored.get() for i in ids] + fresh,)])
        elif fresh:
            self.stored.appendValue((fresh,))

    def _judged(self, row: Row, code: str | None) -> Row:
        return Row(**{name: row[name] for name in self.names}, code=code)

    def close(self) -> None:
        pass


def _order(row: Row) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in (row.recorded_at, row.content_hash))
