"""The folds of ``activity`` over streams: savings by month, price alerts and shared carts, with state that outlives a restart.

Events wait in the state, by time and id, until the watermark has passed them; a timer then
folds them in order. So a stream gives what the batch fold gives, in whatever order events
come, as long as none is later than the watermark allows. Carts can also be folded as
events come, with a time to live. Rows come out whenever a key changes (update mode); the
last of a key is its state. Sessions need the RocksDB state store, see ``ROCKSDB``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import activity

#: The setting that keyed state with maps, lists and timers needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Stored:
    """How a fold's state is kept: names and types of values, of one list and of one map."""

    values: str = ""
    items: str = ""
    keys: str = ""
    entries: str = ""


class Ordered(StatefulProcessor):
    """A fold by key; events are ``columns`` (key first, then ts, event_id and others)."""

    def __init__(self, fold: activity.Fold, stored: Stored, columns: list[str], kinds: str, output: list[str], ttl_ms: int | None = None):
        self.fold, self.stored, self.columns, self.kinds, self.output, self.ttl_ms = fold, stored, columns, kinds, output, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        s, ttl = self.stored, {"ttlDurationMs": self.ttl_ms} if self.ttl_ms else {}
        self.values = handle.getValueState("values", s.values, **ttl) if s.values else None
        self.items = handle.getListState("items", s.items, **ttl) if s.items else None
        self.entries = handle.getMapState("entries", s.keys, s.entries, **ttl) if s.keys else None
        if not self.ttl_ms:
            self.waiting = handle.getMapState("waiting", "ts timestamp, event_id long", self.kinds)

    # the fold's state

    def _load(self) -> dict:
        state = self.fold.begin()
        values = self.values.get() if self.values and self.values.exists() else ()
        names = [x.split()[0] for x in self.stored.values.split(", ")]
        state.update(zip(names, values, strict=False))
        if self.items and self.items.exists():
            state["members"] = [x[0] for x in self.items.get()]
        if self.entries:
            state["alerts"] = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        return state

    def _save(self, before: dict, state: dict) -> None:
        if self.values:
            self.values.update(tuple(state[x.split()[0]] for x in self.stored.values.split(", ")))
        if self.items:
            self.items.clear() if not state["members"] else self.items.put([(x,) for x in state["members"]])
        if self.entries:
            for k, v in state["alerts"].items():
                if before.get(k) != v:
                    self.entries.updateValue((k,), v)

    def _folded(self, key: tuple, events: list) -> Iterator[pd.DataFrame]:
        state = self._load()
        before = dict(state.get("alerts", ()))
        for r in events:
            self.fold.step(state, r)
        self._save(before, state)
        rows = self.fold.end(key[0], state) or self.fold.gone(key[0])
        if rows:
            yield pd.DataFrame(rows, columns=self.output)

    # what Spark calls

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = [r for f in rows for r in f[self.columns].itertuples(index=False)]
        if self.ttl_ms:
            yield from self._folded(key, sorted(events, key=lambda r: (r.ts, r.event_id)))
            return
        for r in events:
            self.waiting.updateValue((r.ts.to_pydatetime(), int(r.event_id)), tuple(_plain(x) for x in r[3:]))
            self.handle.registerTimer(int(r.ts.timestamp() * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        due = sorted(((_naive(k[0]), k[1]), k, v) for k, v in self.waiting.iterator() if _naive(k[0]) <= passed)
        for _, k, _ in due:
            self.waiting.removeKey(k)
        if due:
            yield from self._folded(key, [SimpleNamespace(**dict(zip(self.columns, (key[0], *at, *v), strict=True))) for at, _, v in due])

    def close(self) -> None:
        pass


def _naive(ts) -> pd.Timestamp:
    return pd.Timestamp(ts).tz_localize(None)


def _plain(x):
    """A value as Python has it; None for what is missing."""
    if x is None or x != x:
        return None
    return x.item() if hasattr(x, "item") else x


def _run(events: DataFrame, fold: activity.Fold, stored: Stored, late: str, ttl_ms: int | None = None) -> DataFrame:
    rows = events.select(*fold.columns).filter(F.col(fold.columns[0]).isNotNull())
    if not ttl_ms:
        rows = rows.withWatermark("ts", late)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in fold.columns[3:])
    names = [x.split()[0] for x in fold.schema.split(", ")]
    schema = events.sparkSession.createDataFrame([], fold.schema).schema
    processor = Ordered(fold, stored, fold.columns, kinds, names, ttl_ms)
    return rows.groupBy(fold.columns[0]).transformWithStateInPandas(processor, schema, "Update", "ProcessingTime" if ttl_ms else "EventTime")


def monthly_savings(events: DataFrame, late: str = "1 hour", zone: str = "Europe/Copenhagen", **caps: float) -> DataFrame:
    """``activity.monthly_savings`` of a stream."""
    stored = Stored("month string, amount double, prev_month string, prev double, day string, today int")
    return _run(activity.dated(events, zone), activity.savings_fold(**caps), stored, late)


def price_alerts(requests: DataFrame, late: str = "1 hour", most: int = 200, seconds: float = 1.0, highest: float = 99_999.0) -> DataFrame:
    """``activity.price_alerts`` of a stream: all alerts of a user whenever one of them changes."""
    stored = Stored("last double", keys="pid string", entries="target double, current double, email string, ts timestamp")
    return _run(activity.proper_requests(requests, highest), activity.alerts_fold(most, seconds), stored, late)


def shared_carts(events: DataFrame, late: str = "1 hour", most_members: int = 6, ttl_ms: int | None = None) -> DataFrame:
    """``activity.shared_carts`` of a stream; a cart that is gone has no members.

    With ``ttl_ms`` events count as they come (those of a batch in order), and a cart
    nobody touches for so long is forgotten.
    """
    return _run(events, activity.carts_fold(most_members), Stored("owner long, items string, revision int", items="user_id long"), late, ttl_ms)
