"""Folds over events in order, key by key, with a state that is carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(events: DataFrame, columns: list[str], begin: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]], end: Callable[[object, object], Iterable[tuple]], schema: str) -> DataFrame:
    """Fold the events of each key, which is the first of ``columns``, in order of ts and event_id.

    ``step`` changes a key's state by an event and may give rows; ``end`` gives a key's last
    rows. The events of a key come to a task sorted by Spark, and the task holds a batch of
    them and one key's state, however many there are. Events without a key don't count.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for f in frames:
            out: list[tuple] = []
            for r in f.itertuples(index=False):
                if state is None or r[0] != key:
                    if state is not None:
                        out.extend(end(key, state))
                    key, state = r[0], begin()
                out.extend(step(state, r))
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None and (rest := list(end(key, state))):
            yield pd.DataFrame(rest, columns=names)

    rows = events.select(*columns).filter(events[columns[0]].isNotNull())
    return rows.repartition(columns[0]).sortWithinPartitions(columns[0], "ts", "event_id").mapInPandas(run, schema)
