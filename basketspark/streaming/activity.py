"""Streaming operators; each also takes a batch DataFrame where no state by arrival is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import parse
from .folds import folded

#: Weight of an event for popularity.
WEIGHTS = {"add": 1, "compare": 3}


def cleaned(events: DataFrame) -> DataFrame:
    """Known events of a proper product id, with quantities from 1 to 99."""
    quantity = F.least(F.greatest(F.coalesce(F.col("qty"), F.lit(1)), F.lit(1)), F.lit(99))
    ok = F.length("pid").between(1, 64) & F.col("event_type").isin(*WEIGHTS)
    return events.filter(ok).withColumn("qty", quantity)


def hourly(events: DataFrame, zone: str = "Europe/Copenhagen", late: str = "1 hour") -> DataFrame:
    """Events and quantities by product, kind and (local) hour."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", "1 hour").alias("w"), "pid", "event_type").agg(F.count("*").alias("events"), F.sum("qty").alias("qty"))
    return counted.select(F.from_utc_timestamp("w.start", zone).alias("hour"), "pid", "event_type", "events", "qty")


def minutes(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Counts by minute, kind and path; as a stream, in append mode, a minute appears once it can no longer change."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 minute").alias("w"), "kind", "path").agg(F.count("*").alias("events")).select(F.col("w.start").alias("bucket"), "kind", "path", "events")


def with_overflow(counts: DataFrame, most: int, salts: int = 64) -> DataFrame:
    """Per kind the ``most`` largest keys; all others as one row "(overflow)".

    The largest of each of ``salts`` parts of a kind's keys are found first, so that no task
    has to sort a kind.
    """
    order = F.desc("events"), F.asc("path")
    rows = counts.select("kind", "path", "events").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
    some = rows.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "salt").orderBy(*order)))
    top = some.filter(F.col("nth") <= most).withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter(F.col("nth") <= most)
    top = top.select(F.col("kind").alias("t_kind"), F.col("path").alias("t_path"))
    kept = rows.join(top, F.col("kind").eqNullSafe(F.col("t_kind")) & F.col("path").eqNullSafe(F.col("t_path")), "left")
    rows = kept.withColumn("path", F.when(F.col("t_kind").isNotNull() | F.col("kind").isNull() & F.col("t_path").isNotNull(), F.col("path")).otherwise("(overflow)"))
    return rows.groupBy("kind", "path").agg(F.sum("events").alias("events"))


def _last_hour(counts: DataFrame) -> DataFrame:
    newest = counts.agg(F.max("bucket")).first()[0]  # one value, so that the filter reaches the scan
    return counts.filter(F.col("bucket") >= F.lit(newest) - F.expr("INTERVAL 1 HOUR")) if newest is not None else counts


def alarms(counts: DataFrame, limits: dict[str, int], other: int | None = None) -> DataFrame:
    """Per kind the events (bucket, kind, path, events) of all time and of the last hour, and whether these are more than its limit, or ``other`` where it has none."""
    recent = _last_hour(counts).groupBy("kind").agg(F.sum("events").alias("recent"))
    limit = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in limits.items()), F.lit(other).cast("int"))
    rows = counts.groupBy("kind").agg(F.sum("events").alias("events")).join(recent, "kind", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    return rows.withColumn("alarm", F.coalesce(F.col("recent") > limit, F.lit(False)))


def top_paths(counts: DataFrame, most: int = 10) -> DataFrame:
    """The kinds and paths with most events in the last hour."""
    return _last_hour(counts).groupBy("kind", "path").agg(F.sum("events").alias("events")).orderBy(F.desc("events"), "kind", "path").limit(most)


def _seconds(ts) -> float:
    return pd.Timestamp(ts).tz_localize(None).timestamp() if isinstance(ts, datetime | pd.Timestamp) else float(ts)


def cooldown_fold(key: tuple, rows: Iterator[pd.DataFrame], last: float | None, seconds: float) -> tuple[pd.DataFrame, float | None]:
    """Weights of one product's events in order; an event within the cooldown of the last counted one has none."""
    events = weight = 0
    merged = pd.concat(list(rows)).sort_values(["ts", "event_id"])
    for ts, kind in zip(merged["ts"], merged["event_type"], strict=True):
        events += 1
        now = _seconds(ts)
        if last is None or now - last >= seconds:
            weight, last = weight + WEIGHTS[kind], now
    return pd.DataFrame({"pid": [key[0]], "events": [events], "count": [weight]}), last


def popularity(events: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Batch: events and weighted count of every product, with a cooldown by product."""

    def step(state: dict, r) -> tuple:
        state["events"] += 1
        now = _seconds(r.ts)
        if state["last"] is None or now - state["last"] >= seconds:
            state["count"], state["last"] = state["count"] + WEIGHTS[r.event_type], now
        return ()

    return folded(events, ["pid", "ts", "event_id", "event_type"], lambda: {"events": 0, "count": 0, "last": None}, step, lambda key, s: [(key, s["events"], s["count"])], "pid string, events long, count long")


def popularity_stream(events: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Stream: the same, as increments by micro-batch; the state of a product is its last counted time, kept until the cooldown is over."""

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, last = cooldown_fold(key, rows, state.get[0] if state.exists else None, seconds)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield out

    rows = events.select("pid", "ts", "event_id", "event_type").withWatermark("ts", "1 hour")
    return rows.groupBy("pid").applyInPandasWithState(fold, "pid string, events long, count long", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def limit_fold(key: tuple, rows: Iterator[pd.DataFrame], log: list[float], calls: int, seconds: float) -> tuple[pd.DataFrame, list[float]]:
    out = []
    merged = pd.concat(list(rows)).sort_values(["ts", "event_id"])
    for event_id, ts in zip(merged["event_id"], merged["ts"], strict=True):
        now = _seconds(ts)
        log = [t for t in log if now - t < seconds]
        ok = len(log) < calls
        if ok:
            log.append(now)
        out.append((key[0], event_id, ok))
    return pd.DataFrame(out, columns=["key", "event_id", "allowed"]), log


def rate_limited(events: DataFrame, calls: int, seconds: float) -> DataFrame:
    """Each event with whether its key had fewer than ``calls`` allowed ones in the seconds before (a sliding log)."""

    def step(log: list, r) -> list[tuple]:
        now = _seconds(r.ts)
        log[:] = [t for t in log if now - t < seconds]
        ok = len(log) < calls
        if ok:
            log.append(now)
        return [(r.key, r.event_id, ok)]

    def fold_stream(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, log = limit_fold(key, rows, list(state.get[0]) if state.exists else [], calls, seconds)
        state.update((log,))
        state.setTimeoutTimestamp(max(int((log[-1] + seconds) * 1000) if log else 0, state.getCurrentWatermarkMs() + 1))
        yield out

    schema = f"key {events.schema['key'].dataType.simpleString()}, event_id long, allowed boolean"
    rows = events.select("key", "event_id", "ts")
    if not events.isStreaming:
        return folded(rows, ["key", "event_id", "ts"], list, step, lambda key, log: (), schema)
    return rows.withWatermark("ts", "1 hour").groupBy("key").applyInPandasWithState(fold_stream, schema, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def cooled(events: DataFrame, key: str, seconds: float = 1.0) -> DataFrame:
    """The events that count: of a key those at least ``seconds`` after the last one that counted."""
    ok = rate_limited(events.withColumn("key", F.col(key)), 1, seconds).filter("allowed").select("event_id")
    return events.join(ok, "event_id", "left_semi")


def click_points(clicks: DataFrame, recipes: DataFrame) -> DataFrame:
    """Points of clicks by the recipe's age: 10 in its first week, one less each week, 1 at least; unknown recipes count nothing."""
    age = F.datediff(F.to_date("ts"), "created")
    return clicks.join(recipes, "recipe_id").withColumn("points", F.greatest(F.lit(10) - F.greatest(F.floor(age / 7), F.lit(0)), F.lit(1)).cast("long"))


@dataclass(frozen=True)
class Fold:
    """A fold over a key's events in order: for batches (``folded``) and streams (``stateful``) alike."""

    columns: list[str]
    begin: Callable[[], dict]
    step: Callable[[dict, object], tuple]
    end: Callable[[object, dict], list[tuple]]
    schema: str
    #: What a stream says of a key of which nothing is left.
    gone: Callable[[object], list[tuple]] = lambda key: []

    def batch(self, events: DataFrame) -> DataFrame:
        return folded(events, self.columns, self.begin, self.step, self.end, self.schema)


def dated(events: DataFrame, zone: str) -> DataFrame:
    return events.withColumns({"month": parse.local_month(F.col("ts"), zone), "day": parse.local_day(F.col("ts"), zone)})


def savings_fold(most_events: int = 50, delta_cap: float = 5000.0, cap: float = 100_000.0, ratio_cap: float = 5.0) -> Fold:
    def begin() -> dict:
        return {"month": "", "amount": 0.0, "prev_month": "", "prev": 0.0, "day": "", "today": 0}

    def step(s: dict, r) -> tuple:
        if r.month != s["month"]:
            s["month"], s["amount"], s["prev_month"], s["prev"] = r.month, 0.0, s["month"], s["amount"]
        if r.day != s["day"]:
            s["day"], s["today"] = r.day, 0
        if s["today"] < most_events and r.cheap > 0 and r.dear >= r.cheap:
            s["today"] += 1
            s["amount"] = min(cap, s["amount"] + min(delta_cap, min(r.dear, ratio_cap * r.cheap) - r.cheap))
        return ()

    def end(key, s: dict) -> list[tuple]:
        return [(key, s["month"], round(s["amount"], 2), s["prev_month"], round(s["prev"], 2))]

    return Fold(["user_id", "ts", "event_id", "cheap", "dear", "month", "day"], begin, step, end, "user_id long, month_key string, amount double, prev_month_key string, prev_amount double")


def monthly_savings(events: DataFrame, most_events: int = 50, delta_cap: float = 5000.0, cap: float = 100_000.0, ratio_cap: float = 5.0, zone: str = "Europe/Copenhagen") -> DataFrame:
    """Per user the savings of the last month seen and of the month before, folded in order of events.

    A comparison saves the difference of its dear and cheap price, the dear one taken as
    five times the cheap one at most; single savings, sums and events a day are capped. Months
    and days are those of ``zone``.
    """
    return savings_fold(most_events, delta_cap, cap, ratio_cap).batch(dated(events, zone))


def carts_fold(most_members: int = 6) -> Fold:
    def begin() -> dict:
        return {"members": [], "owner": None, "items": None, "revision": 0}

    def step(s: dict, r) -> tuple:
        members = s["members"]
        if r.action == "join" and r.user_id not in members and len(members) < most_members:
            members.append(r.user_id)
            s["owner"] = r.user_id if s["owner"] is None else s["owner"]
        elif r.action == "leave" and r.user_id in members:
            members.remove(r.user_id)
            if s["owner"] == r.user_id:
                s["owner"] = members[0] if members else None
            if not members:
                s["items"], s["revision"] = None, 0
        elif r.action == "write" and r.user_id in members:
            s["items"], s["revision"] = r.items, s["revision"] + 1
        return ()

    def end(key, s: dict) -> list[tuple]:
        return [(key, s["owner"], len(s["members"]), s["revision"], s["items"])] if s["members"] else []

    schema = "cart_id long, owner long, members int, revision int, items string"
    return Fold(["cart_id", "ts", "event_id", "user_id", "action", "items"], begin, step, end, schema, lambda key: [(key, None, 0, 0, None)])


def shared_carts(events: DataFrame, most_members: int = 6) -> DataFrame:
    """Shared carts from their events (join, leave, write): the last write stands, each one raises the revision.

    Beyond six members nobody joins; if the owner leaves, who joined first is next; a cart
    that nobody is left in is gone.
    """
    return carts_fold(most_members).batch(events)


def proper_requests(requests: DataFrame, highest: float = 99_999.0) -> DataFrame:
    ok = (F.length("email") > 0) & F.length("pid").between(1, 64)
    for c in ("target", "current"):
        ok = ok & (F.col(c) > 0) & (F.col(c) <= highest)
    return requests.filter(ok)


def alerts_fold(most: int = 200, seconds: float = 1.0) -> Fold:
    def step(s: dict, r) -> tuple:
        now = _seconds(r.ts)
        if (s["last"] is None or now - s["last"] >= seconds) and (r.pid in s["alerts"] or len(s["alerts"]) < most):
            s["last"] = now
            s["alerts"][r.pid] = (r.target, r.current, r.email, r.ts)
        return ()

    def end(key, s: dict) -> list[tuple]:
        return [(key, pid, *x, None) for pid, x in s["alerts"].items()]

    columns = ["user_id", "ts", "event_id", "pid", "target", "current", "email"]
    return Fold(columns, lambda: {"last": None, "alerts": {}}, step, end, "user_id long, product_id string, target_price double, current_price double, email string, updated_at timestamp, notified_at timestamp")


def price_alerts(requests: DataFrame, most: int = 200, seconds: float = 1.0, highest: float = 99_999.0) -> DataFrame:
    """Price alerts from their requests (user_id, ts, event_id, pid, target, current, email): the last request for a product stands.

    Requests without an e-mail or a proper product id, or with prices out of range, aren't
    taken, nor is one within ``seconds`` of the user's last taken one, nor one for another
    product beyond ``most``. A request for a product that has an alert arms it again.
    """
    return alerts_fold(most, seconds).batch(proper_requests(requests, highest))


def fired(alerts: DataFrame, prices: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Alerts whose product costs the target or less and that weren't sent, and all alerts with those marked as sent: each fires once."""
    due = alerts.filter(F.col("notified_at").isNull() & F.col("email").isNotNull()).join(prices.select("product_id", "price"), "product_id").filter(F.col("price") <= F.col("target_price"))
    marked = alerts.join(due.select("user_id", "product_id", F.lit(True).alias("due")), ["user_id", "product_id"], "left")
    return due, marked.withColumn("notified_at", F.when(F.col("due"), now).otherwise(F.col("notified_at"))).select(alerts.columns)
