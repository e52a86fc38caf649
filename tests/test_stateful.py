"""Folds over streams give what they give over batches, after a stop in the middle and a restart."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from basketspark.streaming import activity, stateful

BEGIN = dt.datetime(2024, 1, 30, 20)
NOBODY = 999


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set(*stateful.ROCKSDB)
    yield
    spark.conf.unset(stateful.ROCKSDB[0])


def shuffled(rng, rows):
    """Out of order by less than the watermark allows."""
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 50)))


def run(spark, tmp_path, schema, parts, stream, keys, ends=True):
    """The last rows of each key, after a run for each part; each run is a new query."""
    seen = {}
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        made = stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))

        def keep(df, epoch):
            rows = [r for r in df.collect() if r[0] != NOBODY]
            for r in rows:
                seen[tuple(r[k] for k in keys)] = tuple(r)

        writer = made.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "at"))
        if ends:
            writer.trigger(availableNow=True).start().awaitTermination()
        else:  # where time itself is an event, a query has always another batch to run
            q = writer.start()
            try:
                for _ in range(300):
                    if sum(p.numInputRows for p in q.recentProgress) >= len(part):
                        break
                    time.sleep(0.2)
            finally:
                q.stop()
    return seen


def parts_of(rows, last, n=3):
    """Parts of a stream, and then an event that lets the watermark pass all others."""
    cuts = [len(rows) * i // n for i in range(n + 1)]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [[last], [last]]


def test_savings(spark, tmp_path):
    rng = random.Random(1)
    schema = "user_id long, ts timestamp, event_id long, cheap double, dear double"
    rows = [(rng.randrange(6), BEGIN + dt.timedelta(minutes=9 * i), i, float(rng.randrange(0, 50)), float(rng.randrange(0, 400))) for i in range(900)]
    rows = shuffled(rng, rows)
    want = {r[0]: tuple(r) for r in activity.monthly_savings(spark.createDataFrame(rows, schema), most_events=9).collect()}
    last = (NOBODY, BEGIN + dt.timedelta(days=99), 10**6, 1.0, 2.0)
    got = run(spark, tmp_path, schema, parts_of(rows, last), lambda df: stateful.monthly_savings(df, most_events=9), [0])
    assert {k[0]: v for k, v in got.items()} == want and len(want) == 6
    assert any(r[3] for r in want.values())


def test_alerts(spark, tmp_path):
    rng = random.Random(2)
    schema = "user_id long, ts timestamp, event_id long, pid string, target double, current double, email string"
    rows = [(rng.randrange(4), BEGIN + dt.timedelta(seconds=30 * i), i, f"p{rng.randrange(12)}", rng.choice([5.0, 7.5, 0.0]), 10.0, rng.choice(["a@x", "b@x", ""])) for i in range(500)]
    rows = shuffled(rng, rows)
    plain = activity.price_alerts(spark.createDataFrame(rows, schema), most=8, seconds=200.0)
    want = {(r[0], r[1]): tuple(r) for r in plain.collect()}
    last = (NOBODY, BEGIN + dt.timedelta(days=9), 10**6, "p", 1.0, 2.0, "a@x")
    got = run(spark, tmp_path, schema, parts_of(rows, last), lambda df: stateful.price_alerts(df, most=8, seconds=200.0), [0, 1])
    assert got == want and len(want) == 32


def cart_rows(rng):
    rows = []
    for i in range(700):
        action = rng.choice(["join", "join", "leave", "write"])
        rows.append((rng.randrange(5), BEGIN + dt.timedelta(minutes=i), i, rng.randrange(8), action, f"items {i}" if action == "write" else None))
    return rows + [(7, BEGIN, 900, 1, "join", None), (7, BEGIN + dt.timedelta(minutes=5), 901, 1, "write", "x"), (7, BEGIN + dt.timedelta(minutes=600), 902, 1, "leave", None)]


CARTS = "cart_id long, ts timestamp, event_id long, user_id long, action string, items string"


def test_carts(spark, tmp_path):
    rng = random.Random(3)
    rows = shuffled(rng, cart_rows(rng))
    want = {(r[0],): tuple(r) for r in activity.shared_carts(spark.createDataFrame(rows, CARTS)).collect()}
    last = (NOBODY, BEGIN + dt.timedelta(days=9), 10**6, 1, "join", None)
    got = run(spark, tmp_path, CARTS, parts_of(rows, last), stateful.shared_carts, [0])
    assert got.pop((7,)) == (7, None, 0, 0, None)  # a cart that nobody is left in
    assert got == want and len(want) >= 4


def test_carts_as_they_come(spark, tmp_path):
    rows = sorted(cart_rows(random.Random(4)), key=lambda r: r[1])
    want = {(r[0],): tuple(r) for r in activity.shared_carts(spark.createDataFrame(rows, CARTS)).collect()}
    got = run(spark, tmp_path, CARTS, [rows[:300], rows[300:]], lambda df: stateful.shared_carts(df, ttl_ms=3_600_000), [0], ends=False)
    assert {k: v for k, v in got.items() if v[2]} == want


def test_keys_of_any_type(spark):
    """Limits by address and endpoint, as text."""
    at = lambda s: BEGIN + dt.timedelta(seconds=s)
    rows = [("10.0.0.1:search", 1, at(0)), ("10.0.0.1:search", 2, at(1)), ("10.0.0.1:search", 3, at(2)), ("10.0.0.2:search", 4, at(2)), ("10.0.0.1:search", 5, at(70))]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    got = {r.event_id: (r.key, r.allowed) for r in activity.rate_limited(df, 2, 60.0).collect()}
    assert got == {1: ("10.0.0.1:search", True), 2: ("10.0.0.1:search", True), 3: ("10.0.0.1:search", False), 4: ("10.0.0.2:search", True), 5: ("10.0.0.1:search", True)}
    assert sorted(r.event_id for r in activity.cooled(df.withColumn("k", F.col("key")), "k", 60.0).collect()) == [1, 4, 5]
