"""Versioned tables: commits, guards, and sums that count each epoch once."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from basketspark.sources import snapshots
from basketspark.sources.snapshots import Refused, Snapshots

OFFERS = "store string, kind string, id long, price double"


def offers(spark, *rows):
    return spark.createDataFrame(list(rows), OFFERS)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture
def ten(spark, tmp_path):
    """A table of ten stores."""
    table = Snapshots(spark, str(tmp_path / "offers"), "store", "kind")
    assert table.version() == 0
    with pytest.raises(LookupError):
        table.read()
    assert table.commit(spark.createDataFrame([(f"s{i % 10}", "all" if i % 3 else "sale", i, 1.0) for i in range(100)], OFFERS)) == 1
    return table


def test_a_reader_sees_all_old_or_all_new(spark, ten):
    before = ten.read()
    seen = []
    real = ten._publish
    ten._publish = lambda version, m: seen.append(ids(Snapshots(spark, ten.path, "store", "kind").read())) or real(version, m)
    assert ten.commit(spark.createDataFrame([(f"s{i}", "all", 1000 + i, 2.0) for i in range(10)], OFFERS)) == 2
    assert seen == [list(range(100))]  # all is written, nothing is published yet
    assert ids(before) == list(range(100)) and ids(ten.read()) == list(range(1000, 1010)) and ids(ten.read(1)) == list(range(100))


def test_a_job_that_dies_leaves_the_old_version(spark, ten):
    bad = offers(spark, ("s1", "all", 1, 1.0), ("s2", "all", 2, 1.0)).withColumn("price", F.when(F.col("id") == 2, F.raise_error(F.lit("dies")).cast("double")).otherwise(1.0))
    with pytest.raises(Exception, match="dies"):
        ten.commit(bad)
    assert ids(ten.read()) == list(range(100)) and ten.version() == 1

    def killed(version, manifest):  # after the manifest, with an entry in the log that never got its content
        ten._write("manifests/" + "f" * 32 + ".json", manifest.text())
        ten._write(f"log/{version:08d}", "")
        raise KeyboardInterrupt

    real, ten._publish = ten._publish, killed
    with pytest.raises(KeyboardInterrupt):
        ten.commit(offers(spark, ("s1", "all", 7, 1.0)))
    ten._publish = real
    assert ten.version() == 1 and ids(ten.read()) == list(range(100))
    ten.commit(offers(spark, ("s1", "all", 8, 1.0)))
    assert ids(ten.read()) == [8]
    ten.retain(1)
    assert ids(ten.read()) == [8] and len(os.listdir(f"{ten.path}/data")) == 1 and len(os.listdir(f"{ten.path}/manifests")) < 4


def test_scopes(spark, ten):
    s1 = [i for i in range(100) if i % 10 == 1]
    ten.commit(offers(spark, ("s1", "sale", 500, 1.0)), lambda v: v["store"] == "s1" and v["kind"] == "sale")
    assert ids(ten.read(where=lambda v: v["store"] == "s1")) == sorted([i for i in s1 if i % 3] + [500])
    ten.commit(offers(spark, ("s1", "all", 501, 1.0)), lambda v: v["store"] == "s1" and v["kind"] != "sale")
    assert ids(ten.read(where=lambda v: v["store"] == "s1")) == [500, 501]
    ten.commit(offers(spark).limit(0), lambda v: v["store"] == "s1")
    assert ids(ten.read()) == [i for i in range(100) if i % 10 != 1] and ten.manifest().rows == 90
    ten.commit(offers(spark, (None, "a/b=c d", 1, 1.0)), lambda v: v["store"] is None)
    assert ids(ten.read(where=lambda v: v["store"] is None and v["kind"] == "a/b=c d")) == [1]
    ten.retain(1)
    assert ids(ten.read()) == sorted([i for i in range(100) if i % 10 != 1] + [1]) and [*ten.versions()] == [5]


def test_writers_of_two_scopes_at_one_time(spark, ten):
    other = Snapshots(spark, ten.path, "store", "kind")
    real, done = ten._publish, []

    def late(version, manifest):
        if not done:
            done.append(other.commit(offers(spark, ("s3", "all", 903, 1.0)), lambda v: v["store"] == "s3"))
            assert not ten._write(f"log/{version:08d}", "x" * 32)  # the number is taken
            return False
        return real(version, manifest)

    ten._publish = late
    assert ten.commit(offers(spark, ("s4", "all", 904, 1.0)), lambda v: v["store"] == "s4") == 3
    assert ids(ten.read()) == sorted([i for i in range(100) if i % 10 not in (3, 4)] + [903, 904])


def test_each_guard(spark, tmp_path):
    def table(name, rows=0, **columns):
        out = Snapshots(spark, str(tmp_path / name))
        if rows:
            out.commit(spark.range(rows))
        return out

    def refused(t, rows, guards, **facts):
        figures = {"matched": F.count_if(F.col("id") % 10 == 0)}
        before = t.version()
        try:
            t.commit(spark.range(rows), guards=guards, figures=figures, facts=facts)
        except Refused:
            assert t.version() == before and len(os.listdir(f"{t.path}/data")) == before
            return True
        return False

    coverage = snapshots.RUN[0]
    assert refused(table("a"), 1000, [coverage]) and not refused(table("b"), 999, [coverage]) and not refused(table("c"), 0, [coverage])
    size = snapshots.RUN[1]
    assert refused(table("d", 1100), 769, [size]) and not refused(table("e", 1100), 770, [size]) and not refused(table("f", 1000), 1, [size])
    rows, seeding = snapshots.SERVING
    assert refused(table("g"), 7999, [rows]) and not refused(table("h"), 8000, [rows])
    assert refused(table("i"), 100, [seeding])
    shrink, failures, feed = snapshots.FEED
    assert refused(table("j", 20), 9, [shrink]) and not refused(table("k", 20), 10, [shrink]) and not refused(table("l", 19), 1, [shrink])
    assert refused(table("m"), 5, [failures], tasks=20, failed=4) and not refused(table("n"), 5, [failures], tasks=20, failed=3)
    assert refused(table("o", 101), 60, [feed]) and not refused(table("p", 100), 1, [feed])


def test_guards_see_what_is_written_in_one_scan(spark, tmp_path):
    """Rows are computed once, though they are counted, judged and written."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(2000).mapInArrow(count, "id long")
    Snapshots(spark, str(tmp_path / "t")).commit(rows, guards=snapshots.RUN, figures={"matched": F.count_if(F.col("id") % 2 == 0)})
    assert seen.value == 2000


def test_an_epoch_counts_once_and_late_rows_add_up(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "hours"), "day")
    write = snapshots.counted_into(table, "clicks", ["day", "pid"], ["events", "qty"])
    batch = lambda *rows: spark.createDataFrame(list(rows), "day date, pid string, events long, qty long")
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    rows = lambda: sorted((str(r.day), r.pid, r.events, r.qty) for r in table.read().collect())
    write(batch((one, "a", 1, 2), (one, "a", 1, 3), (two, "b", 1, 1)), 0)
    want = [("2024-01-01", "a", 2, 5), ("2024-01-02", "b", 1, 1)]
    assert rows() == want
    write(batch((one, "a", 1, 2), (one, "a", 1, 3), (two, "b", 1, 1)), 0)  # again, after a failure
    assert rows() == want and table.version() == 1
    folders = {v["day"]: p for p, v in ((p, dict(v)) for p, v in table.manifest().folders)}
    write(batch((one, "a", 1, 7), (one, "c", 1, 1)), 1)  # late
    assert rows() == [("2024-01-01", "a", 3, 12), ("2024-01-01", "c", 1, 1), ("2024-01-02", "b", 1, 1)]
    assert dict(table.manifest().folders)[folders["2024-01-02"]] == (("day", "2024-01-02"),)  # the other day's files are the old ones
    snapshots.counted_into(table, "another stream", ["day", "pid"], ["events", "qty"])(batch((two, "b", 1, 1)), 0)
    assert rows()[-1] == ("2024-01-02", "b", 2, 2)


def test_a_stream_that_restarts_counts_once(spark, tmp_path):
    source, table = str(tmp_path / "in"), Snapshots(spark, str(tmp_path / "sums"))
    write = snapshots.counted_into(table, "s", ["pid"], ["events"])
    failing = []

    def once_more(df, epoch):
        write(df, epoch)
        if failing:
            failing.pop()
            raise RuntimeError("dies after the commit, before the stream knows")

    def run():
        rows = spark.readStream.schema("pid string, events long").parquet(source)
        q = rows.writeStream.foreachBatch(once_more).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()

    data = lambda n: spark.createDataFrame([("a", 1), ("b", n)], "pid string, events long").write.mode("append").parquet(source)
    data(1)
    run()
    data(10)
    failing.append(1)
    with pytest.raises(Exception, match="dies after"):
        run()
    run()
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 11)]
