"""A paged service on the loopback, read as a table and as a stream."""

from __future__ import annotations

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from basketspark.sources.paged import PagedSource

SCHEMA = "id long, name string, price double, store int, day date, more string"


class Service:
    """Rows by id; pages of which some fail at first."""

    def __init__(self):
        self.rows, self.asked, self.fail, self.status = {}, [], 0, 503
        self.failed = Counter()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                query = urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query)
                service.asked.append((query, self.headers.get("apikey")))
                service.failed[self.path] += 1
                if service.failed[self.path] <= service.fail:
                    self.send_response(service.status)
                    self.end_headers()
                    return
                body = json.dumps(service.answer(query)).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/offers"

    def answer(self, query):
        rows = list(self.rows.values())
        limit, order = 10**9, "id.asc"
        tests = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}
        for k, v in query:
            if k == "limit":
                limit = int(v)
            elif k == "order":
                order = v
            elif k != "select":
                op, _, value = v.partition(".")
                if op == "in":
                    rows = [r for r in rows if str(r.get(k)) in value.strip("()").split(",")]
                elif op in ("is", "not"):
                    rows = [r for r in rows if (r.get(k) is None) == (op == "is")]
                else:
                    rows = [r for r in rows if r.get(k) is not None and tests[op](r[k], type(r[k])(value))]
        rows.sort(key=lambda r: r["id"], reverse=order.endswith("desc"))
        return rows[:limit]


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def filled(service, ids):
    for i in ids:
        service.rows[i] = {"id": i, "name": f"vare {i}", "price": i / 4 if i % 5 else None, "store": i % 3, "day": f"2024-01-{i % 28 + 1:02}", "more": {"a": [i, "ø"]}}


def reader(spark, service, **options):
    spark.dataSource.register(PagedSource)
    out = spark.read.format("pages").schema(SCHEMA).option("url", service.url).option("wait", "0.01")
    for k, v in options.items():
        out = out.option(k, str(v))
    return out


def test_all_rows_in_ranges_of_keys(spark, service):
    filled(service, [*range(3, 400, 3), 1000, 1001, 1002])
    df = reader(spark, service, pageSize=10, partitions=5, **{"header.apikey": "secret"}).load()
    got = df.collect()
    assert df.rdd.getNumPartitions() == 5
    assert sorted(r.id for r in got) == sorted(service.rows)
    one = next(r for r in got if r.id == 6)
    assert (one.name, one.price, one.store, str(one.day), json.loads(one.more)) == ("vare 6", 1.5, 0, "2024-01-07", {"a": [6, "ø"]})
    assert all(k == "secret" for _, k in service.asked) and max(int(dict(q)["limit"]) for q, _ in service.asked) == 10


def test_pages_that_fail_twice_are_read(spark, service):
    filled(service, range(50))
    service.fail = 2
    assert reader(spark, service, pageSize=7, partitions=3).load().count() == 50
    service.fail, service.failed = 9, Counter()
    with pytest.raises(Exception, match="503"):
        reader(spark, service, retries=1).load().count()
    service.fail, service.status, service.asked = 9, 403, []
    with pytest.raises(Exception, match="403"):
        reader(spark, service).load().count()


def test_empty_and_missing(spark, service):
    assert reader(spark, service).load().count() == 0
    service.rows[7] = {"id": 7}
    assert tuple(reader(spark, service).load().first()) == (7, None, None, None, None, None)
    with pytest.raises(Exception, match="url is missing"):
        spark.dataSource.register(PagedSource)
        spark.read.format("pages").schema(SCHEMA).load().count()


def test_comparisons_reach_the_service(spark, service):
    filled(service, range(200))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = reader(spark, service, pageSize=20, pushFilters=True).load()
        got = df.filter((F.col("store") == 1) & (F.col("id") > 100) & F.col("price").isNotNull() & (F.length("name") > 6)).collect()
        assert sorted(r.id for r in got) == [i for i in range(101, 200) if i % 3 == 1 and i % 5]
        assert ("store", "eq.1") in service.asked[-1][0] and ("price", "not.is.null") in service.asked[-1][0]
        assert reader(spark, service, pushFilters=True).load().filter(F.col("id").isin(3, 5, 900)).count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_goes_on_after_what_it_had(spark, service, tmp_path):
    spark.dataSource.register(PagedSource)
    filled(service, range(25))

    def drained(n):
        rows = spark.readStream.format("pages").schema("id long, store int").option("url", service.url).option("pageSize", "4").load()
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == list(range(n))

    drained(25)
    filled(service, range(25, 40))  # after a restart
    drained(40)
    drained(40)
