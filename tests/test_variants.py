"""JSON of any shape against plain Python."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from basketspark.functions import variants as V


def column(spark, values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "id int, j string").coalesce(1).withColumn("v", V.parsed(F.col("j")))


def test_kinds_and_texts(spark):
    texts = ['{"a": 1}', "[1]", '"x"', "1", "1.5", "1e300", "true", "null", "{", "", None, "9223372036854775807"]
    rows = column(spark, texts).select("id", V.kind(F.col("v")).alias("k"), V.text_of(F.col("v")).alias("t")).orderBy("id").collect()
    assert [r.k for r in rows] == ["object", "array", "string", "number", "number", "number", "boolean", "null", None, None, None, "number"]
    assert [rows[i].t for i in (0, 1, 2, 3, 4, 6, 7)] == ['{"a":1}', "[1]", "x", "1", "1.5", "true", None]


def test_elements_and_recordset(spark):
    rows = column(spark, [[{"pid": "a", "qty": 2}, {"pid": None, "qty": "3"}, 5, None, [1], {"qty": 1.5, "it's": {"b": 1}}], {"pid": "x"}, "nothing", [], None, [{}]])
    assert [r.n for r in rows.select("id", F.size(V.elements(F.col("v"))).alias("n")).orderBy("id").collect()] == [6, 0, 0, 0, 0, 1]
    got = V.recordset(rows.drop("j"), "v", {"pid": "string", "qty": "int", "it's": "string"}).orderBy("id").collect()
    assert [(r.id, r.pid) for r in got] == [(0, "a"), (0, None), (0, None), (5, None)]
    assert [r.qty for r in got][:2] == [2, 3] and got[2]["it's"] == '{"b":1}' and got[3].qty is None
    with pytest.raises(ValueError):
        V.recordset(rows, "v", {"id": "int"})


def expected_items(raw):
    import re

    out = []
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))
    for e in raw if isinstance(raw, list) else []:
        if len(out) >= 100:
            break
        if not isinstance(e, dict) or not text(e.get("p")):
            continue
        q = text(e.get("q")).strip()
        q = int(q) if re.fullmatch("[+-]?[0-9]+", q) and abs(int(q)) < 2**31 else 1
        pr = text(e.get("pr"))
        pr = float(pr) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", pr) else None
        out.append((text(e["p"])[:64], max(1, min(99, q)), text(e.get("n"))[:120], text(e.get("i"))[:300], text(e.get("s"))[:40], pr))
    return out


def test_cart_items(spark):
    carts = [
        [{"p": "a", "q": 3, "n": "name", "pr": 12.5}, {"p": "", "q": 1}, {"q": 4}, 7, None, "x", {"p": 17, "q": "5", "pr": "3.50"}, {"p": "b", "q": -3}, {"p": "c", "q": 1000, "pr": "-1"}],
        [{"p": "x" * 200, "n": "n" * 500, "i": "i" * 500, "s": "s" * 90, "q": "many", "pr": "1,5"}, {"p": "d", "q": 2.5, "pr": True}, {"p": "e", "q": None, "pr": None, "n": None, "s": ["z"]}, {"p": "f", "q": "99999999999"}],
        [{"p": str(i), "q": i} for i in range(150)],
        {"p": "no array"}, [], "null", "{", None,
    ]
    rows = column(spark, carts).select("id", V.cart_items(F.col("v")).alias("x")).orderBy("id").collect()
    for r, cart in zip(rows, carts, strict=True):
        assert [tuple(x) for x in r.x] == expected_items(cart)


def test_pools(spark):
    pool = [
        {"resultClass": 1, "gridbox": 2}, "product", {"data": 3}, {"fullTitle": 4, "price": 5, "brand": 9, "gift": 10}, "Pear juice",
        {"price": 6, "discount": 7, "oldPrice": 11}, 12.5, {"showDiscount": 8}, True, {"name": 99}, None, "none",
        {"resultClass": 13, "gridbox": 2}, "banner", [0, 12], {"resultClass": 1}, {"resultClass": "product", "gridbox": {"data": {"fullTitle": "Inline", "price": {"price": -1}}}},
    ]
    pages = column(spark, [pool, [], {"a": 1}, None, "{"]).drop("v")
    fields = {
        "title": ("gridbox.data.fullTitle", "string"), "price": ("gridbox.data.price.price", "double"), "offer": ("gridbox.data.price.discount.showDiscount", "boolean"),
        "old": ("gridbox.data.price.oldPrice", "double"), "brand": ("gridbox.data.brand.name", "int"), "gift": ("gridbox.data.gift", "boolean"),
    }
    got = V.pool_records(pages, "j", fields, having=["gridbox"], equal={"resultClass": "product"}).collect()
    assert [tuple(r) for r in got] == [(0, "Pear juice", 12.5, True, None, 99, None), (0, "Inline", -1.0, None, None, None, None)]
    assert [r.title for r in V.pool_records(pages, "j", {"title": ("resultClass", "string")}, having=["resultClass"]).collect()] == ["product", "banner", "product", "product"]
