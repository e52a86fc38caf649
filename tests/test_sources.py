"""Sources, sinks, small operators and entry functions on small tables with known results."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from basketspark import api, register
from basketspark.functions import parse, text
from basketspark.operators import cards, history, listing, matching, quality, recipes
from basketspark.sources import readers, writers
from basketspark.streaming import activity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_search_dump(spark, tmp_path):
    rows = [
        {"objectID": "1", "name": "a", "brand": "b", "storeData": {"s1": {"price": 1250, "before": 1500, "offer": True}, "s2": {"price": 900, "before": 0, "offer": False}}, "images": ["u"]},
        {"objectID": "1", "name": "b", "brand": "b", "storeData": {"s1": {"price": 1, "before": 0, "offer": False}}, "images": ["v"]},
        {"objectID": "2", "name": "c", "storeData": {"s9": {"price": 700, "before": 600}, "s1": {"price": 0}}, "images": ["w"]},
        {"objectID": "3", "name": "d", "storeData": {}},
    ]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    got = readers.search_dump(spark, str(tmp_path / "d.json"), ["s0", "s1"]).orderBy("objectID").collect()
    assert [(r.objectID, r.name, r.price, r.normal_price, r.on_sale, r.image_url) for r in got] == [("1", "a", 12.5, 15.0, True, "u"), ("2", "c", 7.0, None, False, "w")]


def test_leaflet_offers(spark, tmp_path):
    rows = [{"id": "2", "catalog_id": "c", "heading": "Ost", "pricing": {"price": 10, "pre_price": 12}, "quantity": "200 g"}, {"id": "1", "catalog_id": "c", "heading": "OST", "pricing": {"price": 9}, "quantity": "x"}, {"id": "3", "catalog_id": "d", "pricing": {"price": 1}}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    got = readers.leaflet_offers(spark, str(tmp_path / "l.json")).collect()
    assert [(r.id, r.name, r.price, r.normal_price, r.weight_g) for r in got] == [("1", "OST", 9.0, None, None)]


def test_snapshots_and_first_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": 1}')
    os.utime(tmp_path / "s.json", (1_700_000_000, 1_700_000_000))
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 600))
    assert readers.fresh_snapshot(spark, str(tmp_path), 11, now).count() == 1
    assert readers.fresh_snapshot(spark, str(tmp_path), 9, now).count() == 0
    empty, full = spark.range(0), spark.range(2)
    assert readers.first_source(lambda: spark.read.json(str(tmp_path / "none")), lambda: empty, lambda: full).count() == 2
    with pytest.raises(LookupError):
        readers.first_source(lambda: empty)


def test_pages_by_key(spark):
    rows = spark.range(3, 28)
    assert [r.id for r in readers.after(rows, "id", 5, 3).collect()] == [6, 7, 8]
    pages = [[r.id for r in p.orderBy("id").collect()] for p in readers.all_pages(rows, "id", 10)]
    assert [x for p in pages for x in p] == list(range(3, 28)) and [len(p) for p in pages] == [10, 10, 5]
    assert list(readers.all_pages(rows.filter("id < 0"), "id")) == []


def test_a_store_that_fails_while_read_fails_alone(spark):
    good = spark.createDataFrame([("a", "n")], "store string, name string")
    for f in spark.createDataFrame([], readers.OFFER).schema.fields:
        if f.name not in good.columns:
            good = good.withColumn(f.name, F.lit(None).cast(f.dataType))
    bad = good.withColumn("name", F.raise_error(F.lit("broken feed")))
    rows, failed = readers.all_stores({"good": lambda: good, "bad": lambda: bad})
    assert [r.store for r in rows.collect()] == ["a"] and [*failed] == ["bad"]


def test_ingest_filter(spark):
    rows = spark.createDataFrame([("a", "Deli", 1.0, "c", "5"), ("b", "Deli", 1.0, "c", "5"), ("b", "x", 0.0, "c", "5"), ("a", None, 2.0, "c", "5"), ("a", "x", 1.0, None, "5"), ("b", "y", None, "c", "5")], "store string, brand string, price double, category string, ean string")
    got = readers.ingestible(rows, {"a": "deli"}, ["b"]).collect()
    assert sorted((r.store, str(r.brand), r.ean) for r in got) == [("a", "None", "5"), ("b", "Deli", None)]


PAGE = '<script type="application/ld+json">{}</script>'


@pytest.mark.parametrize(
    ("node", "expected"),
    [
        ({"@type": ["Thing", "Recipe"], "name": " Suppe ", "recipeYield": ["4 personer"], "recipeIngredient": "2 dl vand", "image": ["u", "v"], "author": [{"name": "A"}], "totalTime": "PT1H30M"}, ("Suppe", "A", "u", 4, 90, ["2 dl vand"])),
        ([{"@type": "Thing"}, {"@graph": [{"@type": "WebSite"}, [{"@type": "Recipe", "ingredients": [" a ", "", "b"], "recipeYield": 6, "image": {"url": "w"}}]]}], ("Unavngivet opskrift", "", "w", 6, None, ["a", "b"])),
        ({"@graph": {"@type": "Recipe", "name": "x", "image": [{"url": "i"}], "author": {"name": "B"}, "recipeYield": "ca. 3-4"}}, ("x", "B", "i", 3, None, [])),
        ({"@type": "Recipe", "name": "y", "author": "C", "image": "j"}, ("y", "C", "j", None, None, [])),
        ({"@type": "Thing"}, None),
    ],
)
def test_json_ld_in_all_forms(spark, node, expected):
    html = PAGE.format("{not json") + PAGE.format(json.dumps(node)) + PAGE.format('{"@type": "Recipe", "name": "later"}')
    got = readers.json_ld_recipes(spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id long, html string")).collect()
    want = expected or ("later", "", "", None, None, [])
    assert [(r.page_id, (r.name, r.source, r.image, r.servings, r.minutes, r.ingredients)) for r in got] == [(1, want)]


def test_swaps_are_staged(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.swap(spark.createDataFrame([(1,), (2,)], "id int"), path)
    with pytest.raises(Exception, match="dies"):
        writers.swap(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("dies")).cast("int")).otherwise(1).alias("id")), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    writers.swap(spark.createDataFrame([(3,)], "id int"), path)
    assert [r.id for r in spark.read.parquet(path).collect()] == [3]
    two = str(tmp_path / "p")
    writers.swap(spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "id int, store string, kind string"), two, "store", "kind")
    writers.swap(spark.createDataFrame([(9, "a", "y")], "id int, store string, kind string"), two, "store", "kind")
    assert sorted((r.id, r.store, r.kind) for r in spark.read.parquet(two).collect()) == [(1, "a", "x"), (3, "b", "x"), (9, "a", "y")]


def test_chunks_and_batches(spark, tmp_path):
    path = str(tmp_path / "c")
    writers.in_chunks(spark.range(25).coalesce(1), path, 10)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 3 and spark.read.parquet(path).count() == 25
    assert spark.read.parquet(f"{path}-index").first().asDict() == {"id": 0, "rows": 25, "chunks": 3}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["aaaa", "bb", "c", "dddddddddddd", None, "é"])], "id int, s string").coalesce(1)
    got = writers.by_bytes(rows, "s", 6).orderBy("id").collect()
    assert [r.batch.split("-")[1] for r in got] == ["0", "0", "1", "2", "2", "3"]


def test_outbox(spark):
    rows = spark.createDataFrame([(1, 5), (2, 3), (3, 4)], "id int, created int")
    send, rest = writers.drained(rows, spark.createDataFrame([(2,)], "id int"), 2)
    assert [r.id for r in send.collect()] == [2, 3] and sorted(r.id for r in rest.collect()) == [1, 3]


def test_visibility_caps_and_first_seen(spark):
    rows = spark.createDataFrame([(1, "approved", "a"), (2, "new", "a"), (3, "new", None)], "id int, status string, owner string")
    assert [r.id for r in quality.visible(rows, "a").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in quality.visible(rows, None).collect()] == [1]
    have = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "owner string, key int")
    new = spark.createDataFrame([("a", 0), ("a", 9), ("b", 9), ("c", 1)], "owner string, key int")
    assert sorted(map(tuple, quality.capped(new, have, 3).collect())) == [("a", 0), ("b", 9), ("c", 1)]
    seen = listing.first_seen(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, image string"), "image", "id")
    assert sorted(r.id for r in seen.collect()) == [1, 3]
    assert matching.assembled(rows, rows.select("id")).count() == 6
    assert [r.product_id for r in history.unresolved(spark.createDataFrame([("p",), ("q",)], "product_id string"), spark.createDataFrame([("p", 1.0)], "product_id string, price double")).collect()] == ["q"]


def test_small_parsers(spark):
    assert one(spark, parse.oere(F.lit("1250"))) == 12.5 and one(spark, parse.oere(F.lit("x"))) is None
    assert one(spark, parse.list_id(F.lit("a b/1_-"))) == "ab1_-" and one(spark, parse.list_id(F.lit("/"))) is None
    assert one(spark, parse.like_escaped(F.lit(" 50%_A\\ "))) == "50\\%\\_a\\\\"
    assert tuple(one(spark, text.query_parts(F.lit(" Øko  mælk ")))) == ("mælk", True)
    assert one(spark, parse.store_name_id(F.lit("s"), F.lit(""))) is None and one(spark, parse.store_name_id(F.lit("s"), F.lit("mælk"))).startswith("sname:s:")
    assert one(spark, parse.effective_price(F.lit(5.0), F.lit(None).cast("double"))) == 5.0
    assert one(spark, parse.is_cheaper(F.lit(1.0), F.lit(1.0005))) is False and one(spark, parse.is_equal_price(F.lit(1.0), F.lit(1.005))) is True
    for unit, name in (("pakker", "pakke"), ("spiseskeer", "spsk"), ("kilo", "kg"), ("fl.", "flaske")):
        assert tuple(one(spark, parse.ingredient(F.lit(f"2 {unit} smør")))) == (2.0, name, "smør")


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Skåret skinke, 150 g. 66,33 kr/kg", ("Skåret skinke", "150 g", "66,33 kr/kg")), ("Frit valg. Flere slags", ("Frit valg", "", "")), ("10 STK", ("", "10 stk", "")), ("Saft 1.5 L, 12/l", ("Saft", "1.5 l", "12 kr/l")), ("", ("", "", ""))],
)
def test_leaflet_description(spark, given, expected):
    assert tuple(one(spark, parse.leaflet_description(F.lit(given)))) == expected


def test_local_keys(spark):
    for ts, month, day in ((dt.datetime(2024, 1, 31, 23, 30), "2024-02", 1), (dt.datetime(2024, 6, 30, 22, 30), "2024-07", 1), (dt.datetime(2024, 6, 30, 21, 30), "2024-06", 30)):
        assert one(spark, parse.local_month(F.lit(ts))) == month
        assert one(spark, parse.local_day_of_month(F.lit(ts))) == day and one(spark, parse.local_day(F.lit(ts))) == f"{month}-{day:02d}"


def test_saved_lists(spark):
    item = "struct<p: string, q: string, n: string, pr: string>"
    rows = [("a/b", " Uge ", [("p", "2", "n", "1")]), ("", "", [("p", None, None, None)]), ("c", "tom", []), *[(f"x{i}", "n", [("p", "1", "n", "1")]) for i in range(12)]]
    got = spark.createDataFrame([(rows,)], f"lists array<struct<id: string, name: string, items: array<{item}>>>").select(parse.saved_lists(F.col("lists")).alias("x")).first()["x"]
    assert len(got) == 10 and (got[0].id, got[0].name) == ("ab", "Uge") and got[1].name == "Liste" and len(got[1].id) == 12 and got[2].id == "x0"


def test_search_keywords(spark):
    lexicon = {"hindbær": "raspberry", "hyldeblomst": "elderflower", "choko": "chocolate", "choco": "chocolate"}
    got = lambda t, u: one(spark, text.search_keywords(F.lit(t).cast("string"), F.lit(u).cast("string"), lexicon))
    assert got("Chokomælk", None) == "choco chocolate choko"
    assert got(None, "https://x/hyldebl-saft_1.png") == "elderflower hyldeblomst" and got("x", "y") == ""


def test_maps_of_prices(spark):
    df = spark.createDataFrame([(1, {"a": 1.0, "b": 0.0}, {"a": 9.0, "b": 2.0, "c": -1.0})], "id int, x map<string,double>, y map<string,double>")
    r = df.select(cards.merged_prices(F.col("x"), F.col("y")).alias("m"), cards.merged_prices(F.lit(None).cast("map<string,double>"), F.col("y")).alias("n"), cards.relabelled(F.col("x"), {"a": "A"}).alias("l"), cards.delimited(F.map_keys("y")).alias("d")).first()
    assert r.m == {"a": 1.0, "b": 2.0} and r.n == {"a": 9.0, "b": 2.0} and r.l == {"A": 1.0, "b": 0.0} and r.d == "|a|b|c|"
    assert [(o.product_id, o.store, o.price) for o in cards.offers(df.withColumn("prices", F.col("x"))).collect()] == [(1, "a", 1.0)]
    structs = df.select(F.transform_values("x", lambda k, v: F.struct(v.alias("price"), F.lit(1).alias("_t"), F.lit(2).alias("_u"))).alias("s"))
    assert structs.select(cards.without(F.col("s"), "_t", "_u").alias("s")).schema["s"].dataType.simpleString() == "map<string,struct<price:double>>"


def test_chosen_stores():
    known = ("a", "b", "c")
    assert cards.chosen_stores("a, b,zz,", None, known) == {"a", "b"} and cards.chosen_stores("", ["a"], known) == set()
    assert cards.chosen_stores(None, None, known) is None and cards.chosen_stores(None, [" a "], known, ["c"]) == {"a", "c"}
    assert cards.chosen_stores(",".join(["x"] * 20 + ["a"]), None, known) == set()


def test_displayed_cards(spark):
    match = "struct<name: string, price: string, normal_price: string, is_sale: boolean, image: string, brand: string, description: string, weight: string, kg_price: string, multi_deal: string, ean: string, category: string>"
    rows = [("1", "Mælk", 14.95, 11.5, "None", "øko", None, "1 l", None, {"s": ("n", "12", "15", True, "i", "nan", "d", "1 l", "x", None, "57", None)}), (None, None, 5.0, None, None, None, "c", "x", 7.0, {})]
    df = spark.createDataFrame(rows, f"id string, title string, price double, sale_price double, brand string, description string, category string, unit_measure string, weight_g double, store_matches map<string,{match}>")
    a, b = cards.display(df).orderBy(F.desc("id")).collect()
    assert (a.price, a.normal_price, a.is_sale, a.brand, a.category, a.weight_g, a.has_match) == (11.5, 14.95, True, "", "Andre varer", 1000.0, True)
    assert (a.store_matches["s"].price, a.store_matches["s"].kg_price, a.store_matches["s"].brand, a.store_matches["s"].multi_deal) == (12.0, None, "", "")
    assert (b.name, b.price, b.is_sale, b.weight_g, b.has_match) == ("Ukendt vare", 5.0, False, 7.0, False)
    pool = spark.createDataFrame([(i, "c", "s", "A", float(i % 4)) for i in range(9)], "id int, category string, subcategory string, store string, price double")
    assert sorted(r.id for r in cards.cheapest_pool(pool, 3).collect()) == [0, 4, 8]


def test_recipe_lists_and_details(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "recipe_id long, created string")
    snaps = spark.createDataFrame([(1, 50.0, 3, 4, 2), (2, 10.0, 1, 1, 1)], "recipe_id long, total double, matched int, lines int, on_sale int")
    points = spark.createDataFrame([(3, 7, 1)], "recipe_id long, points int, clicks int")
    got = recipes.listed(rows, snaps, points).collect()
    assert [(r.recipe_id, r.sale_ratio, r.points, r.matched) for r in got] == [(2, 1.0, 0, 1), (1, 0.5, 0, 3), (3, 0.0, 7, 0)]
    assert [r.recipe_id for r in recipes.listed(rows, snaps, points, "points").collect()] == [3, 2, 1]
    lines = spark.createDataFrame([(1, 0, 10, [11, 10]), (1, 1, None, None), (1, 2, None, [12])], "recipe_id long, position int, matched long, candidates array<bigint>")
    products = spark.createDataFrame([(10, "a", 1.0, ["x", "k"]), (11, "b", 2.0, ["z"])], "product_id long, name string, price double, keys array<string>")
    found = recipes.detail(lines, products, spark.createDataFrame([("k", "kk")], "key string, payload string")).collect()
    assert sorted(((r.position, r.product_id, r.name, r.is_matched, r.payload) for r in found), key=str) == sorted([(0, 10, "a", True, "kk"), (0, 11, "b", False, None), (1, None, None, False, None), (2, 12, None, False, None)], key=str)


def test_price_alerts(spark):
    rows = [(1, at(0), 1, "p", 10.0, 12.0, "e"), (1, at(0.5), 2, "q", 10.0, 12.0, "e"), (1, at(2), 3, "q", 9.0, 12.0, "e"), (1, at(4), 4, "r", 9.0, 12.0, "e"), (1, at(6), 5, "p", 8.0, 12.0, "e"), (1, at(8), 6, "s", 0.0, 1.0, "e"), (2, at(0), 7, "p", 5.0, 5.0, None), (None, at(0), 8, "p", 5.0, 5.0, "e")]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, pid string, target double, current double, email string")
    got = activity.price_alerts(df, most=2)
    assert sorted((r.user_id, r.product_id, r.target_price, r.notified_at) for r in got.collect()) == [(1, "p", 8.0, None), (1, "q", 9.0, None)]
    prices = spark.createDataFrame([("p", 8.0), ("q", 9.5)], "product_id string, price double")
    due, marked = activity.fired(got, prices, F.lit(at(99)))
    assert [r.product_id for r in due.collect()] == ["p"]
    again, _ = activity.fired(marked, prices, F.lit(at(100)))
    assert again.count() == 0 and {r.product_id: r.notified_at for r in marked.collect()} == {"p": at(99), "q": None}


def test_cooled_clicks(spark):
    rows = spark.createDataFrame([(5, 1, at(0)), (5, 2, at(0.9)), (5, 3, at(1.0)), (6, 4, at(0.1))], "recipe_id long, event_id long, ts timestamp")
    assert sorted(r.event_id for r in activity.cooled(rows, "recipe_id").collect()) == [1, 3, 4]


def test_shared_carts(spark):
    rows = [(1, at(0), 1, 7, "join", None), (1, at(1), 2, 8, "join", None), (1, at(2), 3, 9, "write", "no"), (1, at(3), 4, 8, "write", "x"), (1, at(4), 5, 7, "leave", None), (2, at(0), 6, 7, "join", None), (2, at(1), 7, 7, "leave", None)]
    df = spark.createDataFrame(rows, "cart_id long, ts timestamp, event_id long, user_id long, action string, items string").repartition(3)
    assert [tuple(r) for r in activity.shared_carts(df).collect()] == [(1, 8, 1, 1, "x")]


def test_functions_for_sql(spark):
    register.register(spark)
    r = spark.sql("SELECT fuzzy_score('red ring', 'ring red') AS s, normalize_name('HK. Okse 4%') AS n, parse_weight_g('6 x 0.33 liter') AS w").first()
    assert (r.s, r.n, r.w) == (1.0, "hakket okse 4", 1980.0)
    lines = spark.sql("SELECT * FROM parse_ingredients('2 dl mælk\n\n3-4 æg\nsalt\n1/2 spsk. olie') ORDER BY position").collect()
    assert [tuple(x) for x in lines] == [(0, 2.0, "dl", "mælk"), (2, 3.5, "", "æg"), (3, None, "", "salt"), (4, 0.5, "spsk", "olie")]


def test_twins_for_sql_agree_with_the_columns(spark):
    rng = random.Random(1)
    words = ["HK.", "øko", "Økologisk", "eks", "f.eks.", "smør & brød", "Café", "Blå", "vanilla", "4,5%", " eko", " bio ", "A/S", "lay's", "kart/champ", "nan", "okologisk", "x_hk", "sc", "ﬁn", "½"]
    names = [None, "", "nan", *(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(300))]
    weights = [None, "", "500 g", "1,5 L", "6 x 0.33 liter", "3 stk", "12cl", " 2 dl ", "x 3 g", "3 x g", "1.5.2 kg", "0,25 kg"]
    plain = [n for n in names if n is None or "ﬁ" not in n and "½" not in n]
    got = spark.createDataFrame([(n,) for n in plain], "x string").select("x", text.normalized(F.col("x")).alias("y")).collect()
    assert all(r.y == register.normalize_name(r.x) for r in got)
    got = spark.createDataFrame([(w,) for w in weights], "x string").select("x", parse.weight_grams(F.col("x")).alias("y")).collect()
    assert all(r.y == register.parse_weight_g(r.x) for r in got)


def test_entry_functions(spark):
    rows = [(i, f"{w} juice", w, "drinks" if i % 2 else "food", 10.0 + i, 10.0 + i, i % 3 == 0, 100.0 * i, ["a"] if i % 2 else ["a", "b"], i % 4 == 0, i, 1.0) for i, w in enumerate(["apple", "orange", "pear", "plum", "grape", "cherry"])]
    df = spark.createDataFrame(rows, "id long, name string, title string, category string, price double, eff_price double, is_sale boolean, weight_g double, stores array<string>, organic boolean, staple long, rebate double")
    assert [r.id for r in api.category(df, "food", stores=["b"], price=(None, 12.5)).collect()] == [0, 2]
    assert [r.id for r in api.sale(df, order="price-desc").collect()] == [3, 0]
    assert [r.id for r in api.search(df, "pear juice").collect()] == [2] and [r.id for r in api.search(df, "cherri").collect()] == [5]
    assert [r.id for r in api.search(df, "øko").collect()] == [0, 4]
    assert [r.key for r in api.autocomplete(df, "p").collect()] == ["pear juice", "plum juice"]
    assert api.products(df, [1, 9]).count() == 1 and api.products(df, []).count() == 0
    popular = spark.createDataFrame([(1, 5)], "id long, count long")
    assert {r.id for r in api.home(df, popular).collect()} == set(range(6)) and {r.id for r in api.home(df, popular, ["b"]).collect()} == {0, 2, 4}
    prices = spark.createDataFrame([(1, 0, dt.date(2024, 1, 1), 9.0), (1, 0, dt.date(2024, 1, 3), 8.0)], "product_id long, store int, date date, price double")
    assert api.product(df, prices, 1).first()["lowest"] == 8.0
    assert [r.price for r in api.price_history(prices, 1, 3).orderBy("date").collect()] == [9.0, None, 8.0]
    assert [tuple(r) for r in api.stores(prices).collect()] == [(0, 1)]
