"""Queries on tables whose groups are larger than those of the test tables, against DuckDB and brute force."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from basketspark import catalog
from basketspark.functions import gates
from basketspark.operators import basket, history, matching, recipes
from basketspark.plans import baskets


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return None if v is None else str(v)


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives what its SQL gives, on tables made by SQL."""

    def check(name: str, **tables: str) -> list:
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        out = con.execute(catalog.SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == sorted(df.columns)
        got = sorted(str([plain(r[c]) for c in names]) for r in df.collect())
        assert got == sorted(str([plain(v) for v in r]) for r in out.fetchall())
        return got

    return check


PART = """SELECT i AS p_partkey, ['Red ring', 'Blue ring', 'hot bolt', 'Small gear', 'cold widget'][i % 5 + 1] AS p_name, 'Brand#' || i % 7 AS p_brand, ['SMALL', 'LARGE', 'PROMO'][i % 3 + 1] AS p_type,
    CAST(1 + i * 7 % 50 AS INT) AS p_size, 900 + i % 300 / 10 AS p_retailprice FROM range({n}) t(i)"""


def test_carts_of_more_than_a_hundred_items(same):
    assert len(same("compact_carts", part=PART.format(n=60_000))) == 500


def test_alarms_of_kinds_without_a_limit_of_their_own(same):
    """More than 1,000 events of a kind in an hour."""
    kinds = "['view', 'click', 'error', 'signup'][i % 4 + 1]"
    got = same("security_totals", events=f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i // 2) AS ts, i % 9 AS user_id, {kinds} AS event_type, 1.5 AS value, '{{\"k\": 7}}' AS props FROM range(9000) t(i)")
    assert len(got) == 4


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_need_is_decided_once(spark):
    """Prices that cost the same in whole hundredths are settled by the smallest id, and needs are made distinct before the packages come in."""
    rng = random.Random(5)
    packs = [(i % 3, i, rng.choice([100.0, 250.0, 400.0]), rng.choice([10.0, 10.0000000001, 10.001, 10.004, 10.02, 12.5])) for i in range(90, 0, -1)]
    needs = [(i, i % 4, 100 + i % 7 * 150) for i in range(400)]
    df = recipes.scaled_pick(spark.createDataFrame(needs, "need_id long, ingredient_id long, needed_g long"), spark.createDataFrame(packs, "ingredient_id long, product_id long, weight_g double, price double"))
    want = set()
    for n, g, need in needs:
        found = sorted((round(max(-(-need // w), 1) * p, 2), max(-(-need // w), 1), i) for k, i, w, p in packs if k == g)
        want |= {(n, found[0][2], int(found[0][1]), found[0][0])} if found else set()
    assert {tuple(r) for r in df.select("need_id", "product_id", "units", "cost").collect()} == want and len(want) == 300
    assert "keys=[ingredient_id" in plan(df)


def test_a_line_meets_its_cheapest_offer_only(spark):
    lines = spark.createDataFrame([(1, 1, 7), (1, 1, 8), (1, 2, 8), (2, 1, 9), (3, 1, 7)], "recipe_id long, position int, product_id long")
    offers = spark.createDataFrame([(7, 3, 5.0, True), (7, 2, 5.0, False), (8, 1, 5.0, True), (8, 2, 6.0, True)], "product_id long, store long, price double, on_sale boolean")
    df = recipes.snapshot(lines, offers)
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, 2, 10.0, {"1": 10.0}), (3, 1, 0, 5.0, {"2": 5.0})]
    assert "min(struct(price" in plan(df)


def test_days_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, 1, "2024-01-05", 3.0), (1, 1, "2024-01-05", 4.0), (1, 2, "2023-01-01", 9.0), (2, 1, "2024-01-04", None)], "product_id long, store long, date string, price double").withColumn("date", F.to_date("date"))
    df = history.spine(rows, 3)
    got = sorted((r.product_id, r.store, str(r.date)[-2:], r.price or 0.0) for r in df.collect())
    assert got == [(1, 1, "03", 0.0), (1, 1, "04", 0.0), (1, 1, "05", 3.0), (1, 1, "05", 4.0), *((1, 2, d, 0.0) for d in ("03", "04", "05")), *((2, 1, d, 0.0) for d in ("03", "04", "05"))]
    assert "Join" not in plan(df)


LINES = "SELECT i // 3 AS l_orderkey, i * 7 % 97 AS l_partkey, i * 5 % 17 AS l_suppkey, CAST(i % 3 AS INT) AS l_linenumber, 1.0 + i % 9 AS l_quantity, 100.0 * (1 + i % 23) AS l_extendedprice, i % 5 / 40 AS l_discount, 'A' AS l_returnflag, TIMESTAMP '2024-01-01' + to_days(CAST(i % 40 AS INT)) AS l_shipdate FROM range(600) t(i)"


@pytest.mark.parametrize("name", ["basket_missing", "basket_exclusive", "basket_route", "full_coverage_range", "basket_compare", "live_override"])
def test_lines_and_stores(same, name):
    assert same(name, lineitem=LINES)


def test_stores_are_told_apart_after_the_shuffle_by_cart(spark):
    lines = spark.createDataFrame([(1, 1, 5), (1, 2, 1)], "cart_id long, item_id long, quantity int")
    offers = spark.createDataFrame([(1, "A", 10.0, "2 for 15"), (1, "B", 9.0, None), (2, "A", 3.0, None)], "item_id long, store string, price double, deal string")
    rows = basket.priced(lines, offers)
    assert {(r.item_id, r.store, r.price, r.cost) for r in rows.collect()} == {(1, "A", 10.0, 40.0), (1, "B", 9.0, 45.0), (2, "A", 3.0, 3.0)}
    text = plan(rows)
    assert 0 < text.index("Generate posexplode") < text.index("hashpartitioning(cart_id")
    for df in (basket.missing_of(basket.in_stores(lines, offers)), basket.spread(basket.in_stores(lines, offers))):
        assert plan(df).count("hashpartitioning(cart_id") == 1 and "posexplode" not in plan(df)
    assert plan(basket.full_range(basket.in_stores(lines, offers))).count("hashpartitioning(cart_id") == 1


def test_live_prices_are_merged_once_an_item(spark):
    cart = spark.createDataFrame([(c, i, 1, s, p) for c in (1, 2) for i, s, p in ((1, "A", 5.0), (1, "B", 6.0), (2, "A", 7.0))], "cart_id long, item_id long, quantity int, store string, price double")
    live = spark.createDataFrame([(1, "B", 1.0), (1, "C", 2.0), (3, "A", 3.0)], "item_id long, store string, price double")
    offers = basket.live_offers(cart.select("item_id", "store", "price").distinct(), live)
    got = cart.select("cart_id", "item_id", "quantity").distinct().join(offers, "item_id").select("cart_id", "item_id", "quantity", "store", "price")
    assert sorted(got.collect()) == sorted(basket.with_live(cart, live).collect())


def test_conflicts_without_pairs(spark):
    rng = random.Random(3)
    anchors = [(2 * i, rng.choice([None, 100.0]), rng.choice([[], [], [1.0]])) for i in range(40)]
    offers = [(2 * i + 1, rng.choice([None, 50.0, 60.0, 100.0, 110.0, 125.0, 400.0]), rng.choice([[], [1.0], [1.0, 2.0], [3.0]]), rng.choice([None, "e", "f", "g"])) for i in range(60)]
    matches = [(a[0], o[0], o[3]) for a in anchors for o in rng.sample(offers, rng.randrange(1, 6))]
    side = "id long, weight_g double, percents array<double>"
    df = matching.conflicts(spark.createDataFrame(matches, "anchor long, offer long, ean string"), spark.createDataFrame(anchors, side), spark.createDataFrame(offers, side + ", ean string"))
    facts = {x[0]: x for x in anchors + offers}
    fits = lambda a, b: a is None or b is None or abs(a - b) <= max(min(20.0, 0.25 * max(a, b)), 0.08 * max(a, b))
    want = set()
    for a, x, e in matches:
        for b, y, f in matches:
            if a == b and x != y and not (e is not None and e == f):
                (_, w, p), (_, v, q, _), (_, u, r, _) = facts[a], facts[x], facts[y]
                if w is None and not fits(v, u) or not p and q and r and not {*q} & {*r}:
                    want.add((a, x))
    assert {tuple(r) for r in df.collect()} == want and 40 < len(want) < len(matches)
    assert "y_ean" not in plan(df)


def test_anchors_alike_are_decided_once(same):
    assert len(same("pairwise_conflicts", part=PART.format(n=900))) > 1000


def test_a_large_group_is_dealt_over_parts(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0] if i % 3 == 0 else [2.0] if i % 3 == 1 else []) for i in range(60)], "id long, size int, p array<double>")
    df = matching.pairs_within(rows, "size", gates.overlap_if_known(F.col("a_p"), F.col("b_p")), ["p"], 4)
    p = lambda i: i % 3
    assert sorted(map(tuple, df.collect())) == [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and (2 in (p(a), p(b)) or p(a) == p(b))]


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_pairs_of_blocks(spark, monkeypatch, block):
    """Ids in no order, some of them twice, of groups and percentages that may be unknown."""
    monkeypatch.setattr(matching, "BLOCK", block)
    rng = random.Random(6)
    rows = [(rng.randrange(80), rng.choice([1, 1, 2, None]), rng.choice([[], [1.0], [2.0], [1.0, 2.0]])) for _ in range(120)]
    df = matching.pairs_within(spark.createDataFrame(rows, "id long, size int, p array<double>"), "size", gates.overlap_if_known(F.col("a_p"), F.col("b_p")), ["p"], 3)
    want = sorted((a, b) for a, s, p in rows for b, t, q in rows if s is not None and s == t and a < b and (not p or not q or {*p} & {*q}))
    assert sorted(map(tuple, df.collect())) == want and len(want) > 1000


def test_written_pairs_take_little_room(spark, tmp_path):
    """Less than half a byte for a pair, as partners stand in order of blocks."""
    rows = spark.range(6000).select((F.col("id") * 77 % 6007).alias("id"), (F.col("id") % 2).alias("size"), F.array().cast("array<double>").alias("p"))
    matching.pairs_within(rows, "size", gates.overlap_if_known(F.col("a_p"), F.col("b_p")), ["p"], 2).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 2 * 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").rglob("*.parquet")) < 0.5 * 3000 * 2999


def test_percent_gate_deals_sizes_over_parts(spark, sf_dir):
    assert "part" in plan(catalog.QUERIES["percent_gate"](spark, sf_dir))


def test_candidates_meet_ingredients_once_a_text(spark):
    """However many candidates a text has, an ingredient meets its best ones only."""
    products = spark.range(3000).select(F.col("id").alias("product_id"), F.concat(F.lit("red ring "), F.col("id") % 60).alias("name"))
    lines = spark.range(400).select((F.col("id") % 390).alias("ingredient_id"), F.concat(F.lit("red ring "), F.col("id") % 7).alias("ingredient"))
    df = recipes.candidates(lines, products)
    rows = df.collect()
    assert all(len([r for r in rows if r.ingredient_id == i]) == 5 for i in range(0, 390, 13))
    assert {(r.product_id, r.score, r.rank) for r in rows if r.ingredient_id == 20} == {(6 + 60 * n, 1.0, n + 1) for n in range(5)}
    joins = df._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in joins and "collect_list" in joins


def test_lines_of_recipes_are_dealt_by_their_number(spark, same, tmp_path, monkeypatch):
    monkeypatch.setattr(baskets, "LINES_A_TASK", 500)
    lines = "SELECT i // 3 AS l_orderkey, i % 3 AS l_linenumber, i * 7 % 900 AS l_partkey, CAST(i % 40 AS DOUBLE) AS l_quantity FROM range(9000) t(i)"
    got = same("recipe_nutrition", lineitem=f"{lines} UNION ALL {lines}", part=PART.format(n=600))
    assert len(got) > 3000
    parts = baskets._parts(spark, str(tmp_path))
    assert parts == 36
    rows = baskets._recipe_lines(spark, str(tmp_path), parts).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert rows < 1000
    assert plan(catalog.QUERIES["recipe_nutrition"](spark, str(tmp_path))).count("REPARTITION_BY_NUM") >= 3


def test_alternatives_without_pairs_in_a_shuffle(spark, tmp_path, monkeypatch):
    """Names are taken apart once each, and cards of one similarity are reduced where they meet."""
    duckdb.connect().execute(f"COPY ({PART.format(n=1200)}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    seen, words = [], basket.similar_words
    monkeypatch.setattr(basket, "similar_words", lambda cards: seen.append(cards.count()) or words(cards))
    got = catalog.QUERIES["alternatives_best"](spark, str(tmp_path))
    assert seen == [140]
    assert "partial_min" in plan(got)
