from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketspark import checkpoints, register
from basketspark.functions import gates, similarity
from basketspark.operators import basket, claiming, history, listing, matching, quality, recipes
from basketspark.plans import matches
from basketspark.sources import readers, writers
from basketspark.streaming import activity


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "ok"), [(20.0, 40.0, False), (100.0, 150.0, False), (1000.0, 1050.0, True), (1000.0, 1085.0, True), (1000.0, 1090.0, False), (75.0, 100.0, False), (80.0, 100.0, True), (None, 5.0, True)])
def test_weight_gate(spark, a, b, ok):
    x, y = F.lit(a).cast("double"), F.lit(b).cast("double")
    assert one(spark, gates.weights_compatible(x, y)) is ok
    assert one(spark, gates.weights_compatible(y, x)) is ok


@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
@settings(max_examples=200, deadline=None)
def test_similarity_is_that_of_the_table(a, b):
    table = [[0] * (len(b) + 1)]
    for c in a:
        row = [0]
        for j, d in enumerate(b):
            row.append(table[-1][j] + 1 if c == d else max(table[-1][j + 1], row[j]))
        table.append(row)
    assert similarity.common_length(a, b) == table[-1][-1]
    if a and b:
        assert similarity.ratio(a, b) <= 2 * min(len(a), len(b)) / (len(a) + len(b)) + 1e-12
    assert similarity.score(a, b) == similarity.score(b, a)


def test_similarity_by_functions_alone(spark):
    rows = spark.createDataFrame([("red ring", "ring red"), ("gizmo", "gizmos"), ("ab", "")], "a string, b string")
    for r in rows.select("a", "b", similarity.indel_ratio(F.col("a"), F.col("b")).alias("x")).collect():
        assert r["x"] == pytest.approx(similarity.ratio(r["a"], r["b"]))
    assert similarity.score("red ring", "ring red") == 1.0


def test_usual_price(spark):
    day = lambda n: dt.date(2024, 3, 31) - dt.timedelta(n)
    rows = [("p", 1, day(0), 10.0), ("p", 1, day(1), 10.0), ("p", 1, day(2), 12.0), ("p", 2, day(3), 8.0), ("p", 2, day(4), 9.0), ("q", 1, day(30), 5.0), ("q", 1, day(31), 1.0)]
    prices = spark.createDataFrame(rows, "product_id string, store int, date date, price double")
    assert {(r.product_id, r.store): r.usual_price for r in history.usual(prices).collect()} == {("p", 1): 10.0, ("p", 2): 9.0, ("q", 1): 5.0}
    assert {r.product_id: r.lowest for r in history.lowest(prices).collect()} == {"p": 8.0, "q": 5.0}


def test_cheapest_store_has_a_tolerance(spark):
    rows = spark.createDataFrame([(1, 0, 10.0), (1, 1, 9.9995), (2, 0, 10.0), (2, 3, 9.0)], "product_id int, store int, price double").withColumn("ord", F.col("store"))
    assert {r.product_id: r.store for r in history.cheapest_store(rows).collect()} == {1: 0, 2: 3}


def test_basket(spark):
    rows = [(1, 1, "A", 20.0), (1, 1, "B", 18.0), (1, 1, "C", 22.0), (1, 2, "A", 20.0), (1, 2, "B", 15.0)]
    priced = spark.createDataFrame(rows, "cart_id int, item_id int, store string, cost double")
    got = {r.store: (r.total, r.coverage) for r in basket.compare(priced).collect()}
    assert got == {"A": (40.0, 2), "B": (33.0, 2), "C": (22.0, 1)}
    assert [r.store for r in basket.ranked(basket.compare(priced)).orderBy("rank").collect()] == ["B", "A", "C"]
    assert [(r.item_id, r.store) for r in basket.missing(priced).collect()] == [(2, "C")]


def test_routes_go_by_price_and_deals_by_cost(spark):
    lines = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "cart_id int, item_id int, quantity int")
    offers = spark.createDataFrame([(1, "A", 10.0, None), (1, "B", 12.0, "2 for 18"), (2, "A", 20.0, None), (2, "C", 15.0, "x")], "item_id int, store string, price double, deal string")
    rows = basket.priced(lines, offers)
    assert {(r.item_id, r.store): r.cost for r in rows.collect()} == {(1, "A"): 20.0, (1, "B"): 18.0, (2, "A"): 20.0, (2, "C"): 15.0}
    routed = basket.route(rows, F.col("store").isin("B"))
    assert {(r.item_id, r.store, r.cost) for r in routed.collect()} == {(1, "B", 24.0), (2, "C", 15.0)}
    got = basket.route_saving(rows, routed).first()
    assert (got.route_total, got.stops, got.single_total, got.saving) == (39.0, 2, 15.0, 0.0)


def test_alternatives_by_all_rules(spark, sf_dir):
    rows = [Card(r) for r in basket.similar_words(matches.m.cards(spark, sf_dir).select("id", F.concat_ws(" ", "name", F.expr("CASE id % 6 WHEN 0 THEN 'økologisk' WHEN 1 THEN 'okse' WHEN 2 THEN 'gris' ELSE '' END")).alias("name"), "brand", "category", "subcategory", F.col("price").cast("double").alias("price"), "weight_g", "store")).collect()]
    firsts = {}
    for r in rows:
        firsts[r.brand, r.name] = min(firsts.get((r.brand, r.name), r.id), r.id)
    want = {}
    for w in (r for r in rows if r.id in firsts.values()):
        stores = {}
        for c in rows:
            if c.id == w.id or (c.category, c.subcategory, c.flags) != (w.category, w.subcategory, w.flags) or not 0.4 * w.price <= c.price <= 2 * w.price:
                continue
            if w.weight_g and c.weight_g and abs(w.weight_g - c.weight_g) > 0.25 * max(w.weight_g, c.weight_g) or not w.meaty(c):
                continue
            s = round(similarity.score(c.norm, w.norm), 6)
            if s >= 0.35 and ({*c.words} - {*c.brand_words}) & {*w.words}:
                stores.setdefault(c.store, []).append((s, c))
        for store, found in stores.items():
            top = max(s for s, _ in found)
            want[w.id, store] = min((c.price, -s, c.id) for s, c in found if s >= top - 0.12)[2]
    from basketspark.plans import baskets

    assert {(r.wanted_id, r.store): r.id for r in baskets.alternatives_best(spark, sf_dir).collect()} == want and len(want) > 50


def test_live_prices_override(spark):
    cart = spark.createDataFrame([(1, 1, 1, "A", 10.0), (1, 1, 1, "B", 12.0)], "cart_id int, item_id int, quantity int, store string, price double")
    live = spark.createDataFrame([(1, "A", 14.0), (1, "B", 9.0)], "item_id int, store string, price double")
    assert {r.store: r.price for r in basket.with_live(cart, live).collect()} == {"A": 14.0, "B": 9.0}


def test_unknown_weights_in_filters(spark):
    rows = spark.createDataFrame([(1, None), (2, 50.0), (3, 500.0)], "id int, weight_g double")
    ids = lambda **x: [r.id for r in rows.filter(listing.conditions(**x)).orderBy("id").collect()]
    assert ids(weight=(None, 100)) == [1, 2]
    assert ids(weight=(10, None)) == [2, 3]
    stores = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id int, stores array<string>")
    assert [r.id for r in stores.filter(listing.available(F.col("stores"), None)).collect()] == [1, 2]
    assert stores.filter(listing.available(F.col("stores"), [])).count() == 0


def test_claims_are_one_to_one(spark):
    edges = spark.createDataFrame([(1, 0, 10, 0.9), (2, 0, 10, 0.95), (2, 0, 11, 0.7), (3, 1, 12, 0.8)], "anchor long, store long, offer long, score double")
    got = {(r.anchor, r.offer) for r in matching.claimed(edges).collect()}
    assert got == {(1, 10), (2, 11), (3, 12)}


def test_near_images_are_exact(spark):
    rows = [(i, (i * 0x9E3779B97F4A7C15 % 2**64) - 2**63) for i in range(40)] + [(100 + i, ((i * 0x9E3779B97F4A7C15 % 2**64) - 2**63) ^ (0b1011 << i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, hash long")
    got = {(r.a, r.b) for r in matching.near_images(df, df, 4).filter("a < b").collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
    for most, bands in ((12, None), (15, None), (3, 4)):
        got = {(r.a, r.b, r.distance) for r in matching.near_images(df, df, most, bands).filter("a < b").collect()}
        assert got == {(a, b, d) for a, x in rows for b, y in rows if a < b and (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= most}


@pytest.mark.parametrize("n", [60, 100])
def test_components_of_long_paths(spark, n):
    path = [0, *range(n, 0, -1)]
    rows = [*zip(path, path[1:], strict=False), (1000, 1001), (1002, 1001), (1005, 1005)]
    got = {r.node: r.component for r in matching.components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {x: 0 for x in path} | {1000: 1000, 1001: 1000, 1002: 1000, 1005: 1005}


@pytest.mark.parametrize("limit", [None, 50])
def test_claims_of_equal_names_and_at_random(spark, limit, monkeypatch):
    """As many rounds as there are limits of a component, whatever is equal."""
    rounds = []
    real = matching.checkpointed
    monkeypatch.setattr(matching, "checkpointed", lambda df: rounds.append(1) or real(df))
    rng = random.Random(4)
    rows = [(a, s, 5000 + 20 * o + s, 0.9) for a in range(30) for o in range(20) for s in range(3)]
    rows += [(100 + rng.randrange(80), s, 7000 + 10 * rng.randrange(60) + s, rng.randrange(60, 90) / 100) for _ in range(600) for s in [rng.randrange(4)]]
    rows = list({r[:3]: r for r in rows}.values())
    got = {(r.anchor, r.store): r.offer for r in matching.claimed(spark.createDataFrame(rows, "anchor long, store long, offer long, score double"), limit).collect()}
    want, taken = {}, set()
    for a, s, o, _ in sorted(rows, key=lambda r: (r[0], r[1], -r[3], r[2])):
        if (a, s) not in want and o not in taken:
            want[a, s] = o
            taken.add(o)
    assert got == want
    assert len(rounds) < (15 if limit is None else 15 + 2 * len(want) / limit)


def test_a_thousand_equal_names(spark, monkeypatch):
    rounds = []
    real = matching.checkpointed
    monkeypatch.setattr(matching, "checkpointed", lambda df: rounds.append(1) or real(df))
    a, b = spark.range(1000).select(F.col("id").alias("anchor")), spark.range(5000, 5300).select(F.col("id").alias("offer"))
    edges = a.join(b).select("anchor", (F.col("offer") % 2).alias("store"), "offer", F.lit(0.9).alias("score"))
    got = {(r.anchor, r.store): r.offer for r in matching.claimed(edges).collect()}
    assert got == {(i, s): 5000 + 2 * i + s for i in range(150) for s in range(2)}
    assert len(rounds) < 15


def test_claims_in_long_chains(spark):
    """Every anchor wants the offer of the one before it."""
    rows = [(a, 0, o, s) for a in range(12) for o, s in ((a - 1, 0.9), (a, 0.8)) if o >= 0]
    got = {(r.anchor, r.offer) for r in matching.claimed(spark.createDataFrame(rows, "anchor long, store long, offer long, score double")).collect()}
    assert got == {(a, a) for a in range(12)}


class Card:
    """A card and the gates, in plain Python."""

    def __init__(self, r):
        self.__dict__.update(r.asDict())

    def heavy(self, o):
        a, b = self.weight_g, o.weight_g
        return a is None or b is None or abs(a - b) <= max(min(20, max(a, b) / 4), 0.08 * max(a, b))

    def counted(self, o):
        return self.count is None or o.count is None or self.count == o.count

    def percentages(self, o):
        return not self.percents or not o.percents or bool({*self.percents} & {*o.percents})

    def meaty(self, o):
        return not self.meats or not o.meats or {*self.meats} == {*o.meats}

    def flags(self):
        return [getattr(self, f) for f in matching.FLAGS]

    def claims(self, o):
        return all(a == b if f == "alcohol_free" else a or not b for f, a, b in zip(matching.FLAGS, self.flags(), o.flags(), strict=True))

    def priced(self, o):
        return self.price <= 5 * o.price and o.price <= 5 * self.price

    def group(self, o):
        return self.heavy(o) and self.counted(o) and self.percentages(o) and self.meaty(o) and self.flags() == o.flags()

    def words(self, name="norm"):
        return {w for w in getattr(self, name).split() if len(w) >= 3}

    def bits(self, o):
        return None if self.hash is None or o.hash is None else ((self.hash ^ o.hash) & (2**64 - 1)).bit_count()

    def matched(self, o, vocabulary):
        """The score of the offer ``o`` for this anchor, or None."""
        near = self.bits(o)
        named = self.words() & o.words() if self.words() & vocabulary else self.words("described") & o.words()
        if self.ean or not (named or near is not None and near <= 12):
            return None
        close = near is not None and near <= 4
        if not (self.percentages(o) and self.meaty(o) and self.alcohol_free == o.alcohol_free and self.heavy(o) and self.counted(o) and self.priced(o)):
            return None
        if not close and not (self.claims(o) and {*o.flavours} <= {*self.flavours} and {*o.forms} <= {*self.forms}):
            return None
        name, maker = max(similarity.score(n, o.norm) for n in (self.norm, self.described)), similarity.score(self.maker, o.maker)
        own = self.private and o.private
        if self.category != o.category and name < 0.80 or self.private != o.private and name < 0.70:
            return None
        pictured = not own and near is not None and (near <= 8 or near <= 12 and maker >= 0.75)
        kind = lambda c: next((d for d in ("mini", "let", "skummet", "sod", "piske", "kærne", "kær") if d in c.norm), None)
        if kind(self) and kind(o) and kind(self) != kind(o) and (own or near is None or near > 5):
            return None
        first = next((w for w in self.norm.split() if len(w) >= 4), None)
        if first and first not in o.norm and not (name >= 0.60 if own else pictured):
            return None
        if name < 0.75 and not close and not o.weight_g and not o.ean and (self.count is None or o.count is None) and not (self.loose and o.loose):
            return None
        if name < 0.50 and not (pictured and name >= 0.30):
            return None
        image = 0 if near is None else 0.2 + 0.2 * (8 - near) / 8 if near <= 8 else max(0, 0.2 * (15 - near) / 7)
        total = name + 0.3 * (1 if own else maker) + image
        return total if total >= 0.60 else None

    def alike(self, o):
        """The score of two offers of different stores, or None."""
        if self.store == o.store or not self.words() & o.words() or not (self.group(o) and self.priced(o)) or {*self.flavours} != {*o.flavours} or {*self.forms} != {*o.forms}:
            return None
        name = similarity.score(self.norm, o.norm)
        weighed = self.weight_g and o.weight_g or self.count is not None and o.count is not None or self.loose and o.loose
        if name < 0.65 or self.category != o.category and name < 0.80 or self.private != o.private and name < 0.70 or name < 0.75 and not weighed:
            return None
        return name


@pytest.fixture(scope="module")
def featured(spark, sf_dir):
    rows = checkpoints.checkpointed(matches.featured(spark, sf_dir).drop("ean", "count").withColumns({"ean": F.when(F.col("id") % 6 == 0, F.concat(F.lit("e"), F.col("id"))), "count": F.when(F.col("id") % 5 == 0, F.col("id") % 3).cast("int")}))
    # names that differ more than those of the table, and images that are near each other
    changed = F.when(F.col("id") % 4 == 0, F.concat("norm", F.lit(" let"))).when(F.col("id") % 4 == 1, F.concat(F.lit("mini "), "norm")).when(F.col("id") % 10 == 7, F.lit("zz xx")).otherwise(F.col("norm"))
    rows = rows.withColumns({"norm": changed, "hash": F.expr("CASE WHEN id % 3 < 2 THEN id DIV 8 * 829366591 + shiftleft(1L, CAST(id % 8 AS INT)) END"), "described": F.when(F.col("id") % 10 == 7, F.lit("red promo")).otherwise(F.col("described"))})
    rows = checkpoints.checkpointed(rows)
    return rows, [Card(r) for r in rows.orderBy("id").collect()]


def test_anchor_edges_by_all_gates(spark, featured):
    df, cards = featured
    got = {(r.anchor, r.offer): r.score for r in matching.anchor_edges(df.filter("id % 2 = 0"), df.filter("id % 2 = 1")).collect()}
    offers = [c for c in cards if c.id % 2]
    vocabulary = set().union(*(o.words() for o in offers))
    want = {(a.id, o.id): s for a in cards if a.id % 2 == 0 for o in offers if (s := a.matched(o, vocabulary)) is not None}
    assert set(got) == set(want) and len(want) > 20
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def clustered(cards, edges, leads):
    """(base, member) by going through the bases in order."""
    by, free, out = {c.id: c for c in cards}, {c.id for c in cards}, set()
    for base in sorted(cards, key=lambda c: (c.store, c.id)):
        if base.id not in free or not leads(base):
            continue
        best = {}
        for m in free:
            if (s := edges.get((base.id, m))) is not None:
                best[by[m].store] = max(best.get(by[m].store, (0, 0)), (s, -m))
        members = [(s, -m) for _, (s, m) in sorted(best.items())]
        while bad := next(((x, y) for i, x in enumerate(members) for y in members[i + 1 :] if not by[x[1]].group(by[y[1]])), None):
            members.remove(bad[0] if bad[0][0] <= bad[1][0] else bad[1])
        if members:
            free -= {base.id, *(m for _, m in members)}
            out |= {(base.id, base.id), *((base.id, m) for _, m in members)}
    return out


def test_clusters_in_order(spark, featured):
    df, cards = featured
    found = matching.cross_store_edges(df, df).filter("a < b")
    got = {(r.a, r.b): r.score for r in found.collect()}
    want = {(a.id, b.id): s for a in cards for b in cards if a.id < b.id and (s := a.alike(b)) is not None}
    assert set(got) == set(want) and len(want) > 20
    both = got | {(b, a): s for (a, b), s in got.items()}
    made = {(r.base, r.member) for r in matching.clusters(found, df.withColumn("leads", F.col("ean").isNull())).collect()}
    assert made == clustered(cards, both, lambda c: c.ean is None)
    # members that contradict each other although both fit the base
    rows = [(i, i % 4, w) for i, w in enumerate([None, 100.0, 500.0, 100.0] * 3)]
    odd = matching.features(spark.createDataFrame([(i, s, "n", w) for i, s, w in rows], "id long, store long, name string, weight_g double")).withColumn("leads", F.lit(True))
    edges = [(i, j, a, b, 0.7 + (i * j % 7) / 50) for i, a, _ in rows for j, b, _ in rows if i < j and a != b and (a == 0 or b == 0)]
    made = {(r.base, r.member) for r in matching.clusters(spark.createDataFrame(edges, "a long, b long, a_store long, b_store long, score double"), odd).collect()}
    plain = [Card(r) for r in odd.collect()]
    assert made == clustered(plain, {(a, b): s for a, b, _, _, s in edges} | {(b, a): s for a, b, _, _, s in edges}, lambda c: True)


def test_groups_take_what_no_member_contradicts(spark, featured):
    df, _ = featured
    offers, members = matches._groups(df)
    of = {r.id: r.group for r in members.select("id", "group").collect()}
    free, inside = [Card(r) for r in offers.collect()], [Card(r) for r in members.collect()]
    want = {}
    for o in sorted(free, key=lambda c: (c.store, c.id)):
        best = None
        for m in inside:
            mates = [x for x in inside if of[x.id] == of[m.id]] + [x for x in free if want.get(x.id) == of[m.id]]
            if o.ean is None and (s := o.alike(m)) is not None and all(x.store != o.store and o.group(x) for x in mates):
                best = max(best or (0, 0), (round(s, 6), -of[m.id]))
        if best:
            want[o.id] = -best[1]
    assert {r.offer: r.group for r in matching.attached(offers, members).collect()} == want and want


def test_images_merge_cards_that_fit(spark, featured):
    df, cards = featured
    df = df.withColumns({"image": F.when(F.col("id") % 20 > 0, (F.col("id") % 5).cast("string")), "prices": F.create_map(F.col("store").cast("string"), F.col("price"))})
    got = {r.id: (r.prices, r.merged) for r in matching.deduplicated_by_image(df).collect()}
    kept = {}
    for c in cards:
        image = str(c.id % 5) if c.id % 20 else f"none {c.id}"
        own = {str(c.store): c.price}
        fit = next((k for k in kept.setdefault(image, [])[:1] if k[0].group(c) and not (k[0].norm and c.norm and similarity.score(k[0].norm, c.norm) < 0.35)), None)
        if fit:
            fit[1].update({k: v for k, v in own.items() if k not in fit[1]})
            fit[2] += 1
        else:
            kept[image].append([c, own, 0])
    assert got == {k[0].id: (k[1], k[2]) for ks in kept.values() for k in ks}
    assert any(n for _, n in got.values())


def test_a_cluster_needs_the_shared_folder(spark, monkeypatch):
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

            class _conf:
                get = staticmethod(lambda *a: None)

            getConf = staticmethod(lambda: Session.sparkContext._conf)  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints.ready(Session)


def test_guards(spark):
    cards = spark.createDataFrame([(i, i % 10 == 0) for i in range(2000)], "id int, matched boolean")
    assert quality.verdict(quality.metrics(cards, 2000)).first()["verdict"] == "coverage"
    with pytest.raises(Exception, match="the run is stopped"):
        quality.guarded(cards, 2000).count()
    assert quality.guarded(cards, 2000, least_coverage=0.05).count() == 2000


def test_swap_replaces_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.swap(spark.createDataFrame([(1, "a"), (2, "b")], "id int, store string"), path, "store")
    writers.swap(spark.createDataFrame([(3, "b")], "id int, store string"), path, "store")
    assert sorted((r.id, r.store) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_xml_and_json_ld(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<r><product><id>1</id><title>Mælk</title><price>12,95 DKK</price><unit_pricing_measure>1 l</unit_pricing_measure></product><product><id>2</id><title>x</title><price>0</price></product></r>")
    rows = readers.xml_feed(spark, str(tmp_path / "feed.xml")).collect()
    assert [(r.id, r.list_price, r.price_per_kg) for r in rows] == [("1", 12.95, 12.95)]
    html = '<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": "Recipe", "name": "Suppe", "totalTime": "PT1H30M", "recipeIngredient": ["2 dl vand"]}]}</script>'
    got = readers.json_ld_recipes(spark.createDataFrame([(1, html), (2, "<p>")], "page_id long, html string")).collect()
    assert [(r.page_id, r.name, r.minutes, r.ingredients) for r in got] == [(1, "Suppe", 90, ["2 dl vand"])]
    pool = spark.createDataFrame([(1, '[{"a": 1, "b": 2}, "x", "y", {"a": 1}]')], "page_id long, text string")
    assert [(r.a, r.b) for r in readers.pool_products(pool, "text", ["a", "b"]).collect()] == [("x", "y")]


def test_failed_sources_are_recorded(spark):
    def broken():
        raise OSError("gone")

    rows, failed = readers.all_stores({"a": broken})
    assert rows.count() == 0 and failed == {"a": "gone"}


def test_cooldown_and_limits(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("p", at(0), 1, "add"), ("p", at(0.5), 2, "compare"), ("p", at(1.5), 3, "compare")], "pid string, ts timestamp, event_id long, event_type string")
    assert [tuple(r) for r in activity.popularity(rows).collect()] == [("p", 3, 4)]
    calls = spark.createDataFrame([(1, i, at(i)) for i in range(6)], "key long, event_id long, ts timestamp")
    assert [r.allowed for r in activity.rate_limited(calls, 2, 3.0).orderBy("event_id").collect()] == [True, True, False, True, True, False]


def test_savings_are_capped(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, at(1), 1, 1.0, 5000.0), (2, at(1), 1, 100.0, 9000.0), (3, at(1), 1, 9.0, 5.0)], "user_id long, ts timestamp, event_id long, cheap double, dear double")
    assert {r.user_id: r.amount for r in activity.monthly_savings(rows).collect()} == {1: 4.0, 2: 400.0, 3: 0.0}


def test_ingredients_get_products_by_all_gates(spark):
    rng = random.Random(8)
    words = ["hakket", "okse", "kylling", "mælk", "kakao", "let", "rød", "skive", "Smør", "12%"]
    products = [(i, " ".join(rng.sample(words, rng.randrange(1, 4)))) for i in range(300)] + [(400, None), (401, "  ")]
    lines = [(i, " ".join(rng.sample(words, rng.randrange(1, 4)))) for i in range(60)] + [(90, ""), (91, None)]
    got = recipes.candidates(spark.createDataFrame(lines, "ingredient_id long, ingredient string"), spark.createDataFrame(products, "product_id long, name string"), {"kakao": "cocoa"})
    meats = lambda x: {k for k in ("okse", "kylling") if k in x.split()}
    want = {}
    for i, said in lines:
        a = register.normalize_name(said)
        found = []
        for p, title in products:
            b = register.normalize_name(title)
            if a and b and {*a.split()} & {*b.split()} and not (meats(a) and meats(b) and meats(a) != meats(b)) and ("kakao" not in b or "kakao" in a):
                s = similarity.score(a, b)
                if s >= 0.55:
                    found.append((-round(s, 6), p))
        for n, (s, p) in enumerate(sorted(found)[:5], 1):
            want[i, n] = (p, -s, "exact" if -s >= 0.97 else "fuzzy")
    assert {(r.ingredient_id, r["rank"]): (r.product_id, r.score, r.method) for r in got.collect()} == want and len(want) > 150


def test_ranks_of_a_month_that_has_nearly_all(spark):
    rng = random.Random(9)
    rows = [(i, "2024-01" if i % 10 else "2024-02", rng.choice([0.0, 5.0, 5.25, float(rng.randrange(10**6)) / 100])) for i in range(2000)] + [(5000, "2024-03", 3.0), (5001, None, 1.0)]
    got = {r.user_id: (r["rank"], r.n) for r in history.ranked(spark.createDataFrame(rows, "user_id long, month_key string, amount double"), "month_key", "amount").collect()}
    assert got == {u: (1 + sum(a > v for _, k, a in rows if k == m), sum(k == m for _, k, _ in rows)) for u, m, v in rows}


def test_parts_of_visible_rows(spark):
    rows = spark.createDataFrame([(1, "approved", "a"), (2, "new", "a"), (3, "new", "b")], "id int, status string, owner string")
    parts = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w")], "id int, line string")
    assert sorted(r.line for r in quality.visible_parts(parts, rows, "a", "id").collect()) == ["x", "y"]
    assert [r.line for r in quality.visible_parts(parts, rows, None, "id").collect()] == ["x"]


def test_best_of_anchors_without_all_edges(spark, featured):
    df, _ = featured
    # names of few words, in other orders too, and offers that a gate keeps from being taken at first
    names = F.element_at(F.array(*map(F.lit, ["red ring", "ring red", "blue ring", "red ring let", "zz xx"])), (F.col("id") % 5 + 1).cast("int"))
    for first, rows in (32, df), (1, df.withColumns({"norm": names, "maker": F.concat(F.lit("brand#"), F.col("id") % 3), "weight_g": (F.col("id") % 3 * 100).cast("double")})):
        sides = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
        got = {(r.anchor, r.store): (r.offer, r.score) for r in matching.anchor_best(*sides, first=first).collect()}
        want = {(r.anchor, r.store): (r.offer, r.score) for r in matching.best_per_store(matching.anchor_edges(*sides)).collect()}
        assert got == want and len(want) > 20


def test_claims_without_all_edges(spark, featured):
    df, _ = featured
    names = F.element_at(F.array(*map(F.lit, ["red ring", "ring red", "blue ring", "red ring let", "zz xx"])), (F.col("id") % 5 + 1).cast("int"))
    few = df.withColumns({"norm": names, "maker": F.concat(F.lit("brand#"), F.col("id") % 3), "weight_g": (F.col("id") % 3 * 100).cast("double"), "price": F.pow(F.lit(3.0), F.col("id") % 4)})
    for rows in df, few:
        sides = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
        got = sorted(claiming.anchor_claimed(*sides, parts=4).collect())
        want = sorted(matching.claimed(matching.anchor_edges(*sides)).collect())
        assert got == want and len(want) > 10


def test_claims_make_no_row_for_each_pair(spark, featured, monkeypatch):
    """Of equal offers and anchors there are as many rows as there are of them, not of their pairs."""
    df, _ = featured
    rows = df.filter("id < 2").drop("id", "ean", "hash").limit(1).crossJoin(spark.range(400)).withColumns({"ean": F.lit(None).cast("string"), "hash": F.lit(None).cast("long"), "store": F.lit(0).cast("long")})
    seen, join = [], matching.blocked
    monkeypatch.setattr(matching, "blocked", lambda *args, **kwargs: seen.append(join(*args, **kwargs).count()) or join(*args, **kwargs))
    got = claiming.anchor_claimed(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), parts=4).collect()
    assert sorted((r.anchor, r.offer) for r in got) == [(i, i + 1) for i in range(0, 400, 2)]
    assert max(seen) <= 1


def test_groups_that_have_all_stores_meet_no_offer(spark, featured, monkeypatch):
    df, _ = featured
    offers, members = matches._groups(df)
    members = members.withColumn("store", F.lit(3).cast("long")).unionByName(members.withColumn("id", F.col("id") + 10**6).withColumn("store", F.lit(4).cast("long")))
    seen, join = [], matching.cross_store_edges

    def watched(left, right, *args):
        seen.append((right.count(), join(left, right, *args).count()))
        return join(left, right, *args)

    monkeypatch.setattr(matching, "cross_store_edges", watched)
    assert matching.attached(offers.filter("store IN (3, 4)"), members).isEmpty()
    assert seen == [(0, 0)]
    members = members.filter("store = 3")
    assert {r.store for r in matching.attached(offers.filter("store IN (3, 4)"), members).select(F.col("offer").alias("id")).join(offers, "id").select("store").collect()} <= {4}
    assert seen[1][0] > 0
