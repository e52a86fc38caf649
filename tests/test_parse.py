from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from basketspark import register
from basketspark.functions import parse, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "grams"), [("6 x 0.33 liter", 1980.0), ("500 g", 500.0), ("1,5 l", 1500.0), ("3 stk", None), (None, None), ("", None)])
def test_weight(spark, given, grams):
    assert one(spark, parse.weight_grams(F.lit(given).cast("string"))) == grams


@pytest.mark.parametrize(("given", "value"), [("12,95", 12.95), ("1.234", 1234.0), ("2 FOR 25", 25.0), ("FRIT VALG 10", 10.0), ("x", None)])
def test_leaflet_price(spark, given, value):
    assert one(spark, parse.leaflet_price(F.lit(given))) == value


@pytest.mark.parametrize(("given", "size", "total"), [("2 for 30", 2, 30.0), ("3 for 25,50", 3, 25.5), ("", None, None), ("tilbud", None, None), ("1 for 10", None, None)])
def test_deal(spark, given, size, total):
    assert one(spark, parse.deal_size(F.lit(given))) == size
    assert one(spark, parse.deal_total(F.lit(given))) == total


@pytest.mark.parametrize(("quantity", "deal", "cost"), [(2, "2 for 30", 30.0), (3, "2 for 30", 50.0), (1, "2 for 30", 20.0), (4, "2 for 30", 60.0), (2, "", 40.0)])
def test_deal_price(spark, quantity, deal, cost):
    assert one(spark, parse.deal_price(F.lit(20.0), F.lit(quantity), F.lit(deal))) == cost


@pytest.mark.parametrize(
    ("line", "expected"),
    [("2 dl mælk", (2.0, "dl", "mælk")), ("1/2 dl fløde", (0.5, "dl", "fløde")), ("3-4 æg", (3.5, "", "æg")), ("2 spsk. olie", (2.0, "spsk", "olie")), ("salt efter smag", (None, "", "salt efter smag"))],
)
def test_ingredient(spark, line, expected):
    assert tuple(one(spark, parse.ingredient(F.lit(line)))) == expected


def test_nutrition(spark):
    assert one(spark, parse.nutrition_number(F.lit("9,4 g"))) == 9.4
    assert one(spark, parse.nutrition_number(F.lit("< 0,5 g"))) == 0.5
    assert one(spark, parse.nutrition_number(F.lit("1.542 KJ / 366 kcal"), kcal=True)) == 366.0


def test_repair_and_unit_price(spark):
    assert one(spark, parse.repaired_price(F.lit(100.0), F.lit(20.0), F.lit(500.0))) == 10.0
    assert one(spark, parse.unit_amount_text(F.lit(30.0), F.lit(200.0), F.lit(3))) == "50.00 kr/kg"
    assert one(spark, parse.number_text(F.lit(4.0))) == "4"
    assert one(spark, parse.number_text(F.lit(4.25))) in ("4,3", "4,2")


def test_names(spark):
    assert one(spark, text.normalized(F.lit("HK. OKSEKØD 4-7%"))).startswith("hakket oksekød")
    assert one(spark, text.normalized(F.lit("Lay's"))) == "lays"
    assert one(spark, text.normalized(F.lit("fuldk.knækbrød"))) == "fuldkorn knækbrød"
    assert one(spark, parse.without_store_brand(F.lit("ACME SALT CHIPS"), ("acme",))) == "Salt chips"
    assert one(spark, parse.cleaned(F.lit(" NaN "))) is None


@pytest.mark.parametrize(("term", "token", "hit"), [("øl", "pølser", False), ("øl", "juleøl", True), ("ris", "gris", False), ("ris", "rispapir", True), ("maelk", "mælk", True), ("hyldeblomst", "hyldebl", True)])
def test_terms(spark, term, token, hit):
    assert one(spark, text.term_matches(F.lit(token), term)) is hit


@pytest.mark.parametrize(("given", "organic"), [("Økonomipakke", False), ("Mælk ikke økologisk", False), ("øko mælk", True)])
def test_organic(spark, given, organic):
    assert one(spark, text.variant_flags(F.lit(given))["organic"]) is organic


def test_words_are_consumed(spark):
    lexicon = ["løg", "hvidløg", "choko", "karamel", "cola", "sour cream", "sour"]
    assert one(spark, text.keywords(F.lit("hvidløg"), lexicon)) == ["hvidløg"]
    assert one(spark, text.keywords(F.lit("chokokaramel"), lexicon)) == ["choko", "karamel"]
    assert one(spark, text.keywords(F.lit("sour cream"), lexicon)) == ["sour cream"]
    assert one(spark, text.keywords(F.lit("chocolat"), lexicon)) == []
    assert one(spark, text.keywords(F.lit("Saltkaramelsmag"), {"karamel": "caramel"}, suffixes=("smag",))) == ["caramel"]
    assert one(spark, text.keywords(F.lit("druesukker vindrue"), {"drue": "grape", "vandmelon": ("water", "melon")}, blockers=("druesukker",))) == ["grape"]
    assert one(spark, text.keywords(F.lit("vandmelon"), {"vandmelon": ("water", "melon")})) == ["melon", "water"]
    assert one(spark, text.keywords(F.lit(None).cast("string"), lexicon)) == []


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Øko mælk", "mælk"), ("Kart. små", "kartoffel sma"), ("Vanilla is", "vanilje is"), ("200 gr", "200 gr"), ("Sild m. løg", "sild m løg"), ("Sour & Onion", "sour and onion"), ("A&B", "aandb"), ("F.eks. te", "f eks te"), ("Eks. te", "ekstra te"),
     ("HK. okse 4-7%", "hakket okse 4-7"), ("Café crème BIO", "cafe creme"), ("Arla A/S", "arla"), ("kart/champ", "kartoffel champignon"), (None, ""), ("nan", ""), ("hindb jordb", "hindbaer jordbaer"), ("kartoffel", "kartoffel")],
)
def test_names_in_detail(spark, given, expected):
    assert one(spark, text.normalized(F.lit(given).cast("string"))) == expected


@pytest.mark.parametrize(
    ("flag", "given", "has"),
    [("lactose_free", "laktose fri", True), ("lactose_free", "Lactofree", True), ("lactose_free", "lactose", False), ("sugar_free", "uden sukker", True), ("sugar_free", "Nul Suk.", True), ("sugar_free", "xzero", False), ("gluten_free", "uden gluten", True),
     ("alcohol_free", "nul %", True), ("alcohol_free", "0,0 %", True), ("alcohol_free", "10,0 %", False), ("organic", "økologi", True), ("organic", "ikke økologisk", False)],
)
def test_variants(spark, flag, given, has):
    assert one(spark, text.variant_flags(F.lit(given))[flag]) is has


def test_percentages_meats_and_private_labels(spark):
    assert one(spark, text.percents(F.lit("Ost 45+ 4,6% 4.60 %"))) == [4.6, 45.0]
    assert one(spark, text.percents(F.lit("1,45+ 145+"))) == []
    assert one(spark, text.meats(F.lit("HK. OKSEKØD og kyl."))) == ["okse", "kylling"]
    assert one(spark, text.meats(F.lit("Lammefjord gulerødder"))) == []
    own = lambda b, t: one(spark, text.private_label(F.lit(b).cast("string"), F.lit(t), ("own",), ("own ", "ours ")))
    assert [own("Own", "x"), own("Own Best", "x"), own(None, "Ours milk"), own("other", "own")] == [True, True, True, False]
    assert one(spark, text.dairy(F.lit("letmælk mini"))) == "mini"


@pytest.mark.parametrize(
    ("text", "grams", "pieces"),
    [
        ("6 x 33 cl.", 1980.0, None), ("6 x 33 cl", 1980.0, None), ("6x0,33 liter", 1980.0, None), ("0 x 500 g", None, None), ("500 g.", None, None), ("500 g", 500.0, None), (" 1,5 L ", 1500.0, None),
        ("1.2.3 kg", None, None), (".5 kg", 500.0, None), ("500\u00a0g", 500.0, None), ("10.5 stk", None, 10), ("10,5 st", None, 10), ("6 stk.", None, 6), ("10 st.", None, None), ("12 Stk", None, 12), ("ca. 3 stk pr. pose", None, 3),
        ("a10 stk", None, None), ("3 stks", None, None), ("3 stk_", None, None), ("0 stk", None, 0), ("", None, None), (None, None, None),
    ],
)
def test_weights_and_counts_as_feeds_write_them(spark, text, grams, pieces):
    row = spark.createDataFrame([(text,)], "x string").select(parse.weight_grams(F.col("x")).alias("g"), parse.piece_count(F.col("x")).alias("n")).first()
    assert (row.g, row.n) == (grams, pieces)


def test_counts_in_names(spark):
    rows = spark.createDataFrame([("500 g", "Avocado 3 Stk."), ("2 stk", "Æg 10 stk"), (None, "Æg 10 stk"), (None, None)], "w string, n string")
    assert [r.x for r in rows.select(parse.piece_count(F.col("w"), F.col("n")).alias("x")).collect()] == [3, 2, 10, None]


def test_names_are_compared_without_compatibility_forms(spark):
    cases = {"½ kg": "1⁄2 kg", "m²": "m2", "ﬁsk": "fisk", "１２ stk": "12 stk", "5 ㎏": "5 kg", "Cola™": "colaTM", "Is…": "is", "한글": unicodedata.normalize("NFKD", "한글"), "Crème": "creme", "ØL": "øl"}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", text.normalized(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases


def test_names_and_their_twin_agree_on_every_character(spark):
    rows = [(c, f"a{chr(c)}b {chr(c)} c") for c in (*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20))]
    got = spark.createDataFrame(rows, "c int, x string").repartition(8).select("c", "x", text.normalized(F.col("x")).alias("y")).collect()
    newer = {0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC}  # capitals that Python knows and the JVM doesn't yet
    odd = [(hex(r.c), r.y, want) for r in got if r.c not in newer and r.y != (want := register.normalize_name(r.x))]
    assert not odd, (len(odd), odd[:20])
