"""The stored dictionary against scans of every word."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketspark import api
from basketspark.functions import text as T
from basketspark.functions.similarity import score
from basketspark.operators import dictionary, search


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abdekrstøæ") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    out = set(stems)
    for w in stems:  # near ones
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(x) + 1)
                x[i : i + rng.randint(0, 1)] = rng.choice(["", "e", "ks"])
            out.add("".join(x))
    return sorted(out - {""})


@pytest.fixture(scope="module")
def rows(spark, words):
    rng = random.Random(6)
    data = [(i, rng.sample(words, 4)) for i in range(500)] + [(i, [w]) for i, w in enumerate(words, 1000)]
    data += [(7, ["a" * 300, "b" * 200 + "skra"]), (8, ["c" * 130]), (9, None), (None, ["kres"]), (10, []), (11, ["", None, "kres"]), (11, ["", "kres"])]
    return spark.createDataFrame(data, "id long, tokens array<string>").cache()


@pytest.fixture(scope="module")
def stored(spark, rows, tmp_path_factory):
    return dictionary.build(rows, str(tmp_path_factory.mktemp("terms") / "d"), buckets=8)


def ids(df):
    out = [r.id for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def expected(rows, *rules):
    return {r.id for r in rows.filter("id IS NOT NULL AND tokens IS NOT NULL").collect() if all(any(w and rule(w) for w in r.tokens) for rule in rules)}


def test_terms(rows, stored, words):
    for term in [*random.Random(7).sample(words, 3), "sk", "aaaaaa", "skra", "maelk"]:
        want = {r.id for r in rows.filter("id IS NOT NULL").filter(F.exists("tokens", lambda t: (t != "") & T.term_matches(t, term))).collect()}
        assert ids(stored.search([term])) == want


def test_like(rows, stored, words):
    for terms in ([w] for w in random.Random(8).sample(words, 4)):
        names = rows.filter("id IS NOT NULL").select("id", F.array_join("tokens", " ").alias("name"))
        assert ids(stored.search(terms, "containing")) == {r.id for r in names.filter(search.like_any(F.col("name"), terms)).collect()}
    assert ids(stored.search(["kr", "st"], "containing")) == expected(rows, *(lambda w, t=t: w.startswith(t) or w.endswith(t) for t in ("kr", "st")))


def test_spellings_are_found_both_ways(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["mælk"]), (2, ["maelk"]), (3, ["oel"]), (4, ["øl"]), (5, ["pølser"])], "id long, tokens array<string>")
    d = dictionary.build(rows, str(tmp_path / "d"))
    for term, want in (("maelk", {1, 2}), ("mælk", {1, 2}), ("øl", {3, 4}), ("oel", {3, 4})):
        assert ids(d.search([term], "containing")) == want
        assert ids(rows.filter(search.like_any(F.array_join("tokens", " "), [term]))) == want


def test_near_words_are_those_of_all_pairs_and_few_are_scored(stored, words):
    scored = 0
    terms = [w for w in random.Random(9).sample(words, 10) if len(w) >= 4]
    for term in terms:
        want = {(w, round(score(w, term), 6)) for w in words if len(w) >= 4 and abs(len(w) - len(term)) <= 3 and round(score(w, term), 6) >= 0.82}
        assert {(r.word, r.score) for r in stored.near(term).collect()} == want
        scored += stored.candidates(term).count()
    assert scored < 0.25 * len(terms) * len([w for w in words if len(w) >= 4])
    assert stored.near("abc").count() == 0
    assert [r.word for r in stored.near("c" * 131).collect()] == ["c" * 130]
    with pytest.raises(ValueError):
        stored.near("abcd", 0.5)


def test_pieces_of_all_lengths():
    """Whatever is deleted and inserted up to the bound, a piece stays."""
    rng = random.Random(10)
    for _ in range(4000):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(4, 40)))
        x = list(word)
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(len(x) + 1)
            x[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        term = "".join(x)
        if abs(len(word) - len(term)) > 3 or len(term) < 4 or score(word, term) < 0.82:
            continue
        m, d = len(word), dictionary._differences(0.82, len(word), len(term))
        own = {f"{m}|{d}|{k}|{word[k * m // (d + 1) : (k + 1) * m // (d + 1)]}" for k in range(d + 1)}
        assert own & {k for keys in dictionary._keys(term, 0.82) for k in keys}


def test_words_as_they_are(rows, stored):
    assert ids(stored.having(["kres"])) == expected(rows, lambda w: w == "kres") >= {11}
    assert ids(stored.having(["a" * 300, "b" * 200 + "skra"])) == {7}
    assert ids(stored.having([])) == set()


def test_scans_are_pruned(stored):
    plan = stored.having(["kres"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert "StringStartsWith(key" in stored.matching("kre")._jdf.queryExecution().toString()


def test_pages_search_with_and_without(spark, tmp_path):
    names = ["Pear juice", "Pears", "Minimælk", "Hakket oksekød", "Cherry tomatoes", "Pear jucie"]
    cards = spark.createDataFrame([(i, n, i % 2 == 0) for i, n in enumerate(names)], "id long, name string, organic boolean")
    d = dictionary.build(cards.select("id", T.tokens(T.normalized(F.col("name"))).alias("tokens")), str(tmp_path / "d"))
    for asked in ("pear juice", "pear", "cherri", "minimaelk", "tomatos", "organic pear", "zzzz"):
        assert [r.id for r in api.search(cards, asked, stored=d).collect()] == [r.id for r in api.search(cards, asked).collect()]


def test_empty_and_unfinished(spark, tmp_path):
    d = dictionary.build(spark.createDataFrame([], "id long, tokens array<string>"), str(tmp_path / "d"))
    assert d.search(["abcd"]).count() == d.search(["abcd"], "near").count() == d.having(["x"]).count() == 0
    with pytest.raises(Exception):
        dictionary.Dictionary(spark, str(tmp_path / "none"))
    some = dictionary.build(spark.createDataFrame([(1, ["abcd"])], "id long, tokens array<string>"), str(tmp_path / "e"), layouts=["pieces"])
    with pytest.raises(ValueError):
        some.matching("ab")


def test_rows_are_gathered(spark, stored, rows):
    """A stored row has many ids or words, and the layouts have each of them."""
    pairs = {(r.word, r.id) for r in rows.filter("id IS NOT NULL").select("id", F.explode("tokens").alias("word")).filter("word <> ''").collect()}
    kept = spark.read.parquet(f"{stored.path}/postings")
    assert {(r.word, i) for r in kept.collect() for i in r.ids} == pairs
    assert kept.count() < 0.75 * len(pairs)
    short = {w for w, _ in pairs if len(w) <= dictionary.LONGEST}
    grams = spark.read.parquet(f"{stored.path}/grams").collect()
    assert {(r.key, w) for r in grams for w in r.words} == {(w[i : i + 5], w) for w in short for i in range(len(w) - 4)}
    pieces = spark.read.parquet(f"{stored.path}/pieces").collect()
    cut = {(w, d) for w in short for n in range(len(w) - 3, len(w) + 4) if min(n, len(w)) >= 4 and (d := dictionary._differences(0.82, len(w), n)) >= 0}
    want = {(f"{len(w)}|{d}|{k}|{w[k * len(w) // (d + 1) : (k + 1) * len(w) // (d + 1)]}", w) for w, d in cut for k in range(d + 1)}
    assert {(r.key, w) for r in pieces for w in r.words} == want
    assert len(pieces) < 0.75 * len(want)


def test_batches_are_put_together():
    batches = [pa.record_batch([["a", "b", "a"], [i, i + 1, i + 2]], names=["word", "id"]) for i in range(0, 30, 3)]
    chunks = list(dictionary._in_chunks(iter(batches), 7))
    assert [c.num_rows for c in chunks] == [9, 9, 9, 3]
    assert [i for c in chunks for i in c["id"].to_pylist()] == list(range(30))


def test_abbreviations_beside_all_kinds_of_letters(spark):
    """What the coarse pattern lets through is what the exact ones would write out."""
    rng = random.Random(12)
    parts = [*T.ABBREVIATIONS, "f ", " ", "-", "é", "æ", "ß", "9", "_", "٣", "가", "e", "½", "ﬁ"]
    data = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    exact = F.col("name")
    for short, full in T.ABBREVIATIONS.items():
        exact = F.regexp_replace(exact, ("(?<!f )" if short == "eks" else "") + T.whole(short), full)
    df = spark.createDataFrame([(x,) for x in data], "name string").select("name", exact.alias("exact"), T._written_out(F.col("name")).alias("made"))
    assert df.filter("exact <> made").count() == 0 and df.filter("name <> made").count() > 100


def test_few_texts_meet_the_long_patterns(spark):
    """Plain texts are told by their bytes; letters of two bytes by what is left of them."""
    plan = spark.range(1).select(T.without_marks(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert "octet_length" in plan
    some = spark.createDataFrame([("abc",), ("ærø",), ("é½ﬁ",), ("가ǆ",), ("",)], "name string").select(T.without_marks(F.col("name")).alias("x"))
    assert [r.x for r in some.collect()] == ["abc", "ærø", "e1⁄2fi", "\u1100\u1161dz", ""]
