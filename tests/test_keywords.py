"""Keywords of a text by an automaton against a regular expression for each word."""

from __future__ import annotations

import random
import re
import time

from pyspark.sql import functions as F

from basketspark.functions import text as T


def one_by_one(text, means, blockers, suffixes):
    """Passes over the lexicon, longest words first, until one finds nothing."""
    letter = "[a-zæøå]"
    for b in [blockers] if blockers else []:
        text = re.sub("|".join(map(re.escape, b)), " ", text)
    if suffixes:
        text = re.sub(rf"(?<={letter})(?:{'|'.join(sorted(suffixes, key=len, reverse=True))})\b", " ", text)
    out, more = set(), True
    while more:
        more = False
        for w in sorted(means, key=lambda w: -len(w)):
            if m := re.search(f"(?<!{letter}){re.escape(w)}|{re.escape(w)}(?!{letter})", text):
                out.add(means[w])
                text, more = f"{text[: m.start()]} {text[m.end() :]}", True
    return sorted(out)


def test_random_lexica(spark):
    rng = random.Random(3)
    for _ in range(4):
        word = lambda most: "".join(rng.choice("abø 1.") for _ in range(rng.randint(1, most)))
        means = {w: rng.choice("xyz") + str(len(w)) for w in (word(5) for _ in range(25)) if w.strip()}
        blockers, suffixes = rng.choice([(), ("ba", "ø1")]), rng.choice([(), ("a", "bø")])
        texts = ["", *(word(30) for _ in range(150))]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, t string")
        got = {r.id: r.k for r in df.select("id", T.keywords(F.col("t"), means, blockers, suffixes).alias("k")).collect()}
        assert got.pop(-1) == []
        assert got == {i: one_by_one(t, means, blockers, suffixes) for i, t in enumerate(texts)}


def test_empty_lexicon_and_empty_words(spark):
    df = spark.createDataFrame([("pear",), (None,), ("",)], "t string")
    assert [r.k for r in df.select(T.keywords(F.col("t"), []).alias("k")).collect()] == [[], [], []]
    assert [r.k for r in df.select(T.keywords(F.col("t"), ["", " ", "pear"]).alias("k")).collect()] == [["pear"], [], []]


def test_time_does_not_grow_with_the_lexicon():
    rng = random.Random(4)
    words = list(dict.fromkeys("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(50_000)))
    texts = [" ".join(rng.sample(words[:200], 5)) for _ in range(2000)]

    def seconds(lexicon):
        places = T.automaton(lexicon)
        start = time.perf_counter()
        for t in texts:
            assert len(places(t)) >= 5
        return time.perf_counter() - start

    small = min(seconds(words[:200]) for _ in range(3))
    assert min(seconds(words) for _ in range(3)) < 10 * small
