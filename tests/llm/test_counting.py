"""Fill-in-middle, prefix tries and language-model scores, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketspark.llm import fim, lm, queries, trie

BLANKS = " \t\n\v\f\r"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def oracle(sf_dir, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    out = con.execute(queries.SQL[name])
    return [d[0] for d in out.description], out.fetchall()


# fill in the middle


def plain_fim(doc_id, text, marks=fim.MARKS):
    p, s, m = marks
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(x in text for x in marks) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    return (n, "spm", len(a), len(b), s + c + p + a + m + b) if h4 % 100 < 80 else (n, "psm", len(a), len(b), p + a + s + c + m + b)


def test_fim_equals_the_plain_version(spark):
    rng = random.Random(5)
    alphabet = ["a", "ø", "🜁", " ", "<", "P", ">", "<P", "S>", "é", "́", *BLANKS]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(300)]
    texts += [None, "", " ", "\n\n", "a", " a", "a ", "x <M> y", "<S><P><M>", "<", "a" * 300_000, "wörd\t🜁 " * 60_000]
    rows = [(i if i % 50 else None, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x")] * 2 + [(-3, "minus three words", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string")
    made = fim.fill_in_middle(df)
    got = sorted(map(tuple, made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()), key=str)
    assert got == sorted(((i, *plain_fim(i, t), t or "") for i, t, _ in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_query_and_empty_table(spark, sf_dir):
    names, want = oracle(sf_dir, "op11_fill_in_middle", "documents")
    got = queries.op11_fill_in_middle(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_marks_that_can_arise_between_others_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "<S>", ""), ("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, marks=marks)


# prefix tries


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - math.fmod(c, 100), [])[:h]
        seq = tuple(base + turns[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest())
        for s, m in members.items()
    ) if members else []


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_the_plain_version(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "FAN", 2)
    monkeypatch.setattr(trie, "ENTRIES", 40)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 900), 250):
        for t in range(rng.choice([0, 1, 1, 2, 3, 7, 12])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ø🜁"]), 1))
    rows += [(None, 0, "user", "nobody's", 1)] * 3 + rows[:5]
    rows += [(100_000 + i, t, "user", f"copy {t}", 1) for i in range(5000) for t in range(7)]  # many copies, of several cells
    rows += [(7_777, t, "user", "x" * (t % 3), 1) for t in range(700)] + [(7_778, t, "user", "x" * (t % 3), 1) for t in range(699)]  # long ones
    rows += [(8_888, 0, "user", "y" * 200_000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, depth int")
    got = [tuple(r) for r in trie.prefix_trie(df.repartition(5)).collect()]
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)


def test_trie_query_and_empty_table(spark, sf_dir):
    names, want = oracle(sf_dir, "op12_prefix_trie", "conversations")
    got = queries.op12_prefix_trie(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


# language model


def plain_scores(rows, order=3, rounds=30, least_gain=1e-3):
    """(doc_id, held out, tokens, known, N, base score, score) by dictionaries; and the weights."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(i, 0 if i is None else zlib.crc32(str(i).encode()) % 10, [0] * (order - 1) + WORD.findall((t or "").translate(lower)) + ["\n"]) for i, t in rows]
    total, fold = Counter(), Counter()
    for _, part, d in docs:
        for c in [total] * (part > 0) + [fold] * (part == 1):
            for at in range(order - 1, len(d)):
                c.update(tuple(d[at - j + 1 : at + 1]) for j in range(1, order + 1))
            c.update((0,) * j for j in range(1, order))  # what a text begins with is a context too
    words = sum(1 for k in total if len(k) == 1 and k != (0,))
    n, n_fold = (sum(v for k, v in c.items() if len(k) == 1 and k != (0,)) for c in (total, fold))
    uniform = 1 / (words + 1)

    def seen(d, at, less):
        for j in range(1, order + 1):
            c = lambda k: total[k] - (fold[k] if less else 0)  # noqa: B023, E731
            context = n - n_fold * less if j == 1 else c(tuple(d[at - j + 1 : at]))
            yield (c(tuple(d[at - j + 1 : at + 1])) / context if context else 0.0), 1 if j == 1 else context.bit_length()

    def mixed(fs, w):
        p = [uniform]
        for j, (f, b) in enumerate(fs):
            p.append(w[j][b] * f + (1 - w[j][b]) * p[-1])
        return p

    w = [[0.0] + [0.5 if n else 0.0] * 64 for _ in range(order)]
    data = [list(seen(d, at, True)) for _, part, d in docs if part == 1 for at in range(order - 1, len(d))] if n else []
    before = None
    for _ in range(rounds if data else 0):
        taken, reached, ll = Counter(), Counter(), 0.0
        for fs in data:
            p, reach = mixed(fs, w), 1.0
            ll += math.log(p[-1])
            for j in range(order - 1, -1, -1):
                f, b = fs[j]
                share = w[j][b] * f / p[j + 1]
                taken[j, b] += reach * share
                reached[j, b] += reach
                reach *= 1 - share
        w = [[0.0] * 65 for _ in range(order)]
        for j in range(order):
            for k in range(1, 65):
                w[j][k] = (min(taken[j, k] / reached[j, k], 1 - 1e-6) if reached[j, k] else 0.5) if (j, k) in reached else w[j][k - 1]
        if before is not None and ll / len(data) - before < least_gain:
            break
        before = ll / len(data)
    out = []
    for i, part, d in docs:
        counts = [total[(x,)] for x in d[order - 1 :]]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (words + 1))) for c in counts)
        s = sum(math.log10(mixed(list(seen(d, at, False)), w)[-1]) for at in range(order - 1, len(d)))
        out.append((i, part == 0, len(counts), sum(c > 0 for c in counts), n, base, s))
    return out, w


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[6], 3))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-6, atol=1e-6)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["The", "the", "a", "Cat", "ø", "É", "mat,", "sat", "on", "🜁", *(f"w{i}" for i in range(60))]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = ["".join(w + rng.choice([" ", "\n", "  ", " ", "\t"]) for w in rng.choices(words, weights, k=rng.randrange(25))) for _ in range(n)]
    rows = list(enumerate(texts)) + [(3, texts[3])] * 2 + [(n + i, texts[5]) for i in range(40)] + [(None, "the cat sat"), (None, None), (n + 50, None), (n + 51, ""), (n + 52, " \n")]
    return rows


@pytest.mark.parametrize(("order", "block", "bucket"), [(3, 1 << 24, 1 << 24), (3, 700, 400), (2, 90, 1 << 24), (1, 1 << 24, 1 << 24), (4, 300, 300)])
def test_scores_equal_the_plain_version(spark, order, block, bucket):
    rows = corpus(order, 250)
    rows += [(900 + i, "the cat " + "sat on a mat, w1 w2 the " * (60 + i) + "end") for i in range(12)]  # of several pieces in small blocks
    rows += [(920, "x" * 5000), (921, "y" * 3000 + " z")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    model = lm.fit(df, order=order, block=block, bucket=bucket)
    want, weights = plain_scores(rows, order)
    assert np.allclose(model.weights, weights, atol=1e-4)
    same(lm.score(model).collect(), want)


def test_scores_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op13_lm_scoring(spark, sf_dir).collect()
    same(got, plain_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])[0])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_without_anything_to_learn(spark):
    schema = "doc_id long, text string"
    assert lm.score(lm.fit(spark.createDataFrame([], schema))).count() == 0
    rows = [(None, "a b"), (None, "")]
    same(lm.score(lm.fit(spark.createDataFrame(rows, schema))).collect(), plain_scores(rows)[0])
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 > 1][:5]  # no fold
    rows = [(i, "a b a c") for i in ids] + [(None, "a b d")]
    same(lm.score(lm.fit(spark.createDataFrame(rows, schema))).collect(), plain_scores(rows)[0])


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for bits in (1, 7, 20, 45, 60):
        for n in (0, 1, 5, 3000):
            keys = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64))
            assert (lm._unpack(lm._pack(keys, bits)) == keys).all()
            assert (lm._from_planes(lm._planes(keys)) == keys).all()
