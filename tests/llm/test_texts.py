from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketspark.llm import chat, ngramjoin, packing, pii, queries, sentencepieces, suffixdedup, toxicity, warc
from basketspark.llm.suffixes import common_prefixes, suffix_array

DOCS = "doc_id long, text string, lang string, anchor string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "é", "ti", "sh"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(120), text(30)
    rows = [(i, text(rng.randint(1, 150))) for i in range(60)]
    rows += [(100 + i, base) for i in range(25)]
    for i in range(40):
        w = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, text(20) + " " + passage + " " + text(20)) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "   \n"), (403, "one two"), (404, "ONE  two"), (405, "ha " * 400), (406, "a" * 300), (407, "a" * 300), (None, base), (408, base), (408, base)]
    rng.shuffle(rows)
    return rows


# suffix arrays


@given(st.binary(max_size=80), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_suffix_array(data, times):
    data = data * times
    buf = np.frombuffer(data, np.uint8)
    order = sorted(range(len(data)), key=lambda i: data[i:])
    sa = suffix_array(buf)
    assert sa.tolist() == order
    assert suffix_array(buf, np.zeros(0, np.int64)).tolist() == order
    plcp = common_prefixes(buf, sa, 10)
    for i, j in zip(order, order[1:], strict=False):
        shared = next((n for n in range(10) if data[i + n : i + n + 1] != data[j + n : j + n + 1] or j + n >= len(data) or i + n >= len(data)), 10)
        assert plcp[j] == shared


@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 9 for x in b)), max_size=6), st.binary(min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_suffix_array_of_several_strings(strings, last):
    buf = np.frombuffer(b"\n".join([*strings, last]), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in strings], dtype=np.int64) - 1
    at = dict.fromkeys(ends.tolist(), 0)
    key = lambda i: [(0, j) if j in at else (1, int(buf[j])) for j in range(i, len(buf))]
    assert suffix_array(buf, ends).tolist() == sorted(range(len(buf)), key=key)


def removed(rows, width):
    first, out = {}, []
    key = lambda i: 2**63 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            first[w] = min(first.get(w, 2**63), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < key(i):
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


DIGEST = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"


@pytest.mark.parametrize("crowd", [2048, 2])
def test_suffix_dedup(spark, corpus, monkeypatch, crowd):
    plain = suffixdedup.removed_spans
    monkeypatch.setattr(suffixdedup, "removed_spans", lambda docs, **k: plain(docs, **k, crowd=crowd, shard_bytes=2000))
    assert rows_of(suffixdedup.removed_digests(frame(spark, corpus)), *DIGEST) == sorted(removed(corpus, 50), key=str)


def test_suffix_dedup_cuts_no_other_row_of_the_same_id(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    base = text(300)
    rows = [(1, base), (None, base), (None, text(400)), (None, text(400)), (5, base + text(50)), (5, text(500)), (5, text(500)), (5, None), (None, None), (1, text(90) + base)]
    assert rows_of(suffixdedup.removed_digests(frame(spark, rows)), *DIGEST) == sorted(removed(rows, 50), key=str)
    kept = {(r.doc_id, r.text) for r in suffixdedup.without_repeats(frame(spark, rows)).collect()}
    assert {r for r in rows if r[1] is None or r[1] != base and not r[1].startswith(base)} <= kept


@given(st.integers(0, 2**32), st.integers(1, 3), st.integers(17, 40))
@settings(max_examples=12, deadline=None)
def test_suffix_dedup_with_planted_grams(spark, seed, alphabet, long):
    """Passages in which the same grams stand several times, shared in part by other documents; periodic ones too."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij"[: 1 + 3 * alphabet]) for _ in range(n))
    grams = [text(16) for _ in range(3)]
    passages = [rng.choice(grams) + text(rng.randint(0, 4)) + rng.choice(grams) + text(long) + rng.choice(grams) for _ in range(6)] + [(text(rng.randint(1, 5)) * 60)[:120]]
    rows = []
    for i in rng.sample(range(40), 24):
        p = rng.choice(passages)
        cut = rng.randint(0, len(p) // 3)
        rows.append((rng.choice([i, i, i, None, 3]), text(rng.randint(0, 60)) + p[cut:] * rng.randint(1, 2) + text(rng.randint(0, 60))))
    assert rows_of(suffixdedup.removed_digests(frame(spark, rows)), *DIGEST) == sorted(removed(rows, 50), key=str)


def test_ranges_of_anchors_are_even(spark):
    rng = random.Random(17)
    rows = [(i, 0, bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=4000))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, row long, text binary").coalesce(1)
    sizes = [len(r.run) // 8 for r in suffixdedup.find_runs(docs, 50, 6).collect()]
    assert len(sizes) == 64 and max(sizes) < 1.5 * sum(sizes) / 64


def test_suffix_dedup_of_very_long_texts(spark):
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    long = text(400_000)
    rows = [(1, long[:250_000] + "=" * 20_000), (2, long[200_000:] + "=" * 30_000), (3, "x" + "=" * 60)]
    assert rows_of(suffixdedup.removed_digests(frame(spark, rows)), *DIGEST) == sorted(removed(rows, 50), key=str)


def test_suffix_dedup_where_a_line_occurs_again(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(80):
        line, passage = text(rng.randint(16, 30)), text(rng.randint(22, 40))
        rows += [(2 * i, text(60) + line * rng.randint(2, 4) + passage + text(60)), (2 * i + 1, text(60) + line + passage + text(60))]
    rows += [(500, text(60) + "-" * 200 + text(60)), (501, text(60) + "-" * 120 + text(60)), (502, text(60) + "-=" * 60 + text(60)), (503, text(60) + "-=" * 40)]
    got = rows_of(suffixdedup.removed_digests(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(removed(rows, 50), key=str)


def test_texts_without_repeats_stay_text(spark, corpus):
    out = suffixdedup.without_repeats(frame(spark, corpus))
    assert out.columns == ["doc_id", "text", "lang", "anchor", "spans"]
    rows = out.collect()
    assert len(rows) == len(corpus)
    assert [r.text for r in rows if r.doc_id == 400] == [None]
    assert {r.doc_id for r in rows if r.text == ""} >= {401, 407}


# n-gram join


def linked(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else low[top(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "percent", "rare", "combine"), [(4, 85, 64, 2), (5, 80, 3, 2), (2, 60, 1, 3)])
def test_ngram_join(spark, corpus, k, percent, rare, combine):
    got = ngramjoin.jaccard_join(frame(spark, corpus), k=k, percent=percent, rare_limit=rare, combine=combine)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == linked(corpus, k, percent)


# packing


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_piece(lengths):
    counts = np.bincount(lengths, minlength=65)
    made = np.zeros(65, int)
    sequences = 0
    for pattern, times in packing.plan(counts, 64):
        assert sum(pattern) <= 64 and times > 0
        sequences += times
        for x in pattern:
            made[x] += times
    assert made.tolist() == counts.tolist()
    assert sequences <= max(1, -(-2 * sum(lengths) // 64))  # two sequences are never both half empty


def test_exact_complements():
    counts = np.zeros(101, int)
    counts[[60, 40, 30, 10, 50, 25, 15]] = [4, 2, 2, 2, 1, 1, 1]
    counts[[10]] += 1
    assert all(sum(p) == 100 for p, _ in packing.plan(counts, 100)[:4])


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, size = public_tokenizers.path("word_bpe_49k.json"), 64
    tokenizer = Tokenizer.from_file(path)
    rows = [*corpus, (500, "<|endoftext|> İ ΣΑΣ 漢字 \x00 ½ don't"), (501, "x " * 500)]
    got = packing.pack(frame(spark, rows), path, size=size).collect()
    want = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, n, at, len(ids[at : at + size]), zlib.crc32(ids[at : at + size].tobytes())) for n, at in enumerate(range(0, len(ids), size))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= 1.05 * sum(w[3] for w in want) / size + 1
    clashing = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows[:20]], "doc_id long, text string, piece int, start int, part int")
    assert {r.doc_id for r in packing.pack(clashing, path, size=size).collect()} == {i for i, _ in rows[:20]}


def test_little_is_wasted():
    rng = np.random.default_rng(4)
    lengths = np.minimum(np.exp(rng.normal(6, 1.2, 60_000)).astype(int) + 1, 4096)
    sequences = sum(times for _, times in packing.plan(np.bincount(lengths, minlength=4097), 4096))
    assert sequences <= 1.001 * lengths.sum() / 4096 + 1


# pseudonyms


@given(st.integers(1, 5000), st.binary(min_size=1, max_size=8))
@settings(max_examples=30, deadline=None)
def test_permutation(n, tweak):
    there, back = pii.Permuter(b"key"), pii.Permuter(b"key", True)
    n = min(n, 400)
    made = [there(x, n, tweak) for x in range(n)]
    assert sorted(made) == list(range(n))
    assert [back(y, n, tweak) for y in made] == list(range(n))


VALUES = {
    "email": ["anna.b7@mail.example.com", "x+y@a-b.org", "Bob.SMITH@X.org"], "ipv4": ["10.0.0.255", "172.16.254.1"], "card": ["4041894974608795", "4041-8949-7460-8795", "378282246310005"],
    "phone": ["+1 (988) 555-2485", "+45 12 34 56 78", "+4512345678", "+44 (0)20 7946 0958", "+353 1 234 5678", "0045 12345678", "004512345678", "00 353 1 234 5678"], "ssn": ["123-45-6789"], "date": ["2024-02-29", "31.12.1999", "13/02/2001", "02/03/2001", "1999/01/31", "1850-06-07", "2150-06-07"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], "secret": ['token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'],
}


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_formats_are_kept(kind, value):
    there, back = pii.Permuter(b"key"), pii.Permuter(b"key", True)
    new, kinds = pii.replaced(f"see {value}, ok", there, {})
    assert kinds == [kind] and value not in new
    again, kinds = pii.replaced(new, there, {})
    assert kinds == [kind]  # the pseudonym is valid in the same way
    returned = pii.replaced(new, back, {})[0]
    if kind == "date":  # what would be read the other way round is written with dots
        returned, value = returned.replace(".", "/"), value.replace(".", "/")
    assert returned == f"see {value}, ok"
    if kind not in ("ipv4", "email", "iban", "secret", "date"):
        assert re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", f"see {value}, ok")


def test_invalid_values_and_other_texts_stay(spark):
    rows = [(1, "0012345678 001234567890 0000451234567890 id-004512345678 4041894974608796 999.1.1.1 2023-02-30 000-12-3456 v1.2.3.4.5 DE00370400440532013000"), (2, "nothing here"), (3, None), (4, "")]
    out = {r.doc_id: r for r in pii.pseudonymised(frame(spark, rows), b"key").collect()}
    assert {i: r.text for i, r in out.items()} == dict(rows)
    assert all(r[f"n_{k}"] == 0 for r in out.values() for k in pii.KINDS)


SPELLINGS = {
    "card": [["4041894974608795", "4041-8949-7460-8795", "4041 8949 7460 8795"], ["378282246310005", "3782 822463 10005"]],
    "phone": [["+45 12 34 56 78", "+4512345678", "+45 12345678", "+45-1234-5678", "004512345678", "0045 12345678", "00 45 12 34 56 78"], ["+49 30 1234567", "0049301234567", "0049 30 1234567"], ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958", "+44 (20) 7946-0958"], ["+1 (988) 555-2485", "+19885552485", "+1 988 555 2485", "0019885552485", "001 988 555 2485"], ["+353 1 234 5678", "+35312345678"]],
    "iban": [["GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432"]],
    "email": [["Bob.Smith@X.org", "bob.smith@x.org", "BOB.SMITH@x.ORG", "bobSmith@x.org"]],
    "date": [["2001-02-24", "2001/02/24", "24.02.2001", "24/02/2001", "02/24/2001", "24.2.2001", "2/24/2001"], ["2001-02-03", "2001/02/03", "03.02.2001", "02/03/2001"], ["1850-12-31", "31.12.1850"]],
}


def plain_value(kind, text):
    """What a spelling stands for, read without the library."""
    if kind == "email":
        return text.lower().replace(".", "")
    if kind == "phone":
        text = re.sub("^(?:00|[+])[ -]?", "", text)
    if kind != "date":
        return re.sub(r"[^0-9A-Za-z]", "", text.replace("(0)", ""))
    a, b, c = map(int, re.split(r"[./-]", text))
    if a > 31:
        return a, b, c
    return (c, b, a) if "." in text or a > 12 else (c, a, b)


@pytest.mark.parametrize(("kind", "spellings"), [(k, s) for k, vs in SPELLINGS.items() for s in vs])
def test_all_spellings_of_a_value_get_one_pseudonym(kind, spellings):
    there, back = pii.Permuter(b"key"), pii.Permuter(b"key", True)
    new = [pii.replaced(f"a {s} b", there, {})[0][2:-2] for s in spellings]
    assert len({plain_value(kind, s) for s in spellings}) == len({plain_value(kind, n) for n in new}) == 1
    assert plain_value(kind, new[0]) != plain_value(kind, spellings[0])
    assert {plain_value(kind, pii.replaced(n, back, {})[0]) for n in new} == {plain_value(kind, spellings[0])}


@given(st.dates(min_value=__import__("datetime").date(1600, 1, 1), max_value=__import__("datetime").date(2399, 12, 31)))
@settings(max_examples=100, deadline=None)
def test_dates_are_linked_whatever_their_day(d):
    there = pii.Permuter(b"key")
    forms = [f"{d:%Y-%m-%d}", f"{d:%d.%m.%Y}", f"{d:%m/%d/%Y}", *([f"{d:%d/%m/%Y}"] if d.day > 12 else [])]
    assert len({plain_value("date", pii.pseudonym("date", f, there)) for f in forms}) == 1


@given(st.integers(10**9, 10**12))
@settings(max_examples=300, deadline=None)
def test_numbers_dialled_with_zeros_are_linked_at_every_length(body):
    """Up to fifteen digits, some of which could be a card's; what is one stays one."""
    there, back = pii.Permuter(b"key"), pii.Permuter(b"key", True)
    zeros, plus = f"0049{body}", f"+49{body}"
    new = pii.replaced(f"a {plus} b", there, {})[0]
    got, kinds = pii.replaced(f"a {zeros} b", there, {})
    if kinds == ["phone"]:
        assert plain_value("phone", got[2:-2]) == plain_value("phone", new[2:-2])
        assert plain_value("phone", pii.replaced(got, back, {})[0][2:-2]) == f"49{body}"
    else:
        assert kinds == ["card"] and pii.luhn(zeros[:-1]) == int(zeros[-1])
        assert pii.replaced(got, back, {})[0] == f"a {zeros} b"


@pytest.mark.parametrize("value", ["1/2/2024", "24.2.2001", "3/14/1999", "9.9.2009"])
def test_days_without_zeros_in_front_get_none(value):
    new = [pii.pseudonym("date", value, pii.Permuter(b"key%d" % i)) for i in range(200)]
    assert not any(re.search(r"(?<![0-9])0", n) for n in new) and len(set(new)) > 190


def feistel(x, n, tweak, key):
    """The keyed permutation again: eight rounds over two halves, walked until the value is in range."""
    half = (max(2, n - 1).bit_length() + 1) // 2
    while True:
        left, right = divmod(x, 1 << half)
        for i in range(8):
            width = (half + 7) // 8
            noise = b"".join(hashlib.blake2b(b"%d|%d|%d|" % (i, (1 << half) - 1, right) + tweak + b"|%d" % j, key=key).digest() for j in range(-(-width // 64)))
            left, right = right, left ^ int.from_bytes(noise[:width], "little") & ((1 << half) - 1)
        x = (left << half) + right
        if x < n:
            return x


def test_pseudonyms_of_a_table_by_brute_force(spark):
    """Every value of every text again, one at a time."""
    rows = [(1, "call +45 12 34 56 78 or 10.0.0.255"), (2, "call +4512345678, 123-45-6789"), (2, "call +4512345678, 123-45-6789"), (None, "on 2001-02-24"), (4, None), (5, ""), (6, "ver 2020-01-02, version 1.2.3.4, v1.2.3.4"), (7, "x " * 50_000 + "10.0.0.255")]
    df = spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, n_email string, swapped int").repartition(3)
    got = pii.pseudonymised(df, b"key")
    assert got.columns[:4] == df.columns and "n_email_" in got.columns
    ip = lambda s: ".".join(map(str, feistel(int.from_bytes(bytes(map(int, s.split(".")))), 2**32, b"ipv4", b"key").to_bytes(4)))
    phone = f"{feistel(12345678, 10**8, b'phone45|8', b'key'):08d}"
    ssn = 123456789
    while not (ssn := feistel(ssn, 10**9, b"ssn", b"key")) or not re.fullmatch(r"(?!000|666|9)\d{3}(?!00)\d\d(?!0000)\d{4}", f"{ssn:09d}"):
        pass
    import datetime

    first, after = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
    day = datetime.date.fromordinal(first + feistel(datetime.date(2001, 2, 24).toordinal() - first, after - first, b"date1900", b"key"))
    two = f"call +45{phone}, {ssn:09d}"
    two = two[:-9] + f"{two[-9:-6]}-{two[-6:-4]}-{two[-4:]}"
    want = [(1, f"call +45 {phone[:2]} {phone[2:4]} {phone[4:6]} {phone[6:]} or {ip('10.0.0.255')}"), (2, two), (2, two), (None, f"on {day}"), (4, None), (5, ""), rows[6], (7, "x " * 50_000 + ip("10.0.0.255"))]
    assert rows_of(got, "doc_id", "text") == sorted(want, key=str)
    back = pii.pseudonymised(got.select(df.columns), b"key", reverse=True)
    assert rows_of(back, "doc_id", "text") == sorted(rows, key=str)
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymised(df, b"")


# SentencePiece


@pytest.fixture(scope="module")
def known():
    import public_tokenizers

    return sentencepieces.pieces(public_tokenizers.path("piece_bpe_32k.model"))


def best_sum(pieces, unknown, text):
    best = [(0.0, 0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [(best[i][0] + pieces[text[i:end]][1], end - i, best[i][2] + [pieces[text[i:end]][0]]) for i in range(max(0, end - 16), end) if text[i:end] in pieces]
        if text[end - 1] not in pieces:
            options.append((best[end - 1][0] + unknown, 1, best[end - 1][2] + [("bytes", text[end - 1])]))
        best[end] = max(options, key=lambda o: (o[0], o[1]))
    return best[-1][2]


@pytest.mark.parametrize("text", ["Hello world", "  two  spaces\n\ntab\t x ", "é ü 漢字 \U0001f600 x", "a" * 40, " ", "\n", "naïve, re-entrant"])
def test_viterbi_over_the_whole_text(known, text):
    from sentencepiece import sentencepiece_model_pb2

    import public_tokenizers

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
    want = []
    for i in best_sum(pieces, known.unknown, "▁" + text.replace(" ", "▁")):
        want += [known.byte[b] for b in i[1].encode()] if isinstance(i, tuple) else [i]
    assert np.frombuffer(known.encode(text), "<u4").tolist() == want
    assert known.decode(known.encode(text)) == text


def test_pieces_across_words_and_long_words(known):
    rng = random.Random(2)
    letters = ["▁", "a", "b", "c", "\n"]
    longer = ["".join(rng.choice(letters) for _ in range(n)) for n in (2, 2, 2, 3, 3, 4) * 4] + ["a▁b", "\na"]
    plain = sentencepieces.Pieces([*[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *[(p, -rng.random() * 4, 1) for p in sorted({*letters[:4], *longer})]])
    assert plain.whole and not known.whole
    pieces = {p: (256 + i, 0.0) for i, p in enumerate(sorted({*letters[:4], *longer}))}
    scores = {i: s for i, s in ((x[1][0], x[1][1]) for x in (plain.automaton.get(p) and (p, plain.automaton.get(p)) for p in pieces))}
    pieces = {p: (i, scores[i]) for p, (i, _) in pieces.items()}
    for n in (1, 5, 30, 200):
        text = "".join(rng.choice(["a", "b", "c", " ", "\n", "é"]) for _ in range(n))
        want = []
        for i in best_sum(pieces, plain.unknown, "▁" + text.replace(" ", "▁")):
            want += [plain.byte[b] for b in i[1].encode()] if isinstance(i, tuple) else [i]
        assert np.frombuffer(plain.encode(text), "<u4").tolist() == want
        assert plain.decode(plain.encode(text)) == text
    word = "ab漢" * 40_000
    assert known.decode(known.encode(word)) == word and all(len(w) <= sentencepieces.LONGEST for w in known)


def test_round_trip(spark, corpus):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = frame(spark, corpus)
    assert all(r.restored for r in sentencepieces.round_trip(docs, path).collect())
    back = sentencepieces.decode(sentencepieces.encode(docs, path), path)
    assert rows_of(back, "doc_id", "text") == sorted(((i, t or "") for i, t in corpus), key=str)


# WARC


def test_warc(spark):
    rows = [(3, "u3", "x" * 100), (1, "u1\r\nX: y", "x" * 100), (2, None, "x" * 99), (4, "u4", "x" * 99), (5, "u5", None), (6, "u6", "é\r\n\r\n" * 50), (7, "u7", "x" * 100), (1, "again", "x" * 100), (None, "n", "x" * 100)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, offset int, digest string").repartition(3)
    index = warc.write_warc(pages, roll_bytes=200)
    assert index.count() == len(rows)
    got = {(r.page_id, r.url): r for r in warc.read_warc(index, span=300).collect()}
    assert got[3, "u3"].record_type == "revisit" and got[3, "u3"].refers_to == 1
    assert got[None, "n"].record_type == "revisit" and got[1, "again"].record_type == "response"
    assert got[2, None].record_type == got[4, "u4"].record_type == got[5, "u5"].record_type == "response"
    for page_id, url, html in rows:
        r = got[page_id, None if url is None else url.replace("\r\n", "%0D%0A")]
        data = (html or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == data
    assert {r.page_id for r in warc.read_warc(index.filter("page_id > 5")).collect()} == {6, 7}
    assert warc.read_warc(warc.write_warc(pages.filter("page_id = 99"))).collect() == []


# chat


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "cy", ""), (2, 0, None, "nobody"), (None, 5, "ann", "lost")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "conv_id long, turn long, role string, text string, head string")
    got = chat.perspectives(df).collect()
    for conv, who in {(r.conv_id, r.perspective) for r in got}:
        parts = sorted((r for r in got if (r.conv_id, r.perspective) == (conv, who)), key=lambda r: r.position)
        whole = "".join(r.segment for r in parts)
        assert [r.position for r in parts] == list(range(len(parts)))
        for r in parts:
            assert whole[r.start : r.start + r.length] == r.segment
            assert r.target == (r.role == "assistant") == (r["name"] == who)
            if r.target:
                assert whole[r.mask_start : r.mask_start + r.mask_length].endswith(chat.CLOSE)
                assert r.segment.count(chat.CLOSE) == 1
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (1, "cy"), (None, "ann")}
    assert len([r for r in got if r.conv_id == 1]) == 3 * 5


def test_long_dialogues_and_odd_names(spark):
    rng = random.Random(17)
    rows = [(i, rng.choice(["ann", "bob\n<|im_end|>", "cy\r\n", ""]), "w" * rng.randint(0, 30)) for i in rng.sample(range(400), 300)]
    df = spark.createDataFrame([(1, *r) for r in rows], "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.perspectives(df, block=64).collect()
    for who in {"ann", "bob\n<|im_end|>", "cy\r\n"}:
        parts, at = sorted((r for r in got if r.perspective == who), key=lambda r: r.position), 0
        assert [r.turn for r in parts] == sorted(r[0] for r in rows) and [r.position for r in parts] == list(range(300))
        for r in parts:
            assert r.start == at and r.length == len(r.segment)
            assert r.segment.count(chat.OPEN) == r.segment.count(chat.CLOSE) == 1 and r.segment.count("\n") == 2 and "\r" not in r.segment
            at += r.length


# toxicity


def test_toxicity_of_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out()).collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    caught, wrong = sum(r.predicted for r in toxic), sum(r.predicted for r in clean)
    assert len(rows) > 500 and caught >= 0.8 * len(toxic) and caught >= 0.9 * (caught + wrong) and wrong <= 0.02 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(not r.evidence for r in rows) <= 0.01 * len(rows)
    # calibration: the mean score is the share of toxic ones, and scores tell far more than that share
    assert sum(r.score for r in rows) / len(rows) == pytest.approx(len(toxic) / len(rows), abs=0.02)
    assert sum((r.score - r.toxic) ** 2 for r in rows) / len(rows) < 0.35 * len(toxic) * len(clean) / len(rows) ** 2


def plain_terms(text):
    """Lower-case words of letters, and the first four and five bytes of longer ones."""
    out = {}
    for w in re.findall(rb"(?:[a-z]|[\x80-\xff])+", re.sub("[\u0080-\u00bf\u2000-\u2fff]", " ", (text or "").lower()).encode()):
        for t in (w, *((n, w[:n]) for n in (4, 5) if len(w) > n)):
            out[t] = out.get(t, 0) + 1
    return out


def test_toxicity_by_dictionaries(spark):
    """The whole way again, with plain dictionaries."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    bad = ["vile" + w for w in words[:6]]
    docs, labels = [], []
    for i in range(400):
        y = int(rng.random() < 0.4)
        text = " ".join(rng.choice(bad) if y and rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(3, 60)))
        docs.append((i, text if i % 50 else None if i % 100 else ""))
        if i % 4:
            labels.append((i, y))
    docs += [(900, docs[7][1]), (901, docs[7][1].upper() + " — “" + docs[9][1] + "”")]
    df, ys = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, ys)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}

    counts = {d: plain_terms(t) for d, t in docs}
    n = len(docs)
    freq = {}
    for c in counts.values():
        for t in c:
            freq[t] = freq.get(t, 0) + 1
    ids = set(model.index.ids.tolist())
    label = dict(labels)
    assert ids <= {d for d in label if zlib.crc32(str(d).encode()) % 5} and [label[d] == 1 for d in model.index.ids.tolist()] == model.index.toxic.tolist()
    known = set().union(*(counts[d] for d in ids))
    assert len(model.vocabulary) == len(known)
    n1 = sum(label[d] for d in ids)
    n0 = len(ids) - n1
    told = set()
    for t in known:
        a = sum(1 for d in ids if label[d] and t in counts[d])
        b = sum(1 for d in ids if not label[d] and t in counts[d])
        if a * n0 >= 5 * b * n1 and (n1 + n0) * (a * n0 - b * n1) ** 2 / (n1 * n0 * (a + b) * (n1 + n0 - a - b) + 1e-9) >= 20:
            told.add(t)
    assert len(told) == model.telling.terms > 0

    def vector(c, of):
        w = {t: (1 + np.log(m)) * (np.log((1 + n) / (1 + freq[t])) + 1) for t, m in c.items() if t in of}
        length = np.sqrt(sum(x * x for x in w.values())) or 1
        return {t: x / length for t, x in w.items()}

    vectors = [(of, {e: vector(counts[e], of) for e in ids}) for of in (known, told)]
    for d, c in [(d, c) for d, c in counts.items() if d % 7 == 0]:
        seen, near = [], []
        for of, examples in vectors:
            q = vector(c, of)
            scored = sorted((-s, e) for e, v in examples.items() if (s := sum(x * v.get(t, 0) for t, x in q.items())) > 0)[:25]
            near.append(scored)
            total = -sum(s for s, _ in scored)
            share = -sum(s for s, e in scored if label[e]) / total if total else 0
            seen += [share, (2 * share - 1) * np.log1p(total) if total else 0, float(total > 0)]
        z = model.weights[0] + np.dot(model.weights[1:], seen)
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
        assert [e.cosine for e in got[d].evidence] == pytest.approx([-s for s, _ in near[0][:3]])
    assert got[900].score == pytest.approx(got[7].score) and got[0].evidence == [] and got[50].evidence == []


def test_toxicity_of_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    text = docs.filter("length(text) > 200").first()["text"]
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "   \n"), (5, (text + " ") * 400), (6, "12 34")]
    odd = spark.createDataFrame([(i, t, 0.9, 1, "e") for i, t in rows], "doc_id long, text string, score double, predicted int, evidence string")
    got = sorted(((r.doc_id, r.score) for r in toxicity.score(odd, model).collect()), key=str)
    assert len(got) == len(rows)
    of = dict(got)
    assert len({s for d, s in got if d in (1, None)}) == 1 and of[2] == of[3] == of[4] == of[6]
    assert of[5] == pytest.approx(toxicity.score(odd, model).filter("doc_id = 5").first()["score"])
    kept = toxicity.without_toxic(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {d for d, s in got if s < 0.5}


@pytest.mark.parametrize("block", [16, 64, 1000])
def test_nearest_examples_are_exact(block):
    rng = np.random.default_rng(1)
    n, terms = 200, 30
    dense = np.where(rng.random((n, terms)) < rng.random(terms), rng.integers(1, 5, (n, terms)), 0) / 4
    dense[50:60] = dense[50]  # ties
    e, t = np.nonzero(dense)
    index = toxicity.Index.build(np.arange(n) * 3, rng.random(n) < 0.5, terms, e, t, dense[e, t], block, common=0.4)
    assert 0 < (index.column >= 0).sum() < terms
    query = np.where(rng.random((40, terms)) < 0.3, rng.random((40, terms)), 0)
    query[3] = 0
    a, b = np.nonzero(query)
    text, example, cosine = index.nearest(a, b, query[a, b], 40, 7)
    for i in range(40):
        scores = sorted((-s, j) for j, s in enumerate(dense @ query[i]) if s > 0)[:7]
        assert cosine[text == i].tolist() == pytest.approx([-s for s, _ in scores])
        assert len({*example[text == i]}) == len(scores)


def test_toxicity_without_labels(spark, corpus):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    docs = frame(spark, corpus)
    model = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.without_toxic(docs, model).count() == len(corpus)
    assert toxicity.without_toxic(docs, model).columns == docs.columns


# empty tables, and SQL


def test_empty_tables(spark):
    import public_tokenizers

    docs = spark.createDataFrame([], DOCS)
    assert ngramjoin.jaccard_join(docs).collect() == []
    assert suffixdedup.removed_digests(docs).collect() == []
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert sentencepieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    assert pii.pseudonymised(docs, b"key").collect() == []
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, model).collect() == []
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    out = con.execute(queries.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df, *names) == sorted(out.fetchall(), key=str)
