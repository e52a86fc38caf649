"""Scoring by a language model: deleted interpolation of n-gram frequencies.

The probability of a token mixes maximum-likelihood estimates of all orders up to ``order``
and a uniform one over the vocabulary and an unknown word::

    p_0 = 1 / (V + 1)        p_j = w_j(b) c(last j tokens) / c(the j - 1 before) + (1 - w_j(b)) p_(j-1)

where b is the bucket (number of binary digits) of the context's frequency. The weights are
learned by expectation-maximisation on a fold of the learning documents whose own counts are
deleted from the estimates meanwhile; where a context is unknown its weight is 0. Afterwards
the counts of all learning documents are taken.

How Spark does it. Documents go into blocks of some 4 MB of text, each of one role (held
out, learned from, fold), kept as numbers of words in the block's vocabulary. A block asks for
its distinct n-grams: their hashes, sorted, go to buckets of hashes in packed slices with
the block's counts. A bucket adds up what all blocks have, and answers each block with the
totals in the order of its slice, so that no hash goes back. A hot n-gram is one entry of
each block's slice, however often it occurs; buckets and blocks have a size of their own,
whatever the corpus has. The fold's estimates stay in a table, over which a job runs for each
round of expectation-maximisation; a few hundred numbers of each round come to the driver.

Words are known by 56-bit hashes, longer n-grams by hashes with 2^14 values for each byte of
text, so that a part of 1 / 2^16 of unknown n-grams, at any size, is taken for a known one.

Defined results: null text counts as empty, and has one token (the end); documents with a
null id are held out; repeated rows are all counted and all scored; a text longer than two
blocks is cut at blanks into pieces that know the words before them, and summed again; an
empty table has no rows; if nothing is learned, all tokens are the unknown word, of probability
1; if the fold is empty, known contexts weigh a half; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import mix, prefix_hashes, span_hashes
from ._common import batches_of, materialize

#: Bytes of text of a block, and of text for which a bucket of hashes is made.
BLOCK, BUCKET = 1 << 22, 1 << 23
WORD_BITS = 56
BEGIN, END = (np.uint64(int(mix(np.array([x], np.uint64))[0]) >> (64 - WORD_BITS)) for x in (0xBE61, 0xE0D))
HELD_OUT, LEARNED, FOLD = 0, 1, 2
#: Buckets of context frequencies: the number of binary digits.
BUCKETS = 65
MOST = 1 - 1e-6


# packed numbers


def _planes(x: np.ndarray) -> bytes:
    """Small unsigned numbers, compressed byte by byte of their value."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return np.array([len(x), width], np.int64).tobytes() + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, np.int64, 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:]), np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _pack(keys: np.ndarray, bits: int) -> bytes:
    """Sorted distinct numbers below 2^bits: low bytes as they are, high parts by how many numbers share them."""
    low = max(0, -(-(bits - len(keys).bit_length() - 4) // 8))
    high = keys >> np.uint64(8 * low)
    counts = _planes(np.bincount(high.astype(np.int64), minlength=1).astype(np.uint64))
    rest = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :low])
    return np.array([len(keys), low, len(counts)], np.int64).tobytes() + counts + rest.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n, low, size = np.frombuffer(data, np.int64, 3).tolist()
    counts = _from_planes(data[24 : 24 + size]).astype(np.int64)
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(data, np.uint8, n * low, 24 + size).reshape(n, low)
    return out.reshape(-1).view(np.uint64) | (np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(8 * low))


def _joined(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def _parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at = 8 * (n + 1)
    out = []
    for size in np.frombuffer(data, np.int64, n, 8).tolist():
        out.append(data[at : at + size])
        at += size
    return out


# blocks


#: Bytes that are hashed at once.
CHUNK = 1 << 18


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes; the text ends with a blank."""
    begins, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    start = 0
    while start < len(buf):
        stop = min(start + CHUNK, len(buf))
        while True:  # to the last blank of the chunk, or the next one after it
            low = buf[start:stop] + (((buf[start:stop] >= 65) & (buf[start:stop] <= 90)).astype(np.uint8) << 5)
            space = (low == 32) | ((low >= 9) & (low <= 13))
            if stop == len(buf) or (last := int(space.argmax() if not space.any() else len(space) - 1 - space[::-1].argmax())) or space[0]:
                break
            stop = min(stop + 4 * (stop - start), len(buf))
        if stop < len(buf):
            low, space = low[: last + 1], space[: last + 1]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        begins.append(begin + start)
        hashes.append(span_hashes(prefix_hashes(low), begin, end) >> np.uint64(64 - WORD_BITS))
        start += len(low)
    return np.concatenate(begins), np.concatenate(hashes)


class _Block:
    """Texts, or pieces of them, of one role."""

    def __init__(self, lead: int):
        self.lead = lead
        self.clear()

    def clear(self) -> None:
        self.size, self.data, self.meta, self.leads = 0, [], [], {}

    def add(self, rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, first: bool = True, last: bool = True, lead: np.ndarray | None = None) -> None:
        if lead is not None:
            self.leads[sum(len(m[0]) for m in self.meta)] = lead
        self.meta.append((rows, ids, sizes, np.full(len(rows), first), np.full(len(rows), last)))
        self.data.append(data)
        self.size += len(data)

    def row(self, block: int, role: int) -> list:
        rows, ids, sizes, first, last = (np.concatenate(c) for c in zip(*self.meta, strict=True))
        begin, word = _words(np.concatenate(self.data))
        at = np.searchsorted(begin, np.concatenate(([0], np.cumsum(sizes))))
        words = np.diff(at)
        lengths = self.lead + words + last
        off = np.concatenate(([0], np.cumsum(lengths)))
        tokens = np.full(off[-1], BEGIN, np.uint64)
        tokens[np.arange(len(word)) + np.repeat(off[:-1] + self.lead - at[:-1], words)] = word
        tokens[off[1:][last] - 1] = END
        for i, lead in self.leads.items():
            tokens[off[i] : off[i] + self.lead] = lead
        code, seen = pd.factorize(tokens)
        order = np.argsort(seen)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out = [block, role, self.size, _pack(seen[order], WORD_BITS), _planes(place[code]), rows, ids, lengths, first]
        self.clear()
        return out


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("role", pa.int32()), ("n_bytes", pa.int64()), ("vocabulary", pa.binary()), ("words", pa.binary()), ("row", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())), ("first", pa.list_(pa.bool_())),
])
BLOCKS = "block long, role int, n_bytes long, vocabulary binary, words binary, row array<long>, doc_id array<long>, lengths array<int>, first array<boolean>"
#: Stands for a null id inside of blocks.
NO_ID = -(2**63)


def _blocks(lead: int, limit: int):
    """A function for batches of (doc_id, role, text), a blank after each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        row, block = part << 40, part << 24
        pending = {role: _Block(lead) for role in (HELD_OUT, LEARNED, FOLD)}

        def made(role: int) -> pa.RecordBatch:
            nonlocal block
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(pending[role].row(block, role), _BLOCKS, strict=True)], schema=_BLOCKS)

        for t in batches:
            roles = t.column(1).to_numpy(zero_copy_only=False)
            for role, own in pending.items():
                at = np.flatnonzero(roles == role)
                if not len(at):
                    continue
                ids = t.column(0).take(pa.array(at)).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
                text = t.column(2).take(pa.array(at)).cast(pa.large_string())
                o = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data, o = np.frombuffer(text.buffers()[2], np.uint8)[o[0] : o[-1]], o - o[0]
                rows = row + np.arange(len(at))
                row += len(at)
                i = 0
                while i < len(at):
                    if o[i + 1] - o[i] > 2 * limit:
                        for piece, first, last, before in _pieces(data[o[i] : o[i + 1]], limit, lead):
                            own.add(rows[i : i + 1], ids[i : i + 1], np.array([len(piece)]), piece, first, last, before)
                            if own.size >= limit:
                                yield made(role)
                        i += 1
                        continue
                    j = i + 1
                    while j < len(at) and o[j] - o[i] + own.size < limit and o[j + 1] - o[j] <= 2 * limit:
                        j += 1
                    own.add(rows[i:j], ids[i:j], np.diff(o[i : j + 1]), data[o[i] : o[j]])
                    if own.size >= limit:
                        yield made(role)
                    i = j
        for role, own in pending.items():
            if own.meta:
                yield made(role)

    return run


def _pieces(data: np.ndarray, limit: int, lead: int) -> Iterator[tuple[np.ndarray, bool, bool, np.ndarray | None]]:
    """A long text in pieces that end with a blank, each with the words before it."""
    blank = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    start, before = 0, np.full(lead, BEGIN, np.uint64)
    while start < len(data):
        # the last blank within the limit, or else the next one; the text ends with one
        at = np.searchsorted(blank, start + limit)
        stop = len(data) if len(data) - start <= limit else int(blank[at - 1] if at and blank[at - 1] >= start else blank[at]) + 1
        piece = data[start:stop]
        yield piece, start == 0, stop == len(data), None if start == 0 else before
        before = np.concatenate((before, _words(piece)[1]))[len(before) :][-lead:] if lead == 0 else np.concatenate((before, _words(piece)[1]))[-lead:]
        start = stop


class _Tokens:
    """A block's tokens with the hashes of their n-grams."""

    def __init__(self, vocabulary: bytes, words: bytes, lengths: np.ndarray, first: np.ndarray, order: int, bits: int):
        self.order, self.bits = order, bits
        self.vocabulary, self.words = _unpack(vocabulary), _from_planes(words).astype(np.int64)
        off = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        self.own = np.ones(len(self.words), bool)
        for s in range(order - 1):
            self.own[off[:-1] + s] = False
        self.last = off[:-1] + order - 2 if order > 1 else np.zeros(0, np.int64)  # the places before the first own tokens
        self.known = np.asarray(first, bool)
        self.piece = np.repeat(np.arange(len(lengths)), np.asarray(lengths) - (order - 1))
        self.at = np.flatnonzero(self.own)
        token = self.vocabulary[self.words]
        self.hashes = []
        h = token
        for j in range(2, order + 1):
            h = mix(np.concatenate((h[:1], h[:-1])) * np.uint64(0x9E3779B97F4A7C15) + token * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(j))
            self.hashes.append(h >> np.uint64(64 - bits))

    def ngrams(self) -> np.ndarray:
        """Sorted hashes of all occurrences that have a place: contexts before a piece's first token too."""
        parts = []
        for j, h in enumerate(self.hashes, 2):
            parts.append(h[self.at])
            if j < self.order:
                parts.append(h[self.last])
        return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts of the vocabulary, distinct n-grams, their counts); the words before a piece belong to the piece before."""
        words = np.bincount(self.words[self.at], minlength=len(self.vocabulary)) + np.bincount(self.words[self.last[self.known]] if self.order > 1 else [], minlength=len(self.vocabulary))
        keys = self.ngrams()
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, n = keys[edge], np.diff(np.append(edge, len(keys)))
        for j, h in enumerate(self.hashes, 2):
            if j < self.order and not self.known.all():
                np.subtract.at(n, np.searchsorted(keys, h[self.last[~self.known]]), 1)
        return words, keys, n

    def frequencies(self, words: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """For each order how often the n-gram that ends at a place occurs, all places."""
        out = [words[self.words]]
        t = min(self.bits, max(1, len(keys).bit_length()))
        begin = np.concatenate(([0], np.cumsum(np.bincount((keys >> np.uint64(self.bits - t)).astype(np.int64), minlength=1 << t))))
        for j, h in enumerate(self.hashes, 2):
            at = self.at if j == self.order else np.concatenate((self.at, self.last))
            want = h[at]
            place = begin[(want >> np.uint64(self.bits - t)).astype(np.int64)]
            off = np.flatnonzero(keys[place] != want)
            while len(off):
                place[off] += 1
                off = off[keys[place[off]] != want[off]]
            found = np.zeros(len(h), np.int64)
            found[at] = counts[place]
            out.append(found)
        return out


# counts of all blocks


def _slices(keys: np.ndarray, bits: int, cut: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(1, 1 << cut, dtype=np.uint64) << np.uint64(bits - cut))


def _requests(order: int, bits: int, cut: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("role", pa.int32()), ("slice", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(t.num_rows):
                block, role, vocabulary, words, lengths, first = (t.column(c)[i].as_py() if c < 4 else t.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(6))
                x = _Tokens(vocabulary, words, lengths, first, order, bits)
                seen, keys, n = x.counted()
                out = []
                w, g = _slices(x.vocabulary, WORD_BITS, cut), _slices(keys, bits, cut)
                for b, (kw, cw, kg, cg) in enumerate(zip(np.split(x.vocabulary, w), np.split(seen, w), np.split(keys, g), np.split(n, g), strict=True)):
                    if len(kw) or len(kg):
                        low = lambda k, width: k & np.uint64((1 << (width - cut)) - 1)  # noqa: B023, E731
                        counts = (b"", b"") if role == HELD_OUT else (_planes(cw), _planes(cg))
                        out.append((b, block, role, _joined(_pack(low(kw, WORD_BITS), WORD_BITS - cut), _pack(low(kg, bits), bits - cut), *counts)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


ANSWERS = "block long, bucket long, role int, slice binary, words long, tokens long, fold_tokens long"


def _sums(rows: list[tuple[int, np.ndarray, np.ndarray | None]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(places of each row's keys, distinct keys, totals, totals of the fold)."""
    keys = np.sort(np.concatenate([k for _, k, _ in rows]))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    total, fold, places = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), []
    for role, k, n in rows:
        at = np.searchsorted(keys, k)
        places.append(at)
        if n is not None:
            total[at] += n
            if role == FOLD:
                fold[at] += n
    return places, keys, total, fold


def _answered(group: pd.DataFrame, cut: int) -> pd.DataFrame:
    """Each block's slice of a bucket with the totals in place of the keys, and a row of sums of the bucket."""
    parts = [_parts(x) for x in group["slice"]]
    roles = group["role"].tolist()
    counts = lambda p, i: _from_planes(p[i]).astype(np.int64) if p[i] else None
    sums = [_sums([(r, _unpack(p[i]), counts(p, i + 2)) for r, p in zip(roles, parts, strict=True)]) for i in (0, 1)]
    bucket = int(group["bucket"].iloc[0])
    slices = []
    for row, role in enumerate(roles):
        answer = [_planes(total[places[row]]) for places, _, total, _ in sums]
        if role == FOLD:
            answer += [_planes(fold[places[row]]) for places, _, _, fold in sums]
        slices.append(_joined(*answer))
    _, keys, total, fold = sums[0]
    word = (keys | np.uint64(bucket << (WORD_BITS - cut))) != BEGIN
    out = pd.DataFrame({"block": group["block"].tolist(), "bucket": bucket, "role": roles, "slice": slices, "words": 0, "tokens": 0, "fold_tokens": 0})
    out.loc[len(out)] = [-1, bucket, -1, b"", int(np.count_nonzero(word & (total > 0))), int(total[word].sum()), int(fold[word].sum())]
    return out.astype({"block": "int64", "bucket": "int64", "role": "int32", "words": "int64", "tokens": "int64", "fold_tokens": "int64"})


def _estimates(block: pd.Series, answers: pd.DataFrame, order: int, bits: int, n_tokens: int, deleted: bool) -> tuple[_Tokens, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(tokens, estimates of each order, buckets of their contexts, frequencies of words), for the own tokens of a block."""
    x = _Tokens(block["vocabulary"], block["words"], np.asarray(block["lengths"]), block["first"], order, bits)
    keys = x.ngrams()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    parts = [_parts(s) for s in answers.sort_values("bucket")["slice"]]
    words, grams = (np.concatenate([_from_planes(p[i]) for p in parts]).astype(np.int64) for i in (0, 1))
    if deleted:
        words, grams = (a - np.concatenate([_from_planes(p[i]) for p in parts]).astype(np.int64) for i, a in ((2, words), (3, grams)))
    seen = x.frequencies(words, keys, grams)
    estimates, buckets = [], []
    for j, n in enumerate(seen):
        context = np.full(len(x.at), n_tokens) if j == 0 else seen[j - 1][x.at - 1]
        estimates.append(np.divide(n[x.at], context, out=np.zeros(len(x.at)), where=context > 0))
        buckets.append(np.ones(len(x.at), np.uint8) if j == 0 else np.frexp(context.astype(float))[1].astype(np.uint8))
    return x, estimates, buckets, seen[0][x.at]


# weights


def _mixed(estimates: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, uniform: float) -> list[np.ndarray]:
    """Probabilities of order 0, 1, ..."""
    out = [np.full(len(estimates[0]), uniform)]
    for f, b, w in zip(estimates, buckets, weights, strict=True):
        out.append(w[b] * f + (1 - w[b]) * out[-1])
    return out


def _expected(estimates: list[np.ndarray], buckets: list[np.ndarray], weights: np.ndarray, uniform: float) -> tuple[np.ndarray, np.ndarray, float]:
    """For each order and bucket: tokens that its estimate accounts for, tokens that reach it; and the log-likelihood."""
    p = _mixed(estimates, buckets, weights, uniform)
    reach, taken, reached = np.ones(len(p[0])), np.zeros(weights.shape), np.zeros(weights.shape)
    for j in range(len(weights) - 1, -1, -1):
        share = weights[j][buckets[j]] * estimates[j] / p[j + 1]
        taken[j] = np.bincount(buckets[j], reach * share, minlength=BUCKETS)
        reached[j] = np.bincount(buckets[j], reach, minlength=BUCKETS)
        reach = reach * (1 - share)
    return taken, reached, float(np.log(p[-1]).sum())


def _learned(fits: DataFrame, order: int, uniform: float, rounds: int, least_gain: float) -> np.ndarray:
    """Weights by order and bucket, from the fold's estimates."""
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0
    before = None
    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], now: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for f, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                    f = np.frombuffer(f, np.float32).reshape(order, -1).astype(float)
                    taken, reached, ll = _expected(list(f), list(np.frombuffer(b, np.uint8).reshape(order, -1)), now, uniform)
                    j, k = np.nonzero(reached)
                    yield pa.RecordBatch.from_arrays([pa.array([-1, *j], pa.int32()), pa.array([0, *k], pa.int32()), pa.array([ll, *taken[j, k]]), pa.array([float(f.shape[1]), *reached[j, k]])], ["j", "k", "taken", "reached"])

        sums = fits.mapInArrow(step, "j int, k int, taken double, reached double").groupBy("j", "k").agg(F.sum("taken").alias("taken"), F.sum("reached").alias("reached")).collect()
        if not sums:
            break
        weights, seen = np.zeros((order, BUCKETS)), {}
        for r in sums:
            if r.j >= 0 and r.k > 0:
                seen[r.j, r.k] = min(r.taken / r.reached, MOST) if r.reached else 0.5
        for j in range(order):
            for k in range(1, BUCKETS):
                weights[j, k] = seen.get((j, k), weights[j, k - 1])
        gain = next(r.taken / r.reached for r in sums if r.j < 0)
        if before is not None and gain - before < least_gain:
            break
        before = gain
    return weights


@dataclass(frozen=True)
class LanguageModel:
    """What was learned: the documents' blocks, the totals of their n-grams, and the weights by order and bucket."""

    blocks: DataFrame
    answers: DataFrame
    order: int
    bits: int
    words: int
    tokens: int
    weights: np.ndarray


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, order: int = 3, parts: int = 10, rounds: int = 30, least_gain: float = 1e-3, block: int = BLOCK, bucket: int = BUCKET) -> LanguageModel:
    """Learn from the documents whose CRC-32 of the id isn't 0 modulo ``parts``; where it is 1 they are the fold.

    ``rounds`` bounds those of the weights, which end when the fold's mean log-likelihood
    gains less than ``least_gain``.
    """
    remainder = F.crc32(F.col(id_col).cast("string")) % parts
    role = F.when(remainder == 1, FOLD).when(remainder > 1, LEARNED).otherwise(HELD_OUT)
    docs = df.select(F.col(id_col).cast("long"), role.cast("int"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")))
    with batches_of(df.sparkSession):
        blocks = materialize(docs.mapInArrow(_blocks(order - 1, block), BLOCKS), "blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 1
    bits, cut = min(60, n_bytes.bit_length() + 14), max(0, (n_bytes // bucket).bit_length())
    asked = blocks.select("block", "role", "vocabulary", "words", "lengths", "first").mapInArrow(_requests(order, bits, cut), "bucket long, block long, role int, slice binary")
    with batches_of(df.sparkSession):
        answers = materialize(asked.groupBy("bucket").applyInPandas(lambda g: _answered(g, cut), ANSWERS), "answers")
    sums = answers.filter("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "fold_tokens"))).first()
    words, tokens, fold_tokens = (int(x) for x in sums)

    def estimated(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        _, f, k, _ = _estimates(b.iloc[0], a, order, bits, tokens - fold_tokens, True)
        return pd.DataFrame({"f": [np.array(f, np.float32).tobytes()], "k": [np.array(k, np.uint8).tobytes()]})

    if not tokens:
        weights = np.zeros((order, BUCKETS))
    else:
        fits = _together(blocks.filter(F.col("role") == FOLD), answers.filter(F.col("role") == FOLD)).applyInPandas(estimated, "f binary, k binary")
        weights = _learned(materialize(fits, "fits"), order, 1 / (words + 1), rounds, least_gain)
    return LanguageModel(blocks, answers.filter("block >= 0"), order, bits, words, tokens, weights)


def _together(blocks: DataFrame, answers: DataFrame):
    return blocks.groupBy("block").cogroup(answers.select("block", "bucket", "slice").groupBy("block"))


def score(model: LanguageModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row that ``fit`` was given."""
    order, bits, words, tokens, weights = model.order, model.bits, model.words, model.tokens, model.weights

    def scored(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        b = b.iloc[0]
        x, f, k, seen = _estimates(b, a, order, bits, tokens, False)
        p = np.log10(_mixed(f, k, weights, 1 / (words + 1))[-1])
        base = np.log10((seen + 0.1) / (tokens + 0.1 * (words + 1)))
        own = lambda w: np.bincount(x.piece, w, minlength=len(b["row"]))
        return pd.DataFrame({
            "row": b["row"], "doc_id": b["doc_id"], "held_out": b["role"] == HELD_OUT, "n_tokens": own(np.ones(len(p))).astype(np.int64), "n_known": own(seen > 0).astype(np.int64), "base_score": own(base), "score": own(p),
        })

    rows = _together(model.blocks, model.answers).applyInPandas(scored, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
