"""Toxicity: the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index.

Fitting. Up to ``examples`` labelled documents of either class, picked by the hash of their
ids, are the examples; up to ``calibration`` of a quarter that is kept apart set the scale.
Terms are lower-cased words and their first four and five bytes (stems of inflected words),
each known by a 64-bit hash. All terms of the examples are in the index. Those that are
``least_ratio`` times as frequent in toxic ones, with a chi-square of ``least_chi2`` or more,
``telling`` at most, have a second index of their own. The document frequencies of the terms
are counted over all documents.

Scoring. Weights are (1 + ln tf) * idf, vectors have length one. Terms that few examples have
are scored by their postings. Those that many have stand in blocks of ``block`` examples with
each block's largest weight; the query's weights times these bound what the block's examples
can add, and blocks are taken by falling bound until no other can reach the ``k``-th best
cosine. A batch of texts goes through together. The neighbours vote with their cosines, by
all terms and by the telling ones alone; shares and strengths of the toxic votes go through a
logistic curve fitted on the calibration documents. ``evidence`` lists the nearest examples by
all terms.

Defined results: a text with none of the terms, be it empty or null, gets the score of no
evidence; equal cosines go to the example of smaller doc_id; repeated rows get equal
results; a label that is null is no label; without labels of both classes every score is the
share of toxic labels (0.0 without any); an empty table gives an empty result; further
columns are ignored. Labels are learned only from documents whose crc32 of the id, modulo
``folds``, isn't 0, and labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import mix, prefix_hashes, span_hashes
from ._common import id_or_nobody, materialize, null_again, small_batches

SCORES = "doc_id long, score double, predicted int, evidence array<struct<doc_id: bigint, cosine: double, toxic: int>>"
STEMS = (4, 5)
PIECE = 1 << 17
BATCH = 1 << 18


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Lower-cased texts as bytes, a number of them or parts of a long one at a time; parts end at a space if they can."""
    own: list[int] = []
    data: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        x = t.lower().encode("utf-8", "surrogatepass") if t else b""
        at = 0
        while at < len(x):
            stop = len(x)
            if stop - at > PIECE:
                stop = x.rfind(b" ", at, at + PIECE) + 1 or at + PIECE
            own.append(i)
            data.append(x[at:stop])
            size += stop - at
            at = stop
            if size >= PIECE:
                yield own, data
                own, data, size = [], [], 0
    if own:
        yield own, data


def term_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all texts: which text, and the hash."""
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    letter = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    # two-byte signs that begin with C2 and three-byte ones that begin with E2 are punctuation
    for lead, n in ((0xC2, 2), (0xE2, 3)):
        at = np.flatnonzero(buf == lead)
        for j in range(n):
            letter[np.minimum(at + j, len(buf) - 1)] = False
    edge = np.diff(letter.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.cumsum([0, *(len(x) + 1 for x in data)])
    of = np.searchsorted(starts, begin, "right") - 1
    prefix = prefix_hashes(buf)
    hashes, owners = [span_hashes(prefix, begin, end)], [of]
    for n in STEMS:
        longer = np.flatnonzero(end - begin > n)
        hashes.append(mix(span_hashes(prefix, begin[longer], begin[longer] + n) + np.uint64(n)))
        owners.append(of[longer])
    return np.concatenate(owners), np.concatenate(hashes)


def own_terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's terms, rising, and how often each occurs."""
    found = [term_hashes(data)[1] for _, data in pieces([text])]
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)


def counted(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, number) of the terms that are in the (rising) vocabulary, in order of texts and terms."""
    wide = max(1, len(vocabulary))
    keys, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own, data in pieces(texts):
        of, h = term_hashes(data)
        h, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, h), wide - 1)
        term = np.where(vocabulary[at] == h, at, -1)[back] if len(vocabulary) else np.full(len(back), -1)
        known = term >= 0
        key, n = np.unique(np.array(own)[of[known]] * wide + term[known], return_counts=True)
        keys.append(key)
        numbers.append(n)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(back, np.concatenate(numbers), len(key))
    return key // wide, key % wide, n


def held_out(folds: int = 5, doc_id: str = "doc_id"):
    """Whether a document's labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = stop - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def unit(text: np.ndarray, term: np.ndarray, n: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """The weights of counted terms; each text's vector has length one."""
    w = np.log(n)
    w += 1
    w *= idf[term]
    length = np.sqrt(np.bincount(text, w * w, texts))
    return w / np.where(length > 0, length, 1)[text]


@dataclass
class Index:
    """Unit vectors of the examples, in order of their ids: postings of rare terms, and blocks of the others."""

    ids: np.ndarray
    toxic: np.ndarray
    terms: int
    block: int
    example: np.ndarray  # of all postings, by term and example
    weight: np.ndarray
    start: np.ndarray  # term -> first posting
    column: np.ndarray  # term -> its column in the blocks, or -1

    @staticmethod
    def build(ids: np.ndarray, toxic: np.ndarray, terms: int, example: np.ndarray, term: np.ndarray, weight: np.ndarray, block: int = 64, common: float = 1 / 16) -> Index:
        """Of the weights of (example, term) pairs in order of examples."""
        by = np.argsort(term, kind="stable")  # postings come in order of examples
        example, term, weight = example[by], term[by], weight[by]
        del by
        many = np.bincount(term, minlength=terms) > common * len(ids)
        column = np.full(terms, -1, np.int32)
        column[many] = np.arange(many.sum())
        return Index(ids, toxic, terms, block, example.astype(np.int32, copy=False), weight, np.searchsorted(term, np.arange(terms + 1)), column)

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of common terms, (block, example, column), and the largest of each block; made where they are used."""
        if not hasattr(self, "_dense"):
            n = -(-max(1, len(self.ids)) // self.block)
            wide = int((self.column >= 0).sum())
            dense = np.zeros((n * self.block, wide))
            common = np.flatnonzero(self.column >= 0)
            at = ranges(self.start[common], self.start[common + 1])
            dense[self.example[at], np.repeat(self.column[common], self.start[common + 1] - self.start[common])] = self.weight[at]
            self._dense = dense.reshape(n, self.block, wide)
            self._most = self._dense.max(1).T if wide else np.zeros((0, n))
        return self._dense, self._most

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def nearest(self, text: np.ndarray, term: np.ndarray, w: np.ndarray, texts: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine) of the k nearest with a cosine over 0 of each text, nearest first; exact."""
        dense, most = self.blocks()
        n, block, wide = dense.shape
        column = self.column[term]
        rare = np.flatnonzero(column < 0)
        lo, hi = self.start[term[rare]], self.start[term[rare] + 1]
        at = ranges(lo, hi)
        size = hi - lo
        score = np.bincount(np.repeat(text[rare], size) * (n * block) + self.example[at], self.weight[at] * np.repeat(w[rare], size), texts * n * block).astype(float).reshape(texts, n, block)
        query = np.zeros((texts, wide))
        often = np.flatnonzero(column >= 0)
        query[text[often], column[often]] = w[often]
        bound = score.max(2) + query @ most
        order = np.argsort(-bound, axis=1, kind="stable")
        done = np.zeros((texts, n), bool)

        def take(pairs: np.ndarray) -> None:
            """Make the scores of (text, block) pairs whole."""
            for b in np.flatnonzero(pairs.any(0)):
                rows = np.flatnonzero(pairs[:, b])
                score[rows, b] += query[rows] @ dense[b].T
            np.logical_or(done, pairs, out=done)

        if n > 4:
            first = np.zeros((texts, n), bool)
            np.put_along_axis(first, order[:, :4], True, axis=1)
            take(first & (bound > 0))
            sure = np.where(done[:, :, None], score, 0.0).reshape(texts, -1)
            least = np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k] if sure.shape[1] > k else np.zeros(texts)
        else:
            least = np.zeros(texts)
        take((bound > 0) & (bound >= least[:, None] - 1e-12) & ~done)
        whole = np.where(done[:, :, None], score, 0.0).reshape(texts, -1)[:, : len(self.ids)]
        if whole.shape[1] > k:
            least = np.partition(whole, whole.shape[1] - k, axis=1)[:, whole.shape[1] - k]
        t, e = np.nonzero((whole > 0) & (whole >= least[:, None]))
        c = whole[t, e]
        by = np.lexsort((e, -c, t))
        t, e, c = t[by], e[by], c[by]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        return t[rank < k], e[rank < k], c[rank < k]

    def evidence(self, t: np.ndarray, e: np.ndarray, c: np.ndarray, texts: int) -> np.ndarray:
        """What the scale is fitted on: the toxic share of the vote, its surplus, and whether there is any."""
        total, bad = np.bincount(t, c, texts), np.bincount(t, c * self.toxic[e], texts)
        any_ = total > 0
        share = np.where(any_, bad / np.where(any_, total, 1), 0.0)
        return np.column_stack([share, np.where(any_, (2 * share - 1) * np.log1p(total), 0.0), any_])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a penalised logistic regression (the first is the constant), by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[penalty] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """What scoring needs: counted terms of the examples; the indices are built from them where they are used."""

    base: float
    k: int
    vocabulary: np.ndarray | None = None  # hashes, rising
    idf: np.ndarray | None = None
    ids: np.ndarray | None = None  # of the examples
    toxic: np.ndarray | None = None
    per: np.ndarray | None = None  # example -> how many terms it has
    term: np.ndarray | None = None  # of all examples, one after the other
    number: np.ndarray | None = None
    place: np.ndarray | None = None  # term -> its number among the telling ones, or -1
    block: int = 64
    weights: np.ndarray | None = None

    def _built(self, name: str, terms: int, pick: np.ndarray | None) -> Index:
        if name not in self.__dict__:
            example, term, number = np.repeat(np.arange(len(self.per), dtype=np.int32), self.per), self.term, self.number
            if pick is not None:
                own = pick[term] >= 0
                example, term, number = example[own], term[own], number[own]
            weight = unit(example, term, number, self.idf, len(self.ids))
            self.__dict__[name] = Index.build(self.ids, self.toxic, terms, example, term if pick is None else pick[term], weight, self.block)
        return self.__dict__[name]

    @property
    def index(self) -> Index:
        return self._built("_index", len(self.vocabulary), None)

    @property
    def telling(self) -> Index:
        return self._built("_telling", int((self.place >= 0).sum()), self.place)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What the scale is fitted on, by all terms and by the telling ones, and the nearest by all terms."""
        n = len(texts)
        text, term, number = counted(texts, self.vocabulary)
        near = self.index.nearest(text, term, unit(text, term, number, self.idf, n), n, self.k)
        own = self.place[term] >= 0
        text, term, number = text[own], term[own], number[own]
        told = self.telling.nearest(text, self.place[term], unit(text, term, number, self.idf, n), n, self.k)
        return np.hstack([self.index.evidence(*near, n), self.telling.evidence(*told, n)]), near

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.vocabulary is None:
            return np.full(len(texts), self.base), (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        seen, near = self.evidence(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + seen @ self.weights[1:], -30, 30))), near


def batched(texts: pd.Series, most: int = 256) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about a quarter of a megabyte, with the place of the first."""
    own, size, first = [], 0, 0
    for i, t in enumerate(texts):
        own.append(t)
        size += len(t or "")
        if size >= BATCH or len(own) == most:
            yield first, own
            own, size, first = [], 0, i + 1
    if own:
        yield first, own


def fit(docs: DataFrame, labels: DataFrame, *, examples: int = 1500, calibration: int = 4000, telling: int = 4096, least_chi2: float = 20.0, least_ratio: float = 5.0, k: int = 25, block: int = 64, folds: int = 5) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(folds)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    apart = F.pmod(F.xxhash64("doc_id", F.lit("scale")), F.lit(4)) == 0
    picked = [known.filter(~apart & (F.col("toxic") == y)).orderBy(*order).limit(examples).withColumn("use", F.lit("example")) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1]).unionByName(known.filter(apart).orderBy(*order).limit(calibration).withColumn("use", F.lit("scale")))
    # 2 * examples + calibration rows at most
    sample = materialize(docs.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "labelled")
    share = float(known.agg(F.avg("toxic")).first()[0] or 0.0)

    # copies among the examples would make their own words look telling
    shown = sample.filter("use = 'example'").dropDuplicates(["text"])

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [own_terms(t) for t in f["text"]]
            yield f[["doc_id", "toxic"]].assign(terms=[t.tobytes() for t, _ in found], numbers=[n.astype(np.int32).tobytes() for _, n in found])

    # 2 * examples rows at most
    rows = shown.select("doc_id", "toxic", "text").mapInPandas(listed, "doc_id long, toxic int, terms binary, numbers binary").toPandas().sort_values("doc_id")
    toxic = rows["toxic"].to_numpy() == 1
    n1, n0 = float(toxic.sum()), float((~toxic).sum())
    if not n1 or not n0:
        return Model(share, k)
    per = np.array([len(t) // 8 for t in rows["terms"]])
    # the driver holds these few arrays and no copies: a number for each term of each example
    found = np.frombuffer(b"".join(rows.pop("terms")), np.uint64)
    words = np.unique(found)
    term = np.empty(len(found), np.int32)
    for lo in range(0, len(found), 1 << 18):
        term[lo : lo + (1 << 18)] = np.searchsorted(words, found[lo : lo + (1 << 18)])
    del found
    number = np.frombuffer(b"".join(rows.pop("numbers")), np.int32)
    a = np.bincount(term[np.repeat(toxic, per)], minlength=len(words)).astype(float)
    b = np.bincount(term, minlength=len(words)) - a
    chi2 = (n1 + n0) * (a * n0 - b * n1) ** 2 / (n1 * n0 * (a + b) * (n1 + n0 - a - b) + 1e-9)
    told = np.flatnonzero((chi2 >= least_chi2) & (a * n0 >= least_ratio * b * n1))
    told = np.sort(told[np.lexsort((words[told], -chi2[told]))[:telling]])
    ids = rows["doc_id"].to_numpy(np.int64)
    del a, b, chi2, rows

    session = docs.sparkSession.sparkContext
    vocabulary = session.broadcast(words)  # the terms of 2 * examples texts

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(len(vocabulary.value), np.int64), 0
        for f in frames:
            for _, texts in batched(f["text"]):
                df += np.bincount(counted(texts, vocabulary.value)[1], minlength=len(df))
            n += len(f)
        met = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.append(-1, met), "n": np.append(n, df[met])})

    counts = docs.select("text").mapInPandas(held, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # one row a term
    vocabulary.destroy()
    df = np.zeros(len(words) + 1)
    df[counts["term"].to_numpy(np.int64) + 1] = counts["n"]
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1

    place = np.full(len(words), -1)
    place[told] = np.arange(len(told))
    model = Model(share, k, words, idf, ids, toxic, per, term, number, place, block)
    shared = session.broadcast(model)

    def evident(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for first, texts in batched(f["text"]):
                yield f[["doc_id", "toxic"]].iloc[first : first + len(texts)].assign(seen=[*shared.value.evidence(texts)[0]])

    rest = sample.filter("use = 'scale'").select("doc_id", "toxic", "text").mapInPandas(evident, "doc_id long, toxic int, seen array<double>").toPandas().sort_values("doc_id")
    shared.destroy()
    seen = np.array([*rest["seen"]], float).reshape(-1, 6)
    # a pseudo-count of either class where calibration documents are few or none
    seen = np.vstack([seen, [[1, np.log1p(1), 1] * 2, [0] * 6]])
    model.weights = logistic(seen, np.append(rest["toxic"].to_numpy(float), [1.0, 0.0]), 0.1)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and evidence of every row of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of fit()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for f in frames:
            for first, texts in batched(f["text"]):
                scores, (t, e, c) = own.scores(texts)
                evidence: list[list[dict]] = [[] for _ in texts]
                top = np.arange(len(t)) - np.searchsorted(t, t) < 3
                for i, j, x in zip(t[top].tolist(), e[top].tolist(), c[top].tolist(), strict=True):
                    evidence[i].append({"doc_id": int(own.index.ids[j]), "cosine": x, "toxic": int(own.index.toxic[j])})
                yield pd.DataFrame({"doc_id": f["doc_id"].array[first : first + len(texts)], "score": scores, "predicted": (scores >= 0.5).astype(np.int32), "evidence": evidence})

    return null_again(docs.select(id_or_nobody("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SCORES), "doc_id")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        own = [shared.value.scores(t)[0] < 0.5 for _, t in batched(texts)]
        return pd.Series(np.concatenate([np.zeros(0, bool), *own]))

    return docs.filter(accepted(F.col("text").cast("string")))
