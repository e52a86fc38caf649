"""N-gram Jaccard join by token-combination prefixes.

A document is its set of word shingles, each a 64-bit hash. Shingles are put in one order:
rare ones first, frequent ones last. Two sets that are similar enough share much of the
beginning of this order, the prefix. A rare shingle of the prefix is a signature by itself.
Frequent ones aren't selective, so they are dealt into classes by their hash, and every
combination of ``combine`` shingles of a class is a signature; a class may then hide
``combine - 1`` common shingles, and the prefix is extended by as many. Sets that share a
signature are candidates and are verified exactly.

``frequent`` means: in more than max(``rare_limit``, documents / 4096, shingles / 2^20)
documents. So at most 2^20 shingles are frequent, whatever the corpus, and their hashes are
broadcast. Sets of so few shingles that they needn't have ``combine`` in common with one they
link with (2 at 85 %) have single ones as signatures. The number of classes goes by the size of the set (by its power of 1 / threshold,
with which similar sets differ by one at most, and each set takes part in its own and the
next), so that signatures grow linearly with it.

Copies of a set are one node. Candidates of a signature are first only held against the
signature's smallest and largest set; what links is put into components. Where sets of a
signature are still in different components, further pivots are held against them, another
one for each signature and turn, until that closes few. Then all pairs of candidates that are
still in different components are verified, so no link is lost, and the pairs within a group
that hangs together already are never made. Before sets are fetched for
that, each pair passes a test on sizes and parities of the sets that no true link fails.

Defined results: null text counts as empty; texts without words have an empty set and are
linked with nothing; repeated rows link as copies; an empty table gives an empty result; a
row of null doc_id is linked with nothing and has a null component; further columns are ignored. Sets are
told apart by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import BASE, batches, mix, shingle_sets
from ._common import id_or_nobody, materialize, null_again, small_batches
from ._graph import components

#: A set's parities: for each of 64 * WORDS classes of shingles whether it holds an odd number of them; and for FOLD times as many.
WORDS, FOLD = 8, 8
BITS = [f"b{i}" for i in range(WORDS)]
SETS = "doc_id long, n_shingles long, set_key long, wide array<long>, " + ", ".join(f"{b} long" for b in BITS)
SIGNATURES = "signature long, set_key long"
#: So many more stars at most before all pairs that are left are made.
TURNS = 6


def set_key(tokens: np.ndarray) -> int:
    if not len(tokens):
        return 0
    h = mix(tokens + np.uint64(BASE))
    both = np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(h))])
    return int(mix(both)[0].astype(np.int64)) ^ int(mix(both * np.uint64(BASE))[1].astype(np.int64))


def parities(tokens: np.ndarray) -> np.ndarray:
    n = 64 * WORDS * FOLD
    odd = np.bincount((mix(tokens) >> np.uint64(40)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(rows: DataFrame, k: int, make, schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for own, buf, starts in batches(f):
                sets = shingle_sets(buf, starts, k)
                yield make(own, sets, [set_key(s) for s in sets])

    return rows.mapInPandas(run, schema)


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    def make(own, sets, keys):
        wide = np.array([parities(s) for s in sets])
        bits = np.bitwise_xor.reduce(wide.reshape(len(sets), FOLD, WORDS), axis=1)
        return pd.DataFrame({"doc_id": own["doc_id"].array, "n_shingles": [len(s) for s in sets], "set_key": keys, "wide": [*wide], **{b: bits[:, i] for i, b in enumerate(BITS)}})

    return null_again(_sets(docs.select(id_or_nobody("doc_id"), "text"), k, make, SETS), "doc_id")


def frequent_tokens(docs: DataFrame, k: int, limit: int, chars: int) -> np.ndarray:
    """The first 40 and more bits of every shingle hash that more than ``limit`` documents hold, sorted.

    Tasks send what they have seen as packed 32-bit arrays by leading bits; hashes that
    agree in all these bits count as one, which makes a rare one frequent at worst.
    """
    bits = max(8, math.ceil(math.log2(max(1, chars) / 4e6)))
    shift = np.uint64(32 - bits)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            token, n = np.unique(np.concatenate(held) >> shift, return_counts=True)
            bucket, low, cuts = token >> np.uint64(32), token.astype(np.uint32), np.searchsorted(token >> np.uint64(32), np.arange(1, 1 << bits, dtype=np.uint64))
            lows, ns = np.split(low, cuts), np.split(n.astype(np.uint32), cuts)
            full = [i for i, x in enumerate(lows) if len(x)]
            return pd.DataFrame({
                "bucket": full,
                "once": [lows[i][ns[i] == 1].tobytes() for i in full],
                "more": [lows[i][ns[i] > 1].tobytes() for i in full],
                "n": [ns[i][ns[i] > 1].tobytes() for i in full],
            })

        for f in frames:
            for _, buf, starts in batches(f):
                sets = shingle_sets(buf, starts, k)
                held += sets
                size += sum(map(len, sets))
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def count(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        once = [np.frombuffer(x, np.uint32) for x in f["once"]]
        more = [np.frombuffer(x, np.uint32) for x in f["more"]]
        token = np.concatenate(once + more)
        n = np.concatenate([np.ones(sum(map(len, once)), np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in f["n"])])
        order = np.argsort(token, kind="stable")
        token, n = token[order], n[order]
        first = np.flatnonzero(np.diff(token, prepend=np.uint32(~token[0]) if len(token) else 0))
        total = np.add.reduceat(n, first)
        keep = total > limit
        return pd.DataFrame({"token": (np.uint64(key[0]) << np.uint64(32) | token[first][keep].astype(np.uint64)).astype(np.int64)})

    sent = docs.mapInPandas(send, "bucket int, once binary, more binary, n binary")
    found = sent.groupBy("bucket").applyInPandas(count, "token long")
    # 2^20 at most: each is in more than a 2^20-th of all places
    return np.sort(found.toPandas()["token"].to_numpy(np.int64).astype(np.uint64)), shift


def signatures(docs: DataFrame, k: int, percent: int, combine: int, frequent: np.ndarray, shift: np.uint64) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(frequent)
    growth = math.log(100 / percent) if percent < 100 else 1.0
    small = math.ceil(combine * 100 / percent)

    def of(tokens: np.ndarray) -> np.ndarray:
        n = len(tokens)
        spare = n - -(-percent * n // 100)  # so many of its shingles may be missing in the other set
        order = mix(tokens)
        if len(known.value):
            at = np.searchsorted(known.value, tokens >> shift)
            hot = known.value[np.minimum(at, len(known.value) - 1)] == tokens >> shift
        else:
            hot = np.zeros(n, bool)
        rare = np.sort(order[~hot])
        if len(rare) > spare or not hot.any():
            return rare[: spare + 1]
        often, out = np.sort(order[hot]), [rare]
        level = int(math.log(n) / growth + 1e-9)
        for lv in (level, level + 1):
            size = math.exp(lv * growth)
            if size < small:  # too few to have `combine` in common
                out.append(often[: spare + 1 - len(rare)])
                continue
            classes = max(1, round((100 - percent) / 100 * size / 8))
            cls = (often % np.uint64(classes)).astype(np.int64)
            # the n-th shingle of a class counts once combine - 1 others of its class went before
            by = np.argsort(cls, kind="stable")
            nth = np.empty(len(cls), np.int64)
            first = np.searchsorted(cls[by], np.arange(classes))
            nth[by] = np.arange(len(cls)) - first[cls[by]]
            counts = np.cumsum(nth >= combine - 1)
            need = spare + 1 - len(rare)
            stop = int(np.searchsorted(counts, need)) + 1
            group = cls[:stop]
            for c in np.unique(group):
                own_tokens = often[:stop][group == c]
                picked = np.array(np.meshgrid(*[np.arange(len(own_tokens))] * combine, indexing="ij")).reshape(combine, -1)
                picked = picked[:, (np.diff(picked, axis=0) > 0).all(0)]
                made = np.full(picked.shape[1], (lv * 2 + 1) * BASE % 2**64, np.uint64)
                for row in picked:
                    made = mix(made + own_tokens[row])
                out.append(made)
        return np.unique(np.concatenate(out))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = {0}  # a task sends each set once, however many copies it reads
        for f in frames:
            for _, buf, starts in batches(f):
                found: dict[int, np.ndarray] = {}
                for tokens in shingle_sets(buf, starts, k):
                    if (key := set_key(tokens)) not in done:
                        done.add(key)
                        found[key] = tokens
                made = [of(tokens) for tokens in found.values()]
                sizes = [len(x) for x in made]
                yield pd.DataFrame({
                    "signature": np.concatenate([*made, np.zeros(0, np.uint64)]).astype(np.int64),
                    "set_key": np.repeat(np.array([*found], np.int64), sizes),
                })

    return docs.mapInPandas(run, SIGNATURES)


def near(a: str, b: str, percent: int):
    """Whether sets of these sizes and parities can be similar enough.

    A shingle that only one of them holds changes one parity, so they differ in as many
    shingles as in parities at least.
    """
    differ = sum((F.bit_count(F.col(f"{a}_{x}").bitwiseXOR(F.col(f"{b}_{x}"))) for x in BITS), F.lit(0))
    n_a, n_b = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent) & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))


def named(heads: DataFrame, key: str) -> DataFrame:
    return heads.select(F.col("set_key").alias(key), F.col("n").alias(f"{key}_n"), *(F.col(x).alias(f"{key}_{x}") for x in BITS))


def nearer(heads: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that pass the test of ``near`` with more parities, which tells long texts apart."""
    a = heads.select(F.col("set_key").alias("a"), F.col("n").alias("a_n"), F.col("wide").alias("a_wide"))
    b = heads.select(F.col("set_key").alias("b"), F.col("n").alias("b_n"), F.col("wide").alias("b_wide"))
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").filter(differ * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)).select("a", "b")


def verified(docs: DataFrame, heads: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set keys whose sets are similar enough, by the sets themselves."""
    keys = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    wanted = heads.join(keys, "set_key").select("doc_id")

    def make(own, found, found_keys):
        return pd.DataFrame({"set_key": found_keys, "tokens": [s.astype(np.int64) for s in found]})

    tokens = _sets(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"), k, make, "set_key long, tokens array<long>")
    tokens = materialize(tokens, "tokens")
    a = tokens.select(F.col("set_key").alias("a"), F.col("tokens").alias("a_tokens"))
    b = tokens.select(F.col("set_key").alias("b"), F.col("tokens").alias("b_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.size("a_tokens") + F.size("b_tokens") - both)).select("a", "b").distinct()


def opened(shared: DataFrame, groups: DataFrame, heads: DataFrame) -> DataFrame:
    """The sets of the signatures of more than two sets that aren't all in one component, with their sizes and parities."""
    placed = shared.select("signature", "set_key").distinct().join(groups.withColumnRenamed("node", "set_key"), "set_key", "left")
    placed = placed.withColumn("component", F.coalesce("component", "set_key"))
    several = placed.groupBy("signature").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members")).filter("x <> y AND members > 2").select("signature")
    return materialize(placed.join(several, "signature", "left_semi").join(heads.drop("doc_id", "wide"), "set_key"), "open")


def side(placed: DataFrame, key: str) -> DataFrame:
    return placed.select("signature", F.col("set_key").alias(key), F.col("component").alias(f"{key}_component"), F.col("n").alias(f"{key}_n"), *(F.col(x).alias(f"{key}_{x}") for x in BITS))


def star(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of each signature's pivot, which changes from turn to turn, with its sets of other components."""
    by = F.xxhash64("signature", "set_key", F.lit(turn))
    pivots = materialize(placed.groupBy("signature").agg(F.min_by("set_key", by).alias("set_key")), "pivots")
    pivots = materialize(pivots.join(placed, ["signature", "set_key"]), "pivots")
    met = side(placed, "a").join(side(pivots, "b"), "signature").filter((F.col("a_component") != F.col("b_component")) & near("a", "b", percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def across(placed: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of one signature and two components that can be similar enough."""
    different = (F.col("a") < F.col("b")) & (F.col("a_component") != F.col("b_component")) & near("a", "b", percent)
    left, right = side(placed, "a"), side(placed, "b").withColumnRenamed("signature", "of")
    return left.join(right, (F.col("signature") == F.col("of")) & different).select("a", "b").distinct()


def jaccard_join(docs: DataFrame, *, k: int = 5, percent: int = 80, combine: int = 2, rare_limit: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = materialize(document_sets(docs, k), "sets")
    rows, shingles = sets.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    frequent, shift = frequent_tokens(docs, k, max(rare_limit, rows // 4096, shingles >> 20), 6 * shingles)

    heads = sets.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("wide").alias("wide"), *(F.first(x).alias(x) for x in BITS))
    heads = materialize(heads, "heads")

    made = signatures(docs, k, percent, combine, frequent, shift)
    # signatures of at least two different sets, with the smallest and the largest of these
    ends = made.groupBy("signature").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi")
    shared = materialize(made.join(ends.hint("shuffle_hash"), "signature"), "signatures")

    def pairs(end: str) -> DataFrame:
        return shared.filter(F.col("set_key") != F.col(end)).select(F.least("set_key", end).alias("a"), F.greatest("set_key", end).alias("b"))

    tried = pairs("lo").unionByName(pairs("hi")).distinct()
    tried = tried.join(named(heads, "a"), "a").join(named(heads, "b"), "b").filter(near("a", "b", percent)).select("a", "b")
    tried = [materialize(nearer(heads, tried, percent), "pairs")]
    links = materialize(verified(docs, heads, tried[0], k, percent), "links")
    groups = components(links)

    def fresh(pairs: DataFrame) -> DataFrame:
        """The links among those of the pairs that weren't tried before."""
        # written first, or Spark would look up each pair once for every signature that it shares
        new = materialize(pairs, "met")
        for old in tried:
            new = new.join(old, ["a", "b"], "left_anti")
        tried.append(materialize(nearer(heads, new, percent), "pairs"))
        return verified(docs, heads, tried[-1], k, percent)

    # more stars: another pivot for each signature, as long as that closes many of the open ones
    placed, before = opened(shared, groups, heads), None
    for turn in range(TURNS):
        now = placed.count()
        if not now or (before is not None and now > 0.75 * before):
            break
        before = now
        links = materialize(links.unionByName(fresh(star(placed, turn, percent))), "links")
        groups = components(links)
        placed = opened(placed.select("signature", "set_key"), groups, heads)

    # every further pair of candidates that isn't in one component yet
    groups = components(links.unionByName(fresh(across(placed, percent))))

    placed_sets = sets.select("doc_id", "n_shingles", "set_key").join(groups.withColumnRenamed("node", "set_key"), "set_key", "left")
    placed_sets = placed_sets.withColumn("group", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_key")))
    smallest = placed_sets.filter(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("smallest"))
    return placed_sets.join(smallest, "group", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id"))
