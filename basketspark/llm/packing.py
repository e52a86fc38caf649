"""Best-fit packing by exact-complement hashing.

Texts become token ids; longer ones than a sequence are cut, all others stay whole. What
decides the packing is the histogram of piece lengths, which has at most ``size`` entries
however large the corpus, so it's gathered and planned at once: for the longest length left
the gap is looked up among single lengths, sums of two and sums of three, and a combination
that fills it exactly is used as often as the counts allow. Every use exhausts a length, so
there are few. What remains goes, longest first, where it fits best. The plan names for
each length which ranks go into which run of sequences and at which offset; pieces are
ranked within their length by two-level counts, so no length has to be in one task.

Defined results: a null text is an empty one and has the end token alone; repeated rows are
packed one by one; an empty table gives an empty result; a null doc_id is kept; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_or_nobody, materialize, null_again, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenized(docs: DataFrame, vocabulary: str, size: int, end_id: int) -> DataFrame:
    """A row per piece, with the CRC-32 of its ids and the task that made it."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .wordbpe import words

        encode, part, step = words(vocabulary).encode, TaskContext.get().partitionId(), 4 * size
        for f in frames:
            rows = []
            for doc_id, text in zip(f["doc_id"], f["text"], strict=True):
                ids = (encode(text) if text else b"") + end
                for n, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc_id, n, at // 4, len(own) // 4, zlib.crc32(own), part))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return docs.select(id_or_nobody("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, PIECES)


def plan(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) for ``counts[length]`` pieces of each length.

    The lengths of all sequences together are exactly the pieces given.
    """
    left, done = counts.astype(np.int64).copy(), []

    def use(lengths: tuple[int, ...]) -> bool:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(left[x] // n for x, n in need.items())
        if times <= 0:
            return False
        for x, n in need.items():
            left[x] -= n * times
        done.append((lengths, int(times)))
        return True

    def pair(gap: int, spare: np.ndarray) -> tuple[int, int] | None:
        """The two lengths filling ``gap`` that most pieces are left for."""
        if gap < 2:
            return None
        b = np.arange(1, gap // 2 + 1)
        times = np.minimum(spare[b], spare[gap - b])
        if gap % 2 == 0:
            times[-1] = spare[gap // 2] // 2
        best = int(np.argmax(times)) if len(times) else 0
        return (int(gap - b[best]), int(b[best])) if len(times) and times[best] > 0 else None

    def triple(gap: int, spare: np.ndarray) -> tuple[int, ...] | None:
        have = (spare[:gap] > 0).astype(float)
        sums = np.round(np.fft.irfft(np.fft.rfft(have, 2 * gap) ** 2, 2 * gap))[: gap + 1]
        for b in np.flatnonzero((have > 0) & (sums[gap - np.arange(gap)] > 0))[::-1]:
            spare[b] -= 1
            rest = pair(gap - int(b), spare)
            spare[b] += 1
            if rest:
                return (int(b), *rest)
        return None

    for a in range(size, 0, -1):
        gap = size - a
        if left[a] and not gap:
            use((a,))
        if left[a] and gap:
            use((a, gap))
        for search in (pair, triple):
            while left[a] and gap:
                left[a] -= 1
                found = search(gap, left)
                left[a] += 1
                if not found or not use((a, *found)):
                    break

    # best fit: open sequences by gap, each kind with its number; a length goes into the smallest gap that holds it, again and again
    gaps: dict[int, list[list]] = defaultdict(list)
    open_at = np.zeros(size + 1, bool)
    for a in range(size, 0, -1):
        n = int(left[a])
        while n:
            found = np.flatnonzero(open_at[a:])
            gap = a + int(found[0]) if len(found) else size
            kind = gaps[gap][-1] if len(found) else [(), n]
            copies = min(gap // a, n)
            times = min(n // copies, kind[1])
            if len(found):
                kind[1] -= times
                if not kind[1]:
                    gaps[gap].pop()
                    open_at[gap] = bool(gaps[gap])
            gaps[gap - a * copies].append([(*kind[0], *[a] * copies), times])
            open_at[gap - a * copies] = True
            n -= times * copies
    return done + [(lengths, times) for kinds in gaps.values() for lengths, times in kinds]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of ranks of a length: length, first rank, first sequence, offset; sorted by the first two."""
    rank, rows, sequence = defaultdict(int), [], 0
    for lengths, times in patterns:
        at = 0
        for x in lengths:
            rows.append((x, rank[x], sequence, at))
            rank[x] += times
            at += x
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def pack(docs: DataFrame, vocabulary: str, *, size: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    small_batches(docs.sparkSession)
    pieces = materialize(tokenized(docs, vocabulary, size, end_id), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-lengths")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():  # at most `size` rows
        histogram[r["length"]] = r["n"]
    lengths, ranks, sequences, offsets = places(plan(histogram, size))
    keys = lengths * (1 << 48) + ranks

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(own)).join(bases.hint("shuffle_hash"), ["part", "length"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = f["nth"].to_numpy(np.int64) - 1 + f["base"].to_numpy(np.int64)
            at = np.searchsorted(keys, f["length"].to_numpy(np.int64) * (1 << 48) + rank, "right") - 1
            out = f[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["sequence_id"], out["offset"] = sequences[at] + rank - ranks[at], offsets[at]
            yield out

    return null_again(ranked.mapInPandas(place, PACKED), "doc_id")
