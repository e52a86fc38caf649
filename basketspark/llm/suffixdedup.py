"""Suffix-array dedup: bytes of repeats across documents are found and removed.

A byte goes if a window of ``width`` bytes covers it that also starts in a document of a
smaller doc_id; windows are judged on the input as it is.

Suffix arrays are built for shards of the corpus, and every window has to meet its equals
in one shard. The shard of a window is given by its anchor, the smallest hash among the
window's 16-grams, and by the 17 bytes beside the anchor: those before it if the window
holds them, else those after it. Equal windows have equal anchors, first at the same place.
Neighbouring windows with one anchor first at one place make one string (a run), about a
third longer than a window.

1. Tasks find the runs of their documents. Of equal runs only those of the smallest
   document go on; the others repeat it whatever else there is. What goes on is a packed row
   of hashes and places for each range of the anchors' hashes.
2. For each range of anchors the same is done across tasks. An anchor that only one document
   has, or whose runs are all equal, is done with. Of the others those sides go on that a
   different run of another document agrees with; without that no window can be shared.
3. The bytes of these sides are fetched and dealt to shards. A side that very many runs have
   is dealt over several shards by document. A shard's suffix array is built by induced
   sorting; its permuted common prefixes tell which windows are equal, and every window with
   an equal one in a smaller document is removed. Of a side with several shards each shard's
   smallest document with a window is held against those of the other shards.
4. The spans of a document are joined to it and cut out.

Defined results: null text counts as empty; matches never cross documents; documents shorter
than a window keep all; rows that repeat a doc_id are one document to each other (nothing is
removed on their account) but each has its own result; a null doc_id is treated as larger
than any other, and rows without an id are one document to each other in the same way; an
empty table gives an empty result; further columns are ignored. Equal runs are told by
64-bit hashes. A document's spans, at most one for every 17 of its bytes, are brought
together in its row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import batches, mix, powers, prefix_hashes, span_hashes
from ._common import NOBODY, free_name, id_or_nobody, materialize, null_again, small_batches
from .suffixes import common_prefixes, suffix_array

GRAM = 16
#: What is known of a run; "row" tells rows of one doc_id apart, "lead" is where in its first window the anchor is.
FIELDS = (("anchor", np.uint32), ("run", np.uint64), ("doc", np.int64), ("row", np.int64), ("start", np.uint32), ("windows", np.uint16), ("lead", np.uint16), ("around", np.uint32))
SPANS = "doc_id long, row long, start long, stop long"


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: like bytes together compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).reshape(-1).view(kind)


def smallest_in(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` neighbours."""
    have = 1
    while have * 2 <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def half(width: int) -> int:
    """How many bytes beside the anchor every window holds on one side at least."""
    return (width - GRAM) // 2


def runs(buf: np.ndarray, starts: np.ndarray, docs: np.ndarray, rows: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The runs of windows of all texts: the fields, with anchors of 64 bits."""
    n = len(buf) - width + 1
    if n <= 0:
        return {k: np.zeros(0, np.uint64 if k == "anchor" else kind) for k, kind in FIELDS}
    prefix = prefix_hashes(buf)
    _, down = powers(len(prefix))
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(prefix) - GRAM])
    anchor = smallest_in(grams, width - GRAM + 1)[:n]
    lengths = np.diff(starts) - 1
    has = lengths >= width
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts[:-1][has], 1)
    np.add.at(step, starts[:-1][has] + lengths[has] - width + 1, -1)
    ok = np.cumsum(step)[:n] > 0
    # a window that begins with its anchor is the last one with the anchor first there: if it occurs again, a new run has that
    other = (anchor[1:] != anchor[:-1]) | (grams[: n - 1] == anchor[:-1])
    first = ok.copy()
    first[1:] &= ~ok[:-1] | other
    last = ok.copy()
    last[:-1] &= ~ok[1:] | other
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    doc = np.searchsorted(starts, lo, "right") - 1
    value = anchor[lo]
    # where the anchor is: the first gram of this value, the same in all windows of the run
    at = lo.copy()
    missing = np.flatnonzero(grams[lo] != value)
    for i in range(1, width - GRAM + 1):
        at[missing] += 1
        missing = missing[grams[at[missing]] != value[missing]]
    side = half(width)
    around = np.zeros((2, len(lo)), np.uint32)
    for h, (i, j, inside) in zip(around, ((at - side, at, at - side >= lo), (at + GRAM, at + GRAM + side, hi > at - side)), strict=True):
        where = np.flatnonzero(inside)
        h[where] = (span_hashes(prefix, i[where], j[where]) & np.uint64(0x7FFF)) + np.uint64(1)
    return {
        "anchor": value, "run": span_hashes(prefix, lo, hi + width), "doc": docs[doc], "row": rows[doc], "start": (lo - starts[doc]).astype(np.uint32),
        "windows": (hi - lo + 1).astype(np.uint16), "lead": (at - lo).astype(np.uint16), "around": around[0] << np.uint32(16) | around[1],
    }


def spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching spans of a document's row as one."""
    if not len(doc):
        return doc, row, start, stop
    by = np.lexsort((start, row, doc)) if row.any() else np.lexsort((start, doc))
    doc, row, start, stop = doc[by], row[by], start[by].astype(np.int64), stop[by].astype(np.int64)
    new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
    group = np.cumsum(new) - 1
    big = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * big) - group * big
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], row[at], start[at], np.maximum.reduceat(stop, at)


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal keys are together, where each begins there, and how often it occurs."""
    by = np.argsort(key)
    key = key[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return by, at, np.diff(np.append(at, len(key)))


def first_documents(x: dict[str, np.ndarray], width: int):
    """Of equal runs those of the smallest document, and the spans of all others."""
    if not len(x["run"]):
        return x, spans(x["doc"], x["row"], x["start"], x["start"])
    by, at, sizes = groups(x["run"])
    doc = x["doc"][by]
    again = np.zeros(len(by), bool)
    again[by] = doc > np.repeat(np.minimum.reduceat(doc, at), sizes)
    start = x["start"][again].astype(np.int64)
    gone = spans(x["doc"][again], x["row"][again], start, start + x["windows"][again] + width - 1)
    return {k: v[~again] for k, v in x.items()}, gone


def find_runs(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Packed runs by the leading ``bits`` of their anchors' hashes."""
    enough = max(200_000, 4 << bits)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        size = 0

        def flush() -> pd.DataFrame:
            x = {k: np.concatenate([h.pop(k) for h in held]) for k, _ in FIELDS}
            x, found = first_documents(x, width)
            # anchors are the smallest of many hashes, so most of them begin with zeros; ranges are those of a hash of the anchor
            x["anchor"] = mix(x["anchor"])
            bucket = (x["anchor"] >> np.uint64(64 - bits)).astype(np.int64)
            x["anchor"] = (x["anchor"] >> np.uint64(32 - bits)).astype(np.uint32)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(cuts))
            out = pd.DataFrame({"bucket": full})
            for k, kind in FIELDS:
                v = x.pop(k)[by].astype(kind)
                out[k] = [planes(v[cuts[i] : cuts[i + 1]]) for i in full]
            # the spans found here ride along, dealt over the rows
            parts = np.array_split(np.arange(len(found[0])), max(1, len(full)))
            for k, v in zip("dhij", found, strict=True):
                v = v.astype(np.int64)
                out[k] = [planes(v[p]) for p in parts[: len(full)]]
            return out

        for f in frames:
            for own, buf, starts in batches(f, limit=1 << 17):
                held.append(runs(buf, starts, own["doc_id"].to_numpy(np.int64), own["row"].to_numpy(np.int64), width))
                size += len(held[-1]["run"])
                if size > enough:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    schema = "bucket int, " + ", ".join(f"{k} binary" for k in (*(k for k, _ in FIELDS), *"dhij"))
    return docs.mapInPandas(send, schema)


def joined(i: np.ndarray, lo: np.ndarray, hi: np.ndarray, shard: np.ndarray, shared: np.ndarray, x: dict[str, np.ndarray], side: int):
    """Windows of one shard that follow each other (in periodic text the anchor occurs again and again) as one string."""
    near = x["lead"][i] < side
    some = np.flatnonzero(near)
    doc, row = x["doc"][i], x["row"][i]
    some = some[np.lexsort((lo[some], row[some], doc[some], shard[some]))]
    same = lambda v: v[some[1:]] == v[some[:-1]]
    new = np.append(True, ~(same(shard) & same(doc) & same(row) & (lo[some[1:]] == hi[some[:-1]])))[: len(some)]
    first, last = some[np.flatnonzero(new)], some[np.flatnonzero(np.append(new[1:], True)[: len(some)])]
    others = np.flatnonzero(~near)
    keep = np.append(others, first)
    return i[keep], lo[keep], np.append(hi[others], hi[last]), shard[keep], shared[keep]


def compare_runs(packed: DataFrame, width: int, crowd: int) -> DataFrame:
    """Spans removed for certain (shard null), and sides to compare byte by byte: the key of their shard, and whether others have the same side."""
    side = half(width)

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = {k: np.concatenate([unplanes(r, kind) for r in f.pop(k)]) for k, kind in FIELDS}
        carried = [np.concatenate([unplanes(r, np.int64) for r in f.pop(k)]) for k in "dhij"]
        x, found = first_documents(x, width)
        certain = spans(*(np.concatenate([a, b]) for a, b in zip(found, carried, strict=True)))
        out = [pd.DataFrame(dict(zip(("doc_id", "row", "start", "stop"), certain, strict=True))).assign(shard=pd.NA, shared=False)]
        begin, at, end = x["start"].astype(np.int64), x["start"].astype(np.int64) + x["lead"], x["start"].astype(np.int64) + x["windows"]
        for after in (0, 1):
            beside = x["around"] & np.uint32(0xFFFF) if after else x["around"] >> np.uint32(16)
            i = np.flatnonzero(beside)
            place = x["anchor"][i].astype(np.uint64) << np.uint64(16) | beside[i]
            if not len(i):
                continue
            by, first, sizes = groups(place)
            d, r = x["doc"][i][by], x["run"][i][by]
            many = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) & (np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first))
            by, n = by[np.repeat(many, sizes)], np.repeat(sizes[many], sizes[many])
            i, place = i[by], place[by]
            parts = (n - 1) // crowd + 1
            salt = mix(x["doc"][i].astype(np.uint64)) % parts.astype(np.uint64)
            shard = mix(place ^ mix(np.uint64(int(key[0]) * 2 + after) << np.uint64(32) ^ salt)) >> np.uint64(1)
            # windows with these bytes before the anchor, or the others
            lo, hi = (np.maximum(begin[i], at[i] - side + 1), end[i]) if after else (begin[i], np.minimum(end[i], at[i] - side + 1))
            i, lo, hi, shard, shared = joined(i, lo, hi, shard, parts > 1, x, side)
            out.append(pd.DataFrame({"doc_id": x["doc"][i], "row": x["row"][i], "start": lo, "stop": hi + width - 1, "shard": pd.array(shard.astype(np.int64), "Int64"), "shared": shared}))
        return pd.concat([o.astype({"shard": "Int64"}) for o in out], ignore_index=True)

    return packed.groupBy("bucket").applyInPandas(compare, SPANS + ", shard long, shared boolean")


def shard_spans(doc: np.ndarray, row: np.ndarray, start: np.ndarray, shared: np.ndarray, data: list[bytes], width: int):
    """Spans of strings (of one shard) whose windows also start in a smaller document, and the least windows of shared sides: (string, offset)."""
    sizes = np.array([len(x) for x in data])
    buf = np.frombuffer(b"\n".join(data), np.uint8)
    at = np.zeros(len(data), np.int64)
    at[1:] = np.cumsum(sizes[:-1] + 1)
    sa = suffix_array(buf, at[1:] - 1)
    plcp = common_prefixes(buf, sa, width, at[1:] - 1)
    group = np.cumsum(plcp[sa] < width)
    of = np.repeat(np.arange(len(data)), sizes + 1)[: len(buf)]
    inside = np.arange(len(buf)) - at[of] + width <= sizes[of]
    keep = inside[sa]
    sa, group = sa[keep], group[keep]
    if not len(sa):
        return spans(doc[:0], row[:0], start[:0], start[:0]), (sa, sa)
    own = doc[of[sa]]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(sa))))
    gone, least = sa[own > low], sa[(own == low) & shared[of[sa]]]
    begin = start[of[gone]] + gone - at[of[gone]]
    return spans(doc[of[gone]], row[of[gone]], begin, begin + width), (of[least], least - at[of[least]])


def keyed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns, which tell rows apart as far as their spans may differ.

    These are the id (NOBODY for null) and 0, or a hash of the text where the id is null or
    occurs again.
    """
    named, own = free_name(docs, "span_doc"), free_name(docs, "span_row")
    docs = docs.withColumn(named, F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)))
    again = docs.filter(F.col(named) != NOBODY).groupBy(named).count().filter("count > 1").select(named)
    texts = F.xxhash64(F.col(text_col).cast("string"))
    if again.isEmpty():
        return docs.withColumn(own, F.when(F.col(named) == NOBODY, texts).otherwise(F.lit(0).cast("long")))
    # repeated ids are the exception: only for them the texts are shuffled
    twice = docs.join(again.withColumn(own, F.lit(True)).hint("shuffle_hash"), named, "left")
    twice = twice.withColumn(own, F.when((F.col(named) == NOBODY) | F.col(own), texts).otherwise(F.lit(0).cast("long")))
    return twice.select(*docs.columns, own)


def removed_spans(docs: DataFrame, *, width: int = 50, shard_bytes: int = 1 << 18, crowd: int = 2048) -> DataFrame:
    """doc_id, row, start, stop: byte spans of ``docs`` (doc_id, row, text as binary) that repeat a smaller document; those of a row may overlap."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(20, max(5, math.ceil(math.log2(max(1, size) / 1.5e6))))
    found = materialize(compare_runs(find_runs(docs, width, bits), width, crowd), "runs")
    certain = found.filter(F.col("shard").isNull()).select("doc_id", "row", "start", "stop")

    asked = found.filter(F.col("shard").isNotNull())
    total = asked.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_bytes))
    per_doc = asked.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop", F.pmod("shard", F.lit(shards)).alias("shard"), "shared")).alias("asked"))
    pieces = docs.join(per_doc.hint("shuffle_hash"), ["doc_id", "row"]).select("doc_id", "row", "text", F.explode("asked").alias("x"))
    pieces = pieces.select("doc_id", "row", F.col("x.start").alias("start"), F.expr("substring(text, cast(x.start + 1 as int), cast(x.stop - x.start as int))").alias("data"), F.col("x.shard").alias("shard"), F.col("x.shared").alias("shared"))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        doc, row, start, shared = (f[c].to_numpy() for c in ("doc_id", "row", "start", "shared"))
        data = [bytes(x) for x in f["data"]]
        gone, (i, off) = shard_spans(doc, row, start, shared.astype(bool), data, width)
        windows = [data[a][b : b + width] for a, b in zip(i.tolist(), off.tolist(), strict=True)]
        out = pd.DataFrame(dict(zip(("doc_id", "row", "start", "stop"), gone, strict=True))).assign(window=None)
        least = pd.DataFrame({"doc_id": doc[i], "row": row[i], "start": start[i] + off, "stop": start[i] + off + width, "window": windows})
        return pd.concat([out, least], ignore_index=True) if len(least) else out

    compared = pieces.groupBy("shard").applyInPandas(compare, SPANS + ", window binary")
    compared = materialize(compared, "compared")
    between = compared.filter(F.col("window").isNotNull())
    lowest = between.groupBy("window").agg(F.min("doc_id").alias("low"))
    across = between.join(lowest, "window").filter("doc_id > low")
    kept = ["doc_id", "row", "start", "stop"]
    return certain.unionByName(compared.filter(F.col("window").isNull()).select(kept)).unionByName(across.select(kept))


def cut(docs: DataFrame, width: int, text_col: str = "text") -> tuple[DataFrame, str]:
    """The rows of ``docs`` with their spans, unmerged, in another column, whose name is returned too.

    It has starts and stops in turn, which reach Python as one array of numbers.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, text_col)
    doc, row = rows.columns[-2:]
    found = removed_spans(rows.select(F.col(doc).alias("doc_id"), F.col(row).alias("row"), F.col(text_col).cast("string").cast("binary").alias("text")), width=width)
    listed = free_name(rows, "spans")
    per_row = found.groupBy(F.col("doc_id").alias(doc), F.col("row").alias(row)).agg(F.flatten(F.collect_list(F.array("start", "stop"))).alias(listed))
    return rows.join(per_row.hint("shuffle_hash"), [doc, row], "left").select(*docs.columns, listed), listed


def merge_spans(listed: np.ndarray | None) -> list[tuple[int, int]]:
    if listed is None or not len(listed):
        return []
    at = np.asarray(listed, np.int64).reshape(-1, 2)
    none = np.zeros(len(at), np.int64)
    _, _, start, stop = spans(none, none, at[:, 0], at[:, 1])
    return list(zip(start.tolist(), stop.tolist(), strict=True))


def removed_digests(docs: DataFrame, *, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text, listed in zip(f["text"], f["spans"], strict=True):
                data, gone = b"" if text is None else bytes(text), merge_spans(listed)
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                rows.append((len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            out.insert(0, "doc_id", f["doc_id"].array)
            yield out

    found, listed = cut(docs.select("doc_id", "text"), width)
    found = found.select(id_or_nobody("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.col(listed).alias("spans"))
    return null_again(found.mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "doc_id")


def without_repeats(docs: DataFrame, *, width: int = 50, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the removed bytes cut out of their texts.

    A character of which bytes remain but not all goes as well; a null text stays null.
    """

    @F.pandas_udf("string")
    def strip(texts: pd.Series, spans_: pd.Series) -> pd.Series:
        out = []
        for text, listed in zip(texts, spans_, strict=True):
            gone = merge_spans(listed)
            if text is None or not gone:
                out.append(text)
                continue
            data, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
            for a, b in [*gone, (len(data), len(data))]:
                kept.append(data[at:a].decode("utf-8", "ignore"))
                at = b
            out.append("".join(kept))
        return pd.Series(out, dtype=object)

    joined, listed = cut(docs.withColumn(text_col, F.col(text_col).cast("string")), width, text_col)
    return joined.withColumn(text_col, F.when(F.col(listed).isNull(), F.col(text_col)).otherwise(strip(text_col, listed))).select(docs.columns)
