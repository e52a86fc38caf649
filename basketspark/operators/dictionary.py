"""A stored dictionary of terms: layouts in which a search reads some row groups instead of every name.

Five tables of Parquet lie below one path, each in the order of the key it is searched by:

- ``beginnings`` and ``endings``: each word by its text and by its folded text, forwards and
  backwards, so that words with a beginning or an ending are a range of keys;
- ``grams``: each word by its runs of five letters, for words that contain a stem;
- ``pieces``: each word cut into one piece more than a near word may have insertions and
  deletions, by lengths, so that every near word has one of its pieces whole, near its place;
- ``postings``: the ids of a word, in buckets by the word's checksum and in ranges of words and
  ids within, so that the ids of a frequent word are spread over files.

What has many rows a word (``grams``, ``pieces``, ``postings``) is gathered before it's sorted: a
row has those words or ids of a key that one task had among a million rows.

A word of more than ``LONGEST`` letters is in no such layout but in a table ``long``, which every
search tests as a whole. What a layout finds is tested by the rule itself, so results are those
of a scan. The dictionary grows with the distinct words, not with the names.

Defined results: rows without an id or without words have no postings; empty words are left
out; repeated rows and ids give the ids once; an empty table gives an empty dictionary. A
dictionary whose writer died has no ``about`` and can't be opened.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..checkpoints import checkpointed
from ..functions import text as T
from ..functions.similarity import fuzzy_score
from .search import spellings

LAYOUTS = ("beginnings", "endings", "grams", "pieces")
SCHEMAS = {
    "beginnings": "key string, word string",
    "endings": "key string, word string",
    "grams": "key string, words array<string>",
    "pieces": "key string, words array<string>",
    "long": "word string",
    "about": "buckets int, least double, layouts array<string>",
}
LONGEST = 128
GRAM = 5
#: Near words differ by this many letters in length at most, and have this many at least.
SLACK, SHORTEST = 3, 4
#: Rows and bytes that a task gathers at a time, and words that it cuts at a time.
ROWS, BYTES, CUT = 1 << 20, 1 << 26, 1 << 16


def _both(word: Column) -> Column:
    """A word's text, and its folded text where that's another one."""
    return F.array_distinct(F.array(word, T.folded(word)))


def _differences(least: float, m: int, n: int) -> int:
    """How many letters at most are in one of two words of these lengths alone, if they are near; negative for never."""
    d = math.floor((1 - least + 1e-6) * (m + n))
    d -= (d - (m + n)) % 2
    return d if d >= abs(m - n) else -1


def _cuts(m: int, least: float) -> list[int]:
    """The numbers of differences for which words of a length are cut: one for each length of near words, without repeats."""
    return sorted({d for n in range(max(SHORTEST, m - SLACK), m + SLACK + 1) if (d := _differences(least, m, n)) >= 0})


def _pieces(words: pa.Array, least: float) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and words: lengths, number and text of each piece of a word, cut for near words of each length."""
    lengths = pc.utf8_length(words)
    for m in filter(lambda m: m >= SHORTEST, pc.unique(lengths).to_pylist()):
        some = words.filter(pc.equal(lengths, m))
        for d in _cuts(m, least):
            for k in range(d + 1):
                piece = pc.utf8_slice_codeunits(some, k * m // (d + 1), (k + 1) * m // (d + 1))
                yield pc.binary_join_element_wise(f"{m}|{d}|{k}|", piece, ""), some


def _grams(words: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and words: each run of five letters of a word."""
    lengths = pc.utf8_length(words)
    for i in range((pc.max(lengths).as_py() or 0) - GRAM + 1):
        some = words.filter(pc.greater_equal(lengths, i + GRAM))
        yield pc.utf8_slice_codeunits(some, i, i + GRAM), some


def _in_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together, as they may be small."""
    some: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        some.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= BYTES:
            yield pa.Table.from_batches(some).combine_chunks()
            some, n, size = [], 0, 0
    if n:
        yield pa.Table.from_batches(some).combine_chunks()


def _gathered(rows: DataFrame, key: str, value: str, cut: Callable[[pa.Array], Iterator[tuple[pa.Array, pa.Array]]] | None = None) -> DataFrame:
    """(key, values): the values of a key among a million rows of a task; ``cut`` makes keys and values of words."""
    names = [key, f"{value}s"]
    schema = StructType([StructField(names[0], StringType()), StructField(names[1], ArrayType(rows.schema[value].dataType))])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _in_chunks(batches, CUT):
            yield from (pa.record_batch([k, v], names=[key, value]) for k, v in cut(words[value].chunk(0)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _in_chunks(batches if cut is None else cuts(batches), ROWS):
            found = some.group_by(key, use_threads=False).aggregate([(value, "list")])
            yield from found.select([key, f"{value}_list"]).rename_columns(names).to_batches(10_000)

    return rows.mapInArrow(gather, schema)


def _keys(term: str, least: float) -> list[list[str]]:
    """The pieces that a word near the term may share with it, in lists of ten at most."""
    n, out = len(term), []
    for m in range(max(SHORTEST, n - SLACK), n + SLACK + 1):
        d = _differences(least, m, n)
        left, right = (d + m - n) // 2, (d - m + n) // 2
        for k in range(d + 1):
            start, end = k * m // (d + 1), (k + 1) * m // (d + 1)
            found = sorted({term[p : p + end - start] for p in range(max(0, start - left), min(start + right, n - end + start) + 1)})
            keys = [f"{m}|{d}|{k}|{x}" for x in found]
            out += [keys[i : i + 10] for i in range(0, len(keys), 10)]
    return out


def _either(rules: Sequence[Column]) -> Column:
    """Whether one of the rules holds; nested by halves, as a long term has hundreds of lists."""
    if len(rules) < 2:
        return rules[0] if rules else F.lit(False)
    return _either(rules[: len(rules) // 2]) | _either(rules[len(rules) // 2 :])


def build(rows: DataFrame, path: str, *, layouts: Sequence[str] = LAYOUTS, least: float = 0.82, buckets: int = 64) -> Dictionary:
    """Write the dictionary of rows (id, tokens) and open it; ``least`` is the least similarity of near words."""
    if unknown := set(layouts) - set(LAYOUTS):
        raise ValueError(f"no layouts of these names: {sorted(unknown)}")
    spark = rows.sparkSession
    tokens = rows.filter("id IS NOT NULL").select("id", F.explode(F.array_distinct("tokens")).alias("word")).filter("word <> ''")
    gathered = _gathered(tokens, "word", "id").select(F.pmod(F.crc32("word"), F.lit(buckets)).cast("int").alias("bucket"), "word", "ids")
    gathered = checkpointed(gathered)  # names are taken apart once, not for the ranges' sample too
    place = ["bucket", "word", F.col("ids")[0]]
    gathered.repartitionByRange(*place).sortWithinPartitions(*place).write.partitionBy("bucket").parquet(f"{path}/postings")
    # in the type the ids were written with
    postings = spark.read.schema(gathered.select("word", "ids", "bucket").schema).parquet(f"{path}/postings")
    postings.select("word").distinct().write.parquet(f"{path}/words")
    words = spark.read.schema("word string").parquet(f"{path}/words")
    words.filter(F.length("word") > LONGEST).write.parquet(f"{path}/long")
    words = words.filter(F.length("word") <= LONGEST)
    made = {
        "beginnings": lambda: words.select(F.explode(_both(F.col("word"))).alias("key"), "word"),
        "endings": lambda: words.select(F.explode(F.transform(_both(F.col("word")), F.reverse)).alias("key"), "word"),
        "grams": lambda: _gathered(words, "key", "word", _grams),
        "pieces": lambda: _gathered(words.repartitionByRange(F.length("word"), "word"), "key", "word", functools.partial(_pieces, least=least)),
    }
    for name in layouts:
        made[name]().repartitionByRange("key", F.col("words")[0] if "words array" in SCHEMAS[name] else "word").sortWithinPartitions("key").write.parquet(f"{path}/{name}")
    spark.createDataFrame([(buckets, least, list(layouts))], SCHEMAS["about"]).coalesce(1).write.parquet(f"{path}/about")
    return Dictionary(spark, path)


class Dictionary:
    """A dictionary that ``build`` has written; searches return words, ``ids`` their ids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.schema(SCHEMAS["about"]).parquet(f"{path}/about").first()
        self.buckets, self.least, self.layouts = about.buckets, about.least, set(about.layouts)
        self.postings = spark.read.parquet(f"{path}/postings") if self._any() else None

    def _any(self) -> bool:
        return bool(self.spark.read.schema("word string").parquet(f"{self.path}/words").head(1))

    def _table(self, name: str) -> DataFrame:
        if name not in self.layouts and name != "long":
            raise ValueError(f"the dictionary at {self.path} was built without {name}")
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}")
        return rows.select("key", F.explode("words").alias("word")) if "words" in rows.columns else rows

    def _words(self, found: Sequence[DataFrame], rule: Column) -> DataFrame:
        """Distinct words of what the layouts give, and of the long ones, that follow the rule."""
        parts = [f.select("word") for f in found] + [self._table("long")]
        return functools.reduce(DataFrame.unionByName, (p.filter(rule) for p in parts)).distinct()

    def matching(self, term: str) -> DataFrame:
        """Words that a term matches as in ``text.term_matches``."""
        t = term.lower().replace("æ", "ae").replace("ø", "oe")
        start, end = self._table("beginnings"), self._table("endings")
        found = [start.filter(F.col("key").startswith(t)), end.filter(F.col("key").startswith(t[::-1]))]
        # in lists of ten, which the scan looks up in the row groups' figures
        cut = [t[:i] for i in range(4, len(t) + 1)]
        found += [start.filter(F.col("key").isin(cut[i : i + 10])) for i in range(0, len(cut), 10)]
        return self._words(found, T.term_matches(F.col("word"), term))

    def containing(self, term: str) -> DataFrame:
        """Words that begin or end with a spelling of the term or have its first five letters, as in ``search.like_any``."""
        found, rules = [], []
        for t in spellings(term):
            found += [self._table("beginnings").filter(F.col("key").startswith(t)), self._table("endings").filter(F.col("key").startswith(t[::-1]))]
            rules += [F.col("word").startswith(t), F.col("word").endswith(t)]
            if len(t) >= GRAM:
                found.append(self._table("grams").filter(F.col("key") == t[:GRAM]))
                rules.append(F.col("word").contains(t[:GRAM]))
        return self._words(found, functools.reduce(lambda a, b: a | b, rules))

    def candidates(self, term: str) -> DataFrame:
        """The words that ``near`` scores: those that share a piece with the term."""
        keys = _keys(term, self.least) if len(term) >= SHORTEST else []
        found = self._table("pieces").filter(_either([F.col("key").isin(k) for k in keys])).select("word")
        if len(term) >= SHORTEST and len(term) + SLACK > LONGEST:
            found = found.unionByName(self._table("long").filter(F.abs(F.length("word") - len(term)) <= SLACK))
        return found.distinct()

    def near(self, term: str, least: float | None = None) -> DataFrame:
        """(word, score): words near the term as in ``search.fuzzy_terms``, of which few are scored; terms of three letters have none."""
        least = self.least if least is None else least
        if least < self.least:
            raise ValueError(f"the dictionary's pieces are cut for a similarity of {self.least} or more")
        return self.candidates(term).withColumn("score", F.round(fuzzy_score(F.col("word"), F.lit(term)), 6)).filter(F.col("score") >= least)

    def ids(self, words: Sequence[DataFrame]) -> DataFrame:
        """Ids that have, for each of several searches (62 at most), one of its words; other buckets aren't read."""
        if not 1 <= len(words) <= 62:
            raise ValueError("between 1 and 62 searches")
        if self.postings is None:
            return self.spark.createDataFrame([], "id long")
        marked = [w.select(F.pmod(F.crc32("word"), F.lit(self.buckets)).cast("int").alias("bucket"), "word", F.lit(1 << i).cast("long").alias("mask")) for i, w in enumerate(words)]
        found = checkpointed(functools.reduce(DataFrame.unionByName, marked))
        # at most as many numbers as there are buckets
        some = [r.bucket for r in found.select("bucket").distinct().collect()]
        hits = self.postings.filter(F.col("bucket").isin(some)).join(found, ["bucket", "word"]).select("mask", F.explode("ids").alias("id"))
        return hits.groupBy("id").agg(F.bit_or("mask").alias("mask")).filter(F.col("mask") == (1 << len(words)) - 1).select("id")

    def having(self, terms: Sequence[str]) -> DataFrame:
        """Ids that have all the terms as words, as in ``search.and_search``; other buckets and words aren't read."""
        wanted = sorted(set(terms))
        if self.postings is None or not wanted:
            return self.spark.createDataFrame([], "id long") if self.postings is None else self.postings.select(F.explode("ids").alias("id")).limit(0)
        rows = self.postings.filter(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in wanted})) & F.col("word").isin(wanted))
        return rows.select("word", F.explode("ids").alias("id")).groupBy("id").agg(F.count_distinct("word").alias("n")).filter(F.col("n") == len(wanted)).select("id")

    def search(self, terms: Sequence[str], how: str = "matching") -> DataFrame:
        """Ids that every term finds by ``matching``, ``containing`` (eight terms at most, as in ``search.like_any``) or ``near``."""
        some = [t for t in dict.fromkeys(terms) if t]
        if how == "containing":
            some = [t for t in list(terms)[:8] if t]
        if not some:
            raise ValueError("a search needs a term")
        return self.ids([getattr(self, how)(t) for t in some])
