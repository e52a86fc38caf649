"""Search over names: an inverted index, term matching, relevance, suggestions and fuzzy fallback."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import fuzzy_score


def token_index(rows: DataFrame, least: int = 2) -> DataFrame:
    """(token, id), once for each token of an id's normalized name."""
    return rows.select("id", F.explode(T.tokens(T.normalized(F.col("name")), least)).alias("token")).select("token", "id")


def and_search(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Ids that have all the terms as tokens."""
    wanted = sorted(set(terms))
    return index.filter(F.col("token").isin(wanted)).groupBy("id").agg(F.count_distinct("token").alias("hits")).filter(F.col("hits") == len(wanted)).select("id")


def matches(name_tokens: Column, terms: Sequence[str]) -> Column:
    """Every term is matched by a token."""
    matched = lambda term: F.exists(name_tokens, lambda t: T.term_matches(t, term))
    return functools.reduce(lambda a, b: a & b, map(matched, terms), F.lit(True))


def spellings(term: str) -> list[str]:
    """A term and what it's written like with and without the letters æ and ø."""
    return list(dict.fromkeys((term, term.replace("ae", "æ").replace("oe", "ø"), term.replace("æ", "ae").replace("ø", "oe"))))


def like_any(c: Column, terms: Sequence[str]) -> Column:
    """A coarse filter: every term, in one of its spellings, begins or ends a word, or (five letters or more) its first five are in the text."""
    parts = []
    for term in list(terms)[:8]:
        ways = []
        for t in spellings(term):
            ways += [c.startswith(t), c.contains(f" {t}"), c.endswith(t), c.contains(f"{t} ")]
            if len(t) >= 5:
                ways.append(c.contains(t[:5]))
        parts.append(functools.reduce(lambda a, b: a | b, ways))
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True))


def widened(rows: DataFrame, strict: DataFrame, prefix: str) -> DataFrame:
    """The strict result or, if that is empty, all names with a word of this beginning."""
    loose = rows.filter(F.exists(T.tokens(T.normalized(F.col("name"))), lambda t: t.startswith(prefix[:3])))
    empty = strict.limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return strict.select("id", "name").unionByName(loose.join(F.broadcast(empty), F.lit(True), "left_semi").select("id", "name"))


def relevance(name_tokens: Column, name: Column, terms: Sequence[str], preferred: Column | None = None) -> Column:
    """Per term the best of exact 100, prefix 70, suffix 50; 40 for a preferred category; shorter names first."""

    def best(term: str) -> Column:
        points = lambda t: F.when(t == term, 100).when(t.startswith(term), 70).when(t.endswith(term), 50).otherwise(0)
        return F.coalesce(F.array_max(F.transform(name_tokens, points)), F.lit(0))

    total = functools.reduce(lambda a, b: a + b, map(best, terms), F.lit(0))
    if preferred is not None:
        total = total + F.when(preferred, 40).otherwise(0)
    return total * 1000 - F.least(F.length(name), F.lit(999))


def suggestions(rows: DataFrame, beginning: str, pool: int = 60, most: int = 8) -> DataFrame:
    """Distinct normalized names that begin with a text, shortest first, from a pool of the first ids."""
    some = rows.withColumn("key", T.normalized(F.col("name"))).filter(F.col("key").startswith(beginning)).orderBy("id").limit(pool)
    return some.groupBy("key").agg(F.min("id").alias("id")).orderBy(F.length("key"), "key").limit(most)


def category_prior(keywords: DataFrame) -> DataFrame:
    """Keywords that only one category has: (keyword, category)."""
    return keywords.groupBy("keyword").agg(F.count_distinct("category").alias("n"), F.min("category").alias("category")).filter("n = 1").select("keyword", "category")


def fuzzy_terms(vocabulary: DataFrame, term: str, least: float = 0.82) -> DataFrame:
    """Words of a vocabulary near a term; lengths differ by three at most, so few are scored."""
    near = vocabulary.filter((F.length("token") >= 4) & (F.abs(F.length("token") - len(term)) <= 3)).select("token").distinct()
    return near.withColumn("score", F.round(fuzzy_score(F.col("token"), F.lit(term)), 6)).filter(F.col("score") >= least)


def fuzzy_search(index: DataFrame, terms: Sequence[str], least: float = 0.82) -> DataFrame:
    """Ids that have, for every term, a token near it."""
    hits = functools.reduce(DataFrame.unionByName, (fuzzy_terms(index, t, least).select("token", F.lit(t).alias("term")) for t in terms))
    return index.join(hits, "token").groupBy("id").agg(F.count_distinct("term").alias("n")).filter(F.col("n") == len(set(terms))).select("id")


def top_per_group(rows: DataFrame, key: str, by: Sequence[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("rank") <= k)
