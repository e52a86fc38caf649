"""Rule tables: the first rule, in order of priority, that a name, an id or a brand comes under.

A rule has (any of these may be null, but for priority and result's column):

    priority   the smallest that applies wins; unique
    keyword    what the text has to have; without one the rule goes by id and brand alone
    kind       where: "word" (as a whole word), "end" (at the end of a word, as in compounds),
               "start" (at the beginning of one), or "any" (anywhere)
    unless     texts that mustn't be in it
    low, high  ids it is for, both included
    brands     brands it is for, in lower case
    but_brands brands it isn't for
    result     what comes out; null for goods that are left out

Texts are matched in one pass however many rules there are: a rule is found by the first
three characters of its keyword, by an equi-join with those that texts have, and what is
found is checked in full. Distinct texts are matched once. Rules without a keyword are
joined with the rows by nothing else, so there should be few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a rule table.
RULE = "priority int, keyword string, kind string, unless array<string>, low long, high long, brands array<string>, but_brands array<string>, result string"
#: Characters of a keyword by which it is found.
KEY = 3


def _pieces(text: Column) -> Column:
    """Distinct runs of one to ``KEY`` characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(F.substring(text, i, F.lit(n)) for n in range(1, KEY + 1))))))


def _has(text: Column, keyword: Column, kind: Column) -> Column:
    padded, end, start = F.concat(F.lit(" "), text, F.lit(" ")), F.concat(keyword, F.lit(" ")), F.concat(F.lit(" "), keyword)
    return (
        F.when(kind == "word", F.contains(padded, F.concat(start, F.lit(" ")))).when(kind == "end", F.contains(padded, end)).when(kind == "start", F.contains(padded, start)).otherwise(F.contains(text, keyword))
    )


def by_rules(rows: DataFrame, rules: DataFrame, text: str = "text", default: str | None = None, id_col: str = "id", brand: str | None = "brand") -> DataFrame:
    """The rows with ``result`` and ``rule``, the priority of the rule that applied (null, and ``default``, if none did).

    ``text`` is lower-case text with single blanks between words, as ``text.normalized`` gives it.
    """
    own = F.lower(F.coalesce(F.col(brand), F.lit(""))) if brand else F.lit("")
    rows = rows.withColumns({"_text": F.coalesce(F.col(text), F.lit("")), "_brand": own})
    worded = rules.filter(F.col("keyword").isNotNull() & (F.col("keyword") != "")).withColumn("_key", F.substring("keyword", 1, KEY))
    texts = rows.select("_text").distinct()
    found = texts.withColumn("_key", F.explode(_pieces(F.col("_text")))).join(worded, "_key")
    free = F.coalesce(~F.exists("unless", lambda u: F.contains(F.col("_text"), u)), F.lit(True))
    found = found.filter(_has(F.col("_text"), F.col("keyword"), F.col("kind")) & free).select("_text", *[c for c in rules.columns if c not in ("keyword", "kind", "unless")])

    within = F.coalesce(F.col(id_col) >= F.col("low"), F.lit(True)) & F.coalesce(F.col(id_col) <= F.col("high"), F.lit(True))
    within = within & F.coalesce(F.array_contains("brands", F.col("_brand")), F.lit(True)) & ~F.coalesce(F.array_contains("but_brands", F.col("_brand")), F.lit(False))
    keys = rows.select(id_col, "_text", "_brand")
    hits = keys.join(found, "_text").filter(within).select(id_col, "priority", "result")
    plain = rules.filter(F.col("keyword").isNull() | (F.col("keyword") == ""))
    hits = hits.unionByName(keys.join(plain, within & F.coalesce(~F.exists("unless", lambda u: F.contains(F.col("_text"), u)), F.lit(True))).select(id_col, "priority", "result"))
    first = hits.groupBy(id_col).agg(F.min_by(F.struct("priority", "result"), "priority").alias("_first"))
    out = rows.join(first, id_col, "left")
    return out.withColumns({"result": F.when(F.col("_first").isNull(), F.lit(default)).otherwise(F.col("_first.result")), "rule": F.col("_first.priority")}).drop("_text", "_brand", "_first")
