"""Listings of cards: filters, order, pages, promotion and home sections."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 60


def conditions(
    *,
    subcategory: str | None = None,
    on_sale: bool = False,
    price: tuple[float | None, float | None] = (None, None),
    weight: tuple[float | None, float | None] = (None, None),
    flags: Sequence[str] = (),
) -> Column:
    """A filter; an unknown weight passes an upper limit and fails a lower one."""
    parts: list[Column] = []
    if subcategory:
        parts.append(F.col("subcategory") == subcategory)
    if on_sale:
        parts.append(F.col("is_sale"))
    if price[0] is not None:
        parts.append(F.col("eff_price") >= price[0])
    if price[1] is not None:
        parts.append(F.col("eff_price") <= price[1])
    if weight[0]:
        parts.append(F.col("weight_g") >= weight[0])
    if weight[1] is not None:
        parts.append(F.col("weight_g").isNull() | (F.col("weight_g") <= weight[1]))
    parts += [F.col(f) for f in flags]
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True))


def order(kind: str) -> list[Column]:
    """Every order ends in the id, so that pages are stable."""
    unit = F.col("eff_price") / F.when(F.col("weight_g") > 0, F.col("weight_g"))
    return {
        "price-asc": [F.asc("eff_price"), F.asc("id")],
        "price-desc": [F.desc("eff_price"), F.asc("id")],
        "name-asc": [F.asc(F.lower("title")), F.asc("id")],
        "kg-price-asc": [unit.asc_nulls_last(), F.asc("id")],
    }[kind]


def page(cards: DataFrame, kind: str, number: int, size: int = PAGE) -> DataFrame:
    return cards.orderBy(*order(kind)).offset((max(1, number) - 1) * size).limit(size)


def page_counts(cards: DataFrame, by: str, size: int = PAGE) -> DataFrame:
    n = F.count("*")
    return cards.groupBy(by).agg(n.alias("total"), F.greatest(F.ceil(n / size), F.lit(1)).cast("long").alias("pages"))


def available(stores: Column, active: Sequence[str] | None) -> Column:
    """Whether an active store has the card; None means all stores, an empty choice none."""
    if active is None:
        return F.lit(True)
    return F.arrays_overlap(stores, F.array(*(F.lit(s) for s in active)).cast("array<string>")) if active else F.lit(False)


def allowed(cards: DataFrame, restricted: str, not_food: str, placeholder: str) -> DataFrame:
    """Cards that may be shown: no placeholder image, nothing restricted, food."""
    text = F.lower(F.concat_ws(" ", "title", "category"))
    return cards.filter(~F.coalesce(F.col("image").contains(placeholder), F.lit(False)) & ~text.rlike(restricted) & ~text.rlike(not_food))


def promoted(offers: DataFrame, active: Sequence[int]) -> DataFrame:
    """One offer a product from the active stores: the anchor store's if it is active, else the cheapest, then by store order."""
    mine = offers.filter(F.col("store").isin(*active))
    best = Window.partitionBy("product_id").orderBy(F.desc("is_anchor"), "price", "store")
    return mine.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")


def sections(cards: DataFrame, popularity: DataFrame, sale: int = 60, popular: int = 60, fill: int = 20) -> DataFrame:
    """The home page: sales, what is popular, then staples to fill up; no card twice.

    A sale of highest rebate comes first; popular is what was counted twice at least.
    """
    by_rebate = Window.orderBy(F.desc("rebate"), "id")
    first = cards.filter("is_sale").orderBy(F.desc("rebate"), "id").limit(sale).withColumn("position", F.row_number().over(by_rebate)).select(F.lit(1).alias("section"), "position", "id")
    liked = cards.join(popularity.filter("count >= 2"), "id").join(first, "id", "left_anti").orderBy(F.desc("count"), "id").limit(popular)
    second = liked.withColumn("position", F.row_number().over(Window.orderBy(F.desc("count"), "id"))).select(F.lit(2).alias("section"), "position", "id")
    rest = cards.join(first.select("id").unionByName(second.select("id")), "id", "left_anti").orderBy(F.desc("staple"), "id").limit(fill)
    third = rest.withColumn("position", F.row_number().over(Window.orderBy(F.desc("staple"), "id"))).select(F.lit(3).alias("section"), "position", "id")
    return first.unionByName(second).unionByName(third)


def first_seen(rows: DataFrame, key: str, *by: str) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("_nth = 1").drop("_nth")
