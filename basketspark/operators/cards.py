"""Cards: maps of store prices, and what is shown of a card."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse


def merged_prices(first: Column, second: Column) -> Column:
    """A map of prices in which the first one's stand; prices that aren't positive don't count."""
    good = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,double>")), lambda k, v: F.coalesce(v > 0, F.lit(False)))
    a, b = good(first), good(second)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)), a)


def relabelled(prices: Column, labels: Mapping[str, str]) -> Column:
    """The map with other names for its keys; keys without one keep their own."""
    if not labels:
        return prices
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.transform_keys(prices, lambda k, v: F.coalesce(F.try_element_at(known, k), k))


def offers(cards: DataFrame, price_map: str = "prices") -> DataFrame:
    """(product_id, store, price): a row for each entry of a card's map with a positive price."""
    return cards.select(F.col("id").alias("product_id"), F.explode(price_map).alias("store", "price")).filter("price > 0")


def without(matches: Column, *fields: str) -> Column:
    """A map of structs without some of their fields."""
    return F.transform_values(matches, lambda k, v: functools.reduce(lambda x, f: x.dropFields(f), fields, v))


def delimited(labels: Column) -> Column:
    """"|a|b|": distinct labels in order."""
    return F.concat(F.lit("|"), F.array_join(F.array_sort(F.array_distinct(labels)), "|"), F.lit("|"))


def chosen_stores(asked: str | None, saved: Iterable[str] | None, known: Iterable[str], added: Iterable[str] = (), most: int = 20) -> set[str] | None:
    """The stores of a request: of a comma-separated text those that are known, or what was saved with what came since; None means all."""
    if asked is not None:
        return {s.strip() for s in asked.split(",")[:most] if s.strip()} & {*known}
    mine = {str(s).strip() for s in saved or () if str(s).strip()}
    return mine | {*added} if mine else None


def match_row(match: Column) -> Column:
    """What a listing shows of a store's offer."""
    text = lambda f: F.coalesce(match[f].cast("string"), F.lit(""))
    clean = lambda f: F.coalesce(parse.cleaned(match[f].cast("string")), F.lit(""))
    number = lambda f: match[f].cast("string").try_cast("double")
    return F.struct(
        text("name").alias("name"), number("price").alias("price"), number("normal_price").alias("normal_price"), F.coalesce(match["is_sale"], F.lit(False)).alias("is_sale"), text("image").alias("image"), clean("brand").alias("brand"),
        clean("description").alias("description"), clean("weight").alias("weight"), number("kg_price").alias("kg_price"), text("multi_deal").alias("multi_deal"), text("ean").alias("ean"), text("category").alias("category"),
    )


def display(cards: DataFrame, category: str = "Andre varer") -> DataFrame:
    """Cards (id, title, price, sale_price, brand, description, category, unit_measure, weight_g, store_matches) as they are listed."""
    weight = F.coalesce(parse.weight_grams(F.col("unit_measure")), F.col("weight_g"))
    clean = lambda c: F.coalesce(parse.cleaned(F.col(c)), F.lit(""))
    return cards.select(
        F.col("id").cast("string").alias("id"), F.coalesce("title", F.lit("Ukendt vare")).alias("name"), clean("brand").alias("brand"), clean("description").alias("description"), F.coalesce("category", F.lit(category)).alias("category"),
        F.coalesce(parse.effective_price(F.col("price"), F.col("sale_price")), F.lit(0.0)).alias("price"), F.coalesce("price", F.lit(0.0)).alias("normal_price"), F.col("sale_price").isNotNull().alias("is_sale"), weight.alias("weight_g"),
        F.coalesce("stk_count", parse.piece_count(F.col("unit_measure"))).alias("stk_count") if "stk_count" in cards.columns else parse.piece_count(F.col("unit_measure")).alias("stk_count"),
        F.transform_values("store_matches", lambda k, v: match_row(v)).alias("store_matches"), (F.size("store_matches") > 0).alias("has_match"),
    )


def cheapest_pool(cards: DataFrame, most: int = 600, by: tuple[str, ...] = ("category", "subcategory", "store")) -> DataFrame:
    """The cheapest cards of each group, which a suggestion is picked from."""
    return cards.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("price", "id"))).filter(F.col("_nth") <= most).drop("_nth")
