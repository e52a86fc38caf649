"""What the shop's pages ask for, each as one call on its tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import basket, history, listing, recipes
from .operators import search as S
from .operators.dictionary import Dictionary


def home(cards: DataFrame, popularity: DataFrame, stores: Sequence[str] | None = None) -> DataFrame:
    """Sections of the front page for the chosen stores."""
    return listing.sections(cards.filter(listing.available(F.col("stores"), stores)), popularity)


def category(cards: DataFrame, name: str, *, order: str = "price-asc", number: int = 1, stores: Sequence[str] | None = None, **filters) -> DataFrame:
    """A page of a category, with the filters of ``listing.conditions``."""
    rows = cards.filter((F.col("category") == name) & listing.available(F.col("stores"), stores) & listing.conditions(**filters))
    return listing.page(rows, order, number)


def sale(cards: DataFrame, *, order: str = "price-asc", number: int = 1, stores: Sequence[str] | None = None, **filters) -> DataFrame:
    rows = cards.filter(listing.available(F.col("stores"), stores) & listing.conditions(on_sale=True, **filters))
    return listing.page(rows, order, number)


def search(cards: DataFrame, asked: str, *, most: int = 60, preferred: str | None = None, stored: Dictionary | None = None) -> DataFrame:
    """Cards that match every word of a query, best first; where none does, those with words near them.

    With a stored dictionary of the cards' normalized names only those it finds are looked at.
    """
    organic = bool(set(asked.lower().split()) & {"øko", "økologisk", "organic"})
    terms = [w for w in asked.lower().split() if w not in ("øko", "økologisk", "organic")][:8]
    rows = cards.filter("organic") if organic else cards
    rows = rows.withColumn("_tokens", text.tokens(text.normalized(F.col("name"))))
    if not terms:
        return rows.orderBy("id").limit(most).drop("_tokens")
    hits = rows.filter(S.matches(F.col("_tokens"), terms))
    if stored is not None:
        hits = rows.join(stored.search(terms), "id", "left_semi")
        if hits.isEmpty():
            hits = rows.join(stored.search(terms, "near"), "id", "left_semi")
    elif hits.isEmpty():
        near = S.fuzzy_search(rows.select("id", F.explode("_tokens").alias("token")), terms)
        hits = rows.join(near, "id", "left_semi")
    liked = None if preferred is None else F.col("category") == preferred
    return hits.withColumn("relevance", S.relevance(F.col("_tokens"), F.col("name"), terms, liked)).orderBy(F.desc("relevance"), "id").limit(most).drop("_tokens")


def autocomplete(cards: DataFrame, beginning: str) -> DataFrame:
    return S.suggestions(cards, beginning)


def products(cards: DataFrame, ids: Sequence) -> DataFrame:
    return cards.filter(F.col("id").isin(*ids)) if ids else cards.limit(0)


def product(cards: DataFrame, prices: DataFrame, product_id) -> DataFrame:
    """A card with its lowest and usual prices of the last thirty days."""
    own = prices.filter(F.col("product_id") == product_id)
    card = cards.filter(F.col("id") == product_id)
    return card.join(history.lowest(own).select(F.col("product_id").alias("id"), "lowest"), "id", "left")


def price_history(prices: DataFrame, product_id, days: int = 30) -> DataFrame:
    """A product's prices by store and day."""
    return history.spine(prices.filter(F.col("product_id") == product_id), days)


def nutrition(rows: DataFrame, payloads: DataFrame, product_id) -> DataFrame:
    """The payload of the first of a product's keys that has any."""
    return recipes.first_key(rows.filter(F.col("id") == product_id), "keys", payloads)


def alternatives(wanted: DataFrame, cards: DataFrame, store) -> DataFrame:
    """What a store has in place of products it lacks."""
    return basket.alternatives(basket.similar_words(wanted), basket.similar_words(cards.filter(F.col("store") == store)))


def stores(offers: DataFrame) -> DataFrame:
    return offers.groupBy("store").agg(F.count_distinct("product_id").alias("products")).orderBy("store")
