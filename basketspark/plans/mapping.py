"""What in the test tables stands for prices, cards, carts and activity.

Expressions are SQL that Spark and DuckDB read alike, so that a query and its oracle start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = {
    "product_id": "l_partkey",
    "store": "l_suppkey % 14",
    "date": "CAST(l_shipdate AS DATE)",
    "price": "round(l_extendedprice / l_quantity, -2)",
    "on_sale": "l_discount > 0.05",
    "seq": "l_orderkey * 8 + l_linenumber",
}
CARDS = {
    "id": "p_partkey",
    "title": "p_name",
    "name": "lower(p_name)",
    "brand": "p_brand",
    "category": "p_type",
    "subcategory": "split_part(p_name, ' ', 2)",
    "price": "p_retailprice",
    "is_sale": "p_size % 3 = 0",
    "eff_price": "CASE WHEN p_size % 3 = 0 THEN p_retailprice - 100 ELSE p_retailprice END",
    "weight_g": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size * CAST(10 AS DOUBLE) END",
    "organic": "p_partkey % 5 = 0",
    "lactose_free": "p_partkey % 11 = 0",
    "store": "p_partkey % 14",
}
RAW = {
    "id": "p_partkey",
    "weight": "CASE p_partkey % 7 WHEN 0 THEN p_size || ' g' WHEN 1 THEN p_size || ' x ' || (p_size + 1) || ' cl' WHEN 2 THEN p_size || ',5 kg' WHEN 3 THEN p_size || ' stk' WHEN 4 THEN (p_size * 10) || ' ML' WHEN 5 THEN p_size || '.25 liter' ELSE 'ca. ' || p_size END",
    "price": "CASE p_partkey % 6 WHEN 0 THEN p_size || ',95 kr' WHEN 1 THEN 'DKK ' || p_size WHEN 2 THEN '1.' || (100 + p_size) || ',50' WHEN 3 THEN '2 FOR ' || p_size WHEN 4 THEN 'frit valg ' || p_size || ',25' ELSE 'pris' END",
    "unit_price": "CASE p_partkey % 3 WHEN 0 THEN p_size || ',62 kr/kg' WHEN 1 THEN p_size || '.5 kr/l' ELSE 'ukendt' END",
    "deal": "CASE p_partkey % 4 WHEN 0 THEN '2 for ' || (p_size * 3) WHEN 1 THEN '3 for ' || p_size || ',50' WHEN 2 THEN '1 for 10' ELSE 'tilbud' END",
    "ean": "CASE p_partkey % 5 WHEN 0 THEN '' || (5700000000000 + p_partkey) WHEN 1 THEN '' || (40000000 + p_partkey) WHEN 2 THEN 'x' || p_partkey WHEN 3 THEN '' || p_partkey END",
    "nutrition": "CASE p_partkey % 4 WHEN 0 THEN '< ' || p_size || ',5 g' WHEN 1 THEN '1.' || (500 + p_size) || ' kJ / ' || (300 + p_size) || ' kcal' WHEN 2 THEN p_size || '.5' ELSE 'spor' END",
    "line": "CASE p_partkey % 6 WHEN 0 THEN p_size || ' dl ' || p_name WHEN 1 THEN '1/' || (p_size % 4 + 1) || ' dl ' || p_name WHEN 2 THEN '3-' || (p_size % 5 + 4) || ' ' || p_name WHEN 3 THEN p_size || ',5 spsk. ' || p_name WHEN 4 THEN p_size || ' gram ' || p_name ELSE p_name || ' efter smag' END",
    "duration": "CASE p_partkey % 4 WHEN 0 THEN 'PT' || (p_size % 9 + 1) || 'H' || p_size || 'M' WHEN 1 THEN 'PT' || p_size || 'M' WHEN 2 THEN 'P1DT2H' ELSE 'PT0M' END",
    "sale": "CASE p_partkey % 3 WHEN 0 THEN '2024-01-01T00:00:00+01:00/2024-0' || (p_size % 9 + 1) || '-15T23:59:59+01:00' WHEN 1 THEN '2024-01-01T00:00:00+01:00/' ELSE 'nu' END",
    "label": "CASE p_partkey % 6 WHEN 0 THEN 'None' WHEN 1 THEN ' nan ' WHEN 2 THEN p_brand || ' Organic 12%' WHEN 3 THEN p_name || ' 45+ lactose free' WHEN 4 THEN 'not organic ' || p_name || ' 4,6% 0,1 %' ELSE p_brand || ' ' || p_name || ' sugar-free alcohol free' END",
    "size": "p_size",
    "retail": "p_retailprice",
}
EVENTS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "pid": "regexp_replace(props, '[^0-9]', '', 'g')",
    "event_type": "CASE event_type WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'compare' ELSE event_type END",
    "value": "value",
}


def cte(name: str, exprs: dict[str, str], table: str) -> str:
    """``name AS (SELECT ...)`` for an oracle."""
    return f"{name} AS (SELECT {', '.join(f'{e} AS {k}' for k, e in exprs.items())} FROM {table})"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def select(spark: SparkSession, sf_dir: str, table: str, exprs: dict[str, str]) -> DataFrame:
    return load(spark, sf_dir, table).selectExpr(*(f"{e} AS {k}" for k, e in exprs.items()))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, "lineitem", PRICES)


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, "part", CARDS)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(spark, sf_dir, "part", RAW)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select(spark, sf_dir, "events", EVENTS | {"pid": "regexp_replace(props, '[^0-9]', '')"})
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("qty", F.floor("value").cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("name"), "lang", "source")


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import history

    return history.daily(prices(spark, sf_dir))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest price of each product in each store."""
    from ..operators import history

    return history.latest(prices(spark, sf_dir))


P = cte("prices", PRICES, "lineitem")
DAILY = f"{P}, daily AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store, date ORDER BY seq DESC) AS nth FROM prices) WHERE nth = 1)"
OFFERS = f"{P}, offers AS (SELECT product_id, store, date, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store ORDER BY date DESC, seq DESC) AS nth FROM prices) WHERE nth = 1)"
C = cte("cards", CARDS, "part")
R = cte("raw", RAW, "part")
E = cte("ev", EVENTS | {"qty": "CAST(floor(value) AS INT)"}, "events")
