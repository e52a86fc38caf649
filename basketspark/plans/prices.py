"""Price history queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history
from . import mapping as m
from .registry import query

_ASOF = "(SELECT max(date) FROM prices)"


def _mode_sql(days: int) -> str:
    return f"""
WITH {m.P}, seen AS (
    SELECT product_id, store, price, count(*) AS n, max(date) AS last FROM prices
    WHERE date >= {_ASOF} - INTERVAL {days} DAY AND date <= {_ASOF} GROUP BY ALL
)
SELECT product_id, store, price AS usual_price, n FROM (
    SELECT *, row_number() OVER (PARTITION BY product_id, store ORDER BY n DESC, price DESC, last DESC) AS nth FROM seen) WHERE nth = 1
"""


@query(f"WITH {m.P} SELECT product_id, min(price) AS lowest FROM prices WHERE date >= {_ASOF} - INTERVAL 30 DAY AND date <= {_ASOF} GROUP BY product_id")
def price_low_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.lowest(m.prices(spark, sf_dir), 30)


@query(_mode_sql(30))
def price_mode_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usual(m.prices(spark, sf_dir), 30)


@query(_mode_sql(365))
def price_mode_365d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usual(m.prices(spark, sf_dir), 365)


@query(f"WITH {m.OFFERS} SELECT * FROM offers")
def price_latest_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.offers(spark, sf_dir)


@query(f"WITH {m.DAILY} SELECT * FROM daily")
def price_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.daily_prices(spark, sf_dir)


@query(f"WITH {m.OFFERS} SELECT product_id, min(price) AS price, count(*) AS stores FROM offers GROUP BY product_id")
def cheapest_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cheapest(m.offers(spark, sf_dir))


@query(f"WITH {m.OFFERS} SELECT product_id, store, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store) AS nth FROM offers) WHERE nth = 1")
def cheapest_store_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cheapest_store(m.offers(spark, sf_dir).withColumn("ord", F.col("store")))


@query(f"WITH {m.DAILY} SELECT product_id, store, string_agg(date || '=' || CAST(price AS BIGINT), ',' ORDER BY date) AS points FROM daily GROUP BY product_id, store")
def history_by_store_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.series(m.daily_prices(spark, sf_dir))
    point = lambda x: F.concat_ws("=", x["date"].cast("string"), x["price"].cast("long").cast("string"))
    return rows.withColumn("points", F.array_join(F.transform("points", point), ","))


@query(f"""
WITH {m.DAILY}, w AS (
    SELECT *, avg(price) OVER b AS mean, count(*) OVER b AS points, max(date) OVER (PARTITION BY product_id, store) AS last
    FROM daily WINDOW b AS (PARTITION BY product_id, store ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT product_id, store, price, round(mean, 4) AS mean, points, CASE WHEN mean IS NULL THEN 'new' WHEN price < 0.9 * mean THEN 'great'
    WHEN on_sale AND price >= 0.98 * mean AND points + 1 > 2 THEN 'fake' ELSE 'normal' END AS verdict FROM w WHERE date = last
""")
def price_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.insight(m.daily_prices(spark, sf_dir))


@query(f"""
WITH {m.DAILY}, k AS (SELECT DISTINCT product_id, store FROM daily), d AS (
    SELECT CAST(unnest(generate_series((SELECT max(date) FROM daily) - INTERVAL 29 DAY, (SELECT max(date) FROM daily)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date)
SELECT k.product_id, k.store, d.date, daily.price FROM k CROSS JOIN d LEFT JOIN daily ON daily.product_id = k.product_id AND daily.store = k.store AND daily.date = d.date
""")
def price_date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.spine(m.daily_prices(spark, sf_dir), 30)


@query(f"""
WITH {m.P}, w AS (SELECT *, last_value(CASE WHEN NOT on_sale THEN price END IGNORE NULLS) OVER (PARTITION BY product_id, store ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS normal_price FROM prices)
SELECT * FROM w WHERE on_sale
""")
def last_regular_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.regular_before(m.prices(spark, sf_dir))


@query(f"""
WITH {m.P}, w AS (SELECT *, last_value(CASE WHEN NOT on_sale THEN price END IGNORE NULLS) OVER (PARTITION BY product_id, store ORDER BY date, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS normal_price,
    row_number() OVER (PARTITION BY product_id, store ORDER BY date DESC, seq DESC) AS nth FROM prices),
u AS (SELECT product_id, store, usual_price FROM ({_mode_sql(365)})),
j AS (SELECT w.product_id, w.store, w.price, w.on_sale, coalesce(CASE WHEN w.on_sale THEN normal_price END, usual_price) AS against FROM w LEFT JOIN u ON u.product_id = w.product_id AND u.store = w.store WHERE nth = 1)
SELECT product_id, store, CASE WHEN on_sale AND coalesce(against > price, false) THEN against ELSE price END AS list_price, CASE WHEN on_sale AND coalesce(against > price, false) THEN price END AS sale_price FROM j
""")
def display_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = m.prices(spark, sf_dir)
    regular = history.regular_before(prices).select("product_id", "store", "seq", "normal_price")
    last = prices.groupBy("product_id", "store").agg(F.max(F.struct("date", "seq", "price", "on_sale")).alias("x")).select("product_id", "store", "x.seq", "x.price", "x.on_sale")
    return history.face(last.join(regular, ["product_id", "store", "seq"], "left"), history.usual(prices, 365))


_ALERTS = """alerts AS (SELECT c_custkey AS id, c_custkey * 7 % (SELECT 2 * count(*) FROM part) AS product_id, c_acctbal * 20 AS target_price,
    CASE WHEN c_custkey % 5 > 0 THEN c_name END AS email, CASE WHEN c_custkey % 3 = 0 THEN 'sent' END AS notified_at FROM customer)"""


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = m.load(spark, sf_dir, "part").agg((2 * F.count("*")).alias("n"))
    rows = m.load(spark, sf_dir, "customer").crossJoin(F.broadcast(n))
    return rows.selectExpr("c_custkey AS id", "c_custkey * 7 % n AS product_id", "c_acctbal * 20 AS target_price", "CASE WHEN c_custkey % 5 > 0 THEN c_name END AS email", "CASE WHEN c_custkey % 3 = 0 THEN 'sent' END AS notified_at")


@query(f"""WITH {m.OFFERS}, {_ALERTS}, c AS (SELECT product_id, min(price) AS price FROM offers GROUP BY product_id)
SELECT id, product_id, target_price, price FROM alerts JOIN c USING (product_id) WHERE notified_at IS NULL AND email IS NOT NULL AND price <= target_price""")
def alerts_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.alerts(_alerts(spark, sf_dir), history.cheapest(m.offers(spark, sf_dir))).select("id", "product_id", "target_price", "price")


@query(f"""WITH {m.OFFERS}, {_ALERTS} SELECT id, product_id FROM alerts WHERE product_id NOT IN (SELECT product_id FROM offers)""")
def alerts_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.unresolved(_alerts(spark, sf_dir), history.cheapest(m.offers(spark, sf_dir))).select("id", "product_id")


_MONTHS = "months AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%Y-%m') AS month_key, sum(CAST(floor(o_totalprice) AS BIGINT) % 1000)::DOUBLE AS amount FROM orders GROUP BY 1, 2)"


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month_key"), (F.floor("o_totalprice") % 1000).alias("x"))
    return rows.groupBy("user_id", "month_key").agg(F.sum("x").cast("double").alias("amount"))


@query(f"""WITH {_MONTHS}, r AS (SELECT *, rank() OVER (PARTITION BY month_key ORDER BY amount DESC) AS rk, count(*) OVER (PARTITION BY month_key) AS n FROM months)
SELECT user_id, month_key, amount, CAST(CASE WHEN n <= 1 OR amount <= 0 THEN 100 ELSE least(greatest(ceil(rk * 100.0 / n), 1), 100) END AS INT) AS top_pct FROM r""")
def savings_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.savings_rank(_months(spark, sf_dir))


@query(f"""WITH {_MONTHS}, l AS (SELECT *, lag(month_key) OVER w AS pm, lag(amount) OVER w AS pa FROM months WINDOW w AS (PARTITION BY user_id ORDER BY month_key))
SELECT user_id, month_key, amount, CASE WHEN coalesce(CAST(pm || '-01' AS DATE) + INTERVAL 1 MONTH = CAST(month_key || '-01' AS DATE), false) THEN pa ELSE 0.0 END AS prev_amount FROM l""")
def savings_month_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.month_rollover(_months(spark, sf_dir))
