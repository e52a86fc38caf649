"""Price history: product_id, store, date, price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(prices: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Observations of the ``days`` before ``as_of`` and of that day itself."""
    return prices.filter((F.col("date") >= F.date_sub(as_of, days)) & (F.col("date") <= as_of))


def with_as_of(prices: DataFrame) -> DataFrame:
    """The rows with the last date of all as ``as_of``, a literal, so that filters against it reach the scan."""
    return prices.withColumn("as_of", F.lit(prices.agg(F.max("date")).first()[0]).cast("date"))


def lowest(prices: DataFrame, days: int = 30) -> DataFrame:
    return recent(with_as_of(prices), F.col("as_of"), days).groupBy("product_id").agg(F.min("price").alias("lowest"))


def usual(prices: DataFrame, days: int = 30) -> DataFrame:
    """The most frequent price of a product in a store; of equally frequent ones the higher, then the later seen."""
    seen = recent(with_as_of(prices), F.col("as_of"), days).groupBy("product_id", "store", "price").agg(F.count("*").alias("n"), F.max("date").alias("last"))
    best = Window.partitionBy("product_id", "store").orderBy(F.desc("n"), F.desc("price"), F.desc("last"))
    return seen.withColumn("nth", F.row_number().over(best)).filter("nth = 1").select("product_id", "store", F.col("price").alias("usual_price"), "n")


def daily(prices: DataFrame) -> DataFrame:
    """One price a day for a product in a store: of several the last one (by ``seq``) stands."""
    last = Window.partitionBy("product_id", "store", "date").orderBy(F.desc("seq"))
    return prices.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")


def latest(prices: DataFrame) -> DataFrame:
    return prices.groupBy("product_id", "store").agg(F.max(F.struct("date", "seq", "price")).alias("x")).select("product_id", "store", F.col("x.date").alias("date"), F.col("x.price").alias("price"))


def cheapest(offers: DataFrame) -> DataFrame:
    return offers.groupBy("product_id").agg(F.min("price").alias("price"), F.count("*").alias("stores"))


def cheapest_store(offers: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """The store that is cheapest when stores are asked in order: a later one has to be cheaper by more than the tolerance."""
    listed = offers.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("ord", "store", "price"))).alias("all"))
    fold = F.aggregate(
        F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))),
        F.element_at("all", 1),
        lambda best, x: F.when(x["price"] < best["price"] - tolerance, x).otherwise(best),
    )
    return listed.select("product_id", fold.alias("best")).select("product_id", F.col("best.store").alias("store"), F.col("best.price").alias("price"))


def series(prices: DataFrame) -> DataFrame:
    """The prices of a product in a store, by date."""
    return prices.groupBy("product_id", "store").agg(F.sort_array(F.collect_list(F.struct("date", "price"))).alias("points"))


def insight(prices: DataFrame) -> DataFrame:
    """What to think of the current price, given the mean of all earlier days.

    "great" below nine tenths of it; "fake" for a sale at 98 percent or more after more than
    two points; else "normal", or "new" without any earlier point.
    """
    own = Window.partitionBy("product_id", "store")
    before = own.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    rows = prices.select("*", F.avg("price").over(before).alias("mean"), F.count("*").over(before).alias("points"), F.max("date").over(own).alias("last"))
    verdict = (
        F.when(F.col("mean").isNull(), "new")
        .when(F.col("price") < 0.9 * F.col("mean"), "great")
        .when(F.col("on_sale") & (F.col("price") >= 0.98 * F.col("mean")) & (F.col("points") + 1 > 2), "fake")
        .otherwise("normal")
    )
    return rows.filter("date = last").select("product_id", "store", "price", F.round("mean", 4).alias("mean"), "points", verdict.alias("verdict"))


def spine(prices: DataFrame, days: int = 30) -> DataFrame:
    """A row for each of the last days of a product in a store, price null where none was seen.

    The points of those days are gathered by product and store and looked up within the row,
    so the days aren't shuffled.
    """
    first = F.date_sub("as_of", days - 1)
    rows = with_as_of(prices)
    point = F.when(F.col("date").between(first, F.col("as_of")), F.struct("date", "price"))
    keys = rows.groupBy("product_id", "store").agg(F.max("as_of").alias("as_of"), F.collect_list(point).alias("points"))
    keys = keys.select("product_id", "store", "points", F.explode(F.sequence(first, F.col("as_of"))).alias("date"))
    return keys.select("product_id", "store", "date", F.explode_outer(F.transform(F.filter("points", lambda x: x["date"] == F.col("date")), lambda x: x["price"])).alias("price"))


def regular_before(prices: DataFrame) -> DataFrame:
    """For offers on sale the last price at which the product wasn't."""
    before = Window.partitionBy("product_id", "store").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return prices.withColumn("normal_price", F.last(F.when(~F.col("on_sale"), F.col("price")), ignorenulls=True).over(before)).filter("on_sale")


def face(latest_offers: DataFrame, usual_prices: DataFrame) -> DataFrame:
    """List and sale price of an offer: a sale is marked only against a higher own or usual price."""
    rows = latest_offers.join(usual_prices.select("product_id", "store", "usual_price"), ["product_id", "store"], "left")
    against = F.coalesce("normal_price", "usual_price")
    marked = F.col("on_sale") & F.coalesce(against > F.col("price"), F.lit(False))
    return rows.select("product_id", "store", F.when(marked, against).otherwise(F.col("price")).alias("list_price"), F.when(marked, F.col("price")).alias("sale_price"))


def alerts(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """Alerts that weren't sent and can be, whose product costs the target or less."""
    due = wanted.filter(F.col("notified_at").isNull() & F.col("email").isNotNull())
    return due.join(current, "product_id").filter(F.col("price") <= F.col("target_price"))


def unresolved(wanted: DataFrame, current: DataFrame) -> DataFrame:
    return wanted.join(current, "product_id", "left_anti")


def ranked(rows: DataFrame, group: str, value: str) -> DataFrame:
    """With ``rank`` (1 for the largest value, equal ones alike) and ``n``, the rows of the group.

    Equal values are counted first; distinct ones go into buckets of a whole number each, and
    a rank is what the larger buckets have and the larger values of its own. So no task
    has to sort a group: the largest windows are over a group's buckets and over a bucket's
    values.
    """
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", F.floor("_v"))
    larger = Window.partitionBy("_g").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("_g", "_b").agg(F.sum("_n").alias("_all"))
    buckets = buckets.select(F.col("_g").alias("_h"), F.col("_b").alias("_c"), F.coalesce(F.sum("_all").over(larger), F.lit(0)).alias("_before"), F.sum("_all").over(Window.partitionBy("_g")).alias("n"))
    inside = Window.partitionBy("_g", "_b").orderBy(F.desc("_v")).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("_within", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    places = places.join(buckets, F.col("_g").eqNullSafe(F.col("_h")) & F.col("_b").eqNullSafe(F.col("_c")))
    places = places.select("_g", "_v", (F.col("_before") + F.col("_within") + 1).alias("rank"), "n")
    return rows.join(places, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v")


def savings_rank(savings: DataFrame) -> DataFrame:
    """Among the users of a month, the percentile from the top: 1 to 100."""
    rank, n = F.col("rank"), F.col("n")
    top = F.when((n <= 1) | (F.col("amount") <= 0), 100).otherwise(F.least(F.greatest(F.ceil(rank * 100.0 / n), F.lit(1)), F.lit(100)))
    return ranked(savings.select("user_id", "month_key", "amount"), "month_key", "amount").select("user_id", "month_key", "amount", top.cast("int").alias("top_pct"))


def month_rollover(savings: DataFrame) -> DataFrame:
    """With each month the one before it, zero if the user had none in exactly that month."""
    own = Window.partitionBy("user_id").orderBy("month_key")
    follows = F.add_months(F.to_date(F.concat(F.lag("month_key").over(own), F.lit("-01"))), 1) == F.to_date(F.concat("month_key", F.lit("-01")))
    return savings.withColumn("prev_amount", F.when(F.coalesce(follows, F.lit(False)), F.lag("amount").over(own)).otherwise(F.lit(0.0)))
