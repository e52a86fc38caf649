"""Activity queries: batch, and streams read from the events table until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import checkpoints
from ..operators import search
from ..sources import snapshots
from ..streaming import activity
from . import mapping as m
from .registry import query

_CLEAN = f"{m.E}, ok AS (SELECT *, least(greatest(coalesce(qty, 1), 1), 99) AS q FROM ev WHERE length(pid) BETWEEN 1 AND 64 AND event_type IN ('add', 'compare'))"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream over the table's files."""
    rows = spark.readStream.schema(m.load(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rows = rows.selectExpr(*(f"{e} AS {k}" for k, e in (m.EVENTS | {"pid": "regexp_replace(props, '[^0-9]', '')"}).items()))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("qty", F.floor("value").cast("int"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream over stored rows gives, once all of them are read; written to the shared folder batch by batch."""
    spark = stream.sparkSession
    checkpoints.ready(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write)
    writer.start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    return rows.select(*stream.columns)


@query(f"WITH {_CLEAN} SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour, pid, event_type, count(*) AS events, sum(q)::BIGINT AS qty FROM ok GROUP BY ALL")
def cart_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.hourly(activity.cleaned(m.events(spark, sf_dir)))


@query(f"WITH {_CLEAN} SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour, pid, event_type, count(*) AS events, sum(q)::BIGINT AS qty FROM ok GROUP BY ALL")
def stream_cart_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(activity.hourly(activity.cleaned(_stored(spark, sf_dir))), "complete")


@query(f"WITH {_CLEAN} SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour, pid, event_type, count(*) AS events, sum(q)::BIGINT AS qty FROM ok GROUP BY ALL")
def stream_hourly_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counters as additive upserts of each batch into a versioned table with a folder a month."""
    checkpoints.ready(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/counters-{uuid.uuid4().hex}"
    table, keys = snapshots.Snapshots(spark, f"{out}/table", "month"), ["month", "hour", "pid", "event_type"]
    hour = F.from_utc_timestamp(F.date_trunc("hour", "ts"), "Europe/Copenhagen")
    rows = activity.cleaned(_stored(spark, sf_dir)).select(F.date_format(hour, "yyyy-MM").alias("month"), hour.alias("hour"), "pid", "event_type", F.lit(1).cast("long").alias("events"), F.col("qty").cast("long").alias("qty"))
    writer = rows.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    writer.foreachBatch(snapshots.counted_into(table, "carts", keys, ["events", "qty"])).start().awaitTermination()
    return table.read().select("hour", "pid", "event_type", "events", "qty")


@query("""SELECT p_partkey AS id, p_partkey % 14 AS store, p_type AS kind, CASE WHEN p_partkey % 14 = 3 AND p_type <> 'PROMO' THEN 2 ELSE 1 END AS version FROM part WHERE NOT (p_partkey % 14 = 5 AND p_type = 'SMALL')""")
def snapshot_scoped_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All offers as the first version; then one store's but for a kind are replaced, and another store's of a kind deleted."""
    checkpoints.ready(spark)
    table = snapshots.Snapshots(spark, f"{spark.sparkContext.getCheckpointDir()}/offers-{uuid.uuid4().hex}", "store", "kind")
    rows = m.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 14).alias("store"), F.col("p_type").alias("kind"), F.lit(1).alias("version"))
    table.commit(rows)
    table.commit(rows.filter("store = 3 AND kind <> 'PROMO'").withColumn("version", F.lit(2)), lambda v: v["store"] == "3" and v["kind"] != "PROMO")
    table.commit(rows.limit(0), lambda v: v["store"] == "5" and v["kind"] == "SMALL")
    return table.read()


_COOL = f"""WITH RECURSIVE {_CLEAN}, n AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) AS i, CASE event_type WHEN 'add' THEN 1 ELSE 3 END AS w FROM ok),
f AS (SELECT pid, i, ts AS last, w AS total FROM n WHERE i = 1 UNION ALL
    SELECT n.pid, n.i, CASE WHEN n.ts - f.last >= INTERVAL '1 hour' THEN n.ts ELSE f.last END, f.total + CASE WHEN n.ts - f.last >= INTERVAL '1 hour' THEN n.w ELSE 0 END FROM f JOIN n ON n.pid = f.pid AND n.i = f.i + 1)
SELECT pid, max(i) AS events, max(total)::BIGINT AS count FROM f GROUP BY pid"""


@query(_COOL)
def cart_popularity_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.popularity(activity.cleaned(m.events(spark, sf_dir)), 3600.0)


@query(_COOL)
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drained(activity.popularity_stream(activity.cleaned(_stored(spark, sf_dir)), 3600.0), "append")
    return rows.groupBy("pid").agg(F.sum("events").alias("events"), F.sum("count").alias("count"))


@query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.rate_limited(m.events(spark, sf_dir).withColumn("key", F.col("user_id")), 2, 6 * 3600.0)


@query()
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(activity.rate_limited(_stored(spark, sf_dir).withColumn("key", F.col("user_id")), 2, 6 * 3600.0), "append")


_CLICKS = """r AS (SELECT p_partkey AS recipe_id, DATE '2023-11-01' + CAST(p_size * 2 AS INT) AS created FROM part), p AS (
    SELECT recipe_id, greatest(10 - greatest(CAST(floor((CAST(ts AS DATE) - created) / 7.0) AS BIGINT), 0), 1) AS points FROM ev JOIN r ON r.recipe_id = CAST(pid AS BIGINT))"""


def _recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.load(spark, sf_dir, "part").selectExpr("p_partkey AS recipe_id", "date_add(DATE '2023-11-01', p_size * 2) AS created")


@query(f"WITH {m.E}, {_CLICKS} SELECT recipe_id, sum(points)::BIGINT AS points, count(*) AS clicks FROM p GROUP BY 1")
def click_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = m.events(spark, sf_dir).withColumn("recipe_id", F.col("pid").cast("long"))
    return activity.click_points(clicks, _recipes(spark, sf_dir)).groupBy("recipe_id").agg(F.sum("points").alias("points"), F.count("*").alias("clicks"))


@query(f"WITH {m.E}, {_CLICKS} SELECT recipe_id, sum(points)::BIGINT AS points, count(*) AS clicks FROM p GROUP BY 1")
def stream_click_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _stored(spark, sf_dir).withColumn("recipe_id", F.col("pid").cast("long"))
    points = activity.click_points(clicks, _recipes(spark, sf_dir)).groupBy("recipe_id").agg(F.sum("points").alias("points"), F.count("*").alias("clicks"))
    return drained(points, "complete")


@query(f"""WITH RECURSIVE {m.E}, c AS (SELECT *, CAST(pid AS BIGINT) AS recipe_id, row_number() OVER (PARTITION BY pid ORDER BY ts, event_id) AS i FROM ev),
f AS (SELECT recipe_id, i, ts AS last, true AS ok, ts FROM c WHERE i = 1 UNION ALL SELECT c.recipe_id, c.i, CASE WHEN c.ts - f.last >= INTERVAL 1 HOUR THEN c.ts ELSE f.last END, c.ts - f.last >= INTERVAL 1 HOUR, c.ts FROM f JOIN c ON c.recipe_id = f.recipe_id AND c.i = f.i + 1),
r AS (SELECT p_partkey AS recipe_id, DATE '2023-11-01' + CAST(p_size * 2 AS INT) AS created FROM part)
SELECT recipe_id, sum(greatest(10 - greatest(CAST(floor((CAST(ts AS DATE) - created) / 7.0) AS BIGINT), 0), 1))::BIGINT AS points, count(*) AS clicks FROM f JOIN r USING (recipe_id) WHERE ok GROUP BY 1""")
def click_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within an hour of the recipe's last counted one have no points."""
    clicks = m.events(spark, sf_dir).withColumn("recipe_id", F.col("pid").cast("long"))
    return activity.click_points(activity.cooled(clicks, "recipe_id", 3600.0), _recipes(spark, sf_dir)).groupBy("recipe_id").agg(F.sum("points").alias("points"), F.count("*").alias("clicks"))


@query(f"""WITH {m.E} SELECT date_trunc('minute', ts) AS bucket, event_type AS kind, pid AS path, count(*) AS events FROM ev WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM ev) - INTERVAL 5 MINUTE GROUP BY ALL""")
def stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that can no longer change, in append mode."""
    return drained(activity.minutes(_stored(spark, sf_dir).withColumnsRenamed({"event_type": "kind", "pid": "path"})), "append")


@query(f"""WITH {m.E}, q AS (SELECT user_id % 50 AS user_id, ts, event_id, pid, 10 + value AS target FROM ev WHERE event_type <> 'error'), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, pid ORDER BY ts DESC, event_id DESC) AS nth FROM q)
SELECT user_id, pid AS product_id, round(target, 4) AS target_price FROM l WHERE nth = 1""")
def price_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last request of each user for a product; without cooldown or cap."""
    rows = m.events(spark, sf_dir).select((F.col("user_id") % 50).alias("user_id"), "ts", "event_id", "pid", (10 + F.col("value")).alias("target"), F.lit(50.0).alias("current"), F.when(F.col("event_type") != "error", F.lit("a@b.dk")).alias("email"))
    return activity.price_alerts(rows, most=10**9, seconds=0.0).select("user_id", "product_id", F.round("target_price", 4).alias("target_price"))


@query()
def savings_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.events(spark, sf_dir).withColumn("cheap", F.floor("value") % 50).withColumn("dear", F.floor("value").cast("double"))
    return activity.monthly_savings(rows.withColumn("cheap", F.col("cheap").cast("double")))


@query()
def shared_cart_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("value") < 30, "join").when(F.col("value") < 45, "leave").otherwise("write")
    rows = m.events(spark, sf_dir).withColumn("cart_id", F.col("pid").cast("long")).withColumn("action", action).withColumn("items", F.col("event_id").cast("string"))
    return activity.shared_carts(rows)


@query(f"""WITH {m.E}, c AS (SELECT event_type AS kind, pid AS path, count(*) AS events FROM ev GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY events DESC, path) AS nth FROM c)
SELECT kind, CASE WHEN nth <= 10 THEN path ELSE '(overflow)' END AS path, sum(events)::BIGINT AS events FROM k GROUP BY ALL""")
def security_overflow_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = m.events(spark, sf_dir).groupBy(F.col("event_type").alias("kind"), F.col("pid").alias("path")).agg(F.count("*").alias("events"))
    return activity.with_overflow(counts, 10)


@query(f"WITH {m.E} SELECT date_trunc('minute', ts) AS bucket, event_type AS kind, pid AS path, count(*) AS events FROM ev GROUP BY ALL")
def security_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.minutes(m.events(spark, sf_dir).withColumnsRenamed({"event_type": "kind", "pid": "path"}))


@query(f"WITH {m.E} SELECT event_type AS kind, count(*) AS events, count(*) > 2 AS alarm FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR GROUP BY 1")
def security_last_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.events(spark, sf_dir)
    newest = rows.agg(F.max("ts")).first()[0]
    rows = rows.filter(F.col("ts") >= F.lit(newest) - F.expr("INTERVAL 1 HOUR"))
    return rows.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("events")).withColumn("alarm", F.col("events") > 2)


_MINUTES = f"WITH {m.E}, mi AS (SELECT date_trunc('minute', ts) AS bucket, event_type AS kind, pid AS path, count(*) AS events FROM ev GROUP BY ALL), last AS (SELECT * FROM mi WHERE bucket >= (SELECT max(bucket) FROM mi) - INTERVAL 1 HOUR)"


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.minutes(m.events(spark, sf_dir).withColumnsRenamed({"event_type": "kind", "pid": "path"}))


@query(f"""{_MINUTES}, r AS (SELECT kind, sum(events) AS recent FROM last GROUP BY 1)
SELECT kind, sum(events)::BIGINT AS events, coalesce(any_value(recent), 0)::BIGINT AS recent, coalesce(any_value(recent), 0) > CASE kind WHEN 'error' THEN 0 WHEN 'add' THEN 2 ELSE 1000 END AS alarm FROM mi LEFT JOIN r USING (kind) GROUP BY kind""")
def security_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.alarms(_minutes(spark, sf_dir), {"error": 0, "add": 2}, 1000)


@query(f"{_MINUTES} SELECT kind, path, sum(events)::BIGINT AS events FROM last GROUP BY ALL ORDER BY events DESC, kind, path LIMIT 10")
def security_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.top_paths(_minutes(spark, sf_dir))


@query(f"WITH {m.E} SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS highest FROM ev GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.events(spark, sf_dir)
    return rows.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("highest"))


@query(f"WITH {m.E} SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, max(value) AS slowest, round(avg((event_type = 'error')::INT), 6) AS error_rate, count(*) FILTER (event_type = 'error') AS c5, count(*) FILTER (event_type <> 'error') AS c2 FROM ev GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return m.events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("requests"), F.max("value").alias("slowest"), F.round(F.avg(error.cast("int")), 6).alias("error_rate"), F.count_if(error).alias("c5"), F.count_if(~error).alias("c2"))


@query(f"WITH {m.E}, c AS (SELECT pid AS id, count(*) AS count, max(ts) AS last FROM ev GROUP BY 1) SELECT id, count, row_number() OVER (ORDER BY count DESC, last DESC, id)::INT AS rank FROM c QUALIFY rank <= 10")
def top_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = m.events(spark, sf_dir).groupBy(F.col("pid").alias("id")).agg(F.count("*").alias("count"), F.max("ts").alias("last"))
    top = counted.orderBy(F.desc("count"), F.desc("last"), "id").limit(10).withColumn("all", F.lit(1))
    return search.top_per_group(top, "all", [F.desc("count"), F.desc("last"), F.asc("id")], 10).select("id", "count", "rank")
