"""Guards: figures of a run, and what stops it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metrics(cards: DataFrame, previous_rows: int) -> DataFrame:
    """One row: cards, share with a match, and size against the previous run."""
    n = F.count("*")
    return cards.agg(
        n.alias("cards"), F.round(F.coalesce(F.avg(F.col("matched").cast("double")), F.lit(0.0)), 6).alias("coverage"), F.round(n / F.lit(max(1, previous_rows)), 6).alias("against_previous")
    )


def verdict(found: DataFrame, least_rows: int = 1000, least_coverage: float = 0.20, least_size: float = 0.70) -> DataFrame:
    stop = F.when((F.col("cards") >= least_rows) & (F.col("coverage") < least_coverage), "coverage").when(F.col("against_previous") < least_size, "size").otherwise("ok")
    return found.withColumn("verdict", stop)


def guarded(cards: DataFrame, previous_rows: int, **limits: float) -> DataFrame:
    """The cards, unless the guards object: then an action on the result fails."""
    state = verdict(metrics(cards, previous_rows), **limits).select("verdict")
    checked = state.select(F.when(F.col("verdict") == "ok", True).otherwise(F.raise_error(F.concat(F.lit("the run is stopped: "), "verdict")).cast("boolean")).alias("passed"))
    return cards.join(F.broadcast(checked), F.col("passed")).drop("passed")


def quarantined(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items())))
    judged = rows.withColumn("broken", broken)
    return judged.filter(F.size("broken") == 0).drop("broken"), judged.filter(F.size("broken") > 0)


def visible(rows: DataFrame, user: str | None) -> DataFrame:
    """What a user may see: approved rows and their own."""
    mine = F.lit(False) if user is None else F.col("owner") == user
    return rows.filter((F.col("status") == "approved") | F.coalesce(mine, F.lit(False)))


def visible_parts(parts: DataFrame, rows: DataFrame, user: str | None, key: str) -> DataFrame:
    """Parts (of recipes, say) of which a visible row exists."""
    return parts.join(visible(rows, user).select(key).distinct(), key, "left_semi")


def capped(new: DataFrame, existing: DataFrame, most: int = 200) -> DataFrame:
    """Upserts that are allowed: of keys that exist, or of owners below the cap."""
    full = existing.groupBy("owner").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("owner")
    fresh = new.join(existing.select("owner", "key"), ["owner", "key"], "left_anti").join(full, "owner", "left_anti")
    return new.join(existing.select("owner", "key"), ["owner", "key"], "left_semi").unionByName(fresh)
