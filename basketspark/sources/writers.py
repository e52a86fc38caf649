"""Snapshots: swaps by partition, upserts, merges and retention, each as one write."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swap(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replace those partitions of a table that ``rows`` have; others stay. Without any, replace all.

    The rows are written beside the table first, so a job that dies leaves the table as it
    was. Then folders are moved: the old one aside, the new one in its place.
    """
    sc = rows.sparkSession.sparkContext
    stage = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    writer = rows.write
    (writer.partitionBy(*partitions) if partitions else writer).parquet(stage)
    at = sc._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(sc._jsc.hadoopConfiguration())

    def move(new, old) -> None:
        aside = at(f"{stage}-old")
        had = fs.exists(old)
        fs.mkdirs(old.getParent())
        if had:
            fs.rename(old, aside)
        if not fs.rename(new, old):
            if had:
                fs.rename(aside, old)
            raise OSError(f"{new} can't be moved to {old}")
        if had:
            fs.delete(aside, True)

    if partitions:
        for folder in fs.globStatus(at("/".join([stage, *(f"{p}=*" for p in partitions)]))) or ():
            new = folder.getPath()
            inside = new.toString()[new.toString().index(stage.rsplit("/", 1)[-1]) + len(stage.rsplit("/", 1)[-1]) + 1 :]
            move(new, at(at(path), inside))
        fs.delete(at(stage), True)
    else:
        move(at(stage), at(path))


def in_chunks(rows: DataFrame, path: str, size: int = 1000) -> None:
    """Files of ``size`` rows at most, and beside them (in ``path``-index) how many rows there are."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", size).parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    written.agg(F.lit(0).alias("id"), F.count("*").alias("rows"), F.ceil(F.count("*") / size).alias("chunks")).write.mode("overwrite").parquet(f"{path}-index")


def by_bytes(rows: DataFrame, text_col: str, most: int) -> DataFrame:
    """The rows with a ``batch`` each: texts of a batch have ``most`` bytes together, or are one longer text."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, batch, size = TaskContext.get().partitionId(), 0, 0
        for f in frames:
            names = []
            for x in f[text_col]:
                n = len((x or "").encode())
                if size and n and size + n > most:
                    batch, size = batch + 1, 0
                size += n
                names.append(f"{part}-{batch}")
            yield f.assign(batch=names)

    return rows.mapInPandas(deal, f"{kind}, batch string")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """The old rows that no new one replaces, and of the new ones of a key the last."""
    last = Window.partitionBy(*keys).orderBy(by.desc())
    kept = new.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
    return old.join(kept, keys, "left_anti").unionByName(kept)


def merged_source(snapshot: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """A snapshot in which one source's rows are as in ``fresh``: new values, vanished rows gone, new ones in; others as they were."""
    values = [c for c in snapshot.columns if c not in ("id", "source")]
    own = snapshot.filter(F.col("source") == source)
    new = fresh.select("id", *(F.col(c).alias(f"new_{c}") for c in values), F.lit(True).alias("present"))
    both = own.join(new, "id", "full_outer").filter("present")
    updated = both.select("id", F.lit(source).alias("source"), *(F.coalesce(f"new_{c}", c).alias(c) for c in values))
    return snapshot.filter(F.col("source") != source).unionByName(updated)


def retained(rows: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the last days, counted from the newest."""
    newest = rows.agg(F.max(date)).first()[0]  # one value, so that the filter reaches the partitions
    return rows.filter(F.col(date) >= F.date_sub(F.lit(newest), days)) if newest is not None else rows


def reused_hashes(fresh: DataFrame, old: DataFrame) -> DataFrame:
    """Fresh offers with yesterday's image hash where the same offer (by SKU, else by name) has the same image."""
    known = old.filter(F.col("image_hash").isNotNull())
    by_sku = known.groupBy("sku", "image_url").agg(F.min("image_hash").alias("h_sku"))
    by_name = known.groupBy(F.lower("name").alias("l_name"), "image_url").agg(F.min("image_hash").alias("h_name"))
    rows = fresh.withColumn("l_name", F.lower("name")).join(by_sku, ["sku", "image_url"], "left").join(by_name, ["l_name", "image_url"], "left")
    return rows.withColumn("image_hash", F.coalesce("h_sku", "h_name")).drop("h_sku", "h_name", "l_name")


def drained(outbox: DataFrame, acknowledged: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The oldest rows to send, and the outbox without those that were acknowledged."""
    return outbox.orderBy("created", "id").limit(most), outbox.join(acknowledged.select("id"), "id", "left_anti")
