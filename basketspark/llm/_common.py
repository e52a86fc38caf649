"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for a null id where rows are handled in pandas, which has no integers beside nulls.
NOBODY = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session sets none, a session of one machine (local tests) gets a temporary
    folder; on a cluster that is an error, as no other machine would see it.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: How many rows go to Python at once where they hold whole texts.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let batches for Python have ``rows`` rows, unless the session sets another number.

    Spark bounds a batch by rows alone, 10,000 of them; so many texts take a worker's memory
    twice over. Plans are made when a result is used, so this stays set for the session.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(rows))


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Jobs run in here hand Python batches of ``size`` bytes at most, if the session has no setting of its own for that."""
    if spark.conf.get(BATCH_BYTES, None) not in (None, str(64 << 20), "64MB"):
        yield
        return
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before) if before else spark.conf.unset(BATCH_BYTES)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: whatever reads the table again doesn't recompute it, and an
    executor that is lost later takes none of it away. The table goes when the driver ends.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    sc = df.sparkSession.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_nobody(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NOBODY)).alias(name)


def null_again(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NOBODY)) for n in names})


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def finite(vec: str):
    """Whether an array column has components, none of them null, NaN or infinite."""
    x = F.col(vec)
    return F.coalesce(
        (F.size(x) > 0)
        & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False))),
        F.lit(False),
    )
