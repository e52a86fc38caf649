"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketspark.llm import pii, toxicity
from basketspark.llm._common import materialize, table
from basketspark.llm.ngramjoin import jaccard_join
from basketspark.llm.packing import pack
from basketspark.llm.queries import _vocabulary, pseudonym_key
from basketspark.llm.suffixdedup import without_repeats

#: No SQL gives these rows; the stages are tested against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, after texts have changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like the ones labelled toxic go; null and empty texts stay, repeated rows go or stay together."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8 or more) that of the smallest id stays.

    Rows that repeat both id and text are one; rows without an id stay, and so do those
    without words, which link with nothing.
    """
    groups = materialize(jaccard_join(docs, k=5, percent=80), "groups")
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    out = docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    if not groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document of smaller id has go; every row stays.

    Null texts stay null; rows that repeat an id don't count as repeats of each other, and
    rows without an id come after all others.
    """
    return _counted(without_repeats(docs, width=50))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get pseudonyms of their own format; every row stays, null texts stay null, equal rows stay equal."""
    return _counted(pii.pseudonymised(docs, pseudonym_key(spark), counts=False))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces and their places in sequences of 4096 tokens; null and empty texts have one piece of one token."""
    return pack(docs, _vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("private", private),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
