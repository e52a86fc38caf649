"""The queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, lm, pii, segments, sentencepieces, toxicity, trie, vptree, warc
from ._common import table
from .ngramjoin import jaccard_join
from .packing import pack
from .suffixdedup import removed_digests


#: Where the session names the secret key of the pseudonyms; the tests' data is made up and takes the stand-in.
KEY_SETTING, STAND_IN = "basketspark.pseudonyms.key", "an example key, not a secret one"


def pseudonym_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, STAND_IN).encode()


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.vp_search(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(table(spark, sf_dir, "documents"), width=50)


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op4_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_topk(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymised(docs, pseudonym_key(spark))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(lm.fit(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vptree_ann": op1_vptree_ann,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_chat_perspectives": op3_chat_perspectives,
    "op4_segment_topk": op4_segment_topk,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_sentencepieces": op7_sentencepieces,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_packing": op10_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lm_scoring": op13_lm_scoring,
}

SQL: dict[str, str] = {
    "op3_chat_perspectives": chat.PERSPECTIVES_SQL,
    "op4_segment_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op6_warc": warc.WARC_SQL,
    "op11_fill_in_middle": fim.FIM_SQL,
    "op12_prefix_trie": trie.TRIE_SQL,
}
