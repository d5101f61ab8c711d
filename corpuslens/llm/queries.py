"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str, folds: int, fold: int):
    """Whether a row is of the fold that nothing is learned from; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False)).alias("held_out")


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .site_style import extract

    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_cross_polytope_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("word_bpe_49k.json"))


def op4_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = langid.predict(docs, langid.fit(docs, tokenizer("piece_bpe_32k.model")), carry=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4, 2), "lang_pred", "score")


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")), carry=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"), 16)


def op7_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op8_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    found = overlaps(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_items") >= 2).alias("contaminated"))


def op9_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_archive import archive_documents

    return archive_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer("byte_bpe_50k.json"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


QUERIES = {f.__name__: f for f in (op1_site_style_tree, op2_cross_polytope_ann, op3_best_fit_packing, op4_segmentation_langid, op5_pu_quality, op6_ring_shards, op7_simhash_trie_join, op8_wu_manber_decontamination, op9_token_archive, op10_warc_archive)}


def oracle_sql() -> dict[str, str]:
    from .warc import ORACLE

    return {"op10_warc_archive": ORACLE}
