"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimweave.llm import quality, toxicity
from dimweave.llm.collocations import collocations
from dimweave.llm.common import is_training_row, scratch_path, table
from dimweave.llm.fingerprints import edited_fingerprints
from dimweave.llm.mixing import mix
from dimweave.llm.neighbours import nearest
from dimweave.llm.ngram_join import similarity_groups
from dimweave.llm.packing import pack_documents
from dimweave.llm.superminhash import near_duplicates
from dimweave.llm.token_counts import count_tokens
from dimweave.llm.token_files import read_token_files, write_token_files
from dimweave.llm.urls import UrlRule, judge_urls
from dimweave.llm.variants import count_words, variant_forms

# Fixed rules of the url query, and two patterns of the method's own for urls no rule fits.
URL_RULES = (
    UrlRule("block", "net/"),
    UrlRule("allow", "example.net/en/"),
    UrlRule("block", "example.com/de/"),
    UrlRule("allow", "org/fr/"),
    UrlRule("block", "*?sessionid=*", site=False),
    UrlRule("block", "*/wp-login.php*", site=False),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.withColumn("held_out", ~is_training_row(F.col("doc_id")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.withColumn("held_out", ~is_training_row(F.col("doc_id")))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The digest columns of ``pack_documents``: places, and the ids' crc32."""
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, keep=["doc_id"])
    digest = packed.pieces.select("row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(packed.places, ["row", "piece"]).drop("row")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    files = read_token_files(spark, path)
    return files.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


# The mixture keeps this share of all tokens.
MIX_FRACTION = 0.6


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIX_FRACTION)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(count_words(table(spark, sf_dir, "documents"), least=7, one_in=31).where("n >= 2"), ratio=10)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_join": op4_ngram_join,
    "op5_neighbours": op5_neighbours,
    "op6_token_files": op6_token_files,
    "op7_url_filter": op7_url_filter,
    "op8_token_counts": op8_token_counts,
    "op9_mixing": op9_mixing,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_collocations": op12_collocations,
    "op13_super_minhash": op13_super_minhash,
}
