"""The thin ``opN_*`` queries: each applies its operator, with production
parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import (align, ball_tree, decontaminate, html_text, log_bilinear, mixing, ngram_join,
                          permutation_index, repeats, token_files, toxicity, url_reputation, warc)
from feedloom.llm.common import shared_path, stored, table
from feedloom.llm.oracles import ORACLES  # noqa: F401

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    rows = stored(warc.captures(warc.transactions(warc.read_warc(spark, path, payloads=False))), "captures")
    return warc.resolve(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_index(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    counts = stored(url_reputation.outcomes(pages, table(spark, sf_dir, "labels")), "outcomes")
    return url_reputation.judge(pages, url_reputation.reputation(counts)).select(
        "page_id", "host", "path", "rule", "verdict")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), count_links=True)


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept text follows the contract's columns (a code point cut by a
    span's border shows as a replacement character)."""
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=True)
    return kept.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file(PIECES))


def op12_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.scores(table(spark, sf_dir, "documents"))


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_soft_mixing, op2_permutation_index, op3_warc_transactions, op4_counterfactual_toxicity, op5_token_files,
    op6_text_to_tag_ratio, op7_host_reputation, op8_ngram_join, op9_run_length_index, op10_wu_manber, op11_cross_tokenizer,
    op12_log_bilinear, op13_ball_tree)}
