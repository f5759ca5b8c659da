"""One registered query per operator: the operator over its whole table, and the digest of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm import (
    backoff, decontamination, fim, jaccard, lines, mixing, packing, phrases, pii, quality, sharding, suffixes, urls,
)

# The base rules of the url filter, and hosts that are nothing but spam.
URL_RULES = [
    urls.host_rule("block", "net/"),
    urls.host_rule("allow", "example.net/en/"),
    urls.host_rule("block", "example.com/de/"),
    urls.host_rule("allow", "org/fr/"),
]
PASSAGE_BYTES = 240  # fewer than 51 words of usual length
SPAM_LABELS = ["ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    df = quality.quality_verdicts(docs, keep_text=False)
    return df.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("reasons", ",").alias("reasons"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = urls.rule_table(spark, URL_RULES + [urls.label_rule("block", x) for x in SPAM_LABELS])
    df = urls.filtered_urls(pages, rules)
    base = F.col("rank") == 1
    return df.select("row.page_id", "host", "path", F.when(base, F.col("rule")).alias("rule"), "verdict",
                     F.when(~base, F.col("rule")).alias("pattern_rule"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs, keep_text=False).select(
        "row.doc_id", "size", "source_size", "target", "taken", "epochs", "extra")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_links(docs).select(
        F.col("id").alias("doc_id"), "class_id", "same_id", F.col("copies").alias("n_copies"), F.col("links").alias("n_links"))


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = pii.personal_data(docs, keep_text=False)
    base = ["email", "ip", "card", "phone"]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return df.select(
        "row.doc_id", *[count(k) for k in base], hex_sha256(pii.span_text(F.col("spans"), base)).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return backoff.backoff_scores(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_backed", F.round("log_score", 3).alias("log_score"),
        F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return sharding.sharded(docs, keep_text=False).select(
        "row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.without_repeats(docs, keep_text=False, passage_bytes=PASSAGE_BYTES).select(
        "row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_passages", "n_passage_words")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = lines.repeated_lines(docs)
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return df.select(F.col("id").alias("doc_id"), "n_lines", numbers("equal").alias("equal_lines"), numbers("near").alias("near_lines"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return df.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = fim.fill_in_middle(docs, keep_text=False)
    return df.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", hex_sha256(F.col("output")).alias("output_sha256"),
        hex_sha256(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = packing.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = packing.documents_of(files).select("id", "part", "nth", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(packing.file_starts(files), ["part", "nth"]).select(
        F.col("id").alias("doc_id"), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return phrases.collocations(docs)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_url_filters, op3_mixing, op4_ngram_jaccard, op5_pii, op6_lm_scoring, op7_sharding,
              op8_suffix_dedup, op9_line_dedup, op10_decontamination, op11_fill_in_middle, op12_token_files, op13_collocations,
              pipeline)
}
