"""The registered queries of this package: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import (
    exact,
    licenses,
    lines,
    mixing,
    packing,
    pages,
    quality,
    ranking,
    secrets,
    shards,
    simhash,
    spelling,
    substrings,
)
from vectorloom.tables import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark, sf_dir) -> DataFrame:
    """Counts and verdict per document. Measures are written once, without texts."""
    docs = documents(spark, sf_dir)
    found = written(quality.measured(docs, docs["doc_id"]))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality.judged(found).select(
        "doc_id", *[F.col("m")[n].alias(n) for n in names], "base_failed", "kept")


def op2_token_shards(spark, sf_dir) -> DataFrame:
    """Every document's ids, fetched by key from the shards that were just written."""
    docs = documents(spark, sf_dir)
    store = shards.TokenStore.write(docs)
    return store.fetch(shards.document_keys(docs)).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_substring_dedup(spark, sf_dir) -> DataFrame:
    """Words removed per document and the hash of the words that stay."""
    return substrings.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_html_extraction(spark, sf_dir) -> DataFrame:
    """Main text of every page."""
    found = pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(
        F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text",
        F.length("text").cast("long").alias("n_chars"))


def op5_source_mixing(spark, sf_dir) -> DataFrame:
    """Size, target and words taken per document, in order of first training position."""
    docs = documents(spark, sf_dir)
    mixed = mixing.mix(docs, keep=docs["doc_id"])
    first = F.get(F.col("pieces"), 0)["position"]
    return mixed.select(
        F.col("row").alias("doc_id"), "size", "source_size", "target", "taken",
        F.size("pieces").alias("copies"), F.round(first, 9).alias("position"),
    ).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op6_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license_scan(spark, sf_dir) -> DataFrame:
    """Phrase places, labels and score of every document."""
    return licenses.license_scan(documents(spark, sf_dir)).drop("spans")


def op8_line_dedup(spark, sf_dir) -> DataFrame:
    """Lines dropped per document and the hash of what stays."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return lines.without_boilerplate(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed",
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op9_packing(spark, sf_dir) -> DataFrame:
    """Every piece of every document in its sequence."""
    return packing.pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "tier", "step_group")


def op10_exact_dedup(spark, sf_dir) -> DataFrame:
    """The row that stays for every document."""
    return exact.exact_dedup(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def op11_spelling_variants(spark, sf_dir) -> DataFrame:
    """Form, root and neighbours of every word."""
    return spelling.variants(documents(spark, sf_dir))


def op12_secret_scan(spark, sf_dir) -> DataFrame:
    """Findings of every document."""
    found = secrets.secret_scan(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[secrets.number_of(F.col("base"), k).alias(f"n_{k}")
                    for k, _, _ in secrets.STRONG],
        F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"))


def op13_ranked_search(spark, sf_dir) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranking.search(documents(spark, sf_dir), items).select(
        "item_id", "rank", "doc_id", "score")


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_shards": op2_token_shards,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_source_mixing": op5_source_mixing,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_secret_scan": op12_secret_scan,
    "op13_ranked_search": op13_ranked_search,
}
