"""Queries that apply the operators to the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import (
    chat_format,
    fingerprints,
    hard_negatives,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    spelling_variants,
    token_counts,
    toxicity,
    url_filter,
    warc_revisits,
)
from threadline.llm.common import named

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, path: str) -> DataFrame:
    judged = quality_classifier.classify(_table(spark, path, "documents"), _table(spark, path, "labels"), ["doc_id"], narrow=True)
    return judged.select("doc.doc_id", "host", "path", "e_poor", "e_toxic", "site_poor", "site_toxic", "p_poor", "p_toxic", "kept")


def op2_mixing(spark: SparkSession, path: str) -> DataFrame:
    taken = mixing.mix(_table(spark, path, "documents"), ["doc_id"])
    return taken.select("doc.doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_chat_format(spark: SparkSession, path: str) -> DataFrame:
    return chat_format.format_chats(_table(spark, path, "conversations"))


def op4_simhash_dedup(spark: SparkSession, path: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, path, "documents"))
    return found.select("doc_id", simhash_dedup.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, path: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, path, "documents"), vocabulary(), ["doc_id"])
    return counted.select("doc.doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_packing(spark: SparkSession, path: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, path, "documents"), vocabulary(), ["doc_id"])
    # The digest stands in for the ids, so that only narrow rows are written and ranked.
    pieces = pieces.select("doc.doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(pieces)


def warc_records(pages: DataFrame) -> DataFrame:
    """A response and a later not-modified revisit for every page; some revisits have other or no validators."""
    page, url, html = named("page_id"), named("url"), F.coalesce(named("html"), F.lit(""))
    date = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(page, F.lit(0)))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    when = F.concat(F.date_format(date, "yyyy-MM-dd HH:mm:ss"), F.lit(" GMT"))
    full = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nETag: "), tag, F.lit("\r\nLast-Modified: "), when,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\nCache-Control: max-age=60\r\n\r\n"),
    )
    nth = F.coalesce(page, F.lit(0)) % 12
    validator = (
        F.when(nth == 3, F.lit("")).when(nth == 5, F.concat(F.lit("Last-Modified: "), when, F.lit("\r\n")))
        .when(nth == 7, F.lit('ETag: "other"\r\n')).otherwise(F.concat(F.lit("ETag: W/"), tag, F.lit("\r\n")))
    )
    brief = F.concat(
        F.lit("HTTP/1.1 304 Not Modified\r\n"), validator,
        F.lit("Cache-Control: max-age=120\r\nX-Cache: HIT\r\nContent-Length: 0\r\n\r\n"),
    )
    responses = pages.select(
        F.concat(F.lit("r"), page.cast("string")).alias("record_id"), F.lit("response").alias("record_type"), url.alias("target_uri"),
        date.alias("date"), full.alias("http_headers"), html.alias("payload"),
    )
    later = F.when(nth == 9, date - F.expr("INTERVAL 3650 DAYS")).otherwise(date + F.expr("INTERVAL 1 DAY"))
    revisits = pages.select(
        F.concat(F.lit("v"), page.cast("string")), F.lit("revisit"), F.concat(url, F.lit("#again")), later, brief, F.lit(None).cast("string")
    )
    return responses.union(revisits)


def op7_warc_revisits(spark: SparkSession, path: str) -> DataFrame:
    resolved = warc_revisits.resolve_revisits(warc_records(_table(spark, path, "pages")))
    return resolved.select(
        "record_id", "url_key", "refers_to", "outcome", "http_status", warc_revisits.header_text(F.col("headers")).alias("headers"),
        F.md5("payload").alias("payload_md5"), F.octet_length("payload").alias("payload_bytes"),
    )


def op8_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    pairs = fingerprints.fingerprint_pairs(_table(spark, path, "documents"))
    counted = fingerprints.near_counts(pairs, F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False)))
    digits = simhash_dedup.hex_digits
    return counted.select(
        "doc_id", "n_chars", "edited_sha256", digits(F.col("fp")).alias("fingerprint"), digits(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )


def op9_url_filter(spark: SparkSession, path: str) -> DataFrame:
    judged = url_filter.filter_urls(_table(spark, path, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, path, "documents"), _table(spark, path, "labels"), ["doc_id"], narrow=True)
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("cuts_failed", ",").alias("cuts_failed"),
    )


def op11_toxicity(spark: SparkSession, path: str) -> DataFrame:
    judged = toxicity.judge(_table(spark, path, "documents"), _table(spark, path, "labels"), ["doc_id"])
    return judged.select("doc.doc_id", "held_out", "score", "predicted")


def op12_spelling_variants(spark: SparkSession, path: str) -> DataFrame:
    words = spelling_variants.damaged_words(_table(spark, path, "documents"))
    return spelling_variants.group_variants(words)


def op13_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    vec_id, label = named("vec_id"), named("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, path, "embeddings"), vec_id % 100 == 0, shifted)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_classifier, op2_mixing, op3_chat_format, op4_simhash_dedup, op5_token_counts, op6_packing, op7_warc_revisits,
        op8_fingerprints, op9_url_filter, op10_quality_rules,
        op11_toxicity, op12_spelling_variants, op13_hard_negatives,
    ]
    return {function.__name__: function for function in found}
