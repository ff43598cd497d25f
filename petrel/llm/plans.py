"""Queries of the training-text problems over the test tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.llm import boilerplate, exclusion, history, leaks, mixing, personal, truncation
from petrel.llm.personal_training import trained_model
from petrel.storage import bounded, shared_dir, table


def p1_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Records to exclude, with the reason."""
    captures = table(spark, d, "captures")
    return exclusion.residue_records(captures, boilerplate.fit(boilerplate.training_pages(captures)))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_excluded(spark, d).select("row_id")


def p2_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Every page record with the reason why it counts as cut, or none."""
    return truncation.truncated(table(spark, d, "captures"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_truncated(spark, d).where(F.col("reason").isNotNull()).select("row_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each harvester's page records are cut."""
    cut = F.count_if(F.col("reason").isNotNull())
    return p2_truncated(spark, d).groupBy("harvester_id").agg(F.count("*").alias("records"), cut.alias("cut"), F.round(cut / F.count("*"), 6).alias("rate"))


def p5_article(spark: SparkSession, d: str) -> DataFrame:
    """The article's lines with their text."""
    captures = table(spark, d, "captures")
    return exclusion.article_lines(captures, boilerplate.fit(boilerplate.training_pages(captures)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_article(spark, d).select("row_id", "line_no")


def p7_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Resource rows that repeat an earlier batch's payload, exactly or nearly."""
    return history.repeated_payloads(table(spark, d, "captures").where("type = 'resource'"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_repeats(spark, d).select("row_id")


def p7_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from three deliveries of eight batches, each checked against the stored tables of those before it."""
    rows = table(spark, d, "captures").where("type = 'resource'")
    number = F.least(F.floor((F.coalesce("batch_id", F.lit(24)) - 1) / 8), F.lit(2))
    store = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    found = [history.check_batch(rows.where(number == n), store, n) for n in range(3)]
    return reduce(DataFrame.unionByName, found)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    overlaps = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return overlaps.where(F.col("run_words") >= leaks.SPAN).select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Substitution-tolerant overlaps with their extent."""
    overlaps = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return overlaps.where(F.col("overlap_words") >= leaks.SPAN)


def _tokenizer() -> tuple[str, str]:
    """File and splitting pattern of the public tokenizer that sizes are counted in."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), *_tokenizer())


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.share_report(mixing.mix(table(spark, d, "documents"), targets, *_tokenizer()), targets)


def _span_model(spark: SparkSession, d: str) -> personal.SpanModel:
    return trained_model([r[0] for r in bounded(table(spark, d, "given_names").select("given_name").distinct(), 1_000_000)])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.extract(table(spark, d, "documents"), _span_model(spark, d))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with placeholders in place of personal values."""
    return personal.redact(table(spark, d, "documents").select("doc_id", "source", "text"), _span_model(spark, d))


QUERIES = {q.__name__: q for q in (p1_found, p1_excluded, p2_found, p2_truncated, p2_rates, p5_found, p5_article, p7_found, p7_repeats, p7_deliveries, p8_found, p8_overlaps, p9_mix, p9_shares, p10_found, p10_redacted)}
_GRAMS = r"""select {id}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) g
  from (select {id}, regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+') w from {table} where text is not null)"""
SQL = {
    "p8_found": f"select distinct doc_id, item_id from ({_GRAMS.format(id='doc_id', table='documents')}) join ({_GRAMS.format(id='item_id', table='eval_items')}) using (g)",
}
