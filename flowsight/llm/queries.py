"""Registered queries of the text operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lines, lm, near_dup, packing, periods, phrases, pieces, pii, quality, toxicity, urls
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",").alias("removed"),
        F.col("text").alias("clean_text"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.train(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, field)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans")
    )


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(pii.find_spans(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where(fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm.score_documents(docs, docs.where(fold("doc_id", 5) != 1))
    return scored.withColumn("held_out", fold("doc_id", 5) == 1)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.leak_report(found).drop("longest", "match_item", "match_at")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the checksum of their id, repeat a stretch of their words to the end."""
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return periods.run_report(periods.find_runs(docs, planted))


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_minhash_near_dup": op4_minhash_near_dup,
    "op5_url_filter": op5_url_filter,
    "op6_personal_data": op6_personal_data,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_language_id": op8_language_id,
    "op9_language_model": op9_language_model,
    "op10_decontamination": op10_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_piece_encoding": op12_piece_encoding,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op2_line_dedup": lines.SQL,
    "op4_minhash_near_dup": near_dup.SQL,
    "op10_decontamination": decontaminate.SQL,
    "op13_collocations": phrases.SQL,
}
