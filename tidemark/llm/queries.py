"""Queries over the corpus tables, each one operator with production parameters, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, extract, importance, langid, linededup, lm, mixing, rules, spelling, toxicity, warc
from tidemark.llm.common import fold, new_folder, table
from tidemark.llm.sampling import smallest_hashes, told_apart
from tidemark.llm.simhash import hex16, simhash_components


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold() != 0).select("doc_id", "lang"), docs.where(fold() != 0))
    found = langid.predict(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_archive(spark, path, payloads=False)).where("main is not null")
    page = lambda c: F.regexp_extract(c, r"^urn:capture:(-?\d+)", 1).try_cast("long")
    return captures.select(
        page(F.col("main.record_id")).alias("page_id"), F.col("main.length").alias("payload_bytes"), F.col("main.digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), page(F.col("main.refers_to")).alias("refers_to"), F.col("main.uri").alias("url"), F.col("request").isNotNull().alias("has_request"),
    )


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold() == 1)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "n_words", F.round("prob", 6).alias("prob"))


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_removed_lines", "n_removed_words", "kept_in")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame, held_out: bool) -> toxicity.ToxicityModel:
    """Learned from labels; with held_out, only from rows outside fold 0."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.train(labels.where(fold() != 0) if held_out else labels, docs.where(fold() != 0) if held_out else docs)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity_model(spark, sf_dir, docs, held_out=True)).withColumnRenamed("toxicity", "score")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.similarity", "h.start", "h.n_words")


def quality_rules(spark: SparkSession, sf_dir: str, sample: int = 20_000) -> list[rules.Rule]:
    """Learned from a bounded sample of labelled rows outside fold 0."""
    labels = table(spark, sf_dir, "labels").where("quality is not null").where(fold() != 0).select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = told_apart(smallest_hashes(labels, sample), docs)
    counts = rules.quality_counts(docs.join(F.broadcast(chosen), "doc_id"))
    return rules.learn_from(counts.select("doc_id", *rules.features(), (1 - F.col("quality")).alias("junk")).orderBy(F.xxhash64("doc_id")), "junk")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = quality_rules(spark, sf_dir)
    counts = rules.quality_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = counts.select("doc_id", *[F.col(n).alias(f"_{n}") for n in names], base.alias("base_failed"), *rules.features())
    return judged.select("doc_id", *[F.col(f"_{n}").alias(n) for n in names], "base_failed", (~F.col("base_failed") & (rules.verdict(learned) == 0)).alias("kept"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary_of(table(spark, sf_dir, "documents").select("doc_id", "text"), every=31)
    return spelling.variants(words)


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    source = bpe.read_tokenizer(path)
    found = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), source)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_language, op3_warc, op4_lm, op5_mixing, op6_extract, op7_linededup, op8_toxicity, op9_decontam, op10_rules, op11_importance, op12_spelling, op13_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.oracle(), "op11_importance": importance.oracle(), "op12_spelling": spelling.oracle()}
