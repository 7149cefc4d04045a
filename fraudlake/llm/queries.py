"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.llm import (
    align, bk_dedup, decontaminate, exact_dedup, fim, fingerprint, language, packing, quality, secrets, sharding, substring_dedup, toxicity,
)
from fraudlake.llm.common import held_out, table


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeats of 20 words and more that start earlier."""
    return substring_dedup.remove_repeats(table(spark, sf_dir)).drop("kept")


def op3_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document and those the random field adds."""
    docs = table(spark, sf_dir)
    return secrets.find(docs, secrets.fit(docs))


def op4_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out."""
    docs = table(spark, sf_dir)
    model = language.fit(docs.select("doc_id", "text", "lang"), ~held_out(4, 2))
    return language.predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op5_simhash_bk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 64-bit fingerprints of three-word shingles link at three bits or fewer."""
    return bk_dedup.near_groups(table(spark, sf_dir), words=3, bits=64, radius=3)


def op10_quality_fourier_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(4, 2)))
    return (quality.score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")))


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out(5, 0)))
    return (toxicity.score(docs, model)
            .select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def op7_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.place(table(spark, sf_dir)).select("doc_id", "slot", "shard")


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how many others lie within three bits."""
    return fingerprint.fingerprint_documents(table(spark, sf_dir))


def op9_benchmark_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the best window for each item."""
    return decontaminate.matches(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 256 to 4,096 words."""
    return packing.pack_documents(table(spark, sf_dir))


def op11_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document, and how common its pairs are in all."""
    return align.align_documents(table(spark, sf_dir))


def op12_rotation_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle order, and the digest of the text rebuilt from it."""
    made = fim.restore(fim.transform(table(spark, sf_dir).select("doc_id", "text")))
    return made.select("doc_id", F.col("fim_tokens").alias("n"), F.col("fim_form").alias("form"), "prefix_chars", "middle_chars",
                       F.sha2("fim_output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_run_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest id of its text, the size of its group and whether it stays."""
    return exact_dedup.groups(table(spark, sf_dir), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_substring_dedup, op3_secret_field, op4_ftrl_language, op5_simhash_bk_dedup,
    op6_counterfactual_toxicity, op7_maglev_sharding,
    op8_weighted_fingerprints, op9_benchmark_simhash_windows, op10_quality_fourier_ridge,
    op11_merge_path_alignment, op12_rotation_fim, op13_run_merge_dedup,
)}
# The others rest on trained models or on hashes that the SQL engine lacks; tests compare them with brute force.
ORACLES: dict[str, str] = {"op2_substring_dedup": substring_dedup.ORACLE, "op7_maglev_sharding": sharding.ORACLE,
                           "op12_rotation_fim": fim.ORACLE, "op13_run_merge_dedup": exact_dedup.ORACLE}
