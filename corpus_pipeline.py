"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.llm import bk_dedup, decontaminate, packing, quality, secrets
from fraudlake.llm.common import free_name, id_key, ready, table
from fraudlake.session import ensure_checkpoint_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.7 or more, learnt from the labels of the documents of this stage; all of them if there is nothing to learn from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.learnt:
        return docs
    name = free_name(docs, "_quality")
    return quality.score(docs, model, name).where(F.col(name) >= 0.7).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: sets of five-word shingles of similarity 0.8 or more.

    Candidates lie within 72 of 256 bits. At similarity 0.8 two texts differ in 38.8 bits on average (deviation 5.7);
    five shingles against four of them, the widest case, in 48 (6.2).
    """
    ready(spark)
    return bk_dedup.keep_one(docs, words=5, bits=256, radius=72, n_keys=6, least=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mask."""
    ready(spark)
    return secrets.redact(docs, secrets.fit(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of training sequences: placement and words of every piece (empty texts have one piece in no bin)."""
    ready(spark)
    return attach(packing.pack_documents(docs, keyed=True), packing.piece_texts(docs))


def attach(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """``placed`` with the words of each piece; ids may be null."""
    return placed.withColumn("id", id_key()).join(texts, ["id", "text_key", "piece"]).select(*[c for c in placed.columns if c != "text_key"], "text")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]
# Hash families and trained models have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's table goes to the shared folder."""
    docs = table(spark, sf_dir)
    base = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
