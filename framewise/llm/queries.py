"""The registered queries of the training-data operators: thin adapters from the operators to digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import ctw, langid, minhash, packing, pii, repeats, toxicity, vectors, warc
from framewise.llm.common import crc_bucket
from framewise.llm.decontaminate import benchmark_hits

#: The key of the registered PII query; a deployment passes its own.
PII_KEY = b"framewise-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(modulus: int, rest: int):
    return F.coalesce(crc_bucket("doc_id", modulus) == rest, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parser = langid.fit(docs.where(~_held_out(5, 0)))
    out = langid.identify(spark, docs, parser, ["doc_id"])
    return out.select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score", "bits_per_char")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~_held_out(3, 1)))
    out = toxicity.score(spark, docs, model, ["doc_id"])
    return out.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, ["doc_id"])
    return out.select("doc_id", "text", "n_pii", *[f"n_{k}" for k in pii.KINDS])


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    directory, archives, index = warc.archive(spark, pages)
    return warc.find(directory, archives, index, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ctw.score(spark, docs, docs.where(~ctw.held_out()), ["doc_id"])
    return out.select("doc_id", ctw.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_decontamination, op4_pii, op5_repeated_passages, op6_minhash, op7_warc, op8_embeddings, op9_context_tree, op10_packing)}
