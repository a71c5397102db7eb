"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark decontamination, PII and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet in the shared folder and read
again as the next one's documents. Rows that a stage rejects are gone for the later ones; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm import minhash, packing, pii, toxicity
from framewise.llm.common import materialise
from framewise.llm.decontaminate import benchmark_hits
from framewise.llm.queries import PII_KEY, table

#: Percent of shared word shingles from which two documents are near-duplicates for the pipeline; op6 has its own.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of all given documents and drops those that score 0.7 or more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(spark, docs, model, [*docs.columns]).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicates (a similarity of 0.8 or more): that with the smallest id, a
    null id last. Null, empty and wordless texts all stay, as do different texts under one id."""
    return minhash.one_of_each(docs, percent=SIMILAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return benchmark_hits(docs, table(spark, sf_dir, "benchmark"), [*docs.columns]).where(~F.col("contaminated")).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by format-preserving pseudonyms; no row goes."""
    return pii.pseudonymise(docs, PII_KEY, [c for c in docs.columns if c != "text"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the length bucket and batch of every document."""
    return packing.pack(docs, [*docs.columns])


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", hide_personal_data), ("packing", pack)]

#: Toxicity and pseudonyms are beyond SQL; the tests compare run() with a brute-force version of its decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
