"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept.

Stages before the last return the columns of documents; a changed text gets its
own n_chars.  Filters decide row by row beside the text, so nothing is joined back
and repeated or missing ids do no harm.  Models learn from the documents that the
stage is given: language from their lang, toxicity from the labels table.

Cases.  Null or empty texts have no language and go in the first stage.  An empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import langid, packing, pii, simhash, toxicity
from spanforge.llm.common import read, remove, shared_folder

#: The share of the best language below which a document goes.
LEAST_LANGUAGE = 0.3
#: The key of a run is the caller's secret; this one is for tests and measurements.
PII_KEY = "spanforge-test-key"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those in no language clearly, go."""
    return langid.keep(docs, langid.fit(docs), LEAST_LANGUAGE)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    known = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = toxicity.fit(docs.select("doc_id", "text").join(known, "doc_id"))
    return toxicity.keep(docs, model, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays."""
    return simhash.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonymises; n_chars follows the text."""
    out = pii.pseudonymise(docs, PII_KEY, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens; one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("pii", private),
    ("packing", pack),
]

#: No SQL: models, fingerprints and packing are beyond it; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared folder and read again by the next, and removed after that."""
    docs = read(spark, sf_dir, "documents")
    folder, before = shared_folder(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
