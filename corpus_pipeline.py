"""A corpus through five operators: toxicity, exact and near dedup, PII, packing.

``run`` applies the stages to ``documents``; each stage takes what the one
before kept.  The last returns the pieces of packed sequences.

Null texts count as empty, and stay while their stages keep them: of all empty
texts one document is left.  Rows with a null id are judged like any other; as
copies they give way to rows with an id.  Repeated rows are copies.  Very long
texts go through whole.  Columns beside those of ``documents`` stay until the
last stage, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.llm import exact_dedup, packing, pii, simhash_near, toxicity
from meshlens.llm.common import materialize, release, table
from meshlens.llm.queries import PII_KEY, TOXIC_FROM, tokenizer, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model is fitted on the labelled ones."""
    return toxicity.drop_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.dedup_exact(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 of five-word shingles the document with the smallest id."""
    return simhash_near.dedup_similar(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private values become pseudonyms; n_chars follows the text."""
    before = docs.withColumn("_before", F.length("text"))
    after = pii.pseudonymize(before, PII_KEY)
    return after.withColumn("n_chars", (F.col("n_chars") + F.length("text") - F.col("_before")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", replace_private),
    ("best_fit_packing", pack),
]

#: Toxicity, near dedup and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
