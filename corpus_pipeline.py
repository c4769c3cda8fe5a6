"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of ``documents``; the last returns the packed pieces.
Nulls, empty and repeated rows follow the operators: a null or empty text is not
toxic, links with nothing, matches no test item, holds no secret, and is packed
as its end token. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwear.llm import decontamination, jaccard_join, packing, secrets, toxicity
from fleetwear.llm.common import documents, small_batches, table
from fleetwear.session import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="_toxic")
    return scored.where(F.col("_toxic") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    small_batches(spark)
    judged = decontamination.judged(docs, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and the length follows the text."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    changed = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with a checksum in place of the ids."""
    small_batches(spark)
    return packing.digest(packing.pack(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Edit automata, alignment and tokenizers cannot be said in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
