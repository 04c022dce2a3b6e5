"""A training-data pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns documents of the same columns; the last returns token ids. run() writes each
stage's result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headmint.llm.common import shared_dir, stored, table
from headmint.llm.decontaminate import decontaminate
from headmint.llm.jaccard_join import one_of_each
from headmint.llm.pieces import encode
from headmint.llm.quality_cnn import score, train_from
from headmint.llm.queries import MODEL, source
from headmint.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality network scores 0.7 or more.

    Null and empty texts are scored as empty. Repeated rows score alike, so all stay or go; a
    null id is scored like any other. Without labels every score is 0.5 and all go. Extra
    columns, whatever their names, are kept.
    """
    network = train_from(docs, table(spark, sf_dir, "labels"))
    return docs.filter(score(network, F.col("text")) >= 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group of linked documents.

    Null and empty texts link with nothing and stay. Of repeated rows (equal id and text) one
    stays; rows with a null id all stay, and don't make others go. Extra columns are kept.
    """
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a test item.

    Null and empty texts hold none and stay, as all do where no item has words. Repeated rows
    are judged alike; a null id is judged like any other. Extra columns are kept.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars, where there is such a column, follows.

    A null text stays null and its n_chars becomes null; empty texts stay empty. All rows stay,
    repeated ones and null ids too. Overlapping secrets are replaced as one. Other columns
    are kept.
    """
    out = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document.

    Null and empty texts have no ids and 0 tokens. All rows stay, repeated ones and null ids
    too. Other columns are left out.
    """
    return encode(docs.select("doc_id", "text"), MODEL).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens)]

#: The first stage is a network: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
