"""A pipeline from documents to token ids: five stages, each on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
documents. run() writes each stage's result as Parquet to the shared folder, reads it as the next one's docs, and
deletes it once that one's result is written.

In every stage a null text is an empty one, a null id is no error, texts are read whole however long, the order and
partitioning of rows don't matter, an empty table gives an empty table, and further columns of any name pass through
(all stages but the last keep them). Each stage says what becomes of such rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, mixing, near_dup, quality, secrets
from corpusloom.llm.shared import forget, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts have no words, so they fail and go; null ids are kept. Repeated rows fare alike."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class. Rows without id stay, uncompared. Rows of equal id are one document, so they stay or go together; equal texts of other ids are copies, empty ones too."""
    return near_dup.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, and n_chars that fit the masked text. A null text stays null, with a null n_chars; no row goes."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens follow the target shares of sources, languages and topics. A null source or language is a category of its own; texts without words are never sampled by a cell without tokens; without an id the hash of the text decides. Rows of equal id and cell fare alike."""
    return mixing.sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, a row for each row. The memo is small, as workers keep it through the other stages. A null or empty text has no ids; a null id is kept."""
    made = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, memo=60_000)
    return made.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_redaction),
    ("source mix", source_mix),
    ("byte-level BPE", token_ids),
]

#: The stages are not SQL: suffix arrays, sampled hashes, structural parsing, raking and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i}")
            forget(*before)
            before = [docs]
    return docs
