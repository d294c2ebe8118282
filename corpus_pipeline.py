"""The corpus pipeline: documents without toxic ones and near copies, without passages that an earlier
document has and without personal data, packed into sequences of tokens.

``STAGES`` lists (name, function) pairs. Each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read back as the next one's documents; each works on
all that its predecessor kept. All but the last return the columns of documents, with ``n_chars``
the length of the text as it is then, if documents have that column.

Rows whose text is null count as empty texts and stay; repeated rows stay as often as they are, but
near copies under different ids do not; rows without a doc_id stay and are compared with nothing.
An empty table gives empty results. Other columns go through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import near_dups, packing, private_data, repeats, toxicity
from auditlake.llm.common import stage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` brought up to date after a stage that changed texts."""
    if "n_chars" not in docs.columns or "text" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(spark, docs, sf_dir)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.keep_one_of_each(spark, docs, sf_dir)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(repeats.drop_repeats(spark, docs, sf_dir))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(private_data.mask_private(spark, docs, sf_dir))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1, 4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("repeated_passages", drop_repeated_passages),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

# The stages score, hash and rewrite texts, which SQL cannot state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
