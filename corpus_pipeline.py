"""From raw documents to piece ids: filter, deduplicate, mix and encode.

Every stage is a function of ``(spark, docs, sf_dir)``. It works on all rows its predecessor
kept, is trained on them where it needs training, and all but the last return the columns of
``documents``. Nulls, empty tables, repeated rows and extra columns are handled as the operators
say; extra columns pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm.codec import encode_decode
from panelspark.llm.language import keep_known
from panelspark.llm.mixing import mix
from panelspark.llm.quality import keep_good
from panelspark.llm.simhash import keep_one
from panelspark.session import configure, scratch_folder

MODEL = "piece_bpe_32k.model"


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality scorer rejects; texts without words are rejected."""
    return keep_good(docs)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those no learned language claims with at least half of the belief."""
    return keep_known(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of near-duplicate fingerprints."""
    return keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw as many tokens as there are, sources nearer to each other; a row comes as often as drawn."""
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every drawn text, with the digests of ids and decoded text."""
    return encode_decode(docs, public_tokenizers.path(MODEL), keep_text=False)


STAGES = [
    ("quality classifier", good_text),
    ("language id", known_language),
    ("simhash near-dedup", one_per_group),
    ("temperature mixing", mixed),
    ("sentencepiece encoding", encoded),
]

# trained stages and piece ids are beyond SQL; the tests compare the rows with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_folder(spark, f"stage-{i + 1}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
