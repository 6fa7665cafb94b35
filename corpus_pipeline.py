"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, language_id, ngram_join, packing, repeats
from quire.llm.common import shared_dir, stored, table
from quire.llm.queries import HELD_OUT


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text is in some known language; null texts and texts without a letter go."""
    model = language_id.train(docs.where(f"not ({HELD_OUT})"))
    return language_id.identify(docs, model).where("lang_pred <> 'und'").select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near duplicates."""
    return ngram_join.deduplicate(docs)


#: Bytes of a repeated string that goes. A passage of 51 words has 300 bytes as a rule, hardly ever less than this.
REPEATED = 200


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of ``REPEATED`` bytes that occur more than once out of all texts; n_chars follows."""
    left = repeats.remove_repeats(docs, length=REPEATED).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 2048 tokens."""
    import public_tokenizers

    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(stored(pieces.drop("token_ids"), "pieces"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("suffix-array dedup", remove_repeated_strings),
    ("benchmark decontamination", remove_benchmark),
    ("best-fit packing", pack_sequences),
]

#: Tokenization and byte-exact repeats are beyond SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
