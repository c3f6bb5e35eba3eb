"""The corpus pipeline: STAGES over documents, each written as Parquet and read again by the next.

Toxicity filter, SimHash near-dedup, substring dedup, mixing to target weights, BPE encoding. Each stage works on all rows
that its predecessor kept; all but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table (an empty one comes back) and further
columns of any name, which pass as they are; doc_id is a whole number or null. What each does with them is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm import bpe, mixing, simhash, substring, toxicity
from fathomgrid.llm.common import load, materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents scored 0.5 or more go. Null and empty texts have the score of texts without terms; repeated rows go or stay together."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each SimHash group the document with the smallest doc_id stays, with all its rows; rows without a doc_id stay. Null and empty texts are one group."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: repeated passages leave all documents but the first; n_chars follows. Documents stay, even if nothing is left of them.

    A null text stays null. Rows of one doc_id keep what they share; rows without one come last.
    """
    own = {c: f"_fathomgrid_{k}" for k, c in enumerate(docs.columns) if c.startswith("_")}  # the operator's own columns begin so
    out = substring.remove_repeats(docs.withColumnsRenamed(own))
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(own.get(c, c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the mix itself, a row for each repetition. A null source is a source of its own; texts without words may be in or not."""
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: doc_id, source, n_tokens and digests of each row of the mix. A null text is empty."""
    import public_tokenizers

    out = bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), keep=False)
    return out.select("doc_id", "source", *(F.col(f"_{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]
#: The toxicity, SimHash and BPE stages are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
