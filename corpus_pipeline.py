"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, minhash, mixing, quality_rules, substring
from lodestone.llm.common import discard, table, tidy

#: Words of a shingle, and percent of similarity, from which documents are near copies.
SHINGLE, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts, and all of fewer than ten words, go.  Texts of any
    length count whole.  Equal texts get one verdict, so repeated rows stay or
    go together.  No documents give none; any further columns stay as they are.
    """
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Null, empty and wordless texts, and rows of null doc_id, are like nothing
    and stay.  Rows that repeat the doc_id that stays all stay.  No documents
    give none; any further columns stay as they are.
    """
    return minhash.keep(docs, SHINGLE, SIMILARITY)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur earlier; n_chars follows the text.

    Earlier is a smaller doc_id, null first, or the same document further up.
    A document of which nothing is left goes; null and short texts stay.  Rows
    that repeat a doc_id do not count as earlier to each other.  No documents
    give none; any further columns stay as they are.
    """
    cut = substring.strip(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source.  Documents without words weigh nothing and are
    taken like others of their source.  Of rows that are equal in all columns
    it does not matter which one is taken.  Reruns agree.  No documents give
    none; any further columns stay as they are.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, and whether they decode to it.

    A null text is the empty one, without ids.  Repeated rows give repeated
    results.  No documents give none; further columns are left out.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", F.col("text").cast("string").alias("text")), path, checked="round_trip")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality", quality), ("near_copies", near_copies), ("passages", passages), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the estimation of rules, the tree join, or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written, and what a stage wrote on the way, and its input, are deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, tidy(stage)(spark, docs, sf_dir)
        discard(before)
    return docs
