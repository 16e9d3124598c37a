"""The batch build: articles and pages to chunks, codes, and an index of which only what changed is embedded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import article_markdown, content_stream
from lodestone.lexicon import Lexicon
from lodestone.operators import chunking, classify, codes, index


def article_pages(manifest: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One page for each article that says something itself."""
    n = F.size(F.coalesce("attachments", F.array()))
    own = manifest.withColumn("content_stream", content_stream(F.coalesce("body_text", F.lit("")), n)).where((F.col("content_stream") != "pdf") & (F.trim("body_text") != ""))
    return own.select(
        F.concat(F.lit("article:"), "article_id").alias("doc_id"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("string").alias("page_label"), "category", "folder", "title",
        article_markdown(F.col("title"), F.col("body_text")).alias("text"), classify.document_family(F.col("category"), F.col("folder"), F.col("title"), lexicon).alias("product_family"),
        classify.doc_type(F.col("folder"), F.col("title"), lexicon).alias("doc_type"), classify.model_series(F.col("title"), lexicon).alias("model_series"), "content_stream",
    )


def chunks_with_codes(pages: DataFrame, lexicon: Lexicon, tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with their codes, and the table of codes."""
    chunks = codes.annotate(chunking.chunk_pages(pages, tables), lexicon)
    facets = pages.select("doc_id", F.col("page_index").alias("p"), "product_family", "doc_type", "model_series", "title", "content_stream")
    chunks = chunks.join(facets.withColumnRenamed("doc_id", "d"), (F.col("doc_id") == F.col("d")) & F.col("page_index").eqNullSafe(F.col("p"))).drop("d", "p")
    hits = codes.code_hits(chunks.select("chunk_id", "doc_id", "product_family", "title", "page_label", "text"), lexicon)
    return chunks, codes.code_table(hits)


def update_index(spark: SparkSession, chunks: DataFrame, root: str, version: str, cache: DataFrame, embedder: Callable) -> DataFrame:
    """Writes the next version of the index and returns the counts of what was done; without changes nothing is written."""
    from lodestone.sources.jsonl import exists

    old = index.current(spark, root) if exists(spark, f"{root}/current") else None
    if old is None:
        actions = chunks.select("chunk_id", F.lit("new").alias("action"))
    else:
        actions = index.plan(chunks, old)
    actions = actions.persist()
    counts = index.plan_summary(actions)
    moved = counts.first()
    if moved["to_embed"] or moved["removed"]:
        wanted = chunks.join(actions.where("action IN ('new', 'changed')").select("chunk_id"), "chunk_id", "left_semi")
        rows, _ = index.embed(wanted, cache, embedder)
        if old is not None:
            rows = index.delete(index.upsert(old, rows.select(old.columns)), actions.where("action = 'removed'"))
        index.publish(rows, root, version)
    return counts
