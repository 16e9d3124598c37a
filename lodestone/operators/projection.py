"""Rows as they are stored and shown: hits, trimmed results, headers of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.lexicon import UNKNOWN

SHOWN = 160


def _filled(name: str, default: str = "") -> Column:
    return F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(default))


def _place() -> Column:
    return F.coalesce(F.when(F.col("page_range") != "", F.col("page_range")), F.col("page_label"))


def hits(rows: DataFrame, image_url: str = "/page/{doc}/{page}") -> DataFrame:
    """Ranked chunks as they are given out; a rerank score of 0 counts, and only a page that has an index has an address."""
    before, between, after = image_url.replace("{page}", "{doc}").split("{doc}")
    url = F.concat(F.lit(before), F.col("doc_id"), F.lit(between), F.col("page_index").cast("string"), F.lit(after))
    return rows.select(
        _filled("chunk_id").alias("chunk_id"), _filled("doc_id").alias("doc_id"), _filled("title").alias("title"), _place().alias("page_label"), url.alias("page_url"),
        _filled("product_family", UNKNOWN).alias("product_family"), _filled("kind", "prose").alias("kind"), F.coalesce("rerank_score", "boosted_score", F.lit(0.0)).cast("double").alias("score"),
        F.coalesce("boosts", F.array().cast("array<string>")).alias("boosts"), _filled("text").alias("text"),
    )


def trimmed(rows: DataFrame) -> DataFrame:
    """What a person checks of a result: four decimals, the first characters of the text."""
    text = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.substring("text", 1, SHOWN), F.lit("..."))).otherwise("")
    return rows.select(F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), F.coalesce("title", F.lit("")).alias("title"), "page_label", "product_family", "kind", text.alias("text"))


def passage_header(number: Column) -> Column:
    """The line above a passage for a reranking model: number, title, and what the boosts know."""
    place = _place()
    facets = F.concat_ws(", ", _filled("product_family", UNKNOWN), F.when(place != "", F.concat(F.lit("p."), place)), F.when(F.col("content_stream") == "diagnostic_article", "DIAGNOSTIC ARTICLE"))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.substring(F.coalesce("title", F.lit("")), 1, 80), F.lit(" ("), facets, F.lit(")"))


def index_rows(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with their vectors and `is_table` as a column."""
    return chunks.withColumn("is_table", F.col("kind") == "table").join(vectors.select("content_hash", "embedding"), "content_hash")


def has_content(text: Column, tables: Column) -> Column:
    return (F.trim(F.coalesce(text, F.lit(""))) != "") | (F.coalesce(F.size(tables), F.lit(0)) > 0)


def lookup(index: DataFrame, chunk_id: str) -> DataFrame:
    """The row of one chunk, without its vector; the condition reaches the scan."""
    return index.where(F.col("chunk_id") == chunk_id).drop("embedding").limit(1)
