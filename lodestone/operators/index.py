"""Index upkeep: difference of corpus and index, upsert, delete, postings, embedding with a cache.

Plain Parquet tables have no MERGE; a new version is written beside the old
one, and a pointer moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[^\p{L}\p{N}]+"
BATCH_TEXTS, BATCH_TOKENS = 256, 250_000
ANN_ROWS = 5000


def plan(corpus: DataFrame, index: DataFrame, key: str = "chunk_id", value: str = "content_hash") -> DataFrame:
    """(key, action): new, changed, unchanged or removed."""
    old = index.select(F.col(key).alias("k_old"), F.col(value).alias("v_old"))
    both = corpus.select(F.col(key).alias("k_new"), F.col(value).alias("v_new")).join(old, F.col("k_new") == F.col("k_old"), "full_outer")
    action = F.when(F.col("k_old").isNull(), "new").when(F.col("k_new").isNull(), "removed").when(F.col("v_new").eqNullSafe(F.col("v_old")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("k_new", "k_old").alias(key), action.alias("action"))


def plan_summary(actions: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ("new", "changed", "unchanged", "removed")]
    return actions.agg(*counts).withColumn("to_embed", F.col("new") + F.col("changed"))


def upsert(index: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(index: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(keys.select(key), key, "left_anti")


def publish(df: DataFrame, root: str, version: str) -> str:
    """Writes a version of the index and then moves the pointer to it; readers see the old one or the new one."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    df.sparkSession.createDataFrame([(version, path)], "version string, path string").coalesce(1).write.mode("overwrite").json(f"{root}/current")
    return path


def current(spark, root: str) -> DataFrame:
    pointer = spark.read.schema("version string, path string").json(f"{root}/current").first()
    return spark.read.parquet(pointer.path)


# -- full text


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN), lambda t: t != "")


def postings(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, key, tf, doc_len): counted by (key, term) with partial sums before the shuffle."""
    words = docs.select(key, terms(F.col(text)).alias("w"))
    flat = words.select(key, F.size("w").alias("doc_len"), F.explode("w").alias("term"))
    return flat.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def lengths(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, doc_len) of the documents that have postings, without these."""
    return docs.select(key, F.size(terms(F.col(text))).alias("doc_len")).where("doc_len > 0")


def bags(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, terms) of whole documents, terms in order with repeats: what postings count."""
    return docs.select(key, terms(F.col(text)).alias("terms"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


# -- embedding


def missing_keys(chunks: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """One row for each key that the cache lacks."""
    return chunks.join(cache.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def hit_rate(chunks: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    found = chunks.select(key).join(cache.select(F.col(key).alias("c")).distinct(), F.col(key) == F.col("c"), "left")
    return found.agg(F.count("*").alias("lookups"), F.count("c").alias("hits")).withColumn("hit_rate", F.coalesce(F.try_divide("hits", "lookups"), F.lit(0.0)))


def batches_of(sizes: Iterable[int], texts: int = BATCH_TEXTS, tokens: int = BATCH_TOKENS) -> list[list[int]]:
    """Positions in order, in batches of at most so many texts and tokens; a text over the budget is alone."""
    out: list[list[int]] = []
    weight = 0
    for at, own in enumerate(sizes):
        if not out or len(out[-1]) >= texts or weight + own > tokens:
            out.append([])
            weight = 0
        out[-1].append(at)
        weight += own
    return out


def batch_numbers(sizes: Column, texts: int = BATCH_TEXTS, tokens: int = BATCH_TOKENS) -> Column:
    """The batch of each text, in order, as a fold in generated functions."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("w"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= texts) | (a["w"] + x > tokens))
        batch = F.when(full, a["batch"] + 1).otherwise(a["batch"])
        return F.struct(
            F.concat(a["out"], F.array(batch)).alias("out"), batch.alias("batch"), F.when(full, F.lit(1)).otherwise(a["n"] + 1).alias("n"), F.when(full, x.cast("long")).otherwise(a["w"] + x).alias("w")
        )

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def embed(chunks: DataFrame, cache: DataFrame, embedder: Callable[[list[str]], list[list[float]]], key: str = "content_hash", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """`chunks` with an `embedding`, and the new cache rows.  `embedder` maps texts to vectors and is called on executors, a batch at a time, once for each distinct key."""
    misses = missing_keys(chunks, cache, key).select(key, text)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            vectors: list = [None] * len(texts)
            for own in batches_of([len(t or "") for t in texts], BATCH_TEXTS, BATCH_TOKENS * 4):
                for at, v in zip(own, embedder([texts[i] or "" for i in own]), strict=True):
                    vectors[at] = v
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    fresh = misses.mapInArrow(run, f"{key} string, embedding array<float>")
    known = cache.select(key, "embedding").unionByName(fresh)
    return chunks.join(known, key), fresh


def hash_embedder(dim: int = 16) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model, for tests and dry runs."""
    import hashlib
    import math

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = [b - 127.5 for b in hashlib.shake_128(t.encode()).digest(dim)]
            norm = math.sqrt(sum(x * x for x in raw))
            out.append([x / norm for x in raw])
        return out

    return run


def verify(index: DataFrame, dim: int, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """rows, widths found, rows of a wrong width, rows without an id: over the whole index."""
    width = F.size(vector)
    return index.agg(
        F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(width.cast("string"))), ",").alias("widths"), F.count_if(F.coalesce(width != dim, F.lit(True))).alias("wrong_width"), F.count_if(F.col(key).isNull()).alias("without_id")
    )
