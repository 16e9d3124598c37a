"""Binary files: content addressing, type detection, PDF pages through an injected parser, embedding cache."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import detect_suffix, is_pdf, looks_like_html


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, sha256, suffix, is_html, is_pdf, content of files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    content = F.col("content")
    return raw.select("path", "length", F.sha2(content, 256).alias("sha256"), F.coalesce(detect_suffix(content), F.lit(".bin")).alias("suffix"), looks_like_html(content).alias("is_html"), is_pdf(content).alias("is_pdf"), "content")


def blob_path(sha256: Column, suffix: Column) -> Column:
    return F.concat(F.lit("blobs/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, suffix)


def html_cache_path(url: Column) -> Column:
    return F.concat(F.lit("html/"), F.sha1(url), F.lit(".html"))


def page_image_url(doc_id: Column, page_index: Column, base: str = "/pages") -> Column:
    return F.when(page_index.isNotNull(), F.concat(F.lit(base + "/"), F.url_encode(doc_id), F.lit("/"), page_index.cast("string"), F.lit(".png")))


def unique_blobs(files: DataFrame) -> DataFrame:
    """One path for each content, and how many bytes were fetched, stored and saved."""
    return files.groupBy("sha256").agg(F.min("path").alias("path"), F.count("*").alias("copies"), F.max("length").alias("length")).withColumn("saved", F.greatest(F.lit(0), (F.col("copies") - 1) * F.col("length")))


PAGE = "doc_id string, page_index int, text string, images int, label string"


def parse_pages(files: DataFrame, parser: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Pages of PDF files.  `parser` maps bytes to dicts (page_index, text, images, label) and is called on executors, one file at a time; a file it fails on has no pages."""
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = []
            for sha, content in zip(pdf["sha256"], pdf["content"], strict=True):
                try:
                    rows += [(sha, p["page_index"], p.get("text", ""), p.get("images", 0), p.get("label")) for p in parser(content)]
                except Exception:  # noqa: BLE001  a broken file is no reason to stop the others
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "text", "images", "label"])

    return files.where("is_pdf").select("sha256", "content").mapInPandas(run, PAGE)


CACHE = "key string, embedding array<float>"


def namespace(model: str, dim: int) -> str:
    return f"{model.replace('/', '_')}-{dim}"


def read_cache(spark: SparkSession, root: str, model: str, dim: int) -> DataFrame:
    """Cached vectors of one model; shards that cannot be read count as empty."""
    from lodestone.sources.jsonl import exists

    path = f"{root}/{namespace(model, dim)}"
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(f"{CACHE}, shard string").option("ignoreCorruptFiles", True).parquet(path).drop("shard").dropDuplicates(["key"])


def write_cache(rows: DataFrame, root: str, model: str, dim: int) -> None:
    """Appends vectors by the first two characters of their keys; the commit makes them visible together."""
    shard = F.when(F.length("key") >= 2, F.substring("key", 1, 2)).otherwise(F.raise_error(F.lit("key too short")))
    rows.select("key", "embedding").withColumn("shard", shard).write.mode("append").partitionBy("shard").parquet(f"{root}/{namespace(model, dim)}")
