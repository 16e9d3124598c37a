"""Article manifests: unique files, summaries, compaction, validation, resumption."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_distinct(df: DataFrame, key: str, seq: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each key and column the distinct values in order of first occurrence.

    Values are made distinct by (key, column, value) before they are gathered,
    so a file that a third of all rows refer to gathers only what differs.
    """
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    flat = df.select(key, F.struct(*seq).alias("seq"), F.explode(kinds).alias("x")).select(key, "seq", "x.kind", "x.value").where("value IS NOT NULL")
    first = flat.groupBy(key, "kind", "value").agg(F.min("seq").alias("seq"))
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == c, F.struct("seq", "value")))), lambda x: x["value"]).alias(c) for c in columns]
    return first.groupBy(key).agg(*lists)


def unique_documents(attachments: DataFrame, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """One row for each sha256 with every file name, attachment and article that leads to it, and the bytes that sharing saves."""
    lists = ordered_distinct(attachments, "sha256", seq, ["filename", "attachment_id", "article_id", "category", "folder"])
    sizes = attachments.groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"))
    docs = lists.join(sizes, "sha256")
    references = F.size("article_id")
    return docs.withColumns({
        "reference_count": references, "is_shared": references > 1, "primary_filename": F.coalesce(F.get("filename", F.lit(0)), F.lit("")),
        "wasted_bytes_avoided": (references - 1) * F.coalesce("size_bytes", F.lit(0)),
    })


def summary(attachments: DataFrame) -> DataFrame:
    """Counts over all attachments; bytes once for each sha256."""
    per = attachments.groupBy("sha256").agg(F.count("*").alias("n"), F.max("size_bytes").alias("b"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("attachments"),
        F.count_if(F.col("sha256").isNotNull()).alias("unique_files"),
        F.coalesce(F.sum(F.when(F.col("sha256").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(F.col("sha256").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("sha256").isNotNull(), F.col("b"))), F.lit(0)).alias("stored_bytes"),
    ).withColumn("duplication_rate", F.coalesce(F.try_divide(F.col("duplicates"), F.col("attachments")), F.lit(0.0)))


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: compaction of a log, latest feedback, arg-max.  A grouped minimum, combined before the shuffle."""
    values = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    ranked = rows.select(*keys, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), values.alias("v"))
    return ranked.groupBy(*keys).agg(F.min_by("v", "o").alias("v")).select(*keys, "v.*").select(*rows.columns)


def owners(attachments: DataFrame, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Each attachment with `is_duplicate_of`: the first attachment of the same content, null for that one itself."""
    first = attachments.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min_by("attachment_id", F.struct(*seq)).alias("owner"), F.min(F.struct(*seq)).alias("at"))
    joined = attachments.join(first, "sha256", "left")
    return joined.withColumn("is_duplicate_of", F.when(F.struct(*seq) != F.col("at"), F.col("owner"))).drop("owner", "at")


def resume(pending: DataFrame, done: DataFrame, key: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """What is not done yet; a limit counts only new rows."""
    left = pending.join(done.select(key).distinct(), key, "left_anti")
    return left if limit is None else left.orderBy(*order).limit(limit)


def validate(articles: DataFrame, required: Sequence[str], key: str, seq: str) -> DataFrame:
    """(key, problem) for empty required fields, and for each occurrence of a key after its first."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing {c}")) for c in required]), lambda x: x.isNotNull())
    first = articles.groupBy(key).agg(F.min(seq).alias("first_seq"))
    problems = articles.join(first, key).select(key, F.concat(missing, F.filter(F.array(F.when(F.col(seq) > F.col("first_seq"), F.lit(f"duplicate {key}"))), lambda x: x.isNotNull())).alias("p"))
    return problems.select(key, F.explode("p").alias("problem"))


def content_dupes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """hash, n, first id of every text that occurs more than once."""
    return docs.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")


def file_problems(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """Attachments whose stored file is missing or of another size; files: (stored_path, length)."""
    joined = attachments.where("stored_path IS NOT NULL").join(files, "stored_path", "left")
    problem = F.when(F.col("length").isNull(), "missing file").when(F.col("length") != F.col("size_bytes"), "size differs")
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("attachment_id", "stored_path", "problem")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
