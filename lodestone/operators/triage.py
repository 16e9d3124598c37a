"""Which documents need what: pages by tier, and how far printed labels are off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import page_tier
from lodestone.operators.classify import label_offsets

TIERS = ("plain_text", "diagram_heavy", "scanned")


def documents(pages: DataFrame) -> DataFrame:
    """One row for each document of pages (doc_id, page_index, label, chars, images)."""
    tier = page_tier(F.col("chars"), F.col("images"))
    per = pages.withColumn("tier", tier).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce("label", F.lit("")) != "").alias("labelled"), *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS])
    return per.join(label_offsets(pages).select("doc_id", F.col("offset").alias("label_offset")), "doc_id", "left")


def summary(triaged: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: documents, failed ones, pages, their shares by tier, and documents by label offset (offset=count, in order)."""
    per = triaged.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "labelled", *TIERS)])
    counts = triaged.where("label_offset IS NOT NULL").groupBy("label_offset").count()  # as many rows as there are offsets
    listed = counts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("label_offset", "count"))), lambda x: F.concat_ws("=", x["label_offset"].cast("string"), x["count"].cast("string"))), ",").alias("offsets"))
    lost = failed.agg(F.count("*").alias("failed"))
    one = per.withColumn("j", F.lit(1)).join(listed.withColumn("j", F.lit(1)), "j").join(lost.withColumn("j", F.lit(1)), "j").drop("j")
    return one.withColumns({f"pct_{t}": F.coalesce(F.try_divide(F.col(t), F.col("pages")), F.lit(0.0)) for t in TIERS})


def report(row) -> str:
    """The summary as Markdown; warns where more than half of the pages need more than their text."""
    if not row["documents"] and not row["failed"]:
        raise ValueError("no documents to triage")
    lines = ["# Triage", "", f"{row['documents']} documents, {row['failed']} failed, {row['pages']} pages, {row['labelled']} with a label.", "", "| Tier | Pages | Share |", "|-|-|-|"]
    lines += [f"| {t} | {row[t]} | {row[f'pct_{t}']:.1%} |" for t in TIERS]
    if row["pct_diagram_heavy"] + row["pct_scanned"] > 0.5:
        lines += ["", "Warning: most pages need more than their text."]
    return "\n".join([*lines, "", f"Label offsets: {row['offsets'] or 'none'}"])
