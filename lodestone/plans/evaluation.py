"""The evaluation report: a row for each question, then a row for each metric."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluate as E


def cases(questions: DataFrame, log: DataFrame, chunks: DataFrame) -> DataFrame:
    """id with the nullable outcomes recall_hit, page_hit, citation_ok, answer_ok, refusal_ok and latency_ms."""
    matched = E.match_records(questions, log).join(log.select("query_id", "answer", "citations", "confidence", "latency_ms", "chunk_ids"), "query_id", "left")
    rows = matched.select("query_id", F.posexplode("chunk_ids").alias("position", "chunk_id")).join(chunks, "chunk_id")
    retrieved = rows.select("query_id", "position", F.array("title", "source_url", "article_url", "doc_id").alias("candidates"))
    cited = matched.select("query_id", "chunk_ids", F.explode("citations").alias("n")).where("n >= 1").select("query_id", F.get("chunk_ids", F.col("n") - 1).alias("chunk_id")).join(chunks, "chunk_id")
    recall = E.recall(matched, retrieved).withColumnRenamed("hit", "recall_hit")
    pages = E.page_hits(matched, cited).withColumnRenamed("hit", "page_hit")
    valid = E.citation_validity(matched.where("answer IS NOT NULL").select("query_id", "chunk_ids", "citations"), chunks)
    out = matched.join(recall, "id", "left").join(pages, "id", "left").join(valid, "query_id", "left")
    refusable = F.col("category") == "unanswerable"
    return out.withColumns({
        "citation_ok": F.when(~refusable, F.col("valid")),
        "answer_ok": F.when(~refusable & F.col("answer").isNotNull(), E.answer_fits(F.col("answer"), F.col("must_mention"), F.col("must_not_say"))),
        "refusal_ok": F.when(refusable & F.col("answer").isNotNull(), E.is_refusal(F.col("answer"), F.col("citations"), F.col("confidence"))),
    }).select("id", "recall_hit", "page_hit", "citation_ok", "answer_ok", "refusal_ok", "latency_ms")


def report(scored: DataFrame) -> DataFrame:
    names = {"recall_hit": "retrieval_recall_at_8", "page_hit": "page_accuracy", "citation_ok": "citation_validity", "answer_ok": "answer_correctness", "refusal_ok": "refusal_on_unanswerables"}
    out = None
    for column, name in names.items():
        own = E.metric(scored, column, name).select("metric", "value", "ok")
        out = own if out is None else out.union(own)
    return out.union(E.latency(scored.where("latency_ms IS NOT NULL")).select("metric", F.col("value").cast("double"), "ok"))


def as_html(metrics: DataFrame) -> str:
    """A page with one row for each metric, of which there are a handful."""
    rows = "".join(f"<tr><td>{html.escape(r.metric)}</td><td>{'' if r.value is None else round(r.value, 4)}</td><td>{'' if r.ok is None else 'ok' if r.ok else 'fails'}</td></tr>" for r in metrics.orderBy("metric").collect())
    return f"<!DOCTYPE html><title>Evaluation</title><table><tr><th>metric</th><th>value</th><th>gate</th></tr>{rows}</table>"
