"""Evaluation of logged answers; null means that a question cannot be scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import source_key, text_key
from lodestone.operators.manifest import first_by

# Gates of the metrics, and phrases of a refusal.
GATES = {"retrieval_recall_at_8": 0.85, "page_accuracy": 0.70, "citation_validity": 0.95, "answer_correctness": 0.80, "refusal_on_unanswerables": 0.90, "p95_latency_ms": 6000}
REFUSALS = ("not covered", "do not cover", "does not cover", "cannot answer", "can't answer", "nothing in", "no matching", "do not have", "don't have", "not in the")
GUESSED = ("", "none", "index")


def label_is_citable(source: Column, label: Column, range_: Column) -> Column:
    return ~F.lower(F.coalesce(source, F.lit(""))).isin(*GUESSED) & (F.coalesce(F.nullif(range_, F.lit("")), F.nullif(label, F.lit(""))).isNotNull())


def page_numbers(label: Column) -> Column:
    """The pages of "a-b" up to 20 apart, else every number."""
    span = r"^\s*(\d+)\s*-\s*(\d+)\s*$"
    low, high = (F.regexp_extract(label, span, k).try_cast("int") for k in (1, 2))
    numbers = F.transform(F.regexp_extract_all(label, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))
    return F.when(label.rlike(span) & (low <= high) & (high - low <= 20), F.sequence(low, F.greatest(low, high))).otherwise(F.coalesce(numbers, F.array().cast("array<int>")))


def source_matches(expected: Column, candidates: Column) -> Column:
    """Whether one of the candidates holds the expected source or is held by it; empty ones never match."""
    want = source_key(expected)
    keys = F.transform(candidates, lambda c: source_key(F.coalesce(c, F.lit(""))))
    return F.exists(keys, lambda k: (k != "") & (want != "") & (F.contains(k, want) | F.contains(want, k)))


def answer_fits(answer: Column, must: Column, must_not: Column) -> Column:
    low = F.lower(answer)
    none = F.array().cast("array<string>")
    return F.forall(F.coalesce(must, none), lambda t: F.contains(low, F.lower(t))) & ~F.exists(F.coalesce(must_not, none), lambda t: F.contains(low, F.lower(t)))


def is_refusal(answer: Column, numbers: Column, confidence: Column) -> Column:
    low = F.lower(answer)
    said = F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(low, p))
    return (F.size(F.coalesce(numbers, F.array().cast("array<int>"))) == 0) & ((confidence == "low") | said)


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key: feedback, chunk index."""
    return first_by(rows, [key], [-F.col(seq)])


def first_asked(log: DataFrame, last: int | None = None) -> DataFrame:
    """Distinct logged questions in the order of first asking, or the last few of these."""
    out = log.groupBy("query").agg(F.min("seq").alias("seq"))
    return out if last is None else out.orderBy(F.col("seq").desc()).limit(last)


def match_records(questions: DataFrame, log: DataFrame) -> DataFrame:
    """questions ⋈ log by eval_id, else by text; of several records the last.  Two equi-joins, never an OR."""
    keyed = log.withColumn("text_key", text_key(F.col("query")))
    by_id = latest(keyed.where("eval_id IS NOT NULL"), "eval_id", "seq").select(F.col("eval_id").alias("id_"), F.col("query_id").alias("by_id"))
    by_text = latest(keyed, "text_key", "seq").select(F.col("text_key").alias("key_"), F.col("query_id").alias("by_text"))
    q = questions.withColumn("key_", text_key(F.col("question")))
    joined = q.join(by_id, F.col("id") == F.col("id_"), "left").join(by_text, "key_", "left")
    return joined.withColumn("query_id", F.coalesce("by_id", "by_text")).drop("id_", "key_", "by_id", "by_text")


def recall(cases: DataFrame, retrieved: DataFrame, k: int = 8) -> DataFrame:
    """(id, hit): whether one of the first k retrieved rows is of the expected source; null if none is expected or nothing was retrieved."""
    hits = retrieved.where(F.col("position") < k).join(cases.select("id", "query_id", "expected_source"), "query_id")
    hits = hits.groupBy("id").agg(F.max(source_matches(F.col("expected_source"), F.col("candidates"))).alias("hit"))
    return cases.join(hits, "id", "left").select("id", F.when(F.coalesce("expected_source", F.lit("")) != "", F.col("hit")).alias("hit"))


def page_hits(cases: DataFrame, cited: DataFrame) -> DataFrame:
    """(id, hit): an expected page within one page of a citable label; null where no label can be trusted."""
    own = cited.where(label_is_citable(F.col("label_source"), F.col("page_label"), F.col("page_range")))
    pages = own.select("query_id", F.explode_outer(page_numbers(F.coalesce(F.nullif("page_range", F.lit("")), "page_label"))).alias("page"))
    want = cases.select("id", "query_id", F.regexp_extract("expected_page", "[0-9]+", 0).try_cast("int").alias("want"))
    hits = pages.join(want, "query_id").groupBy("id").agg(F.max(F.coalesce(F.abs(F.col("page") - F.col("want")) <= 1, F.lit(False))).alias("hit"), F.max("want").alias("w"))
    return cases.select("id").join(hits.where("w IS NOT NULL").select("id", "hit"), "id", "left")


def citation_validity(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, valid): at least one citation, each within the list and of an existing chunk."""
    rows = records.select("query_id", "chunk_ids", F.explode_outer("citations").alias("n"))
    rows = rows.withColumn("chunk_id", F.when(F.col("n") >= 1, F.get("chunk_ids", F.col("n") - 1)))
    known = chunks.select(F.col("chunk_id").alias("known")).distinct()
    joined = rows.join(known, F.col("chunk_id") == F.col("known"), "left")
    return joined.groupBy("query_id").agg(F.min(F.col("known").isNotNull()).alias("valid"))


def metric(cases: DataFrame, column: str, name: str) -> DataFrame:
    """(metric, value, scored, skipped, gate, ok) of a nullable boolean column."""
    gate = GATES.get(name)
    out = cases.agg(F.count(column).alias("scored"), F.count_if(F.col(column)).alias("hits"), F.count_if(F.col(column).isNull()).alias("skipped"))
    value = F.try_divide(F.col("hits"), F.col("scored"))
    return out.select(F.lit(name).alias("metric"), value.alias("value"), "scored", "skipped", F.lit(gate).cast("double").alias("gate"), (value >= F.lit(gate)).alias("ok"))


def percentile_nearest(rows: DataFrame, column: str, share: float, *keys: str) -> DataFrame:
    """Nearest-rank percentile: sorted by partial aggregation, never gathered as rows."""
    return rows.groupBy(*keys).agg(F.percentile_disc(F.lit(share)).within_group(F.col(column)).alias("value") if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})").alias("value"))


def latency(records: DataFrame) -> DataFrame:
    gate = GATES["p95_latency_ms"]
    return percentile_nearest(records, "latency_ms", 0.95).select(F.lit("p95_latency_ms").alias("metric"), "value", (F.col("value") < gate).alias("ok"))


def inventory(chunks: DataFrame) -> DataFrame:
    """Each document with the first row's metadata, its chunks, and its pages, of which a missing number is one."""
    return chunks.groupBy("doc_id").agg(
        F.min_by(F.struct("title", "product_family"), "seq").alias("m"), F.count("*").alias("chunks"), (F.count_distinct("page_index") + F.max(F.col("page_index").isNull().cast("int"))).alias("pages")
    ).select("doc_id", "m.*", "chunks", "pages")


def ab_totals(compared: DataFrame, k: int = 8) -> DataFrame:
    """Totals of `compare_rankings`; the median lies between the middle two."""
    return compared.agg(
        F.count("*").alias("queries"), F.avg(F.col("overlap") / k).alias("mean_overlap"), F.count_if(F.col("moved") == 0).alias("identical"), F.count_if(F.col("top1_changed")).alias("top1_changed"),
        F.expr("percentile(moved, 0.5)").alias("median_moved"), F.max("moved").alias("max_moved"),
    )
