"""Answers: citations, clean text, confidence, context of a prompt."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
SNIPPET, PASSAGE = 300, 8000

# Characters and their plain forms.
PLAIN = {
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", " ": " ", " ": " ", "‘": "'", "’": "'", "‚": "'",
    "“": '"', "”": '"', "„": '"', "•": "-", "·": "|", "→": "->", "×": "x",
}


def cited_numbers(answer: Column) -> Column:
    """Distinct numbers of markers like [1] or [1, 2], in order of appearance."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).cast("int")))))


def strip_citations(answer: Column) -> Column:
    out = F.regexp_replace(answer, CITATION, "")
    for pattern, to in ((r"\s+([.,;:])", "$1"), (r"[ \t]{2,}", " "), (r"\n[ \t]+", "\n"), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def drop_unresolvable(answer: Column, n_passages: Column) -> Column:
    """struct(text, dropped): markers of passages that were not supplied go, the rest of a group stays.

    The text is cut at the markers, and what stands between is put together
    again with each marker's remaining numbers.
    """
    between = F.split(answer, CITATION)
    groups = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), 1), lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).cast("int")))
    fits = lambda x: (x >= 1) & (x <= n_passages)
    marks = F.transform(groups, lambda g: F.filter(g, fits))
    written = F.transform(marks, lambda g: F.when(F.size(g) > 0, F.concat(F.lit("["), F.array_join(F.transform(g, lambda x: x.cast("string")), ", "), F.lit("]"))).otherwise(""))
    text = F.array_join(F.zip_with(between, written, lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")
    for pattern, to in ((r"\s+([.,;:])", "$1"), (r"[ \t]{2,}", " "), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, to)
    dropped = F.flatten(F.transform(groups, lambda g: F.filter(g, lambda x: ~fits(x))))
    return F.struct(text.alias("text"), dropped.alias("dropped"))


@F.pandas_udf(StringType())
def plain_ascii(text: pd.Series) -> pd.Series:
    """Compatibility forms in ASCII: no function of the engine decomposes characters."""
    table = str.maketrans(PLAIN)
    out = text.map(lambda t: unicodedata.normalize("NFKD", t.translate(table)).encode("ascii", "ignore").decode(), na_action="ignore")
    return out.str.replace(r"[ \t]+\n", "\n", regex=True).str.replace(r"\n{3,}", "\n\n", regex=True).str.strip()


def answer_first(text: Column) -> Column:
    """Moves a line "Answer:" that has text before it to the top; drops blank lines before it."""
    lines = F.split(text, "\n")
    is_head = lambda x: F.lower(F.trim(x)) == "answer:"
    at = F.array_position(F.transform(lines, is_head), True).cast("int")
    before, after = F.slice(lines, 1, F.greatest(at - 1, F.lit(0))), F.slice(lines, F.greatest(at, F.lit(1)) + 1, F.size(lines))
    blank = F.forall(before, lambda x: F.trim(x) == "")
    moved = F.array_join(F.concat(F.array(F.lit("Answer:")), before, after), "\n")
    moved = F.regexp_replace(F.regexp_replace(moved, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(at <= 1, text).when(blank, F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)), "\n")).otherwise(moved)


def snippet(text: Column) -> Column:
    """The body after the breadcrumb, collapsed and cut."""
    body = F.when(F.contains(text, F.lit("\n\n")), F.regexp_replace(text, r"(?s)^.*?\n\n", "")).otherwise(text)
    return F.substring(F.trim(F.regexp_replace(body, r"\s+", " ")), 1, SNIPPET)


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, n, title, page, snippet) for each number of `numbers` that names a passage (query_id, position, ...)."""
    asked = answers.select("query_id", F.explode("numbers").alias("n"))
    own = passages.withColumnRenamed("position", "n")
    return asked.join(own, ["query_id", "n"]).select("query_id", "n", "title", F.coalesce("page_range", "page_label").alias("page"), snippet(F.col("text")).alias("snippet"))


def assemble(replies: DataFrame) -> DataFrame:
    """Final answers of model replies (query_id, answer, answered, confidence, missing, n_passages).

    Declined without an answer or when the model says so; low confidence
    without a citation; high confidence falls when a marker had to go.
    """
    text = answer_first(F.coalesce("answer", F.lit("")))
    said = F.lower(F.coalesce("confidence", F.lit("unknown")))
    said = F.when(said.isin("high", "medium", "low"), said).otherwise("unknown")
    declined = F.coalesce(~F.col("answered"), F.lit(False)) | (text == "")
    missing = F.coalesce(F.nullif(F.trim("missing"), F.lit("")), F.lit(""))
    reason = F.when(text != "", text).when(missing != "", F.concat(F.lit("The retrieved manuals do not cover that. "), missing)).otherwise("The retrieved manuals do not answer that question.")
    cleaned = drop_unresolvable(text, F.col("n_passages"))
    out = replies.withColumns({"declined": declined, "c": cleaned, "said": said, "reason": reason}).withColumn("numbers", F.when(F.col("declined"), F.array().cast("array<int>")).otherwise(F.array_sort(cited_numbers(F.col("c.text")))))
    confidence = (
        F.when(F.col("declined") | (F.size("numbers") == 0), "low").when((F.size("c.dropped") > 0) & (F.col("said") == "high"), "low").otherwise(F.col("said"))
    )
    return out.select("query_id", F.when(F.col("declined"), F.col("reason")).otherwise(strip_citations(F.col("c.text"))).alias("answer"), "numbers", confidence.alias("confidence"), "declined")


def group_sources(cited: DataFrame) -> DataFrame:
    """(query_id, title, page, numbers): citations of one source line."""
    return cited.groupBy("query_id", "title", "page").agg(F.array_sort(F.collect_list("n")).alias("numbers"))


def pinned_text(code: Column, family: Column, meaning: Column, title: Column, page: Column, ambiguous: Column, cross_family: Column) -> Column:
    where = F.concat(F.lit(" (source: "), title, F.when(page != "", F.concat(F.lit(", p."), page)).otherwise(""), F.lit(")"))
    quoted = F.concat(F.lit('"'), meaning, F.lit('"'))
    return (
        F.when(ambiguous, F.concat(F.lit("Code "), code, F.lit(" on "), family, F.lit(" equipment: "), quoted, where, F.lit(". No product was named, and other families may use this code: give every meaning by family.")))
        .when(cross_family, F.concat(F.lit("Code "), code, F.lit(" is not listed for the product asked about. On "), family, F.lit(" equipment: "), quoted, where, F.lit(". Say so.")))
        .otherwise(F.concat(F.lit("Code "), code, F.lit(" ["), family, F.lit("]: "), quoted, where, F.lit(".")))
    )


def passage_text(n: Column, title: Column, page: Column, family: Column, is_table: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")), F.when(page != "", F.concat(F.lit(", p."), page)).otherwise(""))
    return F.concat(head, F.lit(" ("), F.coalesce(family, F.lit("UNKNOWN")), F.lit(", "), F.when(is_table, "table").otherwise("text"), F.lit(")\n"), F.substring(text, 1, PASSAGE))


def context(passages: DataFrame, pins: DataFrame) -> DataFrame:
    """(query_id, context): pinned codes, then numbered passages; passages (query_id, n, line), pins (query_id, pin, line, ambiguous)."""
    lines = lambda order: F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])  # noqa: E731  at most k passages and a few pins
    p = passages.groupBy("query_id").agg(F.array_join(lines("n"), "\n\n").alias("p"))
    c = pins.groupBy("query_id").agg(F.array_join(lines("pin"), "\n").alias("c"), F.max("ambiguous").alias("a"))
    both = p.join(c, "query_id", "full_outer")
    head = F.when(F.col("a"), "CODES, AMBIGUOUS: no product family was named; these are all meanings:").otherwise("CODES, matched exactly:")
    text = F.concat_ws("\n\n", F.when(F.col("c").isNotNull(), F.concat(head, F.lit("\n"), F.col("c"))), F.concat(F.lit("PASSAGES:"), F.coalesce(F.concat(F.lit("\n\n"), F.col("p")), F.lit("\n(none retrieved)"))))
    return both.select("query_id", text.alias("context"))


def parse_reply(raw: Column) -> Column:
    """A JSON object, perhaps in a code fence; null for anything else."""
    body = F.regexp_extract(raw, r"(?s)^\s*(?:```(?:json)?\s*)?(\{.*\})\s*(?:```)?\s*$", 1)
    return F.from_json(F.nullif(body, F.lit("")), "answer string, answered boolean, confidence string, missing string")
