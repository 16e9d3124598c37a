"""What a question asks: family, series, codes, intent; column functions but for the codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.codes import FAULT_WORDS, WINDOW, is_code_like, normalise_code
from lodestone.lexicon import UNKNOWN, Lexicon
from lodestone.operators.classify import model_series, query_family

# Markers of each intent, most specific first.
INTENTS = {
    "fault_diagnosis": (
        "fault", "error", "code", "not working", "won't", "wont", "will not", "failure", "fail", "broken", "lockout", "lock out", "flashing", "alarm", "diagnos", "troubleshoot", "problem", "issue",
        "stopped", "no heat", "not heating", "not cooling", "leak",
    ),
    "parts": ("part number", "spare", "replacement", "exploded", "part no", "order a", "kit"),
    "installation": ("install", "commission", "mount", "duct size", "clearance", "wiring diagram", "connect"),
    "specification": ("pressure", "voltage", "torque", "rating", "capacity", "specification", "spec", "kpa", "kw", "amp", "setting", "how many", "what size"),
    "maintenance": ("service", "clean", "filter", "maintenance", "annual", "descale"),
}
DIAGRAM = ("diagram", "wiring", "schematic", "exploded", "drawing", "layout", "picture", "image", "where is", "which terminal", "what does it look like")


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def intent(query: Column) -> Column:
    low = F.lower(query)
    out = F.lit("general")
    for name, words in reversed(INTENTS.items()):
        out = F.when(_any(low, words), name).otherwise(out)
    return out


def wants_diagram(query: Column) -> Column:
    return _any(F.lower(query), DIAGRAM)


def _keyed(phrase: bool):
    return lambda token: normalise_code(token, F.lit(phrase))


def codes(query: Column, lexicon: Lexicon) -> Column:
    """Codes of a question, pattern by pattern, then explicit FC forms.

    The question counts as standing after "fault code: ", which lends fault
    words to whatever begins within their reach; beyond it the question must
    hold such words itself.  The place of a match is the length of the text
    before its first occurrence.
    """
    text = F.concat(F.lit("fault code: "), query)
    found = []
    for pattern, phrase in lexicon.code_patterns():
        whole = F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), 1)
        token = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 1) if "(" in pattern.replace("(?:", "") else whole
        pairs = F.arrays_zip(whole.alias("w"), token.alias("t"))

        def near(p: Column) -> Column:
            at = F.instr(text, p["w"])
            around = F.lower(F.substr(text, F.greatest(F.lit(1), at - WINDOW), F.length(p["w"]) + WINDOW + F.least(F.lit(WINDOW), at - 1)))
            return _any(around, FAULT_WORDS)

        good = F.filter(pairs, lambda p: is_code_like(p["t"]) & near(p))
        found.append(F.transform(F.transform(good, lambda p: p["t"]), _keyed(phrase)))
    bare = F.transform(F.regexp_extract_all(query, F.lit(r"(?i)\bFC\s?(\d{1,2})\b"), 1), lambda d: F.format_string("FC%02d", d.cast("int")))
    return F.array_distinct(F.filter(F.concat(*found, bare), lambda k: k != ""))


def series(query: Column, lexicon: Lexicon) -> Column:
    """Model codes that are tokens, then those that are the letters of a token with a size ("GH5")."""
    known = [c.upper() for c in dict.fromkeys(c for _, c, _ in lexicon.model_codes())]
    own = model_series(query, lexicon)
    sized = F.transform(F.regexp_extract_all(query, F.lit(r"\b([A-Za-z]{2,6})\d{1,2}[A-Za-z]?\b"), 1), lambda t: F.upper(t))
    sized = F.array_distinct(F.filter(sized, lambda t: F.array_contains(F.array(*map(F.lit, known)).cast("array<string>"), t)))
    upper = F.transform(own, lambda c: F.upper(c))
    return F.concat(own, F.filter(sized, lambda t: ~F.array_contains(upper, t)))


def family_of_series(series_: Column, lexicon: Lexicon) -> Column:
    """The family that owns the first of the series; of several the first in file order."""
    owner: dict[str, str] = {}
    for family, code, _ in lexicon.model_codes():
        owner.setdefault(code.upper(), family)
    if not owner:
        return F.lit(UNKNOWN)
    entries = [F.lit(x) for pair in owner.items() for x in pair]
    hits = F.filter(F.transform(series_, lambda c: F.try_element_at(F.create_map(*entries), F.upper(c))), lambda f: f.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(UNKNOWN))


def understand(questions: DataFrame, lexicon: Lexicon) -> DataFrame:
    """questions (query_id, query) with q_family, q_series, q_codes, intent, wants_diagram, model_explicit, rewritten_query, source."""
    q = F.col("query")
    out = questions.withColumns({"q_series": series(q, lexicon), "q_codes": codes(q, lexicon), "q_family": query_family(q, lexicon), "intent": intent(q), "wants_diagram": wants_diagram(q)})
    return out.withColumns({
        "q_family": F.when(F.col("q_family") == UNKNOWN, family_of_series(F.col("q_series"), lexicon)).otherwise(F.col("q_family")),
        "intent": F.when((F.size("q_codes") > 0) & (F.col("intent") == "general"), "fault_diagnosis").otherwise(F.col("intent")),
        "model_explicit": F.upper(q).rlike(r"\b[A-Z]{2,5}\d{1,2}[A-Z]?\b") & (F.size("q_series") > 0),
        "rewritten_query": q, "source": F.lit("deterministic"),
    })


def enrich(understood: DataFrame, replies: DataFrame) -> DataFrame:
    """Takes intent, diagram wish and rewriting from a model's replies (query_id, intent, wants_diagram, rewrite); all else stays."""
    said = replies.select(F.col("query_id").alias("q"), F.col("intent").alias("i"), F.col("wants_diagram").alias("w"), F.col("rewrite").alias("r"))
    joined = understood.join(said, F.col("query_id") == F.col("q"), "left")
    known = F.col("i").isin(*INTENTS, "general")
    return joined.withColumns({
        "intent": F.when(known, F.col("i")).otherwise(F.col("intent")),
        "wants_diagram": F.col("wants_diagram") | F.coalesce("w", F.lit(False)),
        "rewritten_query": F.coalesce(F.when(F.trim("r") != "", F.col("r")), F.col("rewritten_query")),
        "source": F.when(F.col("q").isNotNull(), "deterministic+llm").otherwise(F.col("source")),
    }).drop("q", "i", "w", "r")


def enrich_with(understood: DataFrame, model: Callable[[str], dict]) -> DataFrame:
    """Asks an injected model about each question; a failure leaves the question as it was."""

    def run(frames):
        for pdf in frames:
            rows = []
            for qid, q in zip(pdf["query_id"], pdf["query"], strict=True):
                try:
                    said = model(q)
                    rows.append((qid, said.get("intent"), said.get("wants_diagram"), said.get("rewrite")))
                except Exception:  # noqa: BLE001  any failure of a model means no enrichment
                    continue
            import pandas as pd

            yield pd.DataFrame(rows, columns=["query_id", "intent", "wants_diagram", "rewrite"])

    replies = understood.select("query_id", "query").mapInPandas(run, f"query_id {understood.schema['query_id'].dataType.simpleString()}, intent string, wants_diagram boolean, rewrite string")
    return enrich(understood, replies)


def flags(understood: DataFrame, results: DataFrame, pins: DataFrame) -> DataFrame:
    """query_id, flags: what a novice's question lacks; results (query_id, doc_id, product_family)."""
    r = results.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.count_distinct("product_family").alias("families"))
    p = pins.groupBy("query_id").agg(F.max("ambiguous").alias("ambiguous"))
    joined = understood.join(r, "query_id", "left").join(p, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    rules = {
        "code_without_family": (F.size("q_codes") > 0) & (F.col("q_family") == UNKNOWN),
        "ambiguous_code": F.coalesce("ambiguous", F.lit(False)),
        "family_unresolved": F.col("q_family") == UNKNOWN,
        "many_families": F.coalesce(F.col("families") > 2, F.lit(False)),
        "single_document": F.coalesce((n > 1) & (F.col("docs") == 1), F.lit(False)),
        "no_results": n == 0,
    }
    return joined.select("query_id", F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]), lambda x: x.isNotNull()).alias("flags"))
