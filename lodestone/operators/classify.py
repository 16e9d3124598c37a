"""Product family, document type, model series, page tiers and label offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import page_tier
from lodestone.lexicon import UNKNOWN, Lexicon


def _literals(rows: Sequence[tuple], names: Sequence[str]) -> Column:
    """A lexicon as an array literal, so that matching it needs neither join nor shuffle."""
    if not rows:
        kinds = {"tier": "int", "position": "int", "n": "int"}
        return F.array().cast("array<struct<" + ",".join(f"{n}:{kinds.get(n, 'string')}" for n in names) + ">>")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])


def _tokens(text: Column, strip: str) -> Column:
    cut = F.split(text, r"\s+")
    return F.transform(cut, lambda t: F.upper(F.regexp_replace(t, rf"^[{strip}]+|[{strip}]+$", "")))


def _code_family(tokens: Column, lexicon: Lexicon) -> Column:
    codes = _literals([(f, c.upper(), len(c), p) for f, c, p in lexicon.model_codes()], ["family", "code", "n", "position"])
    hits = F.transform(F.filter(codes, lambda c: F.array_contains(tokens, c["code"])), lambda c: F.struct((-c["n"]).alias("n"), c["position"].alias("p"), c["family"].alias("family")))
    return F.array_min(hits)["family"]


def document_family(category: Column, folder: Column, title: Column, lexicon: Lexicon) -> Column:
    """Longest category pattern in category and folder, else longest alias there, else a model code among the title's tokens."""
    patterns = _literals(lexicon.patterns(), ["family", "tier", "pattern", "position"])
    place = F.lower(F.concat_ws(" ", category, folder))
    hits = F.transform(
        F.filter(patterns, lambda p: F.contains(place, p["pattern"])),
        lambda p: F.struct(p["tier"].alias("t"), (-F.length(p["pattern"])).alias("n"), p["position"].alias("p"), p["family"].alias("family")),
    )
    return F.coalesce(F.array_min(hits)["family"], _code_family(_tokens(F.translate(title, "/", " "), ".,()"), lexicon), F.lit(UNKNOWN))


def query_family(query: Column, lexicon: Lexicon) -> Column:
    """Longest of patterns and aliases taken together, else a model code among the tokens."""
    patterns = _literals(lexicon.patterns(), ["family", "tier", "pattern", "position"])
    text = F.lower(query)
    hits = F.transform(
        F.filter(patterns, lambda p: F.contains(text, p["pattern"])), lambda p: F.struct((-F.length(p["pattern"])).alias("n"), p["position"].alias("p"), p["family"].alias("family"))
    )
    return F.coalesce(F.array_min(hits)["family"], _code_family(_tokens(F.translate(query, "/", " "), r".,()/\-"), lexicon), F.lit(UNKNOWN))


def doc_type(folder: Column, title: Column, lexicon: Lexicon) -> Column:
    """First pattern in file order found in the folder, else in the title, else "other"."""
    kinds = _literals(lexicon.doc_types(), ["kind", "pattern", "position"])

    def first(text: Column) -> Column:
        low = F.lower(text)
        return F.array_min(F.transform(F.filter(kinds, lambda k: F.contains(low, k["pattern"])), lambda k: F.struct(k["position"].alias("p"), k["kind"].alias("kind"))))["kind"]

    return F.coalesce(first(folder), first(title), F.lit("other"))


def model_series(text: Column, lexicon: Lexicon) -> Column:
    """Model codes that are whole tokens, "/" and "-" being blanks, in file order; a hyphened code so never matches here."""
    tokens = _tokens(F.translate(text, "/-", "  "), ".,()")
    codes = list(dict.fromkeys(c for _, c, _ in lexicon.model_codes()))
    return F.filter(F.array(*map(F.lit, codes)).cast("array<string>"), lambda c: F.array_contains(tokens, F.upper(c)))


def tier_summary(pages: DataFrame, *keys: str) -> DataFrame:
    """Pages by tier and their shares, for each key or for all."""
    tier = page_tier(F.col("chars"), F.col("images"))
    counts = [F.count_if(F.col("tier") == t).alias(t) for t in ("plain_text", "diagram_heavy", "scanned")]
    out = pages.withColumn("tier", tier).groupBy(*keys).agg(F.count("*").alias("pages"), *counts)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("pages")), F.lit(0.0))
    return out.withColumns({"pct_plain": share("plain_text"), "pct_diagram": share("diagram_heavy"), "pct_scanned": share("scanned")}).withColumn("pct_vision", F.col("pct_diagram") + F.col("pct_scanned"))


def label_offsets(pages: DataFrame) -> DataFrame:
    """(doc_id, offset, pages): the commonest label - (page_index + 1); of equals the one met first."""
    offsets = pages.withColumn("offset", F.col("label").try_cast("int") - (F.col("page_index") + 1)).where("offset IS NOT NULL")
    counts = offsets.groupBy("doc_id", "offset").agg(F.count("*").alias("pages"), F.min("page_index").alias("first_page"))
    return counts.groupBy("doc_id").agg(F.min_by(F.struct("offset", "pages"), F.struct(-F.col("pages"), "first_page")).alias("m")).select("doc_id", "m.*")


def transitions(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """How many rows went from which value to which."""
    return old.select(key, F.col(column).alias("old_value")).join(new.select(key, F.col(column).alias("new_value")), key).groupBy("old_value", "new_value").count()


def select_folders(folders: DataFrame, needles: Sequence[str]) -> DataFrame:
    """Folders whose category starts with a needle, or, for a needle that none starts with, holds it."""
    wanted = folders.sparkSession.createDataFrame([(n.lower(),) for n in dict.fromkeys(needles)], "needle string")
    low = F.lower("category")
    hits = folders.join(F.broadcast(wanted), F.contains(low, F.col("needle")))  # needles: a handful of arguments
    hits = hits.withColumn("prefix", F.startswith(low, F.col("needle")))
    strong = hits.groupBy("needle").agg(F.bool_or("prefix").alias("any_prefix"))
    chosen = hits.join(strong, "needle").where("prefix OR NOT any_prefix")
    return chosen.select(*folders.columns).distinct()
