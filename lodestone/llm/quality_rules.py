"""Quality rules by weak supervision, in DataFrame functions alone.

Every rule looks at counts of one text and votes good (1), bad (-1) or abstains
(0).  The votes of all documents are counted by pattern, of which there are at
most 3 ** rules whatever the number of documents; expectation-maximisation on
these counts estimates how often each rule is right, and a document's
posterior probability of being good decides, instead of a demand that all
rules pass.  Reruns agree: the counts are integers and the start is fixed.

Base counts are exact and taken within the row: 5-word windows are compared by
64-bit hashes inside one text only.

Defined results for odd input: null text is the text without words, for which
all counts are 0 and base_failed is true.  Extra columns of any
name are carried by `keep` and ignored by `verdicts`.  Ties
and repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, tidy, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
#: A document stays if its posterior probability of being good is this or more.
THRESHOLD = 0.5
#: Share of good documents, and accuracy of a rule, before anything is counted, and the weight of that belief in documents' shares.
PRIOR, ACCURACY, BELIEF = 0.85, 0.9, 0.05
#: A word of prose: a letter, perhaps after a quote or bracket, then neither capitals nor symbols nor exclamation marks.
PLAIN = r"^[\"'(\u00ab\u201c\u201e\u2018]?\p{L}[^\p{Lu}#*$%&|<>!]*$"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """Evaluates `value` once for all its uses in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words covered by windows that are found twice or more in the array `words`."""

    def count(hashes: Column) -> Column:
        # equal windows stand together after sorting by (hash, start)
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            twin = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            gaps = F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        found = let(let(ordered, starts), covered)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(found)

    def hashes(own: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(own) - window)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(window)]))

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(let(let(word_hashes, hashes), count))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct column `q` of all counts that the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))

    def counts(words: Column, rows: Column) -> Column:
        bare = F.translate(t, BLANKS, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(rows).cast("long").alias("n_lines"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit(r"\p{Ll}")).cast("long").alias("n_lower"),
            (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_bangs"),
            F.size(F.array_distinct(words)).cast("long").alias("n_kinds"),
            F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}"))).cast("long").alias("n_no_letter"),
            F.size(F.filter(words, lambda w: w.rlike(PLAIN))).cast("long").alias("n_plain"),
        )

    return docs.withColumn("q", let(_words(t), lambda words: let(lines, lambda rows: counts(words, rows))))


def votes(q: Column) -> dict[str, Column]:
    """The rules; each votes from the counts of one document.

    All but `plain` know only what speaks against a text, and abstain otherwise:
    the lack of one fault says little about others.
    """
    n, letters = q["n_words"], q["n_upper"] + q["n_lower"]
    bad = {
        "symbols": q["n_symbols"] * 10 > n * 2,
        "bangs": q["n_bangs"] * 10 > n * 2,
        "capitals": q["n_upper"] * 10 > letters * 4,
        "bare_words": q["n_no_letter"] * 10 > n * 2,
        "repeats": q["n_repeat_words"] * 10 > n,
        "lines": q["n_dup_lines"] * 10 > q["n_lines"] * 4,
        "word_length": (q["word_chars"] > n * 14) | (q["word_chars"] < n * 2),
        "variety": (n >= 50) & (q["n_kinds"] * 100 < n * 5),
    }
    found = {k: F.when(v, F.lit(-1)).otherwise(F.lit(0)) for k, v in bad.items()}
    found["plain"] = F.when(q["n_plain"] * 100 < n * 60, F.lit(-1)).when(q["n_plain"] * 100 >= n * 75, F.lit(1)).otherwise(F.lit(0))
    return found


def estimate(counts: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> tuple[float, list[float], list[float]]:
    """Expectation-maximisation on counted vote patterns: the share of good documents, and for
    each rule its probability of voting "good" on a good one, and "bad" on a bad one, when it votes.

    A belief worth a small share of the documents holds the estimates where a rule hardly votes;
    a rule is never taken to be worse than a coin.
    """
    total = sum(n for _, n in counts)
    share, right = PRIOR, [[ACCURACY] * rules, [ACCURACY] * rules]  # right[0]: on good, right[1]: on bad documents
    extra = max(1.0, BELIEF * total)
    for _ in range(rounds if total else 0):
        good_n, hit, cast = 0.0, [[0.0] * rules, [0.0] * rules], [[0.0] * rules, [0.0] * rules]
        for pattern, n in counts:
            p = posterior(pattern, share, right[0], right[1])
            good_n += n * p
            for k, v in enumerate(pattern):
                if v:
                    cast[0][k] += n * p
                    cast[1][k] += n * (1 - p)
                    hit[v < 0][k] += n * (p if v > 0 else 1 - p)
        now = (good_n + extra * PRIOR) / (total + extra)
        new = [[min(0.999, max(0.501, (hit[c][k] + extra * ACCURACY) / (cast[c][k] + extra))) for k in range(rules)] for c in (0, 1)]
        moved = abs(now - share) + sum(abs(a - b) for c in (0, 1) for a, b in zip(new[c], right[c], strict=True))
        share, right = now, new
        if moved < 1e-10:
            break
    return share, right[0], right[1]


def posterior(pattern: tuple[int, ...], share: float, on_good: list[float], on_bad: list[float]) -> float:
    """Probability that a document with these votes is good."""
    x = math.log(share / (1 - share))
    for v, g, b in zip(pattern, on_good, on_bad, strict=True):
        if v > 0:
            x += math.log(g / (1 - b))
        elif v < 0:
            x += math.log((1 - g) / b)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judge(counts: DataFrame) -> DataFrame:
    """Rows of `measured` (a column `q`, and any others) with base counts, base_failed, quality (the posterior) and kept instead of `q`.

    `counts` is read twice: to estimate the rules, and to apply them.
    """
    cast = votes(F.col("q"))
    patterns = counts.where(~_base_failed(F.col("q"))).groupBy(*[v.alias(k) for k, v in cast.items()]).count().orderBy(*cast).collect()  # at most 3 ** rules rows
    share, on_good, on_bad = estimate([(tuple(r[:-1]), r[-1]) for r in patterns], len(cast))
    x = F.lit(math.log(share / (1 - share)))
    for v, g, b in zip(cast.values(), on_good, on_bad, strict=True):
        x = x + F.when(v > 0, F.lit(math.log(g / (1 - b)))).when(v < 0, F.lit(math.log((1 - g) / b))).otherwise(F.lit(0.0))
    out = counts.withColumn("base_failed", _base_failed(F.col("q"))).withColumn("quality", 1 / (1 + F.exp(-x)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))
    return out.withColumns({c: F.col("q")[c] for c in BASE}).drop("q")


def _base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])


@tidy
def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept, quality of every document.

    The counts, some tens of bytes a document, are written once and read for both uses.
    """
    counts = measured(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return judge(written(counts.drop("text"))).select("doc_id", *BASE, "base_failed", "kept", "quality")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.

    Rows are written together with their counts: a filter on the verdict would
    else be pushed below the counts, which it would then take anew for each rule.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"))
    return judge(written(measured(inner).select("row", "q"))).where("kept").select("row.*")
