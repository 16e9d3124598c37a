"""The cascade for a batch of questions: understand, look codes up, two channels, fuse, boost, rerank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.lexicon import Lexicon
from lodestone.operators import retrieve as R
from lodestone.operators.understand import understand


def cascade(
    questions: DataFrame, index: DataFrame, posts: DataFrame, lexicon: Lexicon, where: Column | None = None, k: int = R.TOP_K, rerank: Callable[[DataFrame], DataFrame] | None = None,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """query_id, chunk_id, rank, scores, ranks by channel, boosts.

    questions: (query_id, query, vector); a question with a null vector uses
    the full-text channel alone.  index: chunk_id, embedding and the columns of
    `boost`.  lengths: as for `bm25`.  A filter holds in both channels before ranks are taken.
    """
    asked = understand(questions, lexicon)
    dense = R.dense(questions.where("vector IS NOT NULL"), index, where=where)
    allowed = None if where is None else index.where(where)
    text = R.bm25(asked.select("query_id", F.col("rewritten_query").alias("query")), posts, allowed=allowed, lengths=lengths)
    fused = R.fuse({"dense": dense, "bm25": text})
    facets = index.select("chunk_id", *[c for c in ("content_stream", "product_family", "model_series", "fault_codes") if c in index.columns])
    candidates = fused.join(facets, "chunk_id").join(asked.select("query_id", "query", "q_family", "q_series", "q_codes"), "query_id")
    boosted = R.boost(candidates)
    return rerank(boosted) if rerank else R.rerank_identity(boosted, k)


def predicate(**filters: str | None) -> Column | None:
    """Equalities joined by AND; values must be plain identifiers."""
    import re

    out = None
    for column, value in filters.items():
        if value is None:
            continue
        if not re.fullmatch(r"[A-Za-z0-9_]{1,64}", value):
            raise ValueError(f"{column}: not an identifier: {value!r}")
        own = F.col(column) == F.lit(value)
        out = own if out is None else out & own
    return out
