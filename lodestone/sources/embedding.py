"""Calls of an embedding service from Arrow workers: inputs cut to size, retries, vectors by their index."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import CHARS_PER_TOKEN, estimate_tokens, truncate_tokens

INPUT_TOKENS, BATCH_TOKENS, BATCH_ITEMS = 8191, 250_000, 256
ATTEMPTS, BACKOFF = 5, 2.0
# Names of errors that clients raise.
LASTING = frozenset({"AuthenticationError", "PermissionDeniedError", "BadRequestError"})
PASSING = frozenset({"RateLimitError", "APITimeoutError", "APIConnectionError", "InternalServerError"})

Client = Callable[[list[str]], Sequence[tuple[int, Sequence[float]]]]


class EmbeddingFailed(RuntimeError):
    pass


def worth_another_try(error: Exception) -> bool:
    """By name first, else by HTTP status: 429 and from 500 on."""
    name, status = type(error).__name__, getattr(error, "status_code", None)
    if name in LASTING or name in PASSING:
        return name in PASSING
    return isinstance(status, int) and (status == 429 or status >= 500)


def vectors(client: Client, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One vector for each text; the service's own index decides which is whose."""
    for attempt in range(ATTEMPTS):
        try:
            return [list(v) for _, v in sorted(client(texts), key=lambda item: item[0])]
        except Exception as error:  # noqa: BLE001  clients raise many kinds
            if attempt + 1 == ATTEMPTS or not worth_another_try(error):
                raise EmbeddingFailed(f"given up after {attempt + 1} attempts: {error}") from error
        sleep(BACKOFF * 2**attempt)
    return []


def requests(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts that fit one request, by number and by tokens."""
    start, tokens = 0, 0
    for at, text in enumerate(texts):
        own = int(len(text) / CHARS_PER_TOKEN) + 1
        if at > start and (at - start >= BATCH_ITEMS or tokens + own > BATCH_TOKENS):
            yield start, at
            start, tokens = at, 0
        tokens += own
    if start < len(texts):
        yield start, len(texts)


def embed(rows: DataFrame, client: Client, text: str = "text") -> DataFrame:
    """`rows` with a column `embedding`; texts over the service's limit are cut to it first."""
    cut = F.when(estimate_tokens(F.col(text)) > INPUT_TOKENS, truncate_tokens(F.col(text), INPUT_TOKENS)).otherwise(F.coalesce(text, F.lit("")))
    rows = rows.drop("embedding").withColumn("sent_text", cut)

    def run(batches):
        for batch in batches:
            texts = batch.column("sent_text").to_pylist()
            found = [v for i, j in requests(texts) for v in vectors(client, texts[i:j])]
            kept = batch.select([c for c in batch.schema.names if c != "sent_text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.float32()))], names=[*kept.schema.names, "embedding"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "sent_text")
    return rows.mapInArrow(run, f"{schema}, embedding array<float>")
