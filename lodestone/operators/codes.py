"""The fault-code table: occurrences of codes in chunks, the best of each, and their way back to chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.codes import distinct_keys, sweep
from lodestone.lexicon import Lexicon

HIT = "code string, code_key string, meaning string, evidence string, in_table boolean"


def _compiled(lexicon: Lexicon) -> list[tuple[re.Pattern, bool]]:
    return [(re.compile(p, re.IGNORECASE), phrase) for p, phrase in lexicon.code_patterns()]


def code_hits(chunks: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Each column of `chunks` but the text, with one row for each occurrence that has a usable meaning, and its place."""
    own = [c for c in chunks.columns if c != text]

    def run(batches):
        patterns = _compiled(lexicon)
        for batch in batches:
            found = [sweep(t or "", patterns) for t in batch.column(text).to_pylist()]
            index = pa.array([i for i, hits in enumerate(found) for _ in hits], pa.int64())
            flat = [(at, h) for hits in found for at, h in enumerate(hits)]
            columns = {k: [h[k] for _, h in flat] for k in ("code", "code_key", "meaning", "evidence")}
            arrays = [pa.array(v, pa.string()) for v in columns.values()] + [pa.array([h["in_table"] for _, h in flat], pa.bool_()), pa.array([at for at, _ in flat], pa.int32())]
            kept = batch.select(own).take(index)
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*own, *columns, "in_table", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema if f.name in own)
    return chunks.mapInArrow(run, f"{schema}, {HIT}, place int")


def _placed(chunk: Column) -> list[Column]:
    """What orders chunk ids as chunks were cut: c20 before c100."""
    number = lambda k: F.regexp_extract(chunk, r"^(.*):p(\d+|na):c(\d+)$", k)
    return [number(1).alias("doc_"), number(2).try_cast("long").alias("page_"), number(3).try_cast("long").alias("number_"), chunk.alias("chunk_")]


def code_table(hits: DataFrame, seq: str = "chunk_id") -> DataFrame:
    """The best row of each (code_key, product_family): from a table, then the longer meaning, then the first in the order of document, page and number."""
    keys = ["code_key", "product_family"]
    values = F.struct(*[F.col(c) for c in hits.columns if c not in keys])
    best = F.min_by(values, F.struct((~F.col("in_table")).alias("a"), (-F.length("meaning")).alias("b"), *_placed(F.col(seq)), F.col("place").alias("d")))
    return hits.groupBy(*keys).agg(best.alias("v")).select(*keys, "v.*").drop("place")


def annotate(chunks: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`chunks` with fault_codes, the distinct keys in order of appearance, pattern by pattern."""

    def run(batches):
        patterns = _compiled(lexicon)
        for batch in batches:
            lists = [distinct_keys(t or "", patterns) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], names=[*batch.schema.names, "fault_codes"])

    chunks = chunks.drop("fault_codes")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, fault_codes array<string>")


def by_key(codes: DataFrame) -> DataFrame:
    """code_key with its rows, one for each family."""
    rows = F.sort_array(F.collect_list(F.struct("product_family", "code", "meaning")))
    return codes.groupBy("code_key").agg(rows.alias("rows"))
