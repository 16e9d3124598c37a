"""Pages to chunks of bounded size, and their summary.

The size of a text is the character estimate of `estimate_tokens`, which is
the definition where no tokenizer table can be fetched.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import CHARS_PER_TOKEN, breadcrumb, chunk_id, content_hash, estimate_tokens

TARGET, MOST, OVERLAP, LEAST_CHARS = 800, 1200, 120, 50
TABLE_MOST = 6000


def size_of(chars: int) -> int:
    return max(1, int(chars / CHARS_PER_TOKEN) + 1)


def size(text: str) -> int:
    return size_of(len(text)) if text else 0


def clip(text: str, most: int) -> str:
    return text[: int(most * CHARS_PER_TOKEN)]


def runs(sizes: list[int], most: int, carried: Callable[[int, int], int] | None = None) -> Iterator[tuple[int, int]]:
    """Cuts a row of sizes into runs [i, j) of a sum of at most `most`, each as long as it goes and of one at least.

    `carried` says what of the run before stands in front of the next one, and counts there.
    """
    reach = [0, *itertools.accumulate(sizes)]
    i = 0
    room = most
    while i < len(sizes):
        j = max(i + 1, bisect.bisect_right(reach, reach[i] + room) - 1)
        yield i, j
        room = most - (carried(i, j) if carried and j < len(sizes) else 0)
        i = j


#: Where text may be broken, the best places first, and what joins parts again.
BREAKS = ((re.compile(r"\n\s*\n"), "\n\n"), (re.compile(r"\n"), "\n"), (re.compile(r"(?<=[.!?])\s+"), "\n"))


@dataclass
class Splitter:
    """Breaks prose at paragraphs; what is over the ceiling by itself also at lines, then sentences, then anywhere.

    The parts are put together in runs up to the target.  A run after the first
    begins with the last words of the one before, if the ceiling leaves room.
    """

    target: int = TARGET
    most: int = MOST
    overlap: int = OVERLAP

    def __call__(self, text: str) -> list[str]:
        text = text.strip()
        if size(text) <= self.most:
            return [text] if text else []
        parts = self.parts(text)
        sizes = list(map(size, parts))
        pieces: list[str] = []
        fronts = [""]

        def carried(i: int, j: int) -> int:
            front = self.ending("\n\n".join(filter(None, [fronts[-1], *parts[i:j]])))
            fronts.append(front if size(front) + sizes[j] <= self.most else "")
            return size(fronts[-1])

        for i, j in runs(sizes, self.target, carried):
            pieces.append(clip("\n\n".join(filter(None, [fronts[-1], *parts[i:j]])), self.most))
        return pieces

    def parts(self, text: str) -> list[str]:
        """The text's paragraphs, and instead of those over the ceiling, their lines, sentences or cuts, packed up to it."""
        parts = _broken(text, BREAKS[0][0])
        for pattern, glue in BREAKS[1:]:
            parts = [x for part in parts for x in ([part] if size(part) <= self.most else self._packed(_broken(part, pattern), glue))]
        return [x for part in parts for x in self._cuts(part)]

    def _packed(self, parts: list[str], glue: str) -> list[str]:
        return [glue.join(parts[i:j]) for i, j in runs(list(map(size, parts)), self.most)]

    def _cuts(self, part: str) -> Iterator[str]:
        while size(part) > self.most and clip(part, self.most):
            yield clip(part, self.most)
            part = part[len(clip(part, self.most)) :].strip()
        if part:
            yield part

    def ending(self, text: str) -> str:
        """The fewest last words that reach the overlap."""
        words = text.split()
        if self.overlap <= 0:
            return ""
        lengths = itertools.accumulate(len(w) + 1 for w in reversed(words))
        n = next((n for n, chars in enumerate(lengths, 1) if size_of(chars - 1) >= self.overlap), len(words))
        return " ".join(words[len(words) - n :])


def _broken(text: str, pattern: re.Pattern) -> list[str]:
    return [x for x in map(str.strip, pattern.split(text)) if x]


def split_prose(df: DataFrame, text: str = "text", pieces: str = "pieces", splitter: Splitter | None = None) -> DataFrame:
    """`df` with an array column of the pieces of `text`: a fold over units of data-dependent size, in Arrow batches."""
    cut = splitter or Splitter()
    df = df.drop(pieces)

    def run(batches):
        for batch in batches:
            lists = [cut(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.string()))], names=[*batch.schema.names, pieces])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, {pieces} array<string>")


def pack_lines(lines: Column, most: int) -> Column:
    """Lines packed in order up to `most` tokens, in generated functions: as `runs` of them."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"), F.lit(0).alias("weight"))

    def step(a: Column, x: Column) -> Column:
        own = estimate_tokens(x)
        full = (a["weight"] > 0) & (a["weight"] + own > most)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["weight"] == 0), x).otherwise(F.concat(a["held"], F.lit("\n"), x)).alias("held"),
            F.when(full, own).otherwise(a["weight"] + own).alias("weight"),
        )

    # a lambda of one parameter: F.trim as it stands would get the line's index as the characters to trim
    return F.aggregate(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), start, step, lambda a: F.when(a["weight"] > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"]))


PAGE_COLUMNS = ("doc_id", "page_index", "page_label", "category", "folder", "title")


def chunk_pages(pages: DataFrame, tables: DataFrame | None = None, splitter: Splitter | None = None) -> DataFrame:
    """Chunks of pages: a page's tables first, then its prose; short ones are dropped without using up a number.

    pages: PAGE_COLUMNS and text.  tables: (doc_id, page_index, position, body), rendered.
    """
    prose = split_prose(pages.select(*PAGE_COLUMNS, "text"), splitter=splitter)
    parts = prose.select(*PAGE_COLUMNS, F.lit(1).alias("rank"), F.lit("prose").alias("kind"), F.posexplode("pieces").alias("position", "body"))
    if tables is not None:
        own = tables.join(pages.select(*PAGE_COLUMNS), ["doc_id", "page_index"])
        parts = parts.union(own.select(*PAGE_COLUMNS, F.lit(0), F.lit("table"), "position", "body"))
    parts = parts.where(F.length(F.regexp_replace("body", r"^\s+|\s+$", "")) >= LEAST_CHARS)
    # chunks of one page: their number is bounded by the page's text
    order = Window.partitionBy("doc_id", "page_index").orderBy("rank", "position")
    parts = parts.withColumn("ordinal", F.row_number().over(order) - 1)
    crumb = breadcrumb(*[F.col(c) for c in ("category", "folder", "title", "page_label")])
    text = F.when(crumb != "", F.concat(crumb, F.lit("\n\n"), F.col("body"))).otherwise(F.col("body"))
    out = parts.withColumn("text", text).withColumns({"chunk_id": chunk_id(F.col("doc_id"), F.col("page_index"), F.col("ordinal")), "content_hash": content_hash(F.col("text")), "token_count": estimate_tokens(F.col("text"))})
    return out.select("chunk_id", "doc_id", "page_index", "page_label", "kind", (F.col("kind") == "table").alias("is_table"), "ordinal", "text", "token_count", "content_hash")


def chunk_summary(chunks: DataFrame, *keys: str) -> DataFrame:
    return chunks.groupBy(*keys).agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.avg("token_count").alias("mean_tokens"), F.max("token_count").alias("max_tokens"), F.count_if(F.col("kind") == "table").alias("table_chunks")
    )
