"""Substring dedup by level-wise doubling.

A window of LENGTH words of which the same words also start earlier (smaller
doc_id, or the same document at an earlier start) is repeated, and every word
it covers is removed.  Whole windows of all texts would be many times the size
of the texts, so they are reached by doubling: windows of half the length are
looked at first, and only those that are found more than once are extended to
windows of twice their length, on which the decision falls.

Of the half-length windows it is enough to look at some that equal passages
are sure to share: in every LENGTH-word window, the half-length window of the
smallest hash (the first of these, if several).  Two equal windows have it at
the same place, so nothing that is repeated is missed, and about one start in
six is looked at.

Documents with equal texts are set apart first: all but the first copy have
each window repeated.  Window hashes travel packed: each batch of documents
resolves equal windows within itself at once, so that a passage that a third
of all documents share leaves a batch as one entry, and sends what is left as
one compressed block for each bucket of hashes.  What is found to be repeated
goes on as blocks too, for buckets of documents.  Texts are moved once, for the
second level; those that may lose words go along with what is found there.

Defined results for odd input: null text and texts of fewer than LENGTH words
lose nothing; a document of which nothing is kept has the empty text.  Rows
with equal doc_id are one document: a window does not repeat itself in a
repeated row, and each row keeps what its own text keeps.  Null doc_id comes
before all others.  Extra columns are ignored by `removed` and carried by
`strip`.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, discard, released, tidy, written
from lodestone.llm.shingles import mixed, window_hashes, word_hashes

LENGTH = 20
#: Windows that a batch holds together.
HELD = 1 << 19
#: Buckets of hashes for each shuffle partition; one bucket at a time is held in memory.
BUCKETS = 4

def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def anchors(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the half-length windows that are smallest, first of equals, in some full window."""
    half = length // 2
    if len(hashes) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    own = window_hashes(hashes, half)
    reach = length - half + 1
    least = np.lib.stride_tricks.sliding_window_view(own, reach).argmin(1) + np.arange(len(own) - reach + 1)
    at = np.unique(least)
    return at, own[at]


def _identified(docs: DataFrame) -> DataFrame:
    """doc, key, text: the document's id (null: the smallest) and a digest that tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def _copies(rows: DataFrame) -> DataFrame:
    """doc, key of the rows whose text is that of a smaller document."""
    slim = rows.select("doc", "key", F.md5("text").alias("digest"))
    first = slim.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    return slim.join(first, "digest").where("doc > first").select("doc", "key").distinct()


PACKED = "kind int, bucket int, payload binary, doc long, key long, text string"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("doc", pa.int64()), ("key", pa.int64()), ("text", pa.string())])
ENTRIES, STARTS, TEXT = 0, 1, 2
#: Of an entry: two parts of the hash, document, key and start.
_KINDS = (np.uint64, np.uint32, np.int64, np.int64, np.uint32)


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of entries sorted by the first one, of which only the steps are kept."""
    import zstandard

    steps = np.diff(columns[0], prepend=np.uint64(0))
    raw = b"".join(c.astype(t).tobytes() for c, t in zip([steps, *columns[1:]], _KINDS, strict=True))
    return len(steps).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(payload: bytes) -> list[np.ndarray]:
    import zstandard

    n = int.from_bytes(payload[:4], "little")
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload[4:]), 0, []
    for t in _KINDS:
        size = n * np.dtype(t).itemsize
        out.append(np.frombuffer(raw, t, n, at))
        at += size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _starts_rows(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, buckets: int) -> list[dict]:
    """Starts packed by buckets of documents, dealt by a hash of these, as columns of entries of which the first is the document."""
    bucket = mixed(docs.astype(np.uint64)) % np.uint64(buckets)
    order = np.lexsort((starts, keys, docs, bucket))
    columns = [x[order] for x in (bucket, docs.astype(np.uint64), np.zeros(len(docs), np.uint32), docs, keys, starts)]
    cuts = np.searchsorted(columns[0], np.arange(buckets + 1, dtype=np.uint64))
    return [{"kind": STARTS, "bucket": k, "payload": _pack([c[i:j] for c in columns[1:]])} for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]


def _sorted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Entries by hash, document and start; whether an entry is the first of its hash; and where that first one is."""
    h1, h2, docs, keys, starts = columns
    order = np.lexsort((starts, docs, h2, h1))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return columns, new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _resolve(columns: list[np.ndarray], buckets: int, later_only: bool):
    """What a batch says: entries by bucket, and starts that are known to be repeated.

    later_only: an entry is repeated if an equal one is earlier, and the first
    goes on; else all equal ones are repeated, and of these one goes on
    without a document (of start 2 ** 32 - 1), to speak for its hash.
    """
    columns, new, head = _sorted(columns)
    docs, keys, starts = columns[2:]
    if later_only:
        known = (docs > docs[head]) | (starts > starts[head])
        sent = new | (~known & (keys != keys[head]))  # rows of one id stand in one place
    else:
        several = np.zeros(len(new), bool)
        several[:-1] |= ~new[1:]
        known = several | ~new
        sent = new
        columns[2], columns[3], columns[4] = (np.where(known, v, c) for c, v in zip(columns[2:], (0, 0, 0xFFFFFFFF), strict=True))
    rows = _starts_rows(docs[known], keys[known], starts[known], buckets // BUCKETS)
    sent = [c[sent] for c in columns]
    bucket = (sent[0] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        at = order[cuts[k] : cuts[k + 1]]
        if len(at):
            rows.append({"kind": ENTRIES, "bucket": k, "payload": _pack([c[at] for c in sent])})
    for k in range(0, len(rows), 512):
        yield pa.RecordBatch.from_pylist(rows[k : k + 512], schema=_ARROW)


def _reduced(rows: DataFrame, later_only: bool, buckets: int) -> DataFrame:
    """(doc, key, starts) of what is repeated, from the packed rows of all batches: one bucket of hashes at a time, then one of documents."""

    def run(batches):
        now, held, good = None, [], []

        def found():
            """Of the bucket that is held, the entries that are repeated."""
            columns = [np.concatenate(c) for c in zip(*map(_unpack, held), strict=True)]
            columns, new, head = _sorted(columns)
            docs, keys, starts = columns[2:]
            if later_only:
                at = (docs > docs[head]) | (starts > starts[head])
            else:
                several = np.zeros(len(new), bool)
                several[:-1] |= ~new[1:]
                at = (several | ~new) & (starts != 0xFFFFFFFF)
            return [docs[at], keys[at], starts[at]]

        def said():
            # starts go on packed by buckets of documents: a row for each document would be one for each document and task
            out = _starts_rows(*map(np.concatenate, zip(*good, strict=True)), buckets // BUCKETS)
            for k in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[k : k + 512], schema=_ARROW).select(["bucket", "payload"])

        for batch in batches:
            known = batch.filter(pa.compute.equal(batch.column("kind"), STARTS))
            if known.num_rows:
                yield known.select(["bucket", "payload"])
            for kind, bucket, payload in zip(*[batch.column(c).to_pylist() for c in ("kind", "bucket", "payload")], strict=True):
                if kind != ENTRIES:
                    continue
                if bucket != now and held:
                    good.append(found())
                    held = []
                    if sum(len(g[0]) for g in good) >= HELD:
                        yield from said()
                        good = []
                now = bucket
                held.append(payload)
        if held:
            good.append(found())
        if good:
            yield from said()

    def gathered(batches):
        now, held = None, []

        def said():
            """Of the bucket that is held, a row for each document."""
            docs, keys, starts = [np.concatenate(c) for c in zip(*map(_unpack, held), strict=True)][2:]
            order = np.lexsort((starts, keys, docs))
            docs, keys, starts = docs[order], keys[order], starts[order].astype(np.int32)
            new = np.ones(len(order), bool)  # of a document
            new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
            once = new.copy()
            once[1:] |= starts[1:] != starts[:-1]
            docs, keys, starts, new = docs[once], keys[once], starts[once], new[once]
            heads = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array([*heads, len(starts)], pa.int32()), pa.array(starts, pa.int32()))
            yield from pa.Table.from_arrays([pa.array(docs[heads]), pa.array(keys[heads]), lists], names=["doc", "key", "starts"]).to_batches(max_chunksize=4096)

        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if bucket != now and held:
                    yield from said()
                    held = []
                now = bucket
                held.append(payload)
        if held:
            yield from said()

    dealt = rows.where(F.col("kind") != TEXT).select("kind", "bucket", "payload").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    known = dealt.mapInArrow(released(run), "bucket int, payload binary").repartition("bucket").sortWithinPartitions("bucket")
    return known.mapInArrow(released(gathered), "doc long, key long, starts array<int>")


def _level_one(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """The anchors of all documents; the key plays no part yet, and anchors of equal ids are pooled."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
                at, own = anchors(word_hashes(words_of(text.as_py())), length)
                if len(at):
                    n = len(at)
                    held.append((own, (own >> np.uint64(7)).astype(np.uint32), np.full(n, doc.as_py(), np.int64), np.zeros(n, np.int64), at.astype(np.uint32)))
                    size += n
                if size >= HELD:
                    yield from _resolve([np.concatenate(c) for c in zip(*held, strict=True)], buckets, False)
                    held, size = [], 0
        if held:
            yield from _resolve([np.concatenate(c) for c in zip(*held, strict=True)], buckets, False)

    return rows.select("doc", "text").mapInArrow(released(run), PACKED)


def _level_two(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    """Full windows around repeated anchors (column `anchors`), and the texts that have some; `several`: the id has other texts too; `skip`: keys of copies."""
    reach = length - length // 2

    def run(batches):
        held, size = [], 0
        for batch in batches:
            texts = []
            for doc, key, text, own, several, skip in zip(*[batch.column(c) for c in ("doc", "key", "text", "anchors", "several", "skip")], strict=True):
                doc, key = doc.as_py(), key.as_py()
                if key in (skip.as_py() or ()):
                    continue
                hashes = word_hashes(words_of(text.as_py()))
                near = np.asarray(own.as_py(), np.int64)[:, None] + np.arange(-reach, 1)
                at = np.unique(near[(near >= 0) & (near <= len(hashes) - length)])
                if not len(at):
                    continue
                texts.append({"kind": TEXT, "bucket": -1, "doc": doc, "key": key, "text": text.as_py()})
                n, own_key = len(at), key if several.as_py() else 0
                held.append((window_hashes(hashes, length, 1)[at], window_hashes(hashes, length, 2)[at].astype(np.uint32), np.full(n, doc, np.int64), np.full(n, own_key, np.int64), at.astype(np.uint32)))
                size += n
                if size >= HELD:
                    yield from _resolve([np.concatenate(c) for c in zip(*held, strict=True)], buckets, True)
                    held, size = [], 0
            for k in range(0, len(texts), 256):
                yield pa.RecordBatch.from_pylist(texts[k : k + 256], schema=_ARROW)
        if held:
            yield from _resolve([np.concatenate(c) for c in zip(*held, strict=True)], buckets, True)

    return rows.mapInArrow(released(run), PACKED)


def shortened(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(doc, key, text, starts) of the documents that lose words by a window, and (doc, key) of the copies of earlier texts."""
    buckets = BUCKETS * max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _identified(docs)
    copies = written(_copies(rows))
    chosen = _reduced(_level_one(rows, length, buckets), False, buckets).select("doc", F.col("starts").alias("anchors"))
    several = rows.groupBy("doc").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("doc", F.lit(True).alias("several"))
    skip = copies.groupBy("doc").agg(F.collect_set("key").alias("skip"))
    chosen = written(chosen.join(several, "doc", "left").join(skip, "doc", "left"))
    two = written(_level_two(rows.join(chosen, "doc").select("doc", "key", "text", "anchors", F.coalesce("several", F.lit(False)).alias("several"), "skip"), length, buckets))
    discard(chosen)
    starts = _reduced(two, True, buckets).withColumnsRenamed({"doc": "doc_", "key": "key_"})
    texts = two.where(F.col("kind") == TEXT).select("doc", "key", "text")
    lost = texts.join(starts, (F.col("doc") == F.col("doc_")) & ((F.col("key_") == 0) | (F.col("key") == F.col("key_"))))
    return lost.select("doc", "key", "text", "starts"), copies


def covered(n: int, starts, length: int) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    step = np.zeros(n + 1, np.int64)
    at = np.unique(np.asarray(starts, np.int64))
    step[at] += 1
    step[at + length] -= 1
    return np.cumsum(step[:n]) > 0


def _shortened_texts(lost: DataFrame, length: int) -> DataFrame:
    """doc, key, n_removed, new_text."""

    def run(batches):
        for batch in batches:
            gone, texts = [], []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                words = words_of(text.as_py())
                at = np.asarray(starts.as_py(), np.int64)
                cover = covered(len(words), at[at <= len(words) - length], length)
                gone.append(int(cover.sum()))
                texts.append(b" ".join(w for w, g in zip(words, cover.tolist(), strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc", "key", "n_removed", "new_text"])

    return lost.mapInArrow(released(run), "doc long, key long, n_removed long, new_text string")  # repeated rows repeat here


@tidy
def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    lost, copies = shortened(docs, length)
    less = _shortened_texts(lost, length).select("doc", "key", F.col("n_removed").alias("gone"), F.sha2("new_text", 256).alias("sha")).dropDuplicates(["doc", "key"])

    def whole(batches):
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column("text")]
            sha = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(map(len, words), pa.int64()), pa.array(sha, pa.string())], names=["doc", "key", "n_words", "whole_sha"])

    out = _identified(docs).mapInArrow(released(whole), "doc long, key long, n_words long, whole_sha string")
    out = out.join(less, ["doc", "key"], "left").join(copies.withColumn("copy", F.lit(True)), ["doc", "key"], "left")
    all_ = F.coalesce(F.col("copy") & (F.col("n_words") >= length), F.lit(False))
    return out.select(
        F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc")).alias("doc_id"), "n_words", F.when(all_, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole_sha")).alias("kept_sha256"),
    )


@tidy
def _marks(docs: DataFrame, length: int) -> DataFrame:
    """doc, key, new_text, copy of the rows that lose words."""
    lost, copies = shortened(docs, length)
    return _shortened_texts(lost, length).select("doc", "key", "new_text", F.lit(False).alias("copy")).union(copies.select("doc", "key", F.lit(""), F.lit(True))).dropDuplicates(["doc", "key"])


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with repeated passages removed from `text`; rows that keep no word by that go, unchanged texts stay as they are."""
    marks = _marks(docs, length)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(doc.alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(marks, ["doc", "key"], "left")
    # a copy goes as a whole if it has a window at all
    short = F.coalesce(F.regexp_count(F.col("row.text"), F.lit(WORD)), F.lit(0)) < length
    joined = joined.where(F.col("new_text").isNull() | (F.col("new_text") != "") | (F.col("copy") & short))
    text = F.when(F.coalesce(F.col("new_text"), F.lit("")) != "", F.col("new_text")).otherwise(F.col("row.text"))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {LENGTH - 2})) AS t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM rep, unnest(range({LENGTH})) AS t(k)),
wd AS (SELECT doc_id, w[p] AS word, p FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
o AS (SELECT wd.doc_id, count(*) AS n_words, count(cov.p) AS n_removed, string_agg(word, ' ' ORDER BY wd.p) FILTER (cov.p IS NULL) AS kept FROM wd LEFT JOIN cov ON wd.doc_id = cov.doc_id AND wd.p = cov.p GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
