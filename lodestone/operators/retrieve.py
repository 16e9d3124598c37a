"""Hybrid retrieval for many questions at once: dense and full-text channels, rank fusion, boosts, top k.

Every step takes a DataFrame of questions, so a question is a partition key of
windows, not a pass of a loop.  Rank limits are windows with a limit on
row_number, which the planner turns into a group limit before the shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.lexicon import UNKNOWN
from lodestone.operators.index import terms

CHANNEL_K, RRF_K, TOP_K, PINS, RERANK_POOL = 30, 60, 8, 6, 20
BM25_K1, BM25_B = 1.2, 0.75
#: Factors on the fused score.
ARTICLE, FAMILY, SERIES, CODE = 1.2, 1.35, 1.15, 1.5
DIGITS = 9


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(scored: DataFrame, k: int, query: str = "query_id", key: str = "chunk_id", score: str = "score") -> DataFrame:
    """The k best of each query with their rank from 1; ties by key."""
    order = Window.partitionBy(query).orderBy(F.round(score, DIGITS).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Components that a cell of `dense` holds, of rows and of questions; scores that it holds at a time; rows that are worth a cell of their own.
ROWS_HELD, QUESTIONS_HELD, SCORES_HELD, LEAST_ROWS = 1 << 22, 1 << 20, 1 << 22, 2048
#: Scores no further apart may round alike, whatever the order of their sums.
NEAR = 2.0 / 10**DIGITS


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows summed from the first component on, as in `cosine`."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _nearest(rows: np.ndarray, void: np.ndarray, questions: np.ndarray, void_q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Places of questions and of rows, cosine, and whether that is null, of pairs that hold the k best of each question.

    rows are in the order of their keys; void rows have null components.  What
    may round to the score of the k-th is there too, so that the order by
    rounded scores can be taken later.
    """
    # of equal rows only the first k can be among the best
    whole = np.column_stack([rows, void])
    alike = np.unique(whole.view(f"V{whole.itemsize * whole.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(alike, kind="stable")
    heads = np.flatnonzero(np.diff(alike[order], prepend=-1))
    nth = np.arange(len(rows)) - np.repeat(heads, np.diff([*heads, len(rows)]))
    kept = np.sort(order[nth < k])
    a, q, void = rows[kept].astype(np.float64), questions.astype(np.float64), void[kept]
    norm_a, norm_q = np.sqrt(_summed(a, a)), np.sqrt(_summed(q, q))
    step = max(1, SCORES_HELD // len(a))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        scale = norm_q[part, None] * norm_a[None, :]
        none = (scale == 0) | void_q[part, None] | void[None, :]
        score = (q[part] @ a.T) / scale
        score = np.where(none, -np.inf, np.where(np.isnan(score), np.inf, score))  # in the order of Spark: null last, NaN first
        least = np.partition(score, len(a) - k, 1)[:, len(a) - k, None] if len(a) > k else -np.inf
        near = score >= least - NEAR
        for odd in (np.inf, -np.inf):  # these tie, so the first k are enough
            if (hit := score == odd).any():
                near &= ~hit | (np.cumsum(hit, 1) <= k)
        i, j = np.nonzero(near)
        yield i + at, kept[j], _summed(q[part][i], a[j]) / scale[i, j], none[i, j]


def _vectors(column: pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as matrix, and which have null components."""
    flat = column.combine_chunks().flatten()
    gone = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(column), length).any(1)
    return flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(column), length), gone


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches sorted by cell."""
    held, now = [], None
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i and cell[i] != now:
                if held:
                    yield pa.Table.from_batches(held)
                held, now = [], cell[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def dense(questions: DataFrame, index: DataFrame, k: int = CHANNEL_K, where: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine; a filter holds before the ranks are taken.

    questions: (query_id, vector), a stated set that is compared with all rows
    of as many components.  Blocks of rows meet blocks of questions in cells,
    where products of matrices choose pairs; their scores are then computed as
    `cosine` does, and the ranks are taken over all cells.
    """
    rows = (index if where is None else index.where(where)).select("chunk_id", F.col("embedding").alias("vector")).where("vector IS NOT NULL")
    asked = questions.select("query_id", "vector").where("vector IS NOT NULL")
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    held = lambda n, most: max(1, -(-n * (sizes["dim"] or 1) // most))
    parts = max(held(sizes["n"], ROWS_HELD), min(index.sparkSession.sparkContext.defaultParallelism, sizes["n"] // LEAST_ROWS))
    parts_q = held(asked.count(), QUESTIONS_HELD)
    float_ = all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (rows, asked))
    vector = F.col("vector").cast("array<float>" if float_ else "array<double>")
    every = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell")
    one = rows.withColumn("own", F.pmod(F.xxhash64("chunk_id", "vector"), F.lit(parts)).cast("int"))
    two = asked.withColumn("own", F.pmod(F.xxhash64("query_id", "vector"), F.lit(parts_q)).cast("int"))
    kinds = {"query_id": asked.schema["query_id"].dataType, "chunk_id": rows.schema["chunk_id"].dataType}
    one = one.select(every(parts_q, lambda j: F.col("own") * parts_q + j), F.lit(None).cast(kinds["query_id"]).alias("query_id"), "chunk_id", vector.alias("vector"), F.lit(False).alias("asks"))
    two = two.select(every(parts, lambda i: i * parts_q + F.col("own")), "query_id", F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"), vector.alias("vector"), F.lit(True).alias("asks"))

    def run(batches):
        for cell in _cells(batches):
            asks = cell.column("asks")
            own, said = cell.filter(pc.invert(asks)), cell.filter(asks)
            own = own.take(pc.sort_indices(own, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
            long, long_q = pc.list_value_length(own.column("vector")), pc.list_value_length(said.column("vector"))
            for length in set(pc.unique(long).to_pylist()) & set(pc.unique(long_q).to_pylist()):
                x, y = own.filter(pc.equal(long, length)), said.filter(pc.equal(long_q, length))
                with np.errstate(all="ignore"):
                    for i, j, score, none in _nearest(*_vectors(x.column("vector"), length), *_vectors(y.column("vector"), length), k):
                        out = pa.table({"query_id": y.column("query_id").take(pa.array(i)), "chunk_id": x.column("chunk_id").take(pa.array(j)), "score": pa.array(score, mask=none)})
                        yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    dealt = one.unionByName(two).repartitionById(parts * parts_q, F.col("cell")).sortWithinPartitions("cell")
    schema = ", ".join(f"{c} {kind.simpleString()}" for c, kind in kinds.items())
    return top_k(dealt.mapInArrow(run, f"{schema}, score double"), k)


def bm25(questions: DataFrame, posts: DataFrame, k: int = CHANNEL_K, allowed: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank) over postings (term, chunk_id, tf, doc_len), or over `index.bags` (chunk_id, terms).

    Statistics are those of all documents; `allowed` (chunk_id) filters before
    the ranks are taken.  lengths: (chunk_id, doc_len) of the documents that
    have postings, where that is cheaper than to take it from these.  Postings
    of a document stay together, so that scores of a document are summed and
    those beyond the k best of a part are dropped before anything is moved; the
    terms of the batch of questions go to all parts.  Bags are whole documents,
    of which no row for each term is ever made: the way for a large table.
    """
    wanted = questions.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    if "terms" in posts.columns:
        return _bagged(wanted, posts, k, allowed)
    stats = (posts if lengths is None else lengths).groupBy("chunk_id").agg(F.first("doc_len").alias("doc_len")).agg(F.count("*").alias("n"), F.avg("doc_len").alias("avgdl"))  # one row
    hits = posts.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits if allowed is None else hits.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    scored = rows.repartition("chunk_id").join(F.broadcast(wanted.join(df, "term")), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / F.col("avgdl")))
    return top_k(scored.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score")), k)


def _counted(batches: Iterator[pa.RecordBatch], known: pa.Array) -> Iterator[pa.RecordBatch]:
    """(chunk_id, doc_len, bag) of documents with terms; a bag holds places of known terms, ascending, and how often each occurs, as 32-bit integers."""
    for batch in batches:
        of = batch.column("terms")
        size = pc.fill_null(pc.list_value_length(of), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place = pc.index_in(of.flatten(), value_set=known)
        hit = place.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)[hit]
        both, tf = np.unique(row * len(known) + place.drop_null().to_numpy(), return_counts=True)
        row, place = (both // len(known), both % len(known)) if len(known) else (both, both)
        pairs = np.column_stack([place, tf]).astype("<i4")
        ends = np.searchsorted(row, np.arange(len(size) + 1))
        bag = pa.array([pairs[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())
        out = pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(size), bag], names=["chunk_id", "doc_len", "bag"])
        yield out.filter(pa.array(size > 0))


def _opened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place of the term and its count, of the bags of each row; in the order of rows and of places, once each."""
    bags = batch.column("bags")
    row = np.repeat(np.arange(len(bags)), bags.value_lengths().to_numpy())
    flat = bags.flatten()
    row = np.repeat(row, pc.binary_length(flat).to_numpy() // 8)
    pairs = np.frombuffer(b"".join(flat.to_pylist()), "<i4").reshape(-1, 2).astype(np.int64)
    place, tf = pairs[:, 0], pairs[:, 1]
    if len(flat) > len(bags):  # rows that repeat a chunk_id are one document
        order = np.lexsort([place, row])
        row, place, tf = row[order], place[order], tf[order]
        heads = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
        row, place, tf = row[heads], place[heads], np.add.reduceat(tf, heads)
    return row, place, tf


def _kept(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """`df` as Parquet in the folder that executors share, and what deletes it."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone"
    path = f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"

    def gone() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    try:
        df.write.parquet(path)
    except BaseException:
        gone()
        raise
    return spark.read.schema(df.schema).parquet(path), gone


def _bagged(wanted: DataFrame, bags: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best of each question; wanted: (query_id, term).

    Scores of a block of documents are summed term by term in the order of the
    terms, so that equal documents score alike wherever they lie.  Texts are
    gone through once: what they hold of the terms is written, both for the
    statistics and for the scores, and deleted when these are written.
    """
    pairs = wanted.toArrow()
    asked = pairs.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    known = pc.unique(pairs.column("term")).sort()
    asks = asked.dictionary
    # for each term its questions, and how often they hold it: a query_id that repeats is one question
    both, times = np.unique(pc.index_in(pairs.column("term"), value_set=known).to_numpy().astype(np.int64) * max(len(asks), 1) + asked.indices.to_numpy(), return_counts=True)
    of, who = both // max(len(asks), 1), both % max(len(asks), 1)
    ends = np.searchsorted(of, np.arange(len(known) + 1))

    kind = {"query_id": wanted.schema["query_id"].dataType.simpleString(), "chunk_id": bags.schema["chunk_id"].dataType.simpleString()}
    packed = bags.select("chunk_id", "terms").mapInArrow(lambda batches: _counted(batches, known), f"chunk_id {kind['chunk_id']}, doc_len long, bag binary")
    docs, gone = _kept(packed.groupBy("chunk_id").agg(F.first("doc_len").alias("doc_len"), F.collect_list("bag").alias("bags")))

    def held(batches):
        n, words, df = 0, 0, np.zeros(len(known), np.int64)
        for batch in batches:
            n, words = n + batch.num_rows, words + (pc.sum(batch.column("doc_len")).as_py() or 0)
            df += np.bincount(_opened(batch)[1], minlength=len(known))
        yield pa.RecordBatch.from_pydict({"n": [n], "words": [words], "df": [df.astype("<i8").tobytes()]})

    def summed(batches):
        n, words, df = 0, 0, np.zeros(len(known), np.int64)
        for part in (part for batch in batches for part in batch.to_pylist()):
            n, words, df = n + part["n"], words + part["words"], df + np.frombuffer(part["df"], "<i8")
        yield pa.RecordBatch.from_pydict({"n": [n], "words": [words], "df": [df.astype("<i8").tobytes()]})

    def scored() -> DataFrame:
        parts = docs.select("doc_len", "bags").mapInArrow(held, "n long, words long, df binary").repartition(8).mapInArrow(summed, "n long, words long, df binary")
        n, words, df = 0, 0, np.zeros(len(known), np.int64)
        for part in parts.toLocalIterator():
            n, words, df = n + part["n"], words + part["words"], df + np.frombuffer(part["df"], "<i8")
        rows = docs if allowed is None else docs.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
        run = _scorer(known, asks, who, times, ends, np.log(1 + (n - df + 0.5) / (df + 0.5)), words / n if n else 1.0, k)
        return top_k(rows.select("chunk_id", "doc_len", "bags").mapInArrow(run, f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, score double"), k)

    try:
        return _kept(scored())[0]
    finally:
        gone()


def _scorer(known: pa.Array, asks: pa.Array, who: np.ndarray, times: np.ndarray, ends: np.ndarray, idf: np.ndarray, avgdl: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow from documents (chunk_id, doc_len, bags) to (query_id, chunk_id, score) that hold the k best of each question."""
    step = max(1, SCORES_HELD // max(len(asks), 1))

    def run(batches):
        floor = np.full(len(asks), -np.inf)  # the k-th best of a block so far
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("chunk_id"), null_placement="at_start"))
            for at in range(0, batch.num_rows if len(asks) else 0, step):
                part = batch.slice(at, step)
                row, place, tf = _opened(part)
                long = part.column("doc_len").to_numpy()[row]
                weight = idf[place] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * long / avgdl))
                order = np.argsort(place, kind="stable")
                row, weight = row[order], weight[order]
                cuts = np.searchsorted(place[order], np.arange(len(known) + 1))
                score = np.zeros((len(asks), part.num_rows))
                for t in np.flatnonzero(np.diff(cuts)):
                    i, j, x, y = cuts[t], cuts[t + 1], ends[t], ends[t + 1]
                    score[who[x:y, None], row[i:j]] += times[x:y, None] * weight[i:j]
                if part.num_rows > k:
                    floor = np.maximum(floor, np.partition(score, part.num_rows - k, 1)[:, part.num_rows - k])
                i, j = np.nonzero((score > 0) & (score >= floor[:, None] - NEAR))  # a term that is held weighs more than 0
                own = score[i, j]
                # of equal scores only the first k can be among the best
                order = np.lexsort([j, own, i])
                i, j, own = i[order], j[order], own[order]
                heads = np.flatnonzero((np.diff(i, prepend=-1) != 0) | (np.diff(own, prepend=-1.0) != 0))
                first = np.arange(len(i)) - np.repeat(heads, np.diff([*heads, len(i)])) < k
                i, j, own = i[first], j[first], own[first]
                yield pa.RecordBatch.from_arrays([asks.take(pa.array(i)), part.column("chunk_id").take(pa.array(j)), pa.array(own)], names=["query_id", "chunk_id", "score"])

    return run


def fuse(channels: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, fused_score, ranks): the sum of 1 / (k + rank) over the channels that hold a chunk."""
    parts = [df.select("query_id", "chunk_id", F.lit(name).alias("channel"), "rank") for name, df in channels.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    ranks = F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "rank"))))  # one entry a channel
    return rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused_score"), ranks.alias("ranks"))


def boost(candidates: DataFrame) -> DataFrame:
    """boosted_score and the names of the boosts; nothing is dropped.

    Columns of the chunk: content_stream, product_family, model_series,
    fault_codes; of the question: q_family, q_series, q_codes.
    """
    upper = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.upper(x))
    overlap = lambda a, b: F.coalesce(F.arrays_overlap(upper(F.col(a)), upper(F.col(b))), F.lit(False))
    rules = {
        "diagnostic_article": (F.col("content_stream") == "diagnostic_article", ARTICLE),
        "product_family": ((F.col("q_family") != UNKNOWN) & (F.col("product_family") == F.col("q_family")), FAMILY),
        "model_series": (overlap("model_series", "q_series"), SERIES),
        "code_match": (overlap("fault_codes", "q_codes"), CODE),
    }
    score = F.col("fused_score")
    for hit, factor in rules.values():
        score = score * F.when(hit, F.lit(factor)).otherwise(F.lit(1.0))
    names = F.filter(F.array(*[F.when(hit, F.lit(name)) for name, (hit, _) in rules.items()]), lambda x: x.isNotNull())
    return candidates.withColumns({"boosted_score": score, "boosts": names})


def rerank_identity(candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    score = F.coalesce("boosted_score", "fused_score")
    return top_k(candidates.withColumns({"rerank_score": score, "rerank_backend": F.lit("identity")}), k, score="rerank_score")


def rerank_by_order(candidates: DataFrame, orders: DataFrame, k: int = TOP_K, pool: int = RERANK_POOL) -> DataFrame:
    """Ranks by a given order: orders (query_id, order array<int>) of 1-based positions in the pool.

    Positions out of range and repeats are dropped; passages left out follow in
    their old order with score 0; questions without an order keep theirs.
    """
    head = top_k(candidates, pool, score="boosted_score").withColumnRenamed("rank", "position")
    said = orders.select(F.col("query_id").alias("q"), F.posexplode(F.array_distinct("order")).alias("at", "position_"))
    joined = head.join(said, (F.col("query_id") == F.col("q")) & (F.col("position") == F.col("position_")), "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("at").asc_nulls_last(), "position"))
    judged = F.max(F.col("at").isNotNull()).over(Window.partitionBy("query_id"))  # at most `pool` rows
    score = F.when(~judged, F.col("boosted_score")).when(F.col("at").isNull(), 0.0).otherwise(1 - 0.01 * (place - 1))
    ranked = joined.withColumns({"rank": place, "rerank_score": score, "rerank_backend": F.when(judged, "llm").otherwise("identity")})
    return ranked.where(F.col("rank") <= k).drop("q", "at", "position_", "position")


def rerank_with(candidates: DataFrame, model: Callable[[str, list[str]], Sequence[int]], k: int = TOP_K, pool: int = RERANK_POOL) -> DataFrame:
    """Asks an injected model for the order of each question's pool (columns query, text); its failure leaves the order."""
    head = top_k(candidates, pool, score="boosted_score")
    asked = head.groupBy("query_id").agg(F.first("query").alias("query"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("p")).select("query_id", "query", F.transform("p", lambda x: x["text"]).alias("texts"))

    def run(frames):
        for pdf in frames:
            orders = []
            for q, texts in zip(pdf["query"], pdf["texts"], strict=True):
                try:
                    orders.append([int(x) for x in model(q, list(texts)) if not isinstance(x, bool)])
                except Exception:  # noqa: BLE001  any failure of a model means the old order
                    orders.append([])
            yield pdf[["query_id"]].assign(order=orders)

    return rerank_by_order(candidates, asked.mapInPandas(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, order array<int>"), k, pool)


def lookup_codes(questions: DataFrame, codes: DataFrame, cap: int = PINS) -> DataFrame:
    """Pinned code rows of each question (query_id, q_codes, q_family), in the order of its codes.

    Without a family every meaning is ambiguous; else the family's own rows, or all as cross_family.
    """
    asked = questions.select("query_id", "q_family", F.posexplode("q_codes").alias("code_pos", "code_key"))
    hits = asked.join(codes, "code_key")
    hits = hits.withColumn("own", F.col("product_family") == F.col("q_family"))
    per = Window.partitionBy("query_id", "code_pos")
    hits = hits.withColumn("any_own", F.max("own").over(per))
    named = F.col("q_family") != UNKNOWN
    hits = hits.where(~named | F.col("own") | ~F.col("any_own")).withColumns({"ambiguous": ~named, "cross_family": named & ~F.col("any_own")})
    order = Window.partitionBy("query_id").orderBy("code_pos", "product_family")
    return hits.withColumn("pin", F.row_number().over(order)).where(F.col("pin") <= cap).drop("own", "any_own")


def compare_rankings(one: DataFrame, two: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, overlap, moved, top1_changed) of two rankings (query_id, chunk_id, rank)."""
    a = one.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("r1"))
    b = two.where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("r2"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    return both.groupBy("query_id").agg(
        F.count_if(F.col("r1").isNotNull() & F.col("r2").isNotNull()).alias("overlap"),
        F.count_if(~F.col("r1").eqNullSafe(F.col("r2"))).alias("moved"),
        (~F.max(F.coalesce((F.col("r1") == 1) & (F.col("r2") == 1), F.lit(False)))).alias("top1_changed"),
    )
