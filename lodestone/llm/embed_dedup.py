"""Embedding near-dedup by an epsilon grid order join.

Vectors of unit length with a cosine of at least t are at most eps =
sqrt(2 - 2 t) apart, and no projection moves them further apart.  Vectors are
projected on their leading principal dimensions, sorted by the cells of a grid
of side eps there (label first), and cut into blocks of BLOCK consecutive ones.
Blocks whose first cells are not next to each other, or whose boxes are more
than eps apart, are provably distant and never meet.  Two blocks that may
hold links are joined by recursion: two sequence intervals that are distant
are skipped, small ones are compared in double precision, others are halved.

Equal vectors of a label are one class, found by hash and compared as one with
its number of copies, so copies are never expanded into pairs.  A pair of
blocks gives for each vector the number of its links and one edge to the
smallest vec_id of what it hangs together with there, never the pairs.

Labels may be of any size: the range partitioning goes by label, cells and
hash, so a label with a third of all vectors is many blocks in many tasks.

Defined results for odd input: null label, and vectors that are null, empty,
zero or hold null or non-finite components, link with nothing; so do vectors
of different lengths with each other, and rows with null vec_id, whose
component_id is null and which are kept.  A vec_id that occurs in several rows
names each of them: they share a component, and their links count for each
row's own vector.  Extra columns are ignored.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestone.llm.common import components, discard, released, tidy, written

COSINE = 0.98
#: Principal dimensions of the grid.
DIMS = 6
#: Vectors of a block, and of an interval that is compared directly.
BLOCK = 512
LEAF = 64
#: Vectors that the principal dimensions are taken from, first by hash; any orthonormal basis gives the same links, and a good one prunes more.
SAMPLE = 4096
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length, scaled first so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors in a bounded sample the DIMS leading principal dimensions."""
    rows = classes.orderBy("h1", "h2").limit(SAMPLE).select("embedding").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.embedding), []).append(r.embedding)
    out = {}
    for dim, own in by.items():
        x = unit(np.array(own, float))
        x = x - x.mean(0)
        out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :DIMS]
    return out


def _project(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    p = x @ basis if basis is not None else x[:, :DIMS]
    return np.pad(p, ((0, 0), (0, DIMS - p.shape[1])))


def _near(lo1, hi1, lo2, hi2, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(lo2 - hi1, lo1 - hi2))
    return float(gap @ gap) <= eps * eps


def links_between(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, cosine: float, same: bool) -> np.ndarray:
    """Which vectors of x link with which of y (with same: of x, above the diagonal), as a boolean matrix."""
    eps = math.sqrt(2 - 2 * cosine) + SLACK
    found = np.zeros((len(x), len(y)), bool)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and a >= d:
            continue
        if not _near(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0), eps):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            found[a:b, c:d] = x[a:b] @ y[c:d].T >= cosine
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return np.triu(found, 1) if same else found


def _lowest(found: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the smallest id of those it hangs together with in this pair of blocks."""
    top = np.iinfo(np.int64).max
    a, b = a.copy(), (a if same else b).copy()
    while True:
        b2 = np.minimum(b, np.where(found, a[:, None], top).min(0))
        a2 = np.minimum(a, np.where(found, b2[None, :], top).min(1))
        if same:
            a2 = b2 = np.minimum(a2, b2)
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def _blocks(classes: DataFrame, basis: dict[int, np.ndarray], cosine: float) -> DataFrame:
    eps = math.sqrt(2 - 2 * cosine) + SLACK

    def place(batches):
        for batch in batches:
            dims = np.array(batch.column("dim"))
            cells = np.zeros((len(dims), DIMS), np.int32)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                x = unit(matrix(batch.column("embedding").take(pa.array(at)), dim))
                cells[at] = np.floor(_project(x, basis.get(dim)) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(DIMS)]], names=[*batch.schema.names, *[f"c{k}" for k in range(DIMS)]])

    schema = StructType([*classes.schema.fields, *[StructField(f"c{k}", IntegerType()) for k in range(DIMS)]])
    order = ["label", "dim", *[f"c{k}" for k in range(DIMS)], "h1", "h2"]
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    sorted_ = classes.mapInArrow(released(place), schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches):
        part, number, held, key = TaskContext.get().partitionId(), 0, [], None

        def block():
            nonlocal number, held
            dim = key[1]
            x = np.array([r[0] for r in held], np.float64)
            p = _project(unit(x), basis.get(dim))
            first = [r[5] for r in held]
            row = {
                "block": (part << 32) + number, "label": key[0], "dim": dim, "first": min(first), "last": max(first), "lo": p.min(0).tolist(), "hi": p.max(0).tolist(),
                "h1": [r[1] for r in held], "h2": [r[2] for r in held], "rep": [r[3] for r in held], "n": [r[4] for r in held], "x": x.tobytes(),
            }
            number, held = number + 1, []
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_ARROW)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("embedding", "h1", "h2", "rep", "n", "c0", "label", "dim")]
            for r in zip(*columns, strict=True):
                if held and ((r[6], r[7]) != key or len(held) == BLOCK):
                    yield block()
                key = (r[6], r[7])
                held.append(r)
        if held:
            yield block()

    return sorted_.mapInArrow(released(cut), BLOCK_SCHEMA)


BLOCK_SCHEMA = "block long, label long, dim int, first int, last int, lo array<double>, hi array<double>, h1 array<long>, h2 array<long>, rep array<long>, n array<long>, x binary"
_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("lo", _DOUBLES), ("hi", _DOUBLES)]
    + [("h1", _LONGS), ("h2", _LONGS), ("rep", _LONGS), ("n", _LONGS), ("x", pa.binary())]
)


def _pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, that are not provably distant."""
    eps = math.sqrt(2 - 2 * cosine) + SLACK
    meta = blocks.select("block", "label", "dim", "lo", "hi", F.explode(F.sequence(F.col("first"), F.col("last") + 1)).alias("cell"))
    a = meta.select(F.col("block").alias("a"), "label", "dim", "cell", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    b = meta.select(F.col("block").alias("b"), "label", "dim", "cell", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    gap = [F.greatest(F.lit(0.0), F.get("lo2", F.lit(k)) - F.get("hi1", F.lit(k)), F.get("lo1", F.lit(k)) - F.get("hi2", F.lit(k))) for k in range(DIMS)]
    apart = sum((g * g for g in gap), F.lit(0.0))
    return a.join(b, ["label", "dim", "cell"]).where("a <= b").where(apart <= eps * eps).select("a", "b").distinct()


def _joined(blocks: DataFrame, bases_: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Rows (h1, h2, links, rep, low): of a vector in a pair of blocks the weight of its links, and the lowest id there."""
    one = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("dim", "h1", "h2", "rep", "n", "x")])
    two = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("h1", "h2", "rep", "n", "x")])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same, dim = r["a"] == r["b"], r["dim_a"]
                x = unit(np.frombuffer(r["x_a"]).reshape(-1, dim))
                y = x if same else unit(np.frombuffer(r["x_b"]).reshape(-1, dim))
                basis = bases_.get(dim)
                px, py = _project(x, basis), _project(y, basis)
                found = links_between(x, px, y, py, cosine, same)
                if not found.any():
                    continue
                get = lambda k, s: np.array(r[f"{k}_{s}"], np.int64)  # noqa: B023, E731
                na, nb, ra, rb = get("n", "a"), get("n", "b"), get("rep", "a"), get("rep", "b")
                la, lb = _lowest(found, ra, rb, same)
                if same:
                    both = found | found.T
                    sides = [("a", both @ na, ra, la)]
                else:
                    sides = [("a", found @ nb, ra, la), ("b", na @ found, rb, lb)]
                for s, links, rep, low in sides:
                    at = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (get("h1", s), get("h2", s), links, rep, low)], names=["h1", "h2", "links", "rep", "low"])

    pairs = _pairs(blocks, cosine).join(one, "a").join(two, "b")
    return pairs.mapInArrow(released(run), "h1 long, h2 long, links long, rep long, low long")


@tidy
def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    key = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit("b"), F.reverse("embedding"), "label").alias("h2")]
    members = v.where("good").select("vec_id", "label", "embedding", *key)
    classes = members.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("dim", F.size("embedding")))
    basis = bases(classes)  # some kB for each length of vectors in the sample
    blocks = written(_blocks(classes, basis, cosine))
    hits = written(_joined(blocks, basis, cosine))
    links = hits.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    comp = components(hits.where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    known = classes.select("h1", "h2", "rep", "n").join(links, ["h1", "h2"], "left").join(comp, F.col("rep") == F.col("id"), "left")
    known = written(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    discard(blocks)
    out = members.select("vec_id", "h1", "h2").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = v.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {COSINE}::DOUBLE),
r(id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
