"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is that of its distinct LENGTH-word shingles.  Of each set a
signature of COORDINATES minwise values is kept.  In each of TREES independent
trees, the documents of a node choose coordinates by a hash of the node, one
always and a second one time in four (1 / SIMILARITY on average), and go on to
the nodes of their minwise tokens there; so a pair meets again at every level
with the probability of its similarity or more.  Nodes of at most SMALL
documents are compared exhaustively, larger ones branch again.

What is wanted are components, so work that cannot change them is left out:

* documents with equal sets are one class, compared once;
* documents that meet the smallest member of their nodes time and again are
  held against that one first, and what is confirmed gives first components,
  which closes every node that lies within one of them;
* a large node of which half or more is alike (estimated from its pivot, or in
  the component of most of its members) is not branched again, as branching
  would hardly split it: its members are held against the likest of their
  nodes' pivots, and then it is cut into blocks, in which its largest component
  meets all others, so that its work is linear in that component; such nodes of
  all trees and levels with much the same members are cut as one, so that a
  group is compared once, not once in each node;
* each node or block first offers a spanning forest of its likeliest links, at
  most one link fewer than it has components; only what is still apart when
  these are confirmed is compared in full, on the sets themselves, and of that
  too a spanning forest is given.

So no pairs of a group are ever listed, and there is no cap on partners or
candidates.  After LEVELS levels what is left goes into blocks whatever it is.

Signatures only choose pairs (from an estimate of SIMILARITY - SLACK); every
link is confirmed on the two full sets, 100 |A n B| >= 80 |A u B|.

Defined results for odd input: null and empty texts, and texts without words,
have no shingles and link with nothing; rows with null doc_id link with
nothing, have a null component and are kept.  Rows that repeat a doc_id are
one document for links; each keeps its own n_shingles.  Extra columns are
ignored by `linked` and carried by `keep`.  An empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import components, discard, released, tidy, written
from lodestone.llm.shingles import mixed, shingle_set

LENGTH = 2
PERCENT = 80
COORDINATES = 128
TREES = 12
SMALL = 200
SLACK = 0.12
#: Members of the largest component of a node that are compared at a time, and levels of branching at most.
BLOCK = 512
LEVELS = 12
#: One in so many rows of large nodes must be alike to its pivot and of another component for these to be held against the pivots first.
GAIN = 16
#: First nodes, of about 15, that a document shares with the smallest of them before their sets are fetched for the first components.
MET = 4

_G = np.random.default_rng(20)
_A = _G.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _G.integers(0, 1 << 63, COORDINATES, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """The minwise tokens."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        low = np.minimum(low, (own[None, at : at + 512] * _A[:, None] + _B[:, None]).min(1))
    return mixed(low)


def chosen(node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each choice the places of the nodes that make it, and their coordinates."""
    choice = mixed(node + np.uint64(17))
    second = np.flatnonzero((choice >> np.uint64(32)) % np.uint64(4) == 0)
    return [(np.arange(len(node)), choice % np.uint64(COORDINATES)), (second, (choice[second] >> np.uint64(40)) % np.uint64(COORDINATES))]


def step(node: np.ndarray, choice: int, coordinate: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(mixed(node + np.uint64(choice)) ^ (coordinate << np.uint64(52))) ^ token)


_ROOTS = mixed(np.arange(TREES, dtype=np.uint64) + np.uint64(1000))
_FIRST = [(k, _ROOTS[at], c) for k, (at, c) in enumerate(chosen(_ROOTS))]


def signatures(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (hash of the set), sketch (8 bits of each token), tokens (16 bits), roots (first nodes) of every row."""

    def run(batches):
        for batch in batches:
            n, s1, s2, sketch, tokens, roots = [], [], [], [], [], []
            for t in batch.column("text"):
                own = shingle_set(t.as_py(), length)
                digest = np.frombuffer(xxhash.xxh128_digest(own.tobytes()), np.int64)
                n.append(len(own))
                s1.append(int(digest[0]))
                s2.append(int(digest[1]))
                sig = signature(own)
                sketch.append(sig.astype(np.uint8).tobytes())
                tokens.append(sig.astype("<u2").tobytes())
                first = [step(node, k, at, sig[at.astype(np.int64)]) for k, node, at in _FIRST]
                roots.append(np.concatenate(first).astype(np.int64).tolist() if len(own) else [])
            arrays = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, s1, s2)], pa.array(sketch, pa.binary()), pa.array(tokens, pa.binary()), pa.array(roots, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "s1", "s2", "sketch", "tokens", "roots"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(released(run), "doc_id long, n_shingles long, s1 long, s2 long, sketch binary, tokens binary, roots array<long>")


def _next(node: np.ndarray, tokens: np.ndarray) -> pa.ListArray:
    """The nodes of the next level of each row, one or two, from rows of nodes and their tokens."""
    to, of = [], []
    for k, (at, coordinate) in enumerate(chosen(node)):
        to.append(step(node[at], k, coordinate, tokens[at, coordinate.astype(np.int64)].astype(np.uint64)))
        of.append(at)
    to, of = np.concatenate(to), np.concatenate(of)
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(node)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(to[np.argsort(of, kind="stable")].view(np.int64)))


def _signed(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows (node, rep, label) with the sketch of each and its nodes of the next level; the sketch is the low byte of each token."""

    def run(batches):
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u2").reshape(-1, COORDINATES)
            node = batch.column("node").to_numpy().view(np.uint64)
            sketch = pa.array([x.tobytes() for x in own.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "rep", "label")], sketch, _next(node, own)], names=["node", "rep", "label", "sketch", "next"])

    return rows.join(tokens, "rep").select("node", "rep", "label", "tokens").mapInArrow(released(run), "node long, rep long, label long, sketch binary, next array<long>")


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For all rows of two blocks of sketches the number of places at which they agree."""
    if len(x) * len(y) <= 1024:
        return (x[:, None, :] == y[None, :, :]).sum(2)
    out = np.zeros((len(x), len(y)), np.uint8 if COORDINATES < 256 else np.int32)
    for k in range(COORDINATES):
        out += x[:, k, None] == y[None, :, k]
    return out.astype(np.int64)


def merged(component: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components, numbered from 0, after the components of places a and b are joined."""
    up = np.arange(component.max() + 1)

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(component[a].tolist(), component[b].tolist(), strict=True):
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    return np.array([top(i) for i in range(len(up))])[component]


def forest(weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that join all labels which links of a weight over 0 join: in each round the heaviest of each component."""
    component = np.unique(label, return_inverse=True)[1]
    ends = [np.empty((0, 2), np.int64)]
    while True:
        weight = np.where(component[:, None] == component[None, :], 0, weight)
        best, to = weight.max(1), weight.argmax(1)
        order = np.lexsort((-best, component))
        heads = order[np.concatenate([[True], np.diff(component[order]) != 0])]
        heads = heads[best[heads] > 0]
        if not len(heads):
            found = np.concatenate(ends)
            return found[:, 0], found[:, 1]
        ends.append(np.unique(np.sort(np.stack([heads, to[heads]], 1), 1), axis=0))
        component = merged(component, heads, to[heads])


def _of_each(batches, key: str):
    """The rows of each key, as dictionaries of arrays; batches are sorted by the key, and one key is held at a time."""
    rest = None
    for batch in _and_none(batches):
        if batch is not None:
            rest = pa.Table.from_batches([*(rest.to_batches() if rest is not None else ()), batch])
        if rest is None or not rest.num_rows:
            continue
        table = rest.combine_chunks()
        keys = table.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        full = len(keys) if batch is None else (int(cuts[-1]) if len(cuts) else 0)
        if full:
            columns = {c: _array(table.column(c)) for c in table.column_names}
            edges = [0, *cuts[cuts < full].tolist(), full]
            for i, j in zip(edges, edges[1:], strict=False):
                yield {c: v[i:j] for c, v in columns.items()}
        rest = table.slice(full)


def _and_none(batches):
    yield from batches
    yield None


def _array(column):
    """A column as numpy array; binaries of COORDINATES bytes as matrix, others as list."""
    if pa.types.is_binary(column.type):
        values = column.to_pylist()
        return np.frombuffer(b"".join(values), np.uint8).reshape(-1, COORDINATES) if all(len(x) == COORDINATES for x in values) else values
    return column.to_numpy()


def likeliest(cells: DataFrame, least: float) -> DataFrame:
    """Rows (cell, a, b): for each cell a spanning forest of the likeliest links between its labels; from rows (cell, rep, label, sketch)."""
    need = math.ceil(least * COORDINATES)

    def run(batches):
        found = []
        for own in _of_each(batches, "cell"):
            like = likeness(own["sketch"], own["sketch"])
            a, b = forest(np.where(like >= need, like, 0), own["label"])
            if len(a):
                found.append(np.stack([own["rep"][a], own["rep"][b], np.repeat(own["cell"][:1], len(a))], 1))
            if sum(map(len, found)) > 4096:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(run), "a long, b long, cell long")


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs, the smaller end first, and what stands beside them."""
    found = np.concatenate(found)
    found[:, :2].sort(1)
    return pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(found.shape[1])], names=["a", "b", "cell"][: found.shape[1]])


def groups(cells: DataFrame, least: float) -> DataFrame:
    """Rows (members) of each cell: documents that hang together by likely links between different labels; rows (cell, rep, label, sketch)."""
    need = math.ceil(least * COORDINATES)

    def run(batches):
        for own in _of_each(batches, "cell"):
            rep, label = own["rep"], own["label"]
            weight = np.where((label[:, None] != label[None, :]) & (likeness(own["sketch"], own["sketch"]) >= need), 1, 0)
            component = np.arange(len(rep))
            component = merged(component, *forest(weight, component))
            of = [np.sort(rep[component == c]) for c in np.unique(component[weight.any(1)])]
            if of:
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.list_(pa.int64()))], names=["members"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(released(run), "members array<long>").distinct()


class _Sets:
    """Full sets of documents, computed from their texts when first wanted."""

    def __init__(self, docs: DataFrame, length: int):
        self.docs, self.length, self.have = docs, length, []

    def of(self, wanted: DataFrame) -> DataFrame:
        """Rows (rep, own) with the sets of the wanted reps."""
        wanted = wanted.distinct()
        for table in self.have:
            wanted = wanted.join(table.select("rep"), "rep", "left_anti")
        wanted = written(wanted)
        if not wanted.isEmpty():
            length = self.length

            def run(batches):
                for batch in batches:
                    sets = [shingle_set(t.as_py(), length).tobytes() for t in batch.column("text")]
                    yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "own"])

            texts = self.docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).where("rep IS NOT NULL AND text IS NOT NULL")
            self.have.append(written(texts.join(wanted, "rep", "left_semi").mapInArrow(released(run), "rep long, own binary").distinct()))
        discard(wanted)
        out = self.have[0] if self.have else None
        for table in self.have[1:]:
            out = out.union(table)
        return out


def confirmed(pairs: DataFrame, sets: _Sets, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) that reach the similarity on their full sets."""
    own = sets.of(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
    if own is None:
        return pairs.select("a", "b").where("false")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    one = own.select(F.col("rep").alias("a"), F.col("own").alias("own_a"))
    two = own.select(F.col("rep").alias("b"), F.col("own").alias("own_b"))
    return written(pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(released(run), "a long, b long"))


#: Entries of the sets of a group that are counted at a time; beyond it, its pairs are looked at one by one.
ENTRIES = 1_000_000


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """For all pairs of sets the size of their intersection."""
    n, sizes = len(sets), list(map(len, sets))
    out = np.zeros((n, n), np.int64)
    if n == 2 or sum(sizes) > ENTRIES:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out + np.diag(sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, several = np.repeat(np.arange(n), sizes), count[token] > 1
    number = np.cumsum(count > 1) - 1
    who, token = who[several], number[token[several]]
    order = np.argsort(token, kind="stable")
    who, token = who[order], token[order]
    for at in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
        i, j = np.searchsorted(token, [at, at + 4096])
        has = np.zeros((n, 4096), np.float32)  # sums of up to 4096 ones are exact
        has[who[i:j], token[i:j] - at] = 1
        out += (has @ has.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = sizes
    return out


def within(members: DataFrame, sets: _Sets, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join what reaches the similarity on full sets in each group, a spanning forest; rows (group, rep, label)."""
    own = sets.of(members.select("rep"))
    if own is None:
        return members.selectExpr("rep AS a", "rep AS b").where("false")

    def run(batches):
        for of in _of_each(batches, "group"):
            full = [np.frombuffer(x, np.uint64) for x in of["own"]]
            size = np.array(list(map(len, full)))
            both = shared(full)
            good = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
            a, b = forest(good.astype(np.int64), of["label"])
            if len(a):
                yield _pairs([np.stack([of["rep"][a], of["rep"][b]], 1)])

    rows = members.join(own, "rep").select("group", "rep", "label", "own")
    return written(rows.repartition("group").sortWithinPartitions("group").mapInArrow(released(run), "a long, b long"))


class _Links:
    """What is known of links while they are sought: pairs that were tried, confirmed ones, and the components these give."""

    def __init__(self, sets: _Sets, percent: int):
        self.sets, self.percent = sets, percent

    def new(self, pairs: DataFrame) -> DataFrame:
        return written(pairs.distinct().join(self.tried, ["a", "b"], "left_anti"))

    def hold(self, pairs: DataFrame) -> None:
        """Confirms what `new` gave, and takes the components of all that is confirmed."""
        self.tried = self.tried.union(pairs)
        self.join(confirmed(pairs, self.sets, self.percent))

    def star(self, pairs: DataFrame) -> None:
        """The first pairs, one to a smaller a for each b: components are two steps along these, which need not be the last."""
        self.tried = written(pairs)
        self.edges = confirmed(self.tried, self.sets, self.percent)
        step = self.edges.select(F.col("b").alias("id"), F.col("a").alias("component")).distinct()
        for _ in range(2):
            on = step.select(F.col("id").alias("at"), F.col("component").alias("to"))
            step = written(step.join(on, F.col("component") == F.col("at"), "left").select("id", F.coalesce("to", "component").alias("component")))
        self.first = step

    def join(self, edges: DataFrame | None = None) -> None:
        self.edges = self.edges if edges is None else self.edges.union(edges)
        self.first = written(components(self.edges))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with a column `rep`, and their components so far as `label`."""
        return rows.join(self.first, F.col("rep") == F.col("id"), "left").withColumn("label", F.coalesce("component", "rep")).drop("id", "component")


def _numbers(n, m):
    """In how many blocks the largest component of a node is cut, and in how many chunks its m others; of n members."""
    number = lambda what, size: F.greatest(F.ceil(what / size), F.lit(1)).cast("long")
    return number(n - m, BLOCK), number(m, SMALL)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (cell, rep) from rows (node, rep, label, top, n, m): each node's largest component in blocks, of which each meets all chunks of the m others."""
    blocks, others = _numbers(F.col("n"), F.col("m"))
    rows = rows.withColumn("others", others).withColumn("blocks", blocks)
    main = F.col("label") == F.col("top")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit("place"), "rep"), F.when(main, F.col("blocks")).otherwise(F.col("others"))))
    cell = lambda kind, x, y: F.xxhash64("node", F.lit(kind), x, y)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda j: cell("main", F.col("own"), j))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: cell("main", i, F.col("own")))
    rest = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("others") - 1), lambda j: j != F.col("own")), lambda j: cell("others", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    return rows.select(F.explode(F.when(main, meets).otherwise(F.concat(met, rest))).alias("cell"), "rep")


def _topped(rows: DataFrame) -> DataFrame:
    """node, key, top (the label of most members), n (members) and m (those of other labels) of each node that is open; from rows (node, key, rep, label)."""
    of = rows.groupBy("node", "key", "label").agg(F.count("*").alias("c"))
    sums = of.groupBy("node", "key").agg(F.max(F.struct("c", F.xxhash64("node", "label"), "label")).alias("t"), F.sum("c").alias("n"))
    return sums.select("node", "key", F.col("t.label").alias("top"), "n", (F.col("n") - F.col("t.c")).alias("m")).where("m > 0")


def _together(rows: DataFrame) -> DataFrame:
    """Rows (node, rep, label, top, n, m) for `_blocks`, in which all meet that meet in a node; from rows (node, rep, label, near) of nodes that are alike.

    A large group is in nodes of all trees, with much the same members, and a
    pair need be compared once only.  So nodes whose near members have the same
    smallest label, which is likelier the more they share, are taken as one,
    where that makes fewer rows than they do apart.
    """
    keys = rows.where("near").groupBy("node").agg(F.min("label").alias("key"))
    apart = rows.join(keys, "node").select("node", "key", "rep", "label")
    joint = apart.select(F.xxhash64(F.lit("joint"), "key").alias("node"), "key", "rep", "label").distinct()
    apart, joint = written(apart), written(joint)
    nodes = written(_topped(apart).withColumn("one", F.lit(False)).union(_topped(joint).withColumn("one", F.lit(True))))
    blocks, others = _numbers(F.col("n"), F.col("m"))
    work = (F.col("n") - F.col("m")) * others + F.col("m") * (blocks + others - 1)
    fewer = nodes.groupBy("key").agg(F.sum(F.when(F.col("one"), work)).alias("x"), F.sum(F.when(~F.col("one"), work)).alias("y")).select("key", F.coalesce(F.col("x") <= F.col("y"), F.col("y").isNull()).alias("better"))
    nodes = nodes.join(fewer, "key").where("one = better").select("node", "top", "n", "m")
    return apart.union(joint).select("node", "rep", "label").join(nodes, "node")


def _open(rows: DataFrame, key: str) -> DataFrame:
    """The keys of rows (key, label) that hold different labels, with the number of their rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(key, "n")


def _cells(rows: DataFrame, sketches: DataFrame, tokens: DataFrame, links: _Links, least: float) -> DataFrame:
    """Rows (cell, rep): where documents of different labels are compared; from rows (node, rep) of the first level.

    The alike members of a large node are first held against its pivot, one of
    its largest component and another one in each node, so that few are left
    beside that component when the node is cut into blocks.
    """
    need = math.ceil(least * COORDINATES)

    def alike(batches):
        for batch in batches:
            x, y = _array(batch.column("sketch")), _array(batch.column("pivot_sketch"))
            near = pa.array((x == y).sum(1).astype(np.int32) if batch.num_rows else [], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "rep", "label", "pivot", "top", "next")], near], names=["node", "rep", "label", "pivot", "top", "next", "like"])

    small, alike_ones = [], []
    main = F.col("label") == F.col("top")
    for level in itertools.count():
        rows = links.labelled(rows)
        rows = written(rows.join(_open(rows, "node"), "node"))
        small.append(rows.where(f"n <= {SMALL}").select(F.col("node").alias("cell"), "rep"))
        large = rows.where(f"n > {SMALL}").select("node", "rep", "label")
        if large.isEmpty():
            break
        of = large.groupBy("node", "label").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", "rep"), "rep"))["rep"].alias("pivot"))
        top = of.groupBy("node").agg(F.max(F.struct("c", F.xxhash64("node", "label"), "label", "pivot")).alias("t")).select("node", F.col("t.label").alias("top"), F.col("t.pivot").alias("pivot"))
        top = top.join(sketches.withColumnsRenamed({"rep": "pivot", "sketch": "pivot_sketch"}), "pivot").select("node", "top", "pivot", "pivot_sketch")
        large = written(_signed(large, tokens).join(top, "node").mapInArrow(released(alike), "node long, rep long, label long, pivot long, top long, next array<long>, like int"))
        likest = large.where((F.col("like") >= need) & ~main).groupBy("rep").agg(F.max(F.struct("like", "pivot"))["pivot"].alias("pivot"))
        pairs = links.new(likest.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")))
        if GAIN * pairs.count() >= large.count():
            links.hold(pairs)
            # the pivot's component now; it was the largest before
            large = links.labelled(large.drop("label")).withColumnsRenamed({"label": "own_label", "rep": "own_rep", "pivot": "rep"})
            large = links.labelled(large.drop("top")).select("node", F.col("own_rep").alias("rep"), F.col("own_label").alias("label"), F.col("label").alias("top"), "next", "like")
        near = main | (F.col("like") >= need)
        sums = large.groupBy("node").agg(F.count("*").alias("n"), F.count_if(~main).alias("m"), F.count_if(near).alias("near_n")).where("m > 0")
        sums = written(sums.withColumn("whole", (2 * F.col("near_n") >= F.col("n")) | F.lit(level + 1 >= LEVELS)))
        alike_ones.append(large.join(sums.where("whole").select("node"), "node", "left_semi").select("node", "rep", near.alias("near")))
        rows = written(large.join(sums.where("NOT whole").select("node"), "node", "left_semi").select(F.explode("next").alias("node"), "rep"))
    whole = written(links.labelled(functools.reduce(DataFrame.union, alike_ones))) if alike_ones else None
    if whole is not None and not whole.isEmpty():
        small.append(_blocks(_together(whole)))
    return functools.reduce(DataFrame.union, small)


@tidy
def linked(docs: DataFrame, length: int = LENGTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    least = percent / 100 - SLACK
    signed = written(signatures(docs, length))
    usable = "doc_id IS NOT NULL AND n_shingles > 0"
    reps = written(signed.where(usable).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")))
    ids = reps.select("rep").distinct()
    links = _Links(_Sets(docs, length), percent)

    # nodes of the first level; a document that often meets the smallest of its nodes is held against that one
    rows = written(signed.where(usable).select(F.col("doc_id").alias("rep"), F.explode("roots").alias("node")).join(ids, "rep", "left_semi").select("node", "rep"))
    low = rows.groupBy("node").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b < last").select("node", "b")
    stars = rows.join(low, "node").where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("met")).where(F.col("met") >= MET)
    stars = stars.groupBy("a").agg(F.min(F.struct(-F.col("met"), F.col("b").alias("b"))).alias("m"))
    links.star(stars.select(F.col("m.b").alias("a"), F.col("a").alias("b")))  # the smaller one first, as it is the smallest of a node

    # what the first components leave open
    sketches = signed.where(usable).select(F.col("doc_id").alias("rep"), "sketch")
    tokens = signed.where(usable).select(F.col("doc_id").alias("rep"), "tokens")
    cells = written(_cells(rows, sketches, tokens, links, least))
    likely = written(likeliest(links.labelled(cells).join(sketches, "rep"), least))  # sketches are long, so cells do without
    if likely.isEmpty():
        links.join()
    else:
        links.hold(links.new(likely.select("a", "b")))
        # a forest of which all links hold leaves no two labels of its cell that a likely link could join
        held = links.labelled(likely.select("cell", F.col("a").alias("rep"), "b")).select("cell", F.col("b").alias("rep"), F.col("label").alias("one"))
        open_ = links.labelled(held).where("one <> label").select("cell").distinct()
        apart = links.labelled(cells.join(open_, "cell", "left_semi"))
        apart = written(groups(apart.join(sketches, "rep"), least))
        ends = {k: F.when(F.size("members") == 2, F.get("members", F.lit(k))) for k in (0, 1)}
        apart = apart.join(links.tried, (ends[0] == F.col("a")) & (ends[1] == F.col("b")), "left_anti")
        members = written(links.labelled(apart.select(F.xxhash64("members").alias("group"), F.explode("members").alias("rep"))))
        if not members.isEmpty():
            links.join(within(members, links.sets, percent))

    of = signed.select("doc_id", "n_shingles", "s1", "s2", F.expr(usable).alias("usable"))
    reps = written(links.labelled(reps).select("s1", "s2", F.col("label").alias("component_id")))
    out = of.where("usable").join(reps, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    out = out.union(of.where("NOT usable").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(docs: DataFrame, length: int = LENGTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` of which one document of each group stays, with their own columns."""
    gone = linked(docs, length, percent).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS sh FROM d, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), sn AS (SELECT s.*, n.n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM sn a JOIN sn b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= {PERCENT} * (na + nb - c)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reach), c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
