"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; filters of WIDTH bytes run over it.  Their
responses are max-pooled within overlapping chunks that cover the whole text
(CHUNK positions, every STRIDE), a small layer turns a chunk's maxima into a
logit, and the mean of all chunks' logits is the text's logit.  As a filter is
linear in the bytes, its responses are sums of rows of tables, two bytes to a
row, so scoring is a few gathers and additions a byte.  Long texts are scored
in slabs; memory does not grow with a text's length.

Learning: at most SAMPLE labelled documents of each class, those first in the
order of a digest of doc_id, and of each at most PIECES stretches, evenly
spread; so what comes to the driver is bounded (6 MB).  Labels are learned only
from documents whose crc32(doc_id as text) mod 3 is not 1.  Neither labels nor
lang, source or doc_id enter a score.  Starts and order are seeded: equal
input gives an equal network on one kind of machine.

Defined results for odd input: null and empty texts are scored as a text of
zero bytes; without any label of one of the classes every score is 0.5;
several labels of one document count as the lowest; null doc_id is not held
out and never learned from.  Repeated rows get equal scores.  Extra columns
are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import released

WIDTH = 6
FILTERS = 16
EMBED = 8
HIDDEN = 16
CHUNK = 256
STRIDE = 128
#: Bounds of what is learned from: documents of each class, stretches of a document.
SAMPLE = 1200
PIECES = 6
EPOCHS = 12
#: Positions scored at a time.
SLAB = STRIDE * 1024


class Network:
    """Weights, learning and scoring."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.w = {
            "e": g.normal(0, 0.5, (256, EMBED)), "v": g.normal(0, 0.3, (WIDTH, EMBED, FILTERS)), "b": np.zeros(FILTERS),
            "a": g.normal(0, 0.3, (FILTERS, HIDDEN)), "d": np.zeros(HIDDEN), "u": g.normal(0, 0.3, HIDDEN), "c": np.zeros(1),
        }
        self._tables: list[np.ndarray] | None = None

    def taps(self) -> np.ndarray:
        """Response of each filter to each byte at each place: (WIDTH, 256, FILTERS)."""
        return np.einsum("be,wef->wbf", self.w["e"], self.w["v"])

    def _head(self, pooled: np.ndarray) -> np.ndarray:
        """Logits of chunks from their maxima."""
        w = self.w
        return np.maximum(np.maximum(pooled + w["b"], 0) @ w["a"] + w["d"], 0) @ w["u"] + w["c"][0]

    # -- learning

    def learn(self, pieces: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, batch: int = 48, rate: float = 0.01, seed: int = 11) -> None:
        """pieces: for each document stretches of up to CHUNK + WIDTH - 1 bytes."""
        rng = np.random.default_rng(seed)
        span = CHUNK + WIDTH - 1
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        data = np.zeros((len(owner), span), np.uint8)
        for row, piece in zip(data, (x for p in pieces for x in p), strict=True):
            row[: len(piece)] = np.frombuffer(piece[:span], np.uint8)
        used = np.array([max(1, min(len(x), span) - WIDTH + 1) for p in pieces for x in p])
        first = np.searchsorted(owner, np.arange(len(pieces) + 1))
        y = np.asarray(labels, float)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        step, steps = 0, epochs * -(-len(pieces) // batch)
        for _ in range(epochs):
            for ids in np.array_split(rng.permutation(len(pieces)), -(-len(pieces) // batch)):
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in ids])
                of = np.repeat(np.arange(len(ids)), [first[i + 1] - first[i] for i in ids])
                step += 1
                self._adam(self._gradient(data[rows], used[rows], of, y[ids]), moments, step, rate * (1 - 0.9 * step / steps))
        self._tables = None

    def _gradient(self, data: np.ndarray, used: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, taps = self.w, self.taps().astype(np.float32)
        at = np.arange(CHUNK)
        response = sum(taps[k][data[:, k : k + CHUNK]] for k in range(WIDTH))  # (chunks, positions, filters)
        response[at[None, :] >= used[:, None]] = -1e9
        place = response.argmax(1)
        pooled = np.take_along_axis(response, place[:, None, :], 1)[:, 0].astype(float)
        x = pooled + w["b"]
        r = np.maximum(x, 0)
        h0 = r @ w["a"] + w["d"]
        h = np.maximum(h0, 0)
        chunks = np.bincount(of, minlength=len(y))
        logit = np.bincount(of, h @ w["u"], minlength=len(y)) / chunks + w["c"][0]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g = ((p - y) / len(y))[of] / chunks[of]  # of each chunk's logit
        gh = np.outer(g, w["u"]) * (h0 > 0)
        gx = (gh @ w["a"].T) * (x > 0)
        gt = np.zeros_like(taps, dtype=float)
        f = np.broadcast_to(np.arange(FILTERS), place.shape)
        rows = np.arange(len(data))[:, None]
        for k in range(WIDTH):
            np.add.at(gt[k], (data[rows, place + k], f), gx)
        return {
            "e": np.einsum("wbf,wef->be", gt, w["v"]), "v": np.einsum("wbf,be->wef", gt, w["e"]), "b": gx.sum(0),
            "a": r.T @ gh, "d": gh.sum(0), "u": h.T @ g, "c": np.array([np.sum(p - y) / len(y)]),
        }

    def _adam(self, grads: dict[str, np.ndarray], moments: dict, step: int, rate: float, decay: float = 1e-3) -> None:
        for k, g in grads.items():
            m, v = moments[k]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            self.w[k] -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * self.w[k])

    # -- scoring

    def _pairs(self) -> list[np.ndarray]:
        """For each two neighbouring places of a filter a table of the sum of both responses by the two bytes."""
        if self._tables is None:
            t = self.taps().astype(np.float32)
            self._tables = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        return self._tables

    def score(self, text: bytes) -> float:
        tables = self._pairs()
        data = np.frombuffer(text + b"\0" * max(0, WIDTH - len(text)), np.uint8)
        n = len(data) - WIDTH + 1  # positions
        maxima = []
        for start in range(0, n, SLAB):
            stop = min(start + SLAB, n)
            part = data[start : stop + WIDTH - 1].astype(np.uint16)
            two = (part[:-1] << 8) | part[1:]
            m = stop - start
            response = tables[0][two[:m]]
            for k in range(1, WIDTH // 2):
                response += tables[k][two[2 * k : 2 * k + m]]
            maxima.append(np.maximum.reduceat(response, np.arange(0, m, STRIDE), axis=0))
        half = np.concatenate(maxima) if len(maxima) > 1 else maxima[0]
        chunks = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
        logit = float(self._head(chunks.astype(float)).mean())
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def stretches(text: bytes) -> list[bytes]:
    """At most PIECES stretches of a text, from its start to its end, for learning."""
    span = CHUNK + WIDTH - 1
    room = max(0, len(text) - span)
    n = min(PIECES, 1 + room // STRIDE)
    return [text[s : s + span] for s in (round(room * k / max(1, n - 1)) for k in range(n))]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> list[tuple[int, list[bytes]]]:
    """Label and stretches of the documents that are learned from."""
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    label = label.groupBy("doc_id").agg(F.min("y").alias("y")).withColumn("h", F.md5(F.col("doc_id").cast("string")))
    pick = [label.where(F.col("y") == y).orderBy("h", "doc_id").limit(size) for y in (0, 1)]
    few = F.broadcast(pick[0].union(pick[1]))  # 2 * size rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(few, "doc_id").select("doc_id", "h", "y", "text")

    def cut(batches):
        for batch in batches:
            own = [stretches(t.as_py().encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), pa.array(own, pa.list_(pa.binary()))], names=["h", "y", "pieces"])

    rows = texts.mapInArrow(released(cut), "h string, y int, pieces array<binary>").collect()
    rows = sorted({(r.h, r.y, tuple(map(bytes, r.pieces))) for r in rows})
    return [(y, list(p)) for _, y, p in rows]


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network, or None where documents of both classes are not labelled."""
    found = sample(docs, labels)
    if len({y for y, _ in found}) < 2:
        return None
    few = min(sum(y == c for y, _ in found) for c in (0, 1))
    often = [max(1, min(8, (len(found) - few) // few)) if sum(v == y for v, _ in found) == few else 1 for y, _ in found]  # the rarer class counts as much
    found = [x for x, k in zip(found, often, strict=True) for _ in range(k)]
    network = Network()
    network.learn([p for _, p in found], [y for y, _ in found], epochs=max(EPOCHS, min(120, 20_000 // len(found))))
    return network


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    network = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(network.w if network else None)  # some tens of kB
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        net = None
        if shared.value is not None:
            net = Network()
            net.w = shared.value
        for batch in batches:
            s = [0.5 if net is None else net.score((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(released(run), "doc_id long, held_out boolean, score double, predicted int")
