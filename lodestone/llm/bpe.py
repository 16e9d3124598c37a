"""Byte-level BPE encoding and decoding.

Encoding follows the linear-time backtracking scheme for byte-pair encoding.
Every byte is mapped to the Latin-1 character of the same value so that an
Aho-Corasick automaton over `str` can hold the whole vocabulary.  At each
position the longest vocabulary entry is tried first; an entry is accepted if
it is compatible with the entry before it, that is, if merging the bytes of
the two by rank gives exactly these two tokens again.  A position from which
nothing led on is marked dead, and the search falls back to the next shorter
entry, so each (position, entry) is looked at once.  Compatibility depends on
the two tokens alone and is memoised.

Entries that their own bytes do not merge to are kept out of the automaton;
they are reached only when they are a whole piece, as in the public libraries.

Defined results for odd input: a null text is the empty text; the empty text
has no ids, and both digests are those of the empty byte string.  Repeated
rows give repeated results.  Extra columns are ignored by `digests` and carried
through by `encode`.  Texts of any length are cut at places where no match of
the pattern can cross (before white space that follows a visible character),
so only a block of a long text is held as pieces at a time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from lodestone.llm.common import released

#: Pieces, and token pairs, remembered by a worker at most; the memory is then emptied.
MEMO_LIMIT = 600_000
#: Longest piece that is remembered, in characters.
MEMO_PIECE = 64
#: Characters of a text that are split into pieces at a time.
BLOCK = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary file of lines `base64 rank` as bytes to rank."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Definition of BPE: join the adjacent pair of lowest rank, leftmost first, until none has a rank."""
    return _merges(piece, ranks)[0]


def _merges(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """The parts that are left after all merges, and the two that the last merge joined."""
    parts, last = [piece[i : i + 1] for i in range(len(piece))], None
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            break
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [last[0] + last[1]]
    return parts, last


def merge_tree(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token that its own bytes merge to, the two tokens joined last; (-1, -1) for single bytes."""
    tree = {}
    for token, rank in ranks.items():
        parts, last = _merges(token, ranks)
        if len(parts) == 1:
            tree[rank] = (ranks[last[0]], ranks[last[1]]) if last else (-1, -1)
    return tree


class ByteBpe:
    """Encoder and decoder of one vocabulary; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tree: dict[int, tuple[int, int]] | None = None):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.vocab: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self._tree = merge_tree(ranks) if tree is None else tree
        self._joins = {parts: rank for rank, parts in self._pairs_of(ranks)}
        self._pairs: dict[int, bool] = {}
        self._automaton = ahocorasick.Automaton()
        for rank in self._tree:
            self._automaton.add_word(self.vocab[rank].decode("latin-1"), rank)
        self._most = max(map(len, ranks), default=0)
        self._shorter = [-1] * len(self.vocab)  # the longest entry that is a proper prefix
        for rank in self._tree:
            token = self.vocab[rank]
            prefixes = (ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            self._shorter[rank] = next((x for x in prefixes if x in self._tree), -1)
        self._automaton.make_automaton()
        self._pieces = _PieceMemo(self)

    def _pairs_of(self, ranks: dict[bytes, int]) -> Iterator[tuple[int, int]]:
        """Each pair of tokens whose joined bytes have a rank, as one number, and that rank."""
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    yield rank, left << 32 | right

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens merge to just these two.

        Going back in time from the finished tokens, the one made later is
        undone first; what faces the boundary then is its inner part.  The two
        facing parts may not join while both exist.  Of equal ranks the left
        one merges first, which decides the ties.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= MEMO_LIMIT:
                self._pairs.clear()
            known = self._pairs[key] = self._stays_apart(left, right)
        return known

    def _stays_apart(self, left: int, right: int) -> bool:
        tree, joins = self._tree, self._joins
        until = float("inf")  # a join across the boundary of a rank below this would come first
        while True:
            joined = joins.get(left << 32 | right)
            if joined is not None and joined < until:
                return False
            inner_left, inner_right = tree[left][1], tree[right][0]
            if inner_left < 0 and inner_right < 0:
                return True
            if inner_right < 0 or inner_left >= 0 and left > right:
                until, left = left, inner_left
            else:
                until, right = right + 1, inner_right

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, pairs = piece.decode("latin-1"), self._pairs
        dead = bytearray(len(text) + 1)
        tokens: list[int] = []
        at, last, token = 0, -1, self._longest(text, 0)
        while True:
            end = at + len(self.vocab[token])
            fits = not dead[end]
            if fits and last >= 0:
                known = pairs.get(last << 32 | token)
                fits = self.compatible(last, token) if known is None else known
            if fits:
                tokens.append(token)
                if end == len(text):
                    return tokens
                at, last, token = end, token, self._longest(text, end)
                continue
            token = self._shorter[token]
            while token < 0:  # nothing leads on from here
                if not tokens:
                    raise ValueError("the vocabulary lacks some single byte")
                dead[at] = 1
                token = tokens.pop()
                at -= len(self.vocab[token])
                last = tokens[-1] if tokens else -1
                token = self._shorter[token]

    def _longest(self, text: str, at: int) -> int:
        """The longest vocabulary entry that starts there."""
        ahead = text[at : at + self._most]
        n = self._automaton.longest_prefix(ahead)
        while n:
            found = self._automaton.get(ahead[:n], -1)
            if found >= 0:
                return found
            n -= 1
        raise ValueError("the vocabulary lacks some single byte")

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(text) <= BLOCK:
            return b"".join(map(self._pieces.__getitem__, self.find(text)))
        return b"".join(b"".join(map(self._pieces.__getitem__, self.find(block))) for block in blocks(text))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, memoryview(packed).cast("I")))


class _PieceMemo(dict):
    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.encode_piece(piece.encode("utf-8"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_PIECE:
            if len(self) >= MEMO_LIMIT:
                self.clear()
            self[piece] = packed
        return packed


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Cuts a text before a white space that follows a visible character: no match of the pattern crosses it."""
    import regex

    cut = regex.compile(r"(?<=\S)\s")
    start = 0
    while len(text) - start > size:
        found = cut.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


_BUILT: dict[str, ByteBpe] = {}
_LOADED: dict[tuple[str, float, str], tuple] = {}


def _worker(shared, key: str) -> ByteBpe:
    """The encoder of this Python worker, which serves many tasks."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBpe(*shared.value)
    return _BUILT[key]


def _share(spark: SparkSession, vocabulary: str, pattern: str | None):
    """Broadcasts the vocabulary: tens of thousands of entries, whatever the size of the documents."""
    import os

    import public_tokenizers

    at = (vocabulary, os.path.getmtime(vocabulary), pattern or public_tokenizers.PATTERN)
    if at not in _LOADED:
        ranks = load_ranks(vocabulary)
        _LOADED.clear()
        _LOADED[at] = (ranks, at[2], merge_tree(ranks))
    ranks = _LOADED[at][0]
    key = hashlib.sha256(repr((at[2], sorted(ranks.items()))).encode()).hexdigest()
    return spark.sparkContext.broadcast(_LOADED[at]), key


def encode(docs: DataFrame, vocabulary: str, pattern: str | None = None, text: str = "text", ids: str = "ids", checked: str | None = None) -> DataFrame:
    """`docs` with an added column `ids` array<int>, and where `checked` names one, a boolean column whether they decode to the text's bytes; columns of these names are replaced."""
    shared, key = _share(docs.sparkSession, vocabulary, pattern)
    docs = docs.drop(ids, *([checked] if checked else []))

    def run(batches):
        bpe = _worker(shared, key)
        for batch in batches:
            packed, same = [], []
            for t in batch.column(text):
                given = t.as_py() or ""
                packed.append(bpe.packed(given))
                if checked:
                    same.append(bpe.decode(packed[-1]) == given.encode("utf-8"))
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            more = {ids: lists} | ({checked: pa.array(same, pa.bool_())} if checked else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], names=[*batch.schema.names, *more])

    added = [StructField(ids, ArrayType(IntegerType())), *([StructField(checked, BooleanType())] if checked else [])]
    return docs.mapInArrow(released(run), StructType([*docs.schema.fields, *added]))


def decode(rows: DataFrame, vocabulary: str, pattern: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with `ids` decoded to `text`; bytes that are not UTF-8 become U+FFFD, null ids the empty text."""
    shared, _ = _share(rows.sparkSession, vocabulary, pattern)
    rows = rows.drop(text)

    def run(batches):
        vocab = {rank: token for token, rank in shared.value[0].items()}
        for batch in batches:
            texts = [b"".join([vocab[i] for i in x.as_py() or ()]).decode("utf-8", "replace") for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(released(run), StructType([*rows.schema.fields, StructField(text, StringType())]))


def digests(docs: DataFrame, vocabulary: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: a map without a shuffle."""
    shared, key = _share(docs.sparkSession, vocabulary, pattern)

    def run(batches):
        bpe = _worker(shared, key)
        for batch in batches:
            n, ids, decoded = [], [], []
            for t in batch.column(1):
                packed = bpe.packed(t.as_py() or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
