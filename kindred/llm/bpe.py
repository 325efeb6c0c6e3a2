"""Byte-level BPE by replaying the merges over all distinct pieces of a batch of texts.

A task gathers the distinct pieces (matches of the split pattern) that it has not met yet and holds their symbols in one row of
linked positions. An inverted index leads from each pair of neighbours to its positions; pairs are taken by rank, lowest first,
each merge is made at every position of the pair, and only the two touched neighbours of a position enter the index anew.
Pieces repeat, so a text costs a look at each of its pieces. All state is a task's own: no shuffle, and a lost executor's task
starts again from its rows.

Null and empty texts have no tokens. Special tokens are not known: their strings are ordinary text. A very long text is a step of
its own, and a long piece is replayed but not remembered. Repeated rows have repeated ids; ties of rank don't arise, and merges of
one rank go from left to right. An empty table gives no rows; other columns stay (`encode_column`) or are left out (`token_digests`).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, prepare

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces whose ids a task remembers; when there are more it forgets all and begins again. Their longest form in bytes.
REMEMBERED, SHORT = 300_000, 64
#: Pieces of one replay; positions of a pair from which its merges are made at once.
PIECES, MANY = 100_000, 48


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Tokens and the pairs of tokens that join to one."""

    def __init__(self, path: str):
        table = ranks(path)
        many = max(table.values()) + 1
        #: The rank of the token that left << 17 | right join to.
        self.pairs: dict[int, int] = {}
        for token, k in table.items():
            for cut in range(1, len(token)):
                left, right = table.get(token[:cut]), table.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 17 | right] = k
        self.single = np.array([table[bytes([b])] for b in range(256)])
        self.of_bytes = np.array([[table.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        keys, ranked = np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int64)
        ends = np.arange(many + 1)
        left, right = keys >> 17, keys & ((1 << 17) - 1)
        #: Pairs by their rank, by their left and by their right token: (where each token's begin, the other tokens, ranks or keys).
        self.by_rank, self.by_left, self.by_right = (self._sorted(by, ends, *more) for by, more in ((ranked, (keys, ranked)), (left, (right, ranked)), (right, (left, ranked))))
        self.scratch = np.full(many, -1)

    @staticmethod
    def _sorted(by: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        order = np.argsort(by, kind="stable")
        return np.searchsorted(by[order], ends).tolist(), x[order], y[order]

    def joined(self, side: tuple[list[int], np.ndarray, np.ndarray], token: int, others: np.ndarray) -> np.ndarray:
        """Ranks of a token with others on one side of it, -1 if there is none; others: -1 or less for none."""
        at, partners, ranked = side
        own = slice(at[token], at[token + 1])
        self.scratch[partners[own]] = ranked[own]
        out = np.where(others >= 0, self.scratch[np.maximum(others, 0)], -1)
        self.scratch[partners[own]] = -1
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(pieces: list[bytes], path: str) -> list[np.ndarray]:
    """The token ids of each piece."""
    v = vocabulary(path)
    # One row of symbols; an end of -1 stands before, between and after the pieces and pairs with nothing.
    size = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(pieces) + 1), size)
    n = len(data) + len(pieces) + 1
    row = np.full(n, -1)
    row[at] = v.single[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.full(n, -1)
    if len(data) > 1:
        rank[at[:-1]] = np.where(np.diff(at) == 1, v.of_bytes[data[:-1], data[1:]], -1)
    spots = np.flatnonzero(rank >= 0)
    spots = spots[np.argsort(rank[spots], kind="stable")]
    heap, cut = np.unique(rank[spots], return_index=True)
    index = dict(zip(heap.tolist(), map(np.ndarray.tolist, np.split(spots, cut[1:])), strict=True)) if len(heap) else {}
    heap = heap.tolist()  # ascending, so a heap
    symbol, following, preceding = memoryview(row), memoryview(after), memoryview(before)
    look, find = v.pairs.get, index.get

    def enter(q: int, spots: list[int]) -> None:
        own = find(q)
        if own is None:
            index[q] = spots
            heapq.heappush(heap, q)
        else:
            own += spots

    def at_once(r: int, spots: np.ndarray) -> bool:
        """Makes a merge at all its positions; not if one of them overlaps another."""
        gone = after[spots]
        keys = (row[spots] << 17) | row[gone]
        valid = np.zeros(len(spots), bool)
        start, pairs, _ = v.by_rank
        for key in pairs[start[r] : start[r + 1]]:
            valid |= keys == key
        valid &= (row[spots] >= 0) & (row[gone] >= 0)
        spots, gone = spots[valid], gone[valid]
        if len(spots) > 1 and (gone[:-1] >= spots[1:]).any():
            return False
        right = after[gone]
        row[spots], row[gone] = r, -2
        after[spots], before[right] = right, spots
        left = before[spots]
        for places, q in ((left, v.joined(v.by_right, r, row[left])), (spots, v.joined(v.by_left, r, row[right]))):
            some = np.flatnonzero(q >= 0)
            if len(some):
                some = some[np.argsort(q[some], kind="stable")]
                each, cut = np.unique(q[some], return_index=True)
                own = places[some].tolist()
                cut = [*cut.tolist(), len(own)]
                for k, rank in enumerate(each.tolist()):
                    enter(rank, own[cut[k] : cut[k + 1]])
        return True

    while heap:
        r = heapq.heappop(heap)
        # One token can come of several pairs; they share its rank and so its place in the order.
        spots = index.pop(r)
        if len(spots) >= MANY and at_once(r, np.unique(spots)):
            continue
        spots.sort()
        for at in spots:
            a = symbol[at]
            if a < 0:
                continue
            gone = following[at]
            b = symbol[gone]
            if b < 0 or look(a << 17 | b) != r:
                continue  # a merge beside it has changed it
            symbol[at] = r
            symbol[gone] = -2
            right = following[at] = following[gone]
            preceding[right] = at
            left = preceding[at]
            a, b = symbol[left], symbol[right]
            if a >= 0 and (q := look(a << 17 | r)) is not None:
                enter(q, [left])
            if b >= 0 and (q := look(r << 17 | b)) is not None:
                enter(q, [at])
    keep = row >= 0
    count = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(size + 1)])]
    ids = row[keep].astype("<u4")
    return [ids[a:z] for a, z in zip(count[:-1].tolist(), count[1:].tolist(), strict=True)]


class Encoder:
    """Encodes texts; remembers pieces met before."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.path, self.split = path, regex.compile(pattern).findall
        self.memory: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Token ids as little-endian unsigned 32-bit numbers, a text at a time."""
        at = 0
        while at < len(texts):
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            pieces, n = [], 0
            while at + len(pieces) < len(texts) and (not pieces or n < 1 << 20):
                pieces.append(self.split(texts[at + len(pieces)]))
                n += len(texts[at + len(pieces) - 1])
            memory = self.memory
            new = [p for p in {p for x in pieces for p in x} if p not in memory]
            long: dict[str, bytes] = {}
            for lo in range(0, len(new), PIECES):
                part = new[lo : lo + PIECES]
                for p, ids in zip(part, replay([p.encode() for p in part], self.path), strict=True):
                    (memory if len(p) <= SHORT else long)[p] = ids.tobytes()
            look = memory.__getitem__ if not long else lambda p: memory.get(p) or long[p]
            for x in pieces:
                yield b"".join(map(look, x))
            at += len(pieces)


@lru_cache(maxsize=4)
def tokens(path: str) -> list[bytes]:
    """The bytes of each id."""
    table = ranks(path)
    by_id = [b""] * (max(table.values()) + 1)
    for token, k in table.items():
        by_id[k] = token
    return by_id


def decode(ids: bytes, path: str) -> bytes:
    """The bytes of token ids."""
    by_id = tokens(path)
    return b"".join([by_id[k] for k in np.frombuffer(ids, "<u4").tolist()])


def encode_column(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with each text's ids in the binary column `out` (little-endian unsigned 32-bit numbers)."""
    prepare(docs.sparkSession)
    where = path or public_tokenizers.path(VOCABULARY)

    @frugal
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = Encoder(where)  # the task's own: what it remembers goes when the task ends
        for texts in batches:
            yield pa.array(list(encode([t or "" for t in texts.to_pylist()])), pa.binary())

    return docs.withColumn(out, F.arrow_udf(encoded, "binary")(F.col(text)))


def decode_column(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the bytes of the ids in the binary column `out`."""
    prepare(docs.sparkSession)
    where = path or public_tokenizers.path(VOCABULARY)

    @frugal
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if x is None else decode(x, where) for x in column.to_pylist()], pa.binary())

    return docs.withColumn(out, F.arrow_udf(decoded, "binary")(F.col(ids)))


def token_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """A row for each document: its number of tokens, a digest of its ids, and one of what they decode to."""
    prepare(docs.sparkSession)
    where = path or public_tokenizers.path(VOCABULARY)
    form = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])

    @frugal
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = Encoder(where)
        for texts in batches:
            ids = list(encode([t or "" for t in texts.to_pylist()]))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([decode(x, where) for x in ids], pa.binary())], fields=list(form))

    rows = docs.select(key, F.arrow_udf(both, "struct<ids:binary,decoded:binary>")(F.col(text)).alias("t"))
    return rows.select(key, (F.length("t.ids") / 4).cast("long").alias("n_tokens"), F.sha2("t.ids", 256).alias("ids_sha256"), F.sha2("t.decoded", 256).alias("decoded_sha256"))
