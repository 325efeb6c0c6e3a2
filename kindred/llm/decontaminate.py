"""Benchmark decontamination by a broadcast hash set of word n-grams.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z. A window is WINDOW consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. Tasks get the windows' hashes as one sorted array with a
bitmap before it, and scan each text once: a running sum over word hashes tells the hash of every run of words of each length
that windows have. What the set holds is verified word by word against the window's own words, so hashes only save work. Words
inside a window that occurs are hit. Hit spans can be cut from the texts, or texts with hits left out.

Nothing is shuffled but the benchmark. What is broadcast is bounded: windows go out in blocks of at most BLOCK (a window that
several items share is a row for each), and what one block finds is handed to the next as columns, through a written table, so
neither tasks nor the driver hold more than one block.

Null and empty texts have no words. Very long texts are scanned whole, a text at a time. Items that repeat count once; items
without an id, text or words occur nowhere. Ties don't arise: all windows that occur count. Rows that repeat get a row each,
null keys too. An empty table gives no rows, an empty benchmark no hits. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import free_names, frugal, materialize, prepare, text_steps
from kindred.llm.words import ALNUM, MULTIPLIER, U64, mix64, words

#: Words of a window, and rows of a block of windows.
WINDOW, BLOCK = 10, 1 << 18
#: Bits of the bitmap before the hashes.
BITMAP = 22
_TURN = pow(MULTIPLIER, 5, 2**64)
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[ALNUM] = np.flatnonzero(ALNUM)
_PLAIN[65:91] = np.arange(97, 123)


def _runs(hashes: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length the hashes of all runs of so many words."""
    total, turn = np.zeros(len(hashes), U64), 1
    for n in range(1, max(lengths, default=0) + 1):
        if n > len(hashes):
            return
        total = total[: len(hashes) - n + 1] + hashes[n - 1 :] * U64(turn)
        turn = turn * _TURN % 2**64
        if n in lengths:
            yield n, mix64(total + U64(n))


def _windows(window: int):
    """item, text -> the windows of items: hash, words, gram, item."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_steps(batch.column(1)):
                starts, ends, hashes, first = words(data, bounds, ALNUM)
                many = np.diff(first)
                plain = _PLAIN[data].tobytes()
                for n, run in _runs(hashes, sorted({min(window, k) for k in many.tolist() if k})):
                    text = np.searchsorted(first, np.arange(len(run)), "right") - 1
                    own = np.flatnonzero((np.minimum(many[text], window) == n) & (np.arange(len(run)) + n <= first[text + 1]))
                    grams = [b" ".join(plain[starts[k] : ends[k + n - 1]].split()) for k in own.tolist()]
                    items = batch.column(0).slice(lo, hi - lo).take(pa.array(text[own]))
                    yield pa.RecordBatch.from_arrays([pa.array(run[own].view(np.int64)), pa.array(np.full(len(own), n, np.int32)), pa.array(grams, pa.binary()), items], ["hash", "n", "gram", "item"])

    return run


@dataclass
class Windows:
    """A block of windows: each one's hash (ascending) and words, and the items that have it."""

    hashes: np.ndarray
    lengths: list[int]
    grams: list[bytes]
    first: np.ndarray
    item: np.ndarray
    items: list[str]
    bitmap: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Windows:
        table = table.sort_by([("gram", "ascending")])
        grams, hashes = table.column("gram").to_pylist(), table.column("hash").to_numpy().view(U64)
        order = np.argsort(hashes, kind="stable")  # equal grams stay together
        grams, hashes = [grams[k] for k in order.tolist()], hashes[order]
        new = np.array([k for k, g in enumerate(grams) if not k or g != grams[k - 1]], np.int64)
        names = table.column("item").combine_chunks().take(pa.array(order)).dictionary_encode()
        bitmap = np.zeros(1 << (BITMAP - 3), np.uint8)
        spot = hashes & U64((1 << BITMAP) - 1)
        np.bitwise_or.at(bitmap, (spot >> U64(3)).astype(np.int64), (U64(1) << (spot & U64(7))).astype(np.uint8))
        lengths = sorted(set(table.column("n").to_pylist()))
        return cls(hashes[new], lengths, [grams[k] for k in new.tolist()], np.append(new, len(grams)), names.indices.to_numpy(), names.dictionary.to_pylist(), bitmap)

    def scan(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first word, words, window) for each occurrence of a window in the texts."""
        last = np.repeat(first[1:], np.diff(first))
        for n, run in _runs(hashes, self.lengths):
            spot = run & U64((1 << BITMAP) - 1)
            at = np.flatnonzero((self.bitmap[spot >> U64(3)] >> (spot & U64(7)).astype(np.uint8)) & 1)
            at = at[at + n <= last[at]]
            low, high = (np.searchsorted(self.hashes, run[at], side) for side in ("left", "right"))
            for k, a, z in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                gram = b" ".join(_PLAIN[data[starts[k] : ends[k + n - 1]]].tobytes().split())
                for w in range(a, z):
                    if self.grams[w] == gram:
                        yield k, n, w

    def names(self, found: set[int]) -> set[str]:
        return {self.items[k] for w in found for k in self.item[self.first[w] : self.first[w + 1]].tolist()}


def _scanned(windows: Windows | None, text: str, out: list[str]):
    """Rows with a text -> the same with n (words), runs (first word and end of each run of hit words) and items, added to those there."""
    n_name, runs_name, items_name = out

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            before = [batch.column(batch.schema.get_field_index(c)) for c in (runs_name, items_name)] if runs_name in batch.schema.names else None
            count, runs, items = [], [], []
            for lo, hi, data, bounds in text_steps(column):
                starts, ends, hashes, first = words(data, bounds, ALNUM)
                change = np.zeros(len(starts) + 1, np.int64)
                found: dict[int, set[int]] = {}
                for k, n, w in windows.scan(data, starts, ends, hashes, first) if windows else ():
                    change[k] += 1
                    change[k + n] -= 1
                    found.setdefault(int(np.searchsorted(first, k, "right")) - 1, set()).add(w)
                for row in range(lo, hi) if before else ():
                    for a, z in zip(*[iter(before[0][row].as_py())] * 2, strict=True):
                        change[first[row - lo] + a] += 1
                        change[first[row - lo] + z] -= 1
                hit = np.cumsum(change[:-1]) > 0
                for row in range(hi - lo):
                    own = hit[first[row] : first[row + 1]]
                    edges = np.flatnonzero(np.diff(own, prepend=False, append=False)) if own.any() else np.empty(0, np.int64)
                    runs.append(edges.tolist())
                    items.append(sorted((windows.names(found.get(row, set())) if windows else set()) | set(before[1][lo + row].as_py() if before else ())))
                count.append(np.diff(first))
            new = {n_name: pa.array(np.concatenate(count) if count else np.empty(0, np.int64), pa.int64()), runs_name: pa.array(runs, pa.list_(pa.int64())), items_name: pa.array(items, pa.list_(pa.string()))}
            kept = [c for c in batch.schema.names if c not in new]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *new.values()], [*kept, *new])

    return run


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int | None = None) -> tuple[DataFrame, list[str]]:
    """docs with three further columns, whose names follow: the number of words; runs of hit words, as first word and end of each;
    and the ids of items (as text, ascending) of which a window occurs."""
    prepare(docs.sparkSession)
    block = block or BLOCK
    told = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text"))
    windows = materialize(told.mapInArrow(_windows(window), "hash long, n int, gram binary, item string").distinct(), "windows")
    blocks = max(1, -(-windows.count() // (block - block // 8)))
    names = free_names(docs, "n_words", "runs", "items")
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", {n} {kind}" for n, kind in zip(names, ("long", "array<long>", "array<string>"), strict=True))
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("gram", "item"), F.lit(blocks)) == k).toArrow()
        docs = docs.mapInArrow(_scanned(Windows.of(own) if own.num_rows else None, text, names), schema)
        if k + 1 < blocks:
            docs = materialize(docs, "scanned")
    return docs, names


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row for each document: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, (n, runs, items) = marked(docs.select(F.col(key), F.col(text)), benchmark, text, **how)
    hit = F.aggregate(F.transform(runs, lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(F.col(key), F.col(n).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(runs) > 0).alias("contaminated"))


@frugal
def _cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
    """Texts without the bytes from the first to the last word of each run."""
    out = []
    for lo, hi, data, bounds in text_steps(texts):
        starts, ends, _, first = words(data, bounds, ALNUM)
        for row in range(lo, hi):
            own, at, parts = runs[row].as_py(), int(bounds[row - lo]), []
            for a, z in zip(*[iter(own)] * 2, strict=True):
                parts.append(data[at : starts[first[row - lo] + a]])
                at = int(ends[first[row - lo] + z - 1])
            out.append(b"".join(x.tobytes() for x in [*parts, data[at : bounds[row - lo + 1]]]).decode() if own else texts[row].as_py())
    return pa.array(out, pa.string())


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", spans: bool = True, **how) -> DataFrame:
    """docs without the hit spans of their texts; with spans=False, without the documents that have any."""
    rows, (_, runs, _) = marked(docs, benchmark, text, **how)
    if spans:
        rows = rows.withColumn(text, F.arrow_udf(_cut, "string")(F.col(text), F.col(runs)))
    else:
        rows = rows.where(F.size(runs) == 0)
    return rows.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
