"""Ranked lexical search over a bit-sliced impact index.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z as a-z. With N documents that have terms, L terms in
all, n of a document and tf occurrences in it, a posting's impact is (10**9 * tf) div (1000 * tf + 12 * m), where m is
75 + (25 * n * N) div L; a term that df documents hold weighs floor(1000 * ln((2N + 2) / (2df + 1))) impacts.

The index has a row for each segment: some documents of one task, in ascending order of their keys, and for each of their terms
the documents' places and, bit by bit, packed slices of their impacts. It never shuffles a text or posting. A search reads each
segment once. For the terms of the items it turns the slices, times weight, into bitmaps over the segment's documents, one a bit,
that hold only words with documents; adds an item's bitmaps by bitwise carry, for all items together; and finds each item's best
documents from the most significant slice of the sums down: while more than are wanted have a bit set, the others go. Tasks
merge what their segments tell, then the tasks' bests meet, dealt by item and a salt first.

Terms are told apart by 64-bit hashes: that one of an item's terms is taken for another has a chance of about distinct terms over
2**64. Items go to the tasks in blocks of ENTRIES terms, a search of all segments for each block, so what is broadcast is bounded.

Null and empty texts have no terms and are never found. Very long texts are a segment of their own. Documents without a key
count in N, L and df, but can't be named and aren't found. Documents that repeat a key are each found. Equal scores go by key.
Rows of one item id are one item with all their terms; items without an id or terms find nothing. Empty tables give no rows.
Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import KeyFilter, frugal, materialize, prepare, text_steps
from kindred.llm.words import ALNUM, U64, words

#: Postings and documents of a segment from which another is begun.
POSTINGS, DOCUMENTS = 1 << 19, 1 << 14
#: Items' terms of a block; bytes of the sums of items that are looked at together; bests that a task holds.
ENTRIES, SUMS, HELD = 1 << 17, 1 << 25, 1 << 20
#: Parts of an item's bests that are reduced on their own.
SALT = 64
SEGMENTS = "keys binary, terms binary, starts binary, places binary, slices array<binary>"
_ONE = U64(1)


@frugal
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> the task's documents with terms, and their terms."""
    documents = total = 0
    for batch in batches:
        for _, _, data, bounds in text_steps(batch.column(0)):
            solid = np.concatenate([[False], ALNUM[data]])
            begins = solid[1:] & ~solid[:-1]
            heads = bounds[:-1][np.diff(bounds) > 0]
            begins[heads] = solid[1:][heads]
            at = np.concatenate([[0], np.cumsum(begins)])
            many = at[bounds[1:]] - at[bounds[:-1]]
            documents, total = documents + int((many > 0).sum()), total + int(many.sum())
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([total], pa.int64())], ["documents", "terms"])


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The impacts of postings: tf in documents of n terms."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        m = 75 + 25 * n * documents // total
    else:
        m = np.array([75 + 25 * x * documents // total for x in n.tolist()], np.int64)
    return 10**9 * tf // (1000 * tf + 12 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _segments(documents: int, total: int):
    """key, text -> segments of the task's documents."""
    most_postings, most_documents = POSTINGS, DOCUMENTS

    def segment(held: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([x[0] for x in held])
        starts = np.cumsum([0, *(len(x[0]) for x in held)])
        doc = np.concatenate([x[1] + s for x, s in zip(held, starts, strict=False)])
        term, impact = (np.concatenate([x[k] for x in held]) for k in (2, 3))
        by_key = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by_key] = np.arange(len(keys))
        doc = place[doc]
        order = np.lexsort((doc, term))
        term, doc, impact = term[order], doc[order], impact[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        slices = [np.packbits((impact >> b & 1).astype(bool), bitorder="little").tobytes() for b in range(int(impact.max()).bit_length())]
        told = [keys[by_key].tobytes(), term[first].tobytes(), np.append(first, len(term)).tobytes(), doc.astype(np.uint32).tobytes()]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in told), pa.array([slices], pa.list_(pa.binary()))], ["keys", "terms", "starts", "places", "slices"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, many = [], 0, 0
        for batch in batches:
            for lo, hi, data, bounds in text_steps(batch.column(1)):
                _, _, hashes, first = words(data, bounds, ALNUM)
                n = np.diff(first)
                doc = np.repeat(np.arange(hi - lo), n)
                order = np.lexsort((hashes, doc))
                doc, hashes = doc[order], hashes[order]
                new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.empty(0, np.int64)
                tf = np.diff(np.append(new, len(doc)))
                doc, term = doc[new], hashes[new]
                impact = impacts(tf, n[doc], documents, total) if len(doc) else np.empty(0, np.int64)
                keys = batch.column(0).slice(lo, hi - lo)
                named = keys.is_valid().to_numpy(zero_copy_only=False) & (n > 0)
                kept = named[doc]
                doc = (np.cumsum(named) - 1)[doc[kept]]
                if len(doc):
                    held.append((keys.fill_null(0).to_numpy()[named], doc, term[kept], impact[kept]))
                    postings, many = postings + len(doc), many + int(named.sum())
                if postings >= most_postings or many >= most_documents:
                    yield segment(held)
                    held, postings, many = [], 0, 0
        if held:
            yield segment(held)

    return run


@dataclass
class Index:
    """Segments, the number of documents with terms, and of their terms."""

    segments: DataFrame
    documents: int
    total: int
    unnamed: DataFrame


def built(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of docs, written to the shared folder."""
    prepare(docs.sparkSession)
    size = docs.select(F.col(text).alias("text")).mapInArrow(_sizes, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = size[0] or 0, size[1] or 0
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    segments = materialize(plain.mapInArrow(_segments(documents, max(1, total)), SEGMENTS), "segments")
    return Index(segments, documents, total, plain.where("key is null").select("text"))


@frugal
def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in text_steps(batch.column(1)):
            _, _, hashes, first = words(data, bounds, ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), np.diff(first)))), pa.array(hashes.view(np.int64))], ["item", "term"])


def _held(wanted: KeyFilter):
    """Segments -> how many documents hold each term that may be wanted."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                term, df = np.frombuffer(terms.as_buffer(), np.int64), np.diff(np.frombuffer(starts.as_buffer(), np.int64))
                own = wanted(term)
                yield pa.RecordBatch.from_arrays([pa.array(term[own]), pa.array(df[own])], ["term", "df"])

    return run


@frugal
def _unnamed_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> the distinct terms of each, with df 1."""
    for batch in batches:
        for _, _, data, bounds in text_steps(batch.column(0)):
            _, _, hashes, first = words(data, bounds, ALNUM)
            for row in range(len(bounds) - 1):
                term = np.unique(hashes[first[row] : first[row + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.ones(len(term), np.int64))], ["term", "df"])


def bitmaps(values: np.ndarray, places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slices of the values of each owner's places (ascending in it), and for each of their words the place of the word and its owner."""
    word = places >> 6
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])]))
    one = _ONE << (places & 63).astype(U64)
    slices = np.empty((int(values.max(initial=0)).bit_length(), len(first)), U64)
    for b in range(len(slices)):
        slices[b] = np.bitwise_or.reduceat(np.where(values >> b & 1, one, U64(0)), first)
    return slices, word[first], owner[first]


def added(total: np.ndarray, at: np.ndarray, slices: np.ndarray) -> None:
    """Adds the numbers of slices to those of total at the words `at`, bit by bit with a carry."""
    carry = np.zeros(len(at), U64)
    for b in range(len(total)):
        x = total[b, at]
        if b < len(slices):
            y = slices[b]
            half = x ^ y
            total[b, at] = half ^ carry
            carry = (x & y) | (carry & half)
        elif carry.any():
            total[b, at] = x ^ carry
            carry &= x
        else:
            return


def largest(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of numbers (total: slice, row, word) the places of the k largest above 0, of equal ones the first: rows and places."""
    chosen, equal = np.zeros(total.shape[1:], U64), np.bitwise_or.reduce(total, 0)
    for slice_ in total[::-1]:
        more = chosen | (equal & slice_)
        n = np.bitwise_count(more).sum(1, dtype=np.int64)[:, None]
        chosen = np.where(n <= k, more, chosen)
        equal &= np.where(n > k, slice_, np.where(n < k, ~slice_, U64(0)))
    row, place = np.nonzero(np.unpackbits((chosen | equal).view(np.uint8), axis=1, bitorder="little"))
    sure = (chosen[row, place >> 6] >> (place & 63).astype(U64) & _ONE).astype(bool)
    left = k - np.bincount(row[sure], minlength=len(chosen))
    tied = np.flatnonzero(~sure)
    start = np.searchsorted(row[tied], np.arange(len(chosen)))
    fits = np.arange(len(tied)) - start[row[tied]] < left[row[tied]]
    own = np.sort(np.concatenate([np.flatnonzero(sure), tied[fits]]))
    return row[own], place[own]


def best(item: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the k best of their items."""
    order = np.lexsort((key, -score, item))
    first = np.searchsorted(item[order], item[order])
    return order[np.arange(len(order)) - first < k]


@dataclass
class Items:
    """A block of items: ids, and for each the terms with weights."""

    ids: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def found(self, keys: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, slices: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The best documents of a segment: places of items, scores, keys."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        here = np.flatnonzero((terms[at] == self.terms) & (self.weights > 0))
        item = np.searchsorted(self.first, here, "right") - 1
        width = -(-len(keys) // 64)
        bits = len(slices) + int(self.weights.max(initial=1)).bit_length() + len(self.terms).bit_length()
        step = max(1, SUMS // (8 * width * bits))
        cuts = np.searchsorted(item, np.arange(0, len(self.ids) + step, step))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            rows, low = here[a:z], item[a]
            # Terms that items share are turned into bitmaps once, for each weight that they have.
            pair, which = np.unique(np.stack([at[rows], self.weights[rows]]), axis=1, return_inverse=True)
            begin, count = starts[pair[0]], starts[pair[0] + 1] - starts[pair[0]]
            posting = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            value = np.zeros(len(posting), np.int64)
            for b, packed in enumerate(slices):
                value |= ((packed[posting >> 3] >> (posting & 7).astype(np.uint8)) & 1).astype(np.int64) << b
            own = np.repeat(np.arange(len(count)), count)
            maps, word, owner = bitmaps(value * pair[1][own], places[posting], own)
            first = np.searchsorted(owner, np.arange(len(count) + 1))
            turn = np.arange(len(rows)) - np.searchsorted(item[a:z], item[a:z])  # the how-manieth term of its item
            total = np.zeros((len(maps) + int(turn.max() + 1).bit_length(), (item[z - 1] - low + 1) * width), U64)
            by_turn = np.argsort(turn, kind="stable")
            for own in np.split(by_turn, np.flatnonzero(np.diff(turn[by_turn])) + 1):
                term = which[own]
                many = first[term + 1] - first[term]
                group = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[term], many)
                added(total, np.repeat((item[a:z][own] - low) * width, many) + word[group], maps[:, group])
            total = total.reshape(len(total), -1, width)
            row, place = largest(total, k)
            score = np.zeros(len(row), np.int64)
            for b in range(len(total)):
                score |= (total[b, row, place >> 6] >> (place & 63).astype(U64) & _ONE).astype(np.int64) << b
            yield row + low, score, keys[place]


def _search(items: Items, k: int):
    """Segments -> the task's best documents of each item."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64),) * 3]
        for batch in batches:
            for keys, terms, starts, places, slices in zip(*batch.columns, strict=True):
                numbers = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
                packed = [numbers(x, np.uint8) for x in slices]
                held += items.found(numbers(keys, np.int64), numbers(terms, U64), numbers(starts, np.int64), numbers(places, np.uint32).astype(np.int64), packed, k)
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_merged(held, k)]
        item, score, key = _merged(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(items.ids[item]), pa.array(score), pa.array(key)], ["item", "score", "key"])

    return run


def _merged(held: list[tuple], k: int) -> tuple:
    item, score, key = (np.concatenate(x) for x in zip(*held, strict=True))
    own = best(item, score, key, k)
    return item[own], score[own], key[own]


def search(index: Index, items: DataFrame, item: str = "item_id", item_text: str = "text", key: str = "doc_id", k: int = 20) -> DataFrame:
    """The k best documents of each item with a score above 0: item, rank, key, score."""
    prepare(items.sparkSession)
    told = items.where(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"))
    asked = materialize(told.mapInArrow(_item_terms, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("times")), "asked")
    held = index.segments.select("terms", "starts").mapInArrow(_held(KeyFilter(asked.select("term").distinct())), "term long, df long")
    held = held.unionByName(index.unnamed.mapInArrow(_unnamed_terms, "term long, df long")).groupBy("term").agg(F.sum("df").alias("df"))
    asked = materialize(asked.join(held, "term"), "weighed")
    blocks = max(1, -(-asked.count() // ENTRIES))
    found = None
    for n in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
        ids, first = np.unique(own.column("item").to_numpy(), return_index=True)
        df = own.column("df").to_numpy()
        weights = {x: weight(x, index.documents) for x in np.unique(df).tolist()}
        own = Items(ids, np.append(first, len(df)), own.column("term").to_numpy().view(U64), np.array([weights[x] for x in df.tolist()], np.int64) * own.column("times").to_numpy())
        part = materialize(index.segments.mapInArrow(_search(own, k), "item long, score long, key long"), "bests")
        found = part if found is None else found.unionByName(part)
    by = [F.desc("score"), "key"]
    salted = F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("key"), F.lit(SALT))).orderBy(*by))
    found = found.withColumn("rank", salted).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*by))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
