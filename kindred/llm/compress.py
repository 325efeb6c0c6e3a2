"""Vector codes by filtering Lloyd.

Each component becomes floor(256 * x); vectors are cut into PARTS equal parts, and each part's position has a codebook of
ENTRIES entries that Lloyd's steps improve from the parts of the least keys. Rows are stored in blocks; a block has a kd-tree over its
parts at each position, each node with a bounding box and the sums and the count of its parts. A step walks the trees downwards,
a level at once: of a node's entries the one nearest to its box's middle rules out those that are nearer to no corner of the box,
and a node that one entry is left for goes to it whole, sums and count, without a look at its parts. Distances are integers, so all
this is exact; equal distances go to the lower index. Tasks tell sums and counts by entry, never parts, and the driver gets
PARTS * ENTRIES sums a step. Trees are built once and read in each step.

Rows whose vector is null or holds null, NaN or infinite components are left out. So are vectors that aren't as long as the
one with the least key of those that can be cut evenly. Components beyond LIMIT / 256 count as such, so squares fit in 64 bits.
Of rows that repeat a key, or have none (they come last), those with lesser components go first into the codebooks; all of them
get codes. With fewer than ENTRIES rows a codebook has as many entries; entries that no part is nearest to stay. Rows with null
labels have a label together. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, materialize, prepare

PARTS, ENTRIES, ROUNDS = 16, 64, 2
LIMIT = 1 << 24
#: Rows of a block, parts of a leaf, and numbers that numpy works on at once.
BLOCK, LEAF, STEP = 8192, 8, 1 << 21
BLOCKS = "keys array<long>, labels array<long>, orders array<binary>, points array<binary>"


class Tree:
    """A kd-tree over points: nodes of a level are runs of `order`, halved at the median of their widest side."""

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        """points: integers; with order, they have been put in a tree's order before."""
        n = len(points)
        cuts = [np.array([0, n])]
        while (np.diff(cuts[-1]) > LEAF).any():
            a, z = cuts[-1][:-1], cuts[-1][1:]
            cuts.append(np.concatenate([np.stack([a, (a + z + 1) // 2], 1).ravel(), [n]]))
        if order is None:
            order = np.arange(n)
            for cut in cuts[:-1]:
                x = points[order]
                wide = (np.maximum.reduceat(x, cut[:-1]) - np.minimum.reduceat(x, cut[:-1])).argmax(1)
                node = np.repeat(np.arange(len(wide)), np.diff(cut))
                order = order[np.lexsort((x[np.arange(n), wide[node]], node))]
            points = points[order]
        self.order, self.points, self.cuts = order, points, cuts
        run = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0, np.int64)])
        self.levels = []
        for cut in cuts:
            self.levels.append((np.minimum.reduceat(points, cut[:-1]).astype(np.int64), np.maximum.reduceat(points, cut[:-1]).astype(np.int64), run[cut[1:]] - run[cut[:-1]]))

    def filtered(self, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """What Lloyd's step does, by level: (level, nodes, entries, None) of nodes that go to one entry each whole; at the last level
        (level, nodes, None, open entries) of those whose parts need a look."""
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        for level, (low, high, _) in enumerate(self.levels):
            step, kept = max(1, STEP // book.size), []
            for lo in range(0, len(nodes), step):
                own, live = nodes[lo : lo + step], open_[lo : lo + step]
                middle = low[own] + high[own]
                apart = ((2 * book - middle[:, None]) ** 2).sum(2)
                apart[~live] = np.iinfo(np.int64).max
                near = apart.argmin(1)
                ahead = book - book[near][:, None]
                corner = np.where(ahead > 0, high[own][:, None], low[own][:, None])
                # How much farther an entry is from the corner that suits it best than the nearest one is; at 0 the lower index wins.
                more = ((book - corner) ** 2 - (book[near][:, None] - corner) ** 2).sum(2)
                live = live & ((more < 0) | ((more == 0) & (np.arange(len(book)) <= near[:, None])))
                kept.append(live)
            open_ = np.concatenate(kept)
            one = open_.sum(1) == 1
            if one.any():
                yield level, nodes[one], open_[one].argmax(1), None
            nodes, open_ = nodes[~one], open_[~one]
            if level + 1 == len(self.levels):
                if len(nodes):
                    yield level, nodes, None, open_
            elif len(nodes):
                nodes, open_ = np.repeat(nodes * 2, 2), np.repeat(open_, 2, 0)
                nodes[1::2] += 1
                full = np.diff(self.cuts[level + 1])[nodes] > 0
                nodes, open_ = nodes[full], open_[full]
            if not len(nodes):
                return

    def _looked(self, nodes: np.ndarray, open_: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the nodes' parts in the tree's order, and the nearest of the node's open entries to each."""
        cut = self.cuts[-1]
        many = cut[nodes + 1] - cut[nodes]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cut[nodes], many)
        live, near = np.repeat(open_, many, 0), np.empty(len(at), np.int64)
        step = max(1, STEP // book.size)
        for lo in range(0, len(at), step):
            apart = ((self.points[at[lo : lo + step]].astype(np.int64)[:, None] - book) ** 2).sum(2)
            apart[~live[lo : lo + step]] = np.iinfo(np.int64).max
            near[lo : lo + step] = apart.argmin(1)
        return at, near

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums and the count of the parts that each entry is nearest to."""
        total, count = np.zeros_like(book), np.zeros(len(book), np.int64)
        for level, nodes, entry, open_ in self.filtered(book):
            if open_ is None:
                np.add.at(total, entry, self.levels[level][2][nodes])
                np.add.at(count, entry, np.diff(self.cuts[level])[nodes])
            else:
                at, near = self._looked(nodes, open_, book)
                np.add.at(total, near, self.points[at])
                count += np.bincount(near, minlength=len(book))
        return total, count

    def assigned(self, book: np.ndarray) -> np.ndarray:
        """The entry of each point, in the points' first order."""
        out = np.empty(len(self.points), np.int64)
        for level, nodes, entry, open_ in self.filtered(book):
            if open_ is None:
                cut = self.cuts[level]
                many = cut[nodes + 1] - cut[nodes]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(cut[nodes], many)
                out[at] = np.repeat(entry, many)
            else:
                at, near = self._looked(nodes, open_, book)
                out[at] = near
        back = np.empty_like(out)
        back[self.order] = out
        return back


def _blocks(parts: int, dim: int):
    """key, label, vector of integers -> blocks of rows with a tree for each part."""
    most = BLOCK

    def block(rows: pa.Table) -> pa.RecordBatch:
        points = rows.column("vec").combine_chunks().flatten().to_numpy().astype(np.int32).reshape(-1, parts, dim // parts)
        trees = [Tree(points[:, p]) for p in range(parts)]
        of = lambda column: pa.array([rows.column(column).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([of("key"), of("label"), *(pa.array([x], pa.list_(pa.binary())) for x in ([t.order.astype(np.int32).tobytes() for t in trees], [t.points.tobytes() for t in trees]))], ["keys", "labels", "orders", "points"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield block(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def _trees(orders: pa.Scalar, points: pa.Scalar, part: int) -> Iterator[Tree]:
    for order, data in zip(orders.values, points.values, strict=True):
        yield Tree(np.frombuffer(data.as_buffer(), np.int32).reshape(-1, part), np.frombuffer(order.as_buffer(), np.int32))


def _summed(books: np.ndarray):
    """Blocks -> the task's sums and count of each entry that parts are nearest to."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for orders, points in zip(batch.column(0), batch.column(1), strict=True):
                for p, tree in enumerate(_trees(orders, points, books.shape[2])):
                    more, n = tree.sums(books[p])
                    total[p] += more
                    count[p] += n
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "count", "sums"])

    return run


def _coded(books: np.ndarray):
    """Blocks -> key, label, code and error of each row."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, labels, orders, points in zip(*batch.columns, strict=True):
                code, error = np.empty((len(keys), len(books)), np.uint8), np.zeros(len(keys), np.int64)
                for p, tree in enumerate(_trees(orders, points, books.shape[2])):
                    code[:, p] = entry = tree.assigned(books[p])
                    error[tree.order] += ((tree.points - books[p][entry[tree.order]]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([keys.values, labels.values, pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["key", "label", "code", "error"])

    return run


def codebooks(rows: DataFrame, blocks: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The entries of each part after `rounds` steps: (part, entry, component)."""
    first = rows.orderBy(F.asc_nulls_last("key"), "vec").limit(entries).select("vec").collect()  # at most `entries` rows of dim numbers
    books = np.array([r.vec for r in first], np.int64)
    books = books.reshape(len(books), parts, dim // parts).swapaxes(0, 1).copy()
    sums = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(books.shape[2])]
    for _ in range(rounds):
        told = blocks.select("orders", "points").mapInArrow(_summed(books), "part int, entry int, count long, sums array<long>").groupBy("part", "entry").agg(F.sum("count").alias("count"), *sums)
        for r in told.collect():  # parts * entries rows at most
            books[r.part, r.entry] = [r[f"s{k}"] // r["count"] for k in range(books.shape[2])]
    return books


def coded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """A row for each vector that takes part: key, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vector)
    whole = (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = v.isNotNull() & F.coalesce(whole, F.lit(False))
    number = lambda c: F.floor(F.least(F.greatest(c.cast("double") * 256, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int")
    rows = vectors.where(whole).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.transform(v, number).alias("vec"))
    least = rows.orderBy(F.asc_nulls_last("key"), "vec").limit(1).select(F.size("vec")).collect()
    dim = least[0][0] if least else parts
    rows = rows.where(F.size("vec") == dim)
    blocks = materialize(rows.mapInArrow(_blocks(parts, dim), BLOCKS), "trees")
    books = codebooks(rows, blocks, dim, parts, entries, rounds)
    out = materialize(blocks.mapInArrow(_coded(books), "key long, label long, code string, error long"), "codes")
    errors = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.join(errors, F.col("label").eqNullSafe(F.col("of"))).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
