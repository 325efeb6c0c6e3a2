"""Nearest neighbours by multi-index hashing.

A code has SUBSTRINGS substrings of BITS bits. Its bits are signs of the vector in its principal directions, turned by rotations
that are learned (each group of bits from another start) so that the signs lie close to the values. Every row stands in one index
for each substring, under its value. A query looks up, in each index, all values within `near_bits` of its own substring. By the
pigeonhole principle that retrieves every code within a Hamming radius of SUBSTRINGS * (near_bits + 1) - 1, and of those farther
away the ones that are close in some substring; `near_bits` is the least that retrieves SHARE of the true neighbours, among all
rows, of up to PROBES queries. What is retrieved is ranked by the cosine of the original vectors in double precision, so each cell
tells its true best and nothing that is retrieved is lost, however close the vectors lie. A query that finds fewer than are wanted
looks up all values of one index, so that the answer is whole in small tables and for outliers.

An index is dealt out by the high bits of its values, as many as the number of rows asks for. A row goes to one cell of each
index; a query goes to the cells whose high bits are near enough, which grow with a power of the logarithm of the rows. So what
is shuffled stays in proportion to the rows. Cells with very many rows or queries are split into blocks. Of equal vectors only
the least keys that could be answers go into the indexes, so copies cost nothing.

Vectors that are null, zero, or hold nulls or other than finite numbers take no part; nor do rows without a key. Vectors meet
only those of their own dimension. Rows with the query's own key aren't its neighbours; ties go to the smaller key. Rows that
repeat are each found; queries that repeat a key are asked once. An empty table has no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import frugal, materialize, prepare, sample

SUBSTRINGS, BITS = 10, 16
#: Directions of a group of bits at most, and steps of learning.
GROUP_BITS, TURNS = 64, 30
#: Vectors that are learned from (those with the least hash of their key), queries that set near_bits by their neighbours among all rows, and the share of these.
SAMPLE, PROBES, SHARE = 4000, 200, 0.96
#: Rows and queries of a cell's block that are aimed at; the most high bits.
ROWS, QUERIES, MOST_HIGH = 8192, 4096, 12
#: Candidates looked up at once, and what a cosine that numpy adds up in its own order can differ by.
STEP, SLACK = 1 << 20, 1e-12
_VALUES = np.arange(1 << BITS, dtype=np.uint32)
_WEIGHT = np.bitwise_count(_VALUES)


@dataclass
class Codes:
    """Rotations for vectors of one dimension, and how near a substring is looked up."""

    dim: int
    centre: np.ndarray
    turned: np.ndarray
    near_bits: int = BITS

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The values of the substrings of each vector."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        bits = ((unit - self.centre) @ self.turned > 0).reshape(len(x), SUBSTRINGS, BITS)
        return bits @ (1 << np.arange(BITS)[::-1]).astype(np.int64)


def fit(x: np.ndarray, seed: int = 5) -> Codes:
    """Learns rotations from rows of x."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centre = x.mean(0)
    y = x - centre
    _, directions = np.linalg.eigh(y.T @ y)
    directions = directions[:, ::-1][:, :GROUP_BITS]
    y = y @ directions
    turned = []
    for group in range(-(-SUBSTRINGS * BITS // y.shape[1])):
        turn = np.linalg.qr(np.random.default_rng(seed + group).normal(size=(y.shape[1],) * 2))[0]
        for _ in range(TURNS):
            u, _, w = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ w).T
        turned.append(directions @ turn)
    return Codes(x.shape[1], centre, np.concatenate(turned, 1)[:, : SUBSTRINGS * BITS])


def _neighbours(codes: Codes, keys: np.ndarray, x: np.ndarray, near: int):
    """key, asks, vec -> (probe, about, least): the task's `near` rows nearest to each of the vectors x, and by how many bits their closest substrings differ."""
    own, unit = codes(x), x / np.linalg.norm(x, axis=1, keepdims=True)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, least = np.full((len(x), near), -2.0), np.zeros((len(x), near), np.int64)
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            at = np.flatnonzero(sizes == codes.dim)
            flat, start = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            y = flat[start[at][:, None] + np.arange(codes.dim)]
            cos = unit @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
            cos[keys[:, None] == batch.column(0).to_numpy()[at]] = -2
            best = np.argsort(-cos, axis=1)[:, :near]
            apart = np.bitwise_count(codes(y)[best] ^ own[:, None]).min(2).astype(np.int64) if len(at) else np.zeros(best.shape, np.int64)
            about, least = np.concatenate([about, np.take_along_axis(cos, best, 1)], 1), np.concatenate([least, apart], 1)
            best = np.argsort(-about, axis=1)[:, :near]
            about, least = np.take_along_axis(about, best, 1), np.take_along_axis(least, best, 1)
        probe, place = np.nonzero(about > -2)
        yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(about[probe, place]), pa.array(least[probe, place])], ["probe", "about", "least"])

    return run


def learn_near(codes: Codes, kept: DataFrame, near: int) -> None:
    """Sets near_bits by the true neighbours of some queries (those with the least hash of their key) among all rows."""
    probes = [r for r in sample(kept.where(F.col("asks") & (F.size("vec") == codes.dim)).select("key", "vec"), "key", PROBES).collect()]
    if not probes:
        return
    told = kept.where("not asks").select("key", "asks", "vec").mapInArrow(_neighbours(codes, np.array([r.key for r in probes]), np.array([r.vec for r in probes]), near), "probe long, about double, least long")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("about")))
    least = [r.least for r in told.withColumn("rank", rank).where(F.col("rank") <= near).select("least").collect()]
    if least:
        codes.near_bits = int(np.quantile(least, SHARE, method="higher"))


ENCODED = "key long, asks boolean, row long, dim int, subs array<int>, vec array<double>"


def _encode(codes: Codes | None):
    """key, asks, vec, row -> with the values of the substrings."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            flat, start = batch.column(2).flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = flat[start[at][:, None] + np.arange(dim)]
                subs = codes(x) if codes is not None and codes.dim == dim else np.zeros((len(x), SUBSTRINGS), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * SUBSTRINGS), pa.array(subs.astype(np.int32).ravel()))
                own = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), batch.column(3).take(own), pa.array(np.full(len(x), dim, np.int32)), lists, batch.column(2).take(own)], ["key", "asks", "row", "dim", "subs", "vec"])

    return run


def lookup(values: np.ndarray, bits: int, asked: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in asked, place in values) of all values of `bits` bits that lie within near (for each asked) of an asked one, in steps."""
    order = np.argsort(values, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << bits))])
    for budget in np.unique(near).tolist():
        own = np.flatnonzero(near == budget)
        flips = _VALUES[: 1 << bits][_WEIGHT[: 1 << bits] <= budget].astype(np.int64)
        width = max(1, STEP // max(len(flips), len(values)))
        for lo in range(0, len(own), width):
            part = own[lo : lo + width]
            found = asked[part][:, None] ^ flips
            count = start[found + 1] - start[found]
            i = np.repeat(part, count.sum(1))
            count, first = count.ravel(), start[found].ravel()
            place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            yield i, order[place]


def _best(i: np.ndarray, keys: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores of each i, equal ones by ascending key."""
    order = np.lexsort((keys, -score, i))
    first = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]])) if len(i) else np.empty(0, int)
    return order[np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < most]


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in order."""
    return np.add.reduce(np.ascontiguousarray((a * b).T), axis=0, initial=0.0) if a.shape[1] else np.zeros(len(a))


def cosines(x: np.ndarray, i: np.ndarray, j: np.ndarray, keys: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (i, j) of rows of x the `near` with the highest cosine for each i, equal ones by ascending key of j, and that cosine."""
    length = np.sqrt(_dot(x, x))
    about = np.empty(len(i))
    for lo in range(0, len(i), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        about[part] = np.einsum("ij,ij->i", x[i[part]], x[j[part]]) / (length[i[part]] * length[j[part]])
    # Only what can be among the best is worked out in the order that decides equals.
    last = np.full(len(x), -np.inf)
    best = _best(i, keys[j], about, near)
    full = np.bincount(i[best], minlength=len(x)) >= near
    low = np.full(len(x), np.inf)
    np.minimum.at(low, i[best], about[best])
    last[full] = low[full] - SLACK
    maybe = np.flatnonzero(~(about < last[i]))
    i, j = i[maybe], j[maybe]
    score = np.empty(len(i))
    for lo in range(0, len(i), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        score[part] = _dot(x[i[part]], x[j[part]]) / (length[i[part]] * length[j[part]])
    best = _best(i, keys[j], score, near)
    return i[best], j[best], score[best]


def _probe(high: int, near_most: int):
    """Rows and queries of one cell -> the `near_most` nearest rows for each query."""

    @frugal
    def run(table: pa.Table) -> pa.Table:
        query = table.column("near").is_valid().to_numpy()
        keys, low = table.column("key").to_numpy(), table.column("sub").to_numpy().astype(np.int64) & ((1 << (BITS - high)) - 1)
        rows = table.column("row").to_numpy()
        x = table.column("vec").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(keys), -1)
        ask, row = np.flatnonzero(query), np.flatnonzero(~query)
        near = table.column("near").fill_null(0).to_numpy()[ask]
        out = []
        for i, j in lookup(low[row], BITS - high, low[ask], near) if len(ask) and len(row) else ():
            i, j = ask[i], row[j]
            other = keys[i] != keys[j]
            out.append(cosines(x, i[other], j[other], keys, near_most))
        i, j, score = (np.concatenate([o[k] for o in out]) if out else np.empty(0, kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"query_id": pa.array(keys[i]), "row": pa.array(rows[j]), "vec_id": pa.array(keys[j]), "score": pa.array(score)})

    return run


def _searched(coded: DataFrame, asking: DataFrame, high: int, substrings: int, near_bits: int, near: int) -> DataFrame:
    """(query_id, row, vec_id, score): what the cells tell of the queries `asking`, rows of `coded`."""
    sub = lambda df: df.select("key", "row", "dim", "vec", F.posexplode(F.slice("subs", 1, substrings)).alias("j", "sub"))
    own = F.shiftright("sub", BITS - high)
    rows = sub(coded).withColumn("cell", own)
    masks = [m for m in range(1 << high) if m.bit_count() <= near_bits]
    flips = F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(near_bits - m.bit_count()).alias("near")) for m in masks]))
    asks = sub(asking).withColumn("flip", flips).withColumn("cell", own.bitwiseXOR(F.col("flip.mask"))).withColumn("near", F.col("flip.near")).drop("flip")
    # Cells number SUBSTRINGS * 2**MOST_HIGH for each dimension at most; the split of those that hold many rows or queries is joined to both sides.
    count = lambda df, name: df.groupBy("dim", "j", "cell").agg(F.count("*").alias(name))
    sizes = materialize(count(rows, "r").join(count(asks, "q"), ["dim", "j", "cell"]), "cells")
    sizes = sizes.select("dim", "j", "cell", F.ceil(F.col("r") / (2 * ROWS)).alias("rs"), F.ceil(F.col("q") / (2 * QUERIES)).alias("qs"))
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["dim", "j", "cell", "a", "b", "key", "row", "sub", "vec", "near"]
    rows = rows.join(sizes, ["dim", "j", "cell"]).withColumn("a", block("rs")).withColumn("b", each("qs")).withColumn("near", F.lit(None).cast("int"))
    asks = asks.join(sizes, ["dim", "j", "cell"]).withColumn("a", each("rs")).withColumn("b", block("qs"))
    found = rows.select(columns).unionByName(asks.select(columns)).groupBy("dim", "j", "cell", "a", "b").applyInArrow(_probe(high, near), "query_id long, row long, vec_id long, score double")
    return materialize(found.dropDuplicates(["query_id", "row"]), "candidates")


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", near: int = 5) -> DataFrame:
    """For each row of vectors for which `queries` holds: query_id, rank, vec_id, score of its `near` nearest found, and by_index: whether the indexes alone gave them."""
    prepare(vectors.sparkSession)
    v = F.col(vector)
    whole = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.where(F.coalesce(whole, F.lit(False))).select(F.col(key).cast("long").alias("key"), F.transform(v, lambda c: c.cast("double")).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # Of equal vectors the least keys are the answers to all: one more than are wanted, as one may be the query's own.
    copies = F.row_number().over(Window.partitionBy("vec").orderBy("key"))
    kept = rows.withColumn("copy", copies).where(F.col("copy") <= near + 1).drop("copy", "asks").withColumn("asks", F.lit(False))
    kept = materialize(kept.unionByName(rows.where("asks").dropDuplicates(["key"])), "vectors")
    learned = [r.vec for r in sample(kept.where("not asks").select("key", "vec"), "key", SAMPLE).collect()]
    codes = None
    if learned:
        sizes, times = np.unique([len(v) for v in learned], return_counts=True)
        codes = fit(np.array([v for v in learned if len(v) == sizes[times.argmax()]]))
        learn_near(codes, kept, near)
    high = max(0, min(MOST_HIGH, (kept.count() // ROWS).bit_length()))
    coded = materialize(kept.select("key", "asks", "vec", F.monotonically_increasing_id().alias("row")).mapInArrow(_encode(codes), ENCODED), "codes")
    data, asks = coded.where("not asks"), coded.where("asks")
    found = _searched(data, asks, high, SUBSTRINGS, codes.near_bits if codes else BITS, near)
    # Queries that found too few look up every value of the first index.
    few = asks.join(found.groupBy(F.col("query_id").alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= near), "key", "left_anti")
    found = found.withColumn("by_index", F.lit(True))
    few = materialize(few, "few")
    if not few.isEmpty():
        late = _searched(data, few, high, 1, BITS, near).withColumn("by_index", F.lit(False))
        found = found.join(few.select(F.col("key").alias("query_id")), "query_id", "left_anti").unionByName(late)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= near).select("query_id", "rank", "vec_id", "score", "by_index")
