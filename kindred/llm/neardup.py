"""Near-duplicate documents by SetSketch registers over word shingles.

A document's set holds its distinct 5-word shingles (with fewer words: the whole sequence as one; without words: nothing), as
64-bit hashes. A sketch has 72 registers: register i holds floor(1 - log_b(least exponential variate of the set under hash i)),
cut to 0..65535 - exponentially spaced, truncated minima, of which the larger of two is that of a union (`merge`). Equal
registers are the likelier the more two sets share, so bands of three registers, read as exact keys, deal out candidates; at a
similarity of 0.75 all 24 bands differ with probability 2e-6. A pair's similarity is estimated jointly from its registers by
maximum likelihood, given the sets' sizes, and a pair for which 0.75 is out of question is dropped (its log-likelihood lies
REJECT below the best, about six standard deviations). All others are verified on the full sets.

Groups of any size stay linear. Equal sets count once. In a bucket each set meets the one with the least key, never all others;
as that order is the same in all buckets, a set of a large group meets few others. Their verified links give components. Only
buckets that still hold several components are looked at again, and there only sets outside the bucket's main component meet the
others, in blocks of bounded size, in which links already implied are left out. So every pair that shares a band is decided, and
no link between different components is lost.

Very long texts are hashed whole, one numpy step each. Ties don't arise. An empty table gives no rows; other columns are untouched.
Rows with a null key or without words are linked with nothing and kept. Rows that repeat a key and text are one set; all such
rows get the same component, and all are kept if their key is the component's smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import KeyFilter, frugal, materialize, prepare, text_steps
from kindred.llm.components import components
from kindred.llm.words import U64, mix64, numbers, words

WIDTH = 5
REGISTERS, ROWS = 72, 3
BANDS = REGISTERS // ROWS
BASE, RATE, MOST = 1.001, 20.0, 65535
#: Log-likelihood by which 0.75 may lie below the best estimate.
REJECT = 18.0
#: Sets of a block in the second look.
BLOCK = 512
_TERMS = numbers(WIDTH, 2) | U64(1)
_SEEDS = numbers(REGISTERS, 3) | U64(1)
SIGN = U64(1 << 63)


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts, repeats included, and each text's first (with the number of shingles at the end)."""
    _, _, word, first = words(data, bounds)
    n = len(word)
    count = np.diff(first)
    per = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(per)])
    out = np.empty(int(start[-1]), U64)
    if n >= WIDTH:
        runs = word[: n - WIDTH + 1] * _TERMS[0]
        for k in range(1, WIDTH):
            runs += word[k : n - WIDTH + 1 + k] * _TERMS[k]
        whole = np.flatnonzero(count >= WIDTH)
        inside = np.zeros(n + 1, np.int32)  # places where a shingle begins that ends in its own text
        np.add.at(inside, first[whole], 1)
        np.add.at(inside, first[whole] + per[whole], -1)
        at = np.flatnonzero(np.cumsum(inside)[: len(runs)])
        target = np.zeros(int(start[-1]) + 1, np.int32)
        np.add.at(target, start[whole], 1)
        np.add.at(target, start[whole] + per[whole], -1)
        out[np.flatnonzero(np.cumsum(target)[:-1])] = mix64(runs[at])
    for d in np.flatnonzero((count > 0) & (count < WIDTH)):
        k = int(count[d])
        out[start[d]] = mix64(np.array([(word[first[d] : first[d + 1]] * _TERMS[:k]).sum(dtype=U64) + U64(k)], U64))[0]
    return out, start


def registers(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row of registers for each set; a set without members has zeros."""
    out = np.zeros((len(start) - 1, REGISTERS), np.uint16)
    own = np.flatnonzero(np.diff(start) > 0)
    if not len(own):
        return out
    least = np.empty((len(own), REGISTERS))
    for i, seed in enumerate(_SEEDS):
        least[:, i] = np.minimum.reduceat(hashes * seed, start[own])
    variate = -np.log1p(-(least + 0.5) / 2.0**64) / RATE
    out[own] = np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, MOST)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """A key for each band: its number and its registers, exactly."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.int64)
    return (np.arange(BANDS, dtype=np.int64) << 48) | r[:, :, 0] << 32 | r[:, :, 1] << 16 | r[:, :, 2]


def from_bands(keys: np.ndarray) -> np.ndarray:
    """The registers that band keys tell."""
    keys = keys.reshape(-1, BANDS)
    out = np.empty((len(keys), BANDS, ROWS), np.uint16)
    for k in range(ROWS):
        out[:, :, k] = keys >> (16 * (ROWS - 1 - k)) & MOST
    return out.reshape(-1, REGISTERS)


_GRID = np.linspace(0, 1, 201)


def likelihoods(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity of the grid for pairs of register rows and set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = REGISTERS - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    up, down = np.clip(p(np.maximum(u - v * _GRID, 0)), 1e-12, 1), np.clip(p(np.maximum(v - u * _GRID, 0)), 1e-12, 1)
    both = np.clip(1 - up - down, 1e-12, 1)
    return more * np.log(up) + less * np.log(down) + same * np.log(both)


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether a similarity of 0.75 or more is not out of question."""
    near = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(near)
    for lo in range(0, len(at), 4096):
        k = at[lo : lo + 4096]
        told = likelihoods(a[k], b[k], na[k].astype(float), nb[k].astype(float))
        # No similarity beyond the sizes' ratio is possible; what lies there counts as that ratio.
        out[k] = told[:, _GRID >= 0.75].max(1) >= told.max(1) - REJECT
    return out


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sorted sets x and y share three quarters of their union."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    shared = int(np.count_nonzero(y[at] == x)) if len(y) else 0
    return 100 * shared >= 75 * (len(x) + len(y) - shared)


@frugal
def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text -> key, size, two halves of a hash of the set, band keys."""
    for batch in batches:
        key = batch.column(0)
        for lo, hi, data, bounds in text_steps(batch.column(1)):
            hashes, start = shingles(data, bounds)
            regs = registers(hashes, start)
            sets = [np.unique(hashes[a:z]) for a, z in zip(start[:-1], start[1:], strict=True)]
            size = np.array([len(s) for s in sets], np.int64)
            halves = [np.array([int(mix64(s ^ U64(salt)).sum(dtype=U64)) for s in sets], U64).view(np.int64) for salt in (0, 0x5851F42D4C957F2D)]
            keys = bands(regs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([key.slice(lo, hi - lo), pa.array(size), pa.array(halves[0]), pa.array(halves[1]), lists], ["key", "n", "h1", "h2", "bands"])


def _full_sets(wanted: KeyFilter):
    """key, text -> key and sorted set of the keys that may be wanted."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            own = np.flatnonzero(wanted(key.to_numpy()))
            key, text = key.take(pa.array(own)), batch.column(1).take(pa.array(own))
            for lo, hi, data, bounds in text_steps(text):
                hashes, start = shingles(data, bounds)
                sets = [np.unique(hashes[a:z]).tobytes() for a, z in zip(start[:-1], start[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([key.slice(lo, hi - lo), pa.array(sets, pa.binary())], ["id", "members"])

    return run


def _sets(col: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in col]


@frugal
def plausible(bands_a: pa.Array, bands_b: pa.Array, size_a: pa.Array, size_b: pa.Array) -> pa.Array:
    """Of each pair, whether its registers and sizes leave a link possible."""
    if not len(size_a):
        return pa.array([], pa.bool_())
    return pa.array(possible(from_bands(bands_a.flatten().to_numpy()), from_bands(bands_b.flatten().to_numpy()), size_a.to_numpy(), size_b.to_numpy()))


@frugal
def verified(set_a: pa.Array, set_b: pa.Array) -> pa.Array:
    """Of each pair, whether it is a link."""
    return pa.array([linked(a, b) for a, b in zip(_sets(set_a), _sets(set_b), strict=True)], pa.bool_())


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Side 0 meets side 1; in a cell of side 2 all meet."""
    return (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side < 2).any() else (np.arange(len(side)),) * 2


@frugal
def cell_survivors(table: pa.Table) -> pa.Table:
    """Rows of a cell that could link to another component, by a pair whose first common band is the cell's."""
    side, comp, n = (table.column(c).to_numpy() for c in ("side", "comp", "n"))
    keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    regs, band = from_bands(keys), table.column("band")[0].as_py() >> 48
    left, right = _sides(side)
    lives = np.zeros(len(side), bool)
    for i in left:
        js = right[comp[right] != comp[i]]
        js = js[4 * np.minimum(n[js], n[i]) >= 3 * np.maximum(n[js], n[i])]
        if band and len(js):
            js = js[~(keys[js, :band] == keys[i, :band]).any(1)]
        if len(js):
            js = js[possible(np.broadcast_to(regs[i], (len(js), REGISTERS)), regs[js], np.full(len(js), n[i]), n[js])]
            lives[js] = True
            lives[i] |= len(js) > 0
    return table.filter(pa.array(lives)).select(["band", "kind", "x", "y", "side", "comp", "id", "n", "bands"])


@frugal
def cell_links(table: pa.Table) -> pa.Table:
    """Links between components that the full sets of a cell give; those that others imply are left out."""
    side, comp, n = (table.column(c).to_numpy() for c in ("side", "comp", "n"))
    regs = from_bands(table.column("bands").combine_chunks().flatten().to_numpy())
    sets = _sets(table.column("members").combine_chunks())
    left, right = _sides(side)
    parent = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    found = []
    for i in left:
        js = right[comp[right] != comp[i]]
        js = js[possible(np.broadcast_to(regs[i], (len(js), REGISTERS)), regs[js], np.full(len(js), n[i]), n[js])] if len(js) else js
        for j in js:
            a, b = root(int(comp[i])), root(int(comp[j]))
            if a != b and linked(sets[i], sets[j]):
                parent[max(a, b)] = min(a, b)
                found.append((int(comp[i]), int(comp[j])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, n_shingles, component_id (the smallest key reached over links, its own included), kept."""
    prepare(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = materialize(plain.mapInArrow(set_rows, "key long, n long, h1 long, h2 long, bands array<long>"), "sets")
    alone = "n > 0 and key is not null"
    unique = rows.where(alone).groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.min_by("bands", "key").alias("bands"), F.min("n").alias("n"))
    unique = materialize(unique, "unique")

    def with_sets(ids: DataFrame, name: str) -> DataFrame:
        """The full sets of ids, from a second look at the texts that a filter of fixed size lets through."""
        found = plain.where("key is not null").mapInArrow(_full_sets(KeyFilter(ids)), "id long, members binary").join(ids, "id", "left_semi")
        return materialize(found.groupBy("id").agg(F.min("members").alias("members")), name)

    bucket = unique.select("rep", F.explode("bands").alias("band"))
    pivots = bucket.groupBy("band").agg(F.count("rep").alias("n"), F.min("rep").alias("p")).where("n > 1")
    shared = materialize(bucket.join(pivots, "band"), "buckets")
    own = lambda side: unique.select(F.col("rep").alias(side), F.col("bands").alias(f"bands_{side}"), F.col("n").alias(f"n_{side}"))

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        """Which of the pairs (rep, p) are links, as (a, b)."""
        pairs = pairs.select(F.greatest("rep", "p").alias("a"), F.least("rep", "p").alias("b")).distinct()
        pairs = pairs.join(own("a"), "a").join(own("b"), "b").where(F.arrow_udf(plausible, "boolean")("bands_a", "bands_b", "n_a", "n_b"))
        pairs = materialize(pairs.select("a", "b"), "pairs")
        sets = with_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "members")
        members = lambda side: sets.select(F.col("id").alias(side), F.col("members").alias(f"m_{side}"))
        return pairs.join(members("a"), "a").join(members("b"), "b").where(F.arrow_udf(verified, "boolean")("m_a", "m_b")).select("a", "b")

    # Each set meets its bucket's least.
    first = materialize(components(linked_pairs(shared.where("rep != p").select("rep", "p"))), "first")
    # Buckets of which these pairs don't say all: those that hold several components, `main` the largest.
    placed = shared.where("n > 2").select("band", "rep").join(first.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("root", "rep").alias("comp"))
    parts = placed.groupBy("band", "comp").agg(F.count("rep").alias("n"))
    mixed = parts.groupBy("band").agg(F.count("comp").alias("parts"), F.max(F.struct("n", "comp"))["comp"].alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("parts > 1")
    mixed = mixed.select("band", "main", F.ceil(F.col("most") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("rests"))
    placed = placed.join(mixed, "band").withColumn("rest", F.col("comp") != F.col("main"))
    place = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n))
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # Main sets keep to their block and meet each chunk of the others; the others meet each block, each chunk and themselves.
    cells = placed.select("band", "rep", "comp", F.explode(F.when(~F.col("rest"), F.transform(count("rests"), lambda c: F.struct(F.lit(0).alias("kind"), place(1, "blocks").alias("x"), c.alias("y"), F.lit(0).alias("side")))).otherwise(
        F.concat(
            F.transform(count("blocks"), lambda x: F.struct(F.lit(0).alias("kind"), x.alias("x"), place(2, "rests").alias("y"), F.lit(1).alias("side"))),
            F.transform(count("rests"), lambda c: F.struct(F.lit(1).alias("kind"), F.least(c, place(2, "rests")).alias("x"), F.greatest(c, place(2, "rests")).alias("y"), F.when(c == place(2, "rests"), 2).when(c > place(2, "rests"), 0).otherwise(1).alias("side"))),
        ))).alias("c"))
    cells = cells.select("band", "c.*", "comp", F.col("rep").alias("id")).join(unique.select(F.col("rep").alias("id"), "n", "bands"), "id")
    lives = "band long, kind int, x long, y long, side int, comp long, id long, n long, bands array<long>"
    cells = materialize(cells.groupBy("band", "kind", "x", "y").applyInArrow(cell_survivors, lives), "cells")
    more = with_sets(cells.select("id").distinct(), "more")
    found = cells.join(more, "id").groupBy("band", "kind", "x", "y").applyInArrow(cell_links, "a long, b long")
    second = components(found)
    root = first.withColumnRenamed("root", "mid").join(second.select(F.col("id").alias("mid"), F.col("root").alias("top")), "mid", "left").select("id", F.coalesce("top", "mid").alias("root"))
    late = second.join(first.select("id"), "id", "left_anti")
    root = root.unionByName(late)

    grouped = unique.select("h1", "h2", "rep").join(root.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    out = rows.where(alone).select("key", "n", "h1", "h2").join(grouped, ["h1", "h2"]).select("key", "n", "component_id")
    out = out.unionByName(rows.where(f"not ({alone}) or key is null").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that lie in a component of a smaller key."""
    gone = near_duplicates(docs, key, text).where("not kept").select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")
