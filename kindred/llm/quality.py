"""Quality scores by a factorisation machine.

Inputs of a text: its words hashed to 2**14 places (lengths 1 as a vector), statistics of its structure (shares of capitals,
digits, symbols, space; word and line lengths; repeats) in standard units, and what is told of it as a whole: the class of its
size and of its script. Each input has a weight and a vector of 8 factors; a score is the logistic of the weighted inputs plus
all pairwise products of the vectors, which the identity 2 * sum_{i<j} = (sum)^2 - sum of squares gives in linear time.

Labels, language, source and key are never inputs. A null or empty text has no words and all statistics 0; a very long text is
scored whole. A row's score depends on its text alone, so repeated rows have the same. Ties of the sample's hashes go by key. Without
labelled rows every score is 0.5; an empty table gives no rows, and other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, prepare, sample, text_steps
from kindred.llm.words import U64, words

BITS, FACTORS = 14, 8
WORDS = 1 << BITS
STATS = 14
SIZES, SCRIPTS = 24, 8
INPUTS = WORDS + STATS + SIZES + SCRIPTS
#: At most so many labelled rows of each class are learned from: those with the least hash of their key.
PER_CLASS = 2000
EPOCHS, BATCH, STEP = 8, 64, 0.1
_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 capital, 2 digit, 3 space, 4 symbol, 5 other
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, *range(9, 14)]] = 3
_COMMON = np.zeros(256, bool)
_COMMON[list(b".,;:'\"-?")] = True


def inputs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts: places and values of their words, each text's first place; their statistics; their size and script classes (places)."""
    n = len(bounds) - 1
    starts, ends, hashes, first = words(data, bounds)
    count = np.diff(first)
    text_of = np.repeat(np.arange(n), count)
    spots, times = np.unique((text_of.astype(np.int64) << BITS) | (hashes >> U64(64 - BITS)).astype(np.int64), return_counts=True)
    owner, place = spots >> BITS, spots & (WORDS - 1)
    start = np.searchsorted(owner, np.arange(n + 1))
    norm = np.sqrt(np.bincount(owner, times.astype(float) ** 2, n))
    value = times / norm[owner] if len(owner) else times.astype(float)

    size = np.diff(bounds)
    per = lambda flags, at=bounds: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    kind = _CLASS[data]
    some, tokens = np.maximum(size, 1), np.maximum(count, 1)
    last = data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    head = data[starts] if len(starts) else last
    odd = (_CLASS[last] == 4) & ~_COMMON[last]
    long = ends - starts
    lines = per(data == 10)
    stats = np.stack([
        np.log1p(size), *(per(kind == k) / some for k in range(5)), per((kind == 4) & ~_COMMON[data]) / some, per(long, first) / tokens,
        per(odd, first) / tokens, per((long == 1) & (_CLASS[head] == 4), first) / tokens, per(_CLASS[head] == 1, first) / tokens,
        np.diff(start) / tokens, np.log1p(lines), np.log1p(count / (lines + 1)),
    ], 1)
    sizes = WORDS + STATS + np.minimum(np.log2(some).astype(np.int64), SIZES - 1)
    scripts = WORDS + STATS + SIZES + np.minimum((per(kind == 5) * 2 * SCRIPTS) // some, SCRIPTS - 1)
    stats[size == 0] = 0
    return place, value, start, stats, np.stack([sizes, scripts], 1)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, place: np.ndarray, value: np.ndarray, start: np.ndarray, stats: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All inputs of each text in one row of places and values."""
        n = len(start) - 1
        own = np.clip((stats - self.mean) / self.spread, -4, 4)
        fixed = STATS + told.shape[1]
        width = np.diff(start)
        at = start[:-1] + np.arange(n) * fixed
        total = len(place) + n * fixed
        places, values = np.empty(total, np.int64), np.empty(total)
        slot = np.arange(len(place)) + np.repeat(np.arange(n) * fixed, width)
        places[slot], values[slot] = place, value
        tail = (at + width)[:, None] + np.arange(fixed)
        places[tail] = np.concatenate([np.broadcast_to(np.arange(WORDS, WORDS + STATS), (n, STATS)), told], 1)
        values[tail] = np.concatenate([own, np.ones(told.shape)], 1)
        return places, values, np.append(at, total)

    def raw(self, places: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic, the sums of the vectors, and the weighted vectors."""
        vectors = self.factor[places] * values[:, None]
        sums = np.add.reduceat(vectors, at[:-1])
        squares = np.add.reduceat((vectors**2).sum(1), at[:-1])
        return self.bias + np.add.reduceat(self.weight[places] * values, at[:-1]) + 0.5 * ((sums**2).sum(1) - squares), sums, vectors

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = [np.empty(0)]
        for _, _, data, bounds in text_steps(texts):
            z, _, _ = self.raw(*self.rows(*inputs(data, bounds)))
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], seed: int = 7) -> Machine:
    """A machine for rows of label, places, values, statistics, told places."""
    rng = np.random.default_rng(seed)
    blank = Machine(0.0, np.zeros(INPUTS), np.zeros((INPUTS, FACTORS)), np.zeros(STATS), np.ones(STATS))
    if not rows:
        return blank
    label = np.array([r[0] for r in rows], float)
    stats = np.stack([r[3] for r in rows])
    m = Machine(0.0, np.zeros(INPUTS), rng.normal(0, 0.02, (INPUTS, FACTORS)), stats.mean(0), stats.std(0) + 1e-6)
    sum_w, sum_v, sum_b = np.full(INPUTS, 1e-2), np.full((INPUTS, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            own = [rows[k] for k in order[lo : lo + BATCH]]
            start = np.concatenate([[0], np.cumsum([len(r[1]) for r in own])])
            places, values, at = m.rows(np.concatenate([r[1] for r in own]), np.concatenate([r[2] for r in own]), start, np.stack([r[3] for r in own]), np.stack([r[4] for r in own]))
            z, sums, vectors = m.raw(places, values, at)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[order[lo : lo + BATCH]]) / len(own)
            each = np.repeat(slope, np.diff(at))
            use, back = np.unique(places, return_inverse=True)
            gw = np.bincount(back, each * values, len(use)) + 1e-4 * m.weight[use]
            step = (np.repeat(sums, np.diff(at), axis=0) - vectors) * (each * values)[:, None]
            gv = np.stack([np.bincount(back, step[:, f], len(use)) for f in range(FACTORS)], 1) + 1e-4 * m.factor[use]
            sum_w[use] += gw**2
            sum_v[use] += gv**2
            sum_b += slope.sum() ** 2
            m.weight[use] -= STEP * gw / np.sqrt(sum_w[use])
            m.factor[use] -= STEP * gv / np.sqrt(sum_v[use])
            m.bias -= STEP * slope.sum() / np.sqrt(sum_b)
    return m


def _input_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> label and inputs."""
    for batch in batches:
        for lo, hi, data, bounds in text_steps(batch.column(1)):
            place, value, start, stats, told = inputs(data, bounds)
            cut = lambda x: pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), cut(place.astype(np.int16)), cut(value.astype(np.float32)), pa.array(list(stats)), pa.array(list(told.astype(np.int32)))], ["label", "place", "value", "stats", "told"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS, held_out: tuple[int, int] = (3, 1)) -> Machine:
    """Fits a machine to at most `per_class` rows of each class that aren't held out.

    Held out are keys whose crc32, as text, has the given remainder. Executors compute the inputs; the driver gets those of at
    most 2 * per_class rows as Arrow columns, six bytes for each of at most 2**14 words of a row.
    """
    prepare(docs.sparkSession)
    free = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (F.crc32(F.col(key).cast("string")) % held_out[0] != held_out[1]))
    free = free.groupBy(F.col(key).alias("key")).agg(F.min(label).cast("int").alias("label"))
    taken = [sample(free.where(F.col("label") == k), "key", per_class) for k in (0, 1)]
    chosen = F.broadcast(taken[0].unionByName(taken[1]))  # 2 * per_class rows at most
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    told = found.select("key", "label", "text").mapInArrow(_with_key, "key string, label int, place array<smallint>, value array<float>, stats array<double>, told array<int>").toArrow()
    columns = [told.column("label").to_pylist(), *([x.values.to_numpy() for x in told.column(c)] for c in ("place", "value", "stats", "told"))]
    rows = sorted(zip(told.column("key").to_pylist(), *columns, strict=True), key=lambda r: (r[0], len(r[2]), r[2][:3].tolist()))
    return fit([(label, place, value, stats, classes) for _, label, place, value, stats, classes in rows])


@frugal
def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in _input_rows(iter([pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], ["label", "text"])])):
            keys = batch.column(0).slice(at, part.num_rows).cast(pa.string())
            at += part.num_rows
            yield pa.RecordBatch.from_arrays([keys, *part.columns], ["key", *part.schema.names])


def score(text: Column, machine: Machine) -> Column:
    """The score of each text, from 0 to 1."""
    return F.arrow_udf(frugal(lambda texts: pa.array(machine(texts))), "double")(text)


def scored(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (3, 1)) -> DataFrame:
    """A row for each document: key, held_out, score, predicted."""
    prepare(docs.sparkSession)
    away = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % held_out[0] == held_out[1]
    rows = docs.select(key, away.alias("held_out"), score(F.col(text), machine).alias("score"))
    return rows.select(key, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs without those that are predicted as class 0."""
    prepare(docs.sparkSession)
    return docs.where(score(F.col(text), machine) >= 0.5)
