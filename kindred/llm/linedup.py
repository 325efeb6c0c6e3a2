"""Line deduplication by an exact set-similarity join.

A line's set holds its words (A-Z as a-z), a word that comes k times as k members. Lines of five words or more, or of 16
bytes besides white space (the parameter `least`), whose sets have a Jaccard similarity of 3/4 or more match; a line that matches an earlier
one (by key, then line number) is removed, whether or not that one stays. Shorter lines are left alone and
counted: they repeat in clean texts by chance; with least=(1, 1) they are treated as the others. The second measure takes in lines of scripts without spaces and long lines of few words.

Equal sets are found by a 128-bit hash of the set. For the rest, members are ordered by rarity: by the count, over all
documents, of their word's bucket (a table of RARITY sums, whatever the corpus), then by hash. A pair that matches shares a member
among the first n - ceil(3n/4) + 1 of the longer line and the first m - ceil(6m/7) + 1 of the shorter, so only these prefixes are
dealt out, by member, packed as arrays, and in several rounds, so that but a part of them is on disk at once; a table holds the
prefixes meanwhile, so texts aren't read for each round. There a pair must pass the length filter, the positional filter and a bound on the
overlap from 128 parities, 256 for long lines (of the members by hash; sets differ in as many members at least as parities), all
of which lose no match. Members that very many prefixes hold, as counted over all documents, are dealt out in blocks that meet
two by two, so no group of prefixes is large.

What passes are lists of partners, a row for each line of a group. These candidates' components are dealt into cells of bounded
size, to which each line's full set goes once; in components larger than a cell, whose lines are dealt into blocks, once for each
block in which it has a partner. A cell verifies
its candidates and tells of each line the number of its links, its earliest partner and a link towards its class; so pairs are
never rows.

The report tells every link between lines of different words and the class that links and equal words put a line in, so there all
candidates are verified. Where only removals are wanted, a group of many lines that match each other isn't expanded into all pairs:
of each line and member the likeliest and the oldest candidates are tried first, which decides nearly all lines; lines that were
left with untried candidates and without an earlier match have all their candidates tried in a second round, so every line is
decided exactly.

Null and empty texts have no lines that are looked at. Very long texts and lines are handled whole, a text at a time. Documents
with a null key are left alone and match nothing. Rows that repeat a key and line are the same line, and are kept or removed
together; ties don't arise, as key and number order all lines. Empty tables give empty results; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import components
from kindred.llm.common import KeyFilter, discard, frugal, keep_freed, materialize, one_file_a_task, prepare, text_steps
from kindred.llm.words import U64, mix64, solid_words

#: A line is looked at if it has so many words, or so many bytes besides white space: the parameter `least`.
LEAST = (5, 16)
#: Buckets of the table of words' counts, and of the table of prefixes' counts; tables are added up in parts.
RARITY, HELD, PART = 1 << 18, 1 << 16, 1 << 12
#: Prefix members of a block of a hot member, and of a group of prefixes, that are aimed at; the least number of groups.
BLOCK, GROUP, GROUPS = 100_000, 1_000_000, 64
#: Prefix members that a round deals out at least, and the rounds for all lines' prefixes at most; copies of hot members take more.
ROUND, ROUNDS = 1 << 21, 4
#: Lines of a cell in which candidates are verified.
CELL = 2048
#: Prefix members that a task packs at once; pairs that numpy looks at together.
PACK, STEP = 1 << 18, 1 << 18
#: Words from which a line has 256 parities instead of 128.
LONG = 110
_ODD = U64(0x9E3779B97F4A7C15)
_NONE = np.empty(0, np.uint32)
#: Lists name partners by these bits of their keys; if two lines of a cell have the same, both are verified.
LOW = 0xFFFFFFFF
#: What is dealt out of a member of a prefix, packed: plain numbers, and counts in as few bytes as the largest needs.
PLAIN = {"token": np.uint32, "key": np.int64, "bits": U64, "more": U64, "when": np.uint32}
SHORT = ("size", "spot", "mark")
#: Candidates of a line and member that are tried first: so many by likeness, and so many by age.
FIRST = 2
#: Partners that lists name of a line and member, on the average of the member's lines; links of further ones that are held at once.
LISTED, TIED = 8, 1 << 22


def _prefix(size: np.ndarray) -> np.ndarray:
    """The members of the prefixes of lines of so many."""
    return size - (3 * size + 3) // 4 + 1


class Lines:
    """The lines of texts that are looked at: their text, number, and words (as hashes, a line's together)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, least: tuple[int, int] = LEAST):
        starts, ends, hashes = solid_words(data, bounds)
        self.words = hashes  # also of lines that aren't looked at
        feeds = np.flatnonzero(data == 10)
        # A line's number is the count of line feeds before it in its text. Empty lines that begin where another does have no words.
        begin = np.unique(np.concatenate([bounds[:-1], feeds + 1]))
        before = np.searchsorted(feeds, bounds)
        self.per_text = before[1:] - before[:-1] + 1
        at = np.searchsorted(starts, begin)
        count = np.diff(np.append(at, len(starts)))
        solid = np.concatenate([[0], np.cumsum(ends - starts)])
        own = (count > 0) & ((count >= least[0]) | (solid[at + count] - solid[at] >= least[1]))
        self.word = hashes[np.repeat(own, count)]
        left = np.searchsorted(bounds, begin[(count > 0) & ~own], "right") - 1
        self.short = np.bincount(left, minlength=len(bounds) - 1)
        begin, self.count = begin[own], count[own]
        self.text = np.searchsorted(bounds, begin, "right") - 1
        self.number = np.searchsorted(feeds, begin) - before[self.text]
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.line = np.repeat(np.arange(len(self.count)), self.count)

    def key(self, salt: int = 0x1F83D9AB) -> np.ndarray:
        """A hash of each line's set: a sum over its words, so their order makes no difference."""
        if not len(self.count):
            return np.empty(0, np.int64)
        return np.add.reduceat(mix64(self.word ^ U64(salt)), self.start[:-1]).view(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two halves of a hash of each line's set."""
        return self.key(), self.key(0x5BE0CD19)

    def some(self, lines: np.ndarray) -> Lines:
        """Only the lines with these places."""
        if len(lines) == len(self.count):
            return self
        part = object.__new__(Lines)
        chosen = np.zeros(len(self.count), bool)
        chosen[lines] = True
        part.word, part.count, part.text, part.number = self.word[chosen[self.line]], self.count[chosen], self.text[chosen], self.number[chosen]
        part.start = np.concatenate([[0], np.cumsum(part.count)])
        part.line = np.repeat(np.arange(len(part.count)), part.count)
        return part

    def members(self) -> np.ndarray:
        """Members line by line. A word's second occurrence is another member than its first."""
        word = self.word[np.lexsort((self.word, self.line))]
        return mix64(word + self._times(word) * _ODD)

    def _times(self, word: np.ndarray) -> np.ndarray:
        """How often each word came in its line before, where equal ones of a line follow each other."""
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (self.line[1:] != self.line[:-1])
        first = np.flatnonzero(new)
        return (np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))).astype(U64)

    def ranked(self, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members line by line, the rarest first: rank and 16 bits of the word, and its times before. Words that agree in both count as
        one here, so lines may seem to share more than they do, never less."""
        rank, low = rarity[(self.word >> U64(46)).astype(np.int64)], self.word.astype(np.uint16)
        order = np.lexsort((low, rank, self.line.astype(np.uint16) if len(self.count) < 1 << 16 else self.line))
        word = ((rank.astype(np.uint32) << np.uint32(16)) | low)[order]
        return word, self._times(word)

    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the members of the prefixes: their places among all, their lines, and their places in these."""
        n = _prefix(self.count)
        line, total = np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)])
        spot = np.arange(total[-1]) - total[line]
        return self.start[line] + spot, line, spot


TABLE = "part long, spots binary, counts binary"
PARTS = "kind int, key long, lines int, short int, a array<long>, b array<long>, c array<long>, spots binary, counts binary"
BEGUN_NAMES = ["part", "keys", "age", "half", "more", "size", "words", "times", "spots", "counts"]
BEGUN = "part long, " + ", ".join(f"{c} binary" for c in BEGUN_NAMES[1:])
FOUND = "a long, root long, others binary"


def _least(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _counts(data: bytes, n: int) -> np.ndarray:
    """n counts that _least has packed."""
    return np.frombuffer(data, f"u{max(1, len(data) // max(n, 1))}").astype(np.int64)


def _parts(total: np.ndarray) -> list[pa.Array]:
    """The parts of a table of counts that hold any: number, places in the part, and counts there."""
    own = [(k, np.flatnonzero(x), x) for k, x in enumerate(total.reshape(-1, PART)) if x.any()]
    return [pa.array([k for k, _, _ in own], pa.int64()), pa.array([at.astype(np.uint16).tobytes() for _, at, _ in own], pa.binary()), pa.array([_least(x[at]).tobytes() for _, at, x in own], pa.binary())]


@frugal
def _added(table: pa.Table) -> pa.Table:
    total = np.zeros(PART, np.int64)
    for spots, counts in zip(table.column("spots").to_pylist(), table.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(spots, np.uint16)] += _counts(counts, len(spots) // 2)
    return pa.table({"part": table.column("part").slice(0, 1), "spots": pa.array([np.arange(PART, dtype=np.uint16).tobytes()]), "counts": pa.array([_least(total).tobytes()])})


def _table(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of tables of counts (part, counts)."""
    total = np.zeros((size // PART, PART), np.int64)
    added = rows.groupBy("part").applyInArrow(_added, TABLE).toArrow()  # `size` numbers at most
    for k, counts in zip(added.column("part").to_pylist(), added.column("counts").to_pylist(), strict=True):
        total[k] = _counts(counts, PART)
    return total.ravel()


class _Seen:
    """Which line keys a task meets for the first time; it forgets now and then, so it only saves work."""

    def __init__(self, most: int = 300_000):
        self.keys: set[int] = set()
        self.most = most

    def fresh(self, keys: np.ndarray) -> list[int]:
        if len(self.keys) > self.most:
            self.keys.clear()
        return [k for k, key in enumerate(keys.tolist()) if key not in self.keys and not self.keys.add(key)]


def _survey(least: tuple[int, int]):
    """key, text -> kind 0: a document's lines (numbers, two halves of keys); kind 1: the task's counts of words by bucket."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total = np.zeros(RARITY, np.int64)
        names = ["kind", "key", "lines", "short", "a", "b", "c", "spots", "counts"]
        for batch in batches:
            for lo, hi, data, bounds in text_steps(batch.column(1)):
                f = Lines(data, bounds, least)
                np.add.at(total, (f.words >> U64(46)).astype(np.int64), 1)
                cut = np.searchsorted(f.text, np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int64))) for x in (f.number, *f.keys())]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(f.per_text.astype(np.int32)), pa.array(f.short.astype(np.int32)), *lists, *[pa.nulls(hi - lo, pa.binary())] * 2], names)
        part, spots, counts = _parts(total)
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), part, *[pa.nulls(n, pa.int32())] * 2, *[pa.nulls(n, pa.list_(pa.int64()))] * 3, spots, counts], names)

    return run


def _mixed(word: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The members that Lines.ranked tells of, as 64 bits."""
    return mix64(word.astype(U64) + times.astype(U64) * _ODD)


def _parities(member: np.ndarray, start: np.ndarray) -> np.ndarray:
    """256 parities of each line's members, as four words."""
    one, at = U64(1) << (member & U64(63)), (member >> U64(6)) & U64(3)
    return np.stack([np.bitwise_xor.reduceat(np.where(at == k, one, U64(0)), start[:-1]) for k in range(4)], 1)


def _begun(rarity: np.ndarray, least: tuple[int, int]):
    """rarity: each bucket's rank. key, text -> runs of lines, packed: keys, ages (documents' keys), parities, sizes, and the members of
    their prefixes; with a part number, the task's counts of these by bucket."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        total, seen = np.zeros(HELD, np.int64), _Seen()
        for batch in batches:
            for lo, hi, data, bounds in text_steps(batch.column(1)):
                f = Lines(data, bounds, least)
                # The task's repeats of a line go here, so a line that is everywhere leaves each task a few times at most.
                keys = f.key()
                if not (fresh := seen.fresh(keys)):
                    continue
                f, keys = f.some(fresh), keys[fresh]
                word, times = f.ranked(rarity)
                member, at = _mixed(word, times), f.prefixes()[0]
                np.add.at(total, (member[at] >> U64(48)).astype(np.int64), 1)
                bits, long = _parities(member, f.start), f.count > LONG
                age = np.clip(batch.column(0).slice(lo, hi - lo).to_numpy(), 0, 2**32 - 1).astype(np.uint32)
                pack = (keys, age[f.text], bits[:, :2] ^ bits[:, 2:], bits[long, 2:], _least(f.count), word[at], _least(times[at]))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in pack), *[pa.nulls(1, pa.binary())] * 2], BEGUN_NAMES)
        part, spots, counts = _parts(total)
        yield pa.RecordBatch.from_arrays([part, *[pa.nulls(len(part), pa.binary())] * (len(BEGUN_NAMES) - 3), spots, counts], BEGUN_NAMES)

    return run


def _run_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """Of a run of lines that _begun has packed: keys, ages, 128 parities, 128 more (0 for lines that aren't long), sizes, and their prefixes'
    members, with lines and places in these."""
    data = [batch.column(name)[k].as_buffer() for name in BEGUN_NAMES[1:-2]]
    keys, age, half = (np.frombuffer(x, kind) for x, kind in zip(data, (np.int64, np.uint32, U64), strict=False))
    size, word = _counts(data[4], len(keys)), np.frombuffer(data[5], np.uint32)
    more = np.zeros((len(keys), 2), U64)
    more[size > LONG] = np.frombuffer(data[3], U64).reshape(-1, 2)
    n = _prefix(size)
    line = np.repeat(np.arange(len(n)), n)
    return keys, age, half.reshape(-1, 2), more, size, _mixed(word, _counts(data[6], len(word))), line, np.arange(len(word)) - (np.cumsum(n) - n)[line]


def _prefixes(blocks: np.ndarray, groups: int, part: int = 0, rounds: int = 1, wanted: KeyFilter | None = None, aged: bool = True):
    """blocks: into how many a bucket's members are dealt; part, rounds: only the groups of this round; wanted: the only members dealt
    out; aged: with documents' ages."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # of entries: group, token, line, place in it, mark
        owners: list[tuple] = []  # of lines: key, parities, age, size
        n = lines = 0

        def flush() -> Iterator[pa.RecordBatch]:
            group, token, line, spot, mark = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, half, more, when, size = (np.concatenate(x) for x in zip(*owners, strict=True))
            held.clear()
            owners.clear()
            order = np.argsort(group, kind="stable")
            line = line[order]
            cut = np.searchsorted(group[order], np.arange(groups + 1))
            some = np.flatnonzero(np.diff(cut))
            own = [slice(cut[g], cut[g + 1]) for g in some]
            token, key, half, size, spot, mark = token[order], keys[line], half[line], size[line], spot[order], mark[order]
            long, when = size > LONG, when[line] if aged else None
            pack = [[f(k).tobytes() for k in own] for f in (
                lambda k: token[k], lambda k: key[k], lambda k: half[k], lambda k: more[line[k][long[k]]], lambda k: when[k] if aged else _NONE,
                lambda k: _least(size[k]), lambda k: _least(spot[k]), lambda k: mark[k])]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(x, pa.binary()) for x in pack)], ["group", *PLAIN, *SHORT])

        for batch in batches:
            for row in range(batch.num_rows):
                keys, age, half, more, size, member, line, spot = _run_of(batch, row)
                if wanted is not None:
                    at = np.flatnonzero(wanted(member.view(np.int64)))
                    line, spot, member = line[at], spot[at], member[at]
                index = spot < (size - (6 * size + 6) // 7 + 1)[line]
                many = blocks[(member >> U64(48)).astype(np.int64)]
                own = (keys[line].view(U64) % many.astype(U64)).astype(np.int64)
                for block in range(int(many.max(initial=1))):
                    # An entry goes to the cell of its own block and to one with each other block; mark: its side there, 2 if it is alone.
                    k = np.flatnonzero(many > block)
                    low, high = np.minimum(own[k], block), np.maximum(own[k], block)
                    token = mix64(member[k] + (low * 0x10001 + high * 0x10000003).astype(U64) * _ODD)
                    group = ((token >> U64(32)) % U64(groups)).astype(np.uint16 if groups < 1 << 16 else np.int64)
                    if rounds > 1:
                        at = np.flatnonzero(group % rounds == part)
                        k, low, high, token, group = k[at], low[at], high[at], token[at], group[at]
                    side = np.where(low == high, 2, (own[k] == high).astype(np.int64))
                    held.append((group, token.astype(np.uint32), line[k] + lines, spot[k], (side << 1 | index[k]).astype(np.uint8)))
                    n += len(k)
                owners.append((keys, half, more, age, size))
                lines += len(size)
                if max(n, lines) >= PACK:
                    yield from flush()
                    n = lines = 0
        if held:
            yield from flush()

    return run


def _best(owner: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Of each owner's pairs the FIRST with the least value."""
    order = np.lexsort((by, owner))
    start = np.flatnonzero(np.concatenate([[True], owner[order][1:] != owner[order][:-1]]))
    return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < FIRST]


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    columns = [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]) for name, kind in PLAIN.items()]
    count = [len(x.as_buffer()) // 4 for x in table.column("token")]
    for name in SHORT:
        columns.append(np.concatenate([_counts(x.as_buffer(), n) for x, n in zip(table.column(name), count, strict=True)]))
    return tuple(columns)


def _reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest vertex that each of n vertices reaches over the links i, j."""
    low = np.arange(n)
    while True:
        now = low.copy()
        np.minimum.at(now, i, low[j])
        np.minimum.at(now, j, low[i])
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _candidates(asking: KeyFilter | None = None, every: bool = False):
    """Of each line of a group its partners with lesser keys that pass the filters, and the least key of those that candidates join.

    With `every`, all partners. Else at first, of each line and member only the likeliest and the oldest partners, and for each line
    of which a pair is left out a row without root. With `asking`, all earlier partners of the lines that are asking.

    Where a member's lines have more than LISTED partners each, these aren't named, since they grow with the square of the lines: each of the
    lines has an empty list, and meets all others of its component that have one.
    """

    @frugal
    def run(table: pa.Table) -> pa.Table:
        token, key, bits, more, when, size, spot, mark = _unpacked(table)
        bits, long = bits.reshape(-1, 2), size > LONG
        wide = np.cumsum(long) - 1  # an entry's place in `more`
        more = more.reshape(-1, 2)
        if size.max(initial=0) < 1 << 16:
            order = np.argsort((token.astype(U64) << U64(32)) | (size.astype(U64) << U64(16)) | (key.view(U64) & U64(0xFFFF)))
        else:
            order = np.lexsort((key, size, token))
        t, k = token[order], key[order]
        # Entries that other tasks have dealt out too go, but for rare ones, which meet themselves below.
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
        last = np.append(t[1:] != t[:-1], True)
        order = order[new & ~(last & np.concatenate([[True], last[:-1]])[: len(t)])]
        token, key, size, bits, spot, wide, mark = (x[order] for x in (token, key, size.astype(np.int32), bits, spot.astype(np.int32), np.where(long, wide, -1), mark))
        when = when[order] if len(when) else when
        asks = asking(key) if asking is not None else None
        known, code = np.unique(key, return_inverse=True)  # pairs are told by places among these
        index, side, rest = (mark & 1) == 1, mark >> 1, size - spot
        sided = bool((side != 2).any())
        # Of each member's lines, by size: a line meets those before it that are in the index and not too short.
        place = (token.astype(np.int64) << 31) | size
        shorter = np.flatnonzero(index)
        low = np.searchsorted(place[shorter], (token.astype(np.int64) << 31) | -(-3 * size.astype(np.int64) // 4))
        high = np.cumsum(index) - index
        many = np.maximum(high - low, 0)
        run = np.concatenate([[0], np.cumsum(many)])
        found, cut = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        number = np.cumsum(np.append(True, token[1:] != token[:-1])[: len(token)]) - 1  # an entry's member
        begin = np.flatnonzero(np.diff(number, prepend=-1))
        pairs_of, thick, meets = np.zeros(len(begin), np.int64), np.zeros(len(begin), bool), np.zeros(len(token), bool)
        tied, reach = np.empty((2, 0), np.int64), np.arange(len(known))
        rest_of, size_of = rest[shorter], size[shorter]
        lo = 0
        while lo < len(token):
            hi = max(lo + 1, int(np.searchsorted(run, run[lo] + STEP, "right")) - 1)
            step = many[lo:hi]
            j = np.arange(run[lo], run[hi]) + np.repeat(low[lo:hi] - run[lo:hi], step)  # places in the index
            both = np.repeat(size[lo:hi], step) + size_of[j]
            ok = np.flatnonzero(7 * np.minimum(np.repeat(rest[lo:hi], step), rest_of[j]).astype(np.int64) >= 3 * both.astype(np.int64))
            i, j, both = np.repeat(np.arange(lo, hi), step)[ok], shorter[j[ok]], both[ok]
            if sided or asks is not None:
                ok = (side[i] == 2) | (side[i] != side[j])
                if asks is not None:
                    ok &= (asks[i] & (when[j] <= when[i])) | (asks[j] & (when[i] <= when[j]))
                i, j, both = i[ok], j[ok], both[ok]
            apart = np.bitwise_count(bits[i, 0] ^ bits[j, 0]).astype(np.int32) + np.bitwise_count(bits[i, 1] ^ bits[j, 1])
            ok = np.flatnonzero(7 * ((both - apart) // 2).astype(np.int64) >= 3 * both.astype(np.int64))
            i, j, both, apart = i[ok], j[ok], both[ok], apart[ok]
            k = np.flatnonzero(np.minimum(wide[i], wide[j]) >= 0)
            if len(k):
                x, y = more[wide[i[k]]], more[wide[j[k]]]
                apart[k] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) + np.bitwise_count(x ^ bits[i[k]] ^ y ^ bits[j[k]]).sum(1, dtype=np.int64)
                out = k[7 * ((both[k] - apart[k]) // 2).astype(np.int64) < 3 * both[k].astype(np.int64)]
                i, j, both, apart = (np.delete(x, out) for x in (i, j, both, apart))
            if asks is None and not every and len(i):
                late = (when[i] > when[j]) | ((when[i] == when[j]) & (key[i] > key[j]))
                later, older = np.where(late, i, j), np.where(late, j, i)
                tried = np.zeros(len(i), bool)
                tried[_best(later, apart / both)] = True
                tried[_best(later, when[older])] = True
                cut.append(np.unique(np.concatenate([key[i[~tried]], key[j[~tried]]])))
                i, j = i[tried], j[tried]
            elif len(i):
                first, end = number[lo], number[hi - 1] + 1
                meets[i] = meets[j] = True
                lines = np.bincount(number[begin[first] : hi][meets[begin[first] : hi]] - first, minlength=end - first)
                pairs_of[first:end] += np.bincount(number[i] - first, minlength=end - first)
                thick[first:end] |= pairs_of[first:end] > LISTED * lines
                out = thick[number[i]]
                if out.any():
                    x, y = code[i[out]], code[j[out]]
                    some = reach[x] != reach[y]
                    tied = np.concatenate([tied, [x[some], y[some]]], 1)
                    if tied.shape[1] > TIED:
                        reach = _reached(len(known), *tied)
                        far = np.flatnonzero(reach != np.arange(len(known)))
                        tied = np.stack([far, reach[far]])
                    i, j = i[~out], j[~out]
            i, j = code[i], code[j]
            i, j = i[i != j], j[i != j]
            found.append(np.maximum(i, j) * len(known) + np.minimum(i, j))
            lo = hi
        pairs, cut = np.sort(np.concatenate(found)), np.unique(np.concatenate(cut))
        pairs = pairs[np.append(pairs[1:] != pairs[:-1], True)[: len(pairs)]]
        pairs = np.stack(np.divmod(pairs, max(1, len(known))), 1)
        met = np.zeros(len(known), bool)
        many = np.zeros(len(known), bool)
        many[code[meets & thick[number]]] = True
        met[pairs] = True
        met |= many
        ids, at, many = known[met], (np.cumsum(met) - 1)[pairs], many[met]
        pairs, tied = known[pairs], (np.cumsum(met) - 1)[tied]
        root = ids[_reached(len(ids), np.append(at[:, 0], tied[0]), np.append(at[:, 1], tied[1]))]
        first = np.searchsorted(at[:, 0], np.arange(len(ids) + 1))
        low = (pairs[:, 1] & LOW).astype(np.uint32)
        others = [low[a:z].tobytes() if z > a else None for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        n = len(ids) + (many := np.flatnonzero(many)).size
        roots = pa.array(np.concatenate([root, root[many], cut]), mask=np.arange(n + len(cut)) >= n)
        return pa.table({"a": pa.array(np.concatenate([ids, ids[many], cut])), "root": roots, "others": pa.array(others + [b""] * len(many) + [None] * len(cut), pa.binary())})

    return run


def _fetch(documents: KeyFilter, lines: KeyFilter, least: tuple[int, int]):
    """key, text -> line key, document, number and sorted members of lines that may be wanted in documents that may be."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.array(np.flatnonzero(documents(batch.column(0).to_numpy())))
            key, text = batch.column(0).take(some).to_numpy(), batch.column(1).take(some)
            for lo, _, data, bounds in text_steps(text):
                f = Lines(data, bounds, least)
                keys = f.key()
                own = np.flatnonzero(lines(keys))
                if len(own):
                    f = f.some(own)
                    member = f.members()
                    sets = pa.array([np.sort(member[a:z]).tobytes() for a, z in zip(f.start[:-1], f.start[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(key[lo + f.text]), pa.array(f.number), sets], ["id", "key", "line", "members"])

    return run


def similar(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Whether the sets of each of the pairs, sorted by the first of the two, have a Jaccard similarity of 3/4 or more."""
    size = np.array([len(x) for x in sets], np.int64)
    known, code = np.unique(np.concatenate(sets), return_inverse=True) if sets else (_NONE, _NONE)
    code, end = code.astype(np.int32), np.cumsum(size)
    coded = [code[z - n : z] for n, z in zip(size.tolist(), end.tolist(), strict=True)]
    cut = np.searchsorted(pairs[:, 0], np.arange(len(sets) + 1))
    shared, own = np.zeros(len(pairs), np.int64), np.zeros(len(known), bool)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        others = pairs[cut[k] : cut[k + 1], 1]
        own[coded[k]] = True
        first = np.cumsum(size[others]) - size[others]
        shared[cut[k] : cut[k + 1]] = np.add.reduceat(own[np.concatenate([coded[j] for j in others.tolist()])], first, dtype=np.int64)
        own[coded[k]] = False
    return 4 * shared >= 3 * (size[pairs].sum(1) - shared)


DECIDED = "id long, links long, gone boolean, root long"


@frugal
def _decided(table: pa.Table) -> pa.Table:
    """Sets and lists of partners of one cell -> of each line with links their number there, whether one is earlier, and a line that they reach."""
    ids, many, x, y = (table.column(c).to_numpy() for c in ("id", "many", "x", "y"))
    has = table.column("members").is_valid().to_numpy()
    lines, first = np.unique(ids[has], return_index=True)
    told = table.select(["members", "first_key", "first_line"]).take(pa.array(np.flatnonzero(has)[first]))
    sets = [np.frombuffer(m.as_buffer(), U64) for m in told.column("members")]
    age = np.stack([told.column(c).to_numpy() for c in ("first_key", "first_line")], 1) if len(lines) else np.empty((0, 2), np.int64)
    low = lines & LOW
    by_low = np.argsort(low, kind="stable")
    low = low[by_low]
    pairs = [np.empty(0, np.int64)]
    # Lines whose lists are empty meet all such lines of their component, of which a first look at sizes and parities leaves few in vain.
    others, blank = table.column("others"), pc.equal(pc.binary_length(table.column("others")), 0).fill_null(False).to_numpy()
    own, at = np.unique(np.searchsorted(lines, ids[blank]), return_index=True)
    if len(own):
        if not np.isin(ids[blank], lines).all():
            raise ValueError("a candidate's set is not in its cell")
        size, block = np.array([len(sets[k]) for k in own.tolist()], np.int64), (lines[own] & LOW) % many[blank][at]
        bits = _parities(np.concatenate([sets[k] for k in own.tolist()]), np.append(0, np.cumsum(size)))
        apart, kin = (x[blank][0] != y[blank][0]), table.column("first_key").to_numpy()[blank][at]
        for part in np.split(order := np.argsort(kin, kind="stable"), np.flatnonzero(np.diff(kin[order])) + 1):
            for k in range(1, len(part)):
                before, one = part[:k], part[k]
                both = size[before] + size[one]
                shared = (both - np.bitwise_count(bits[before] ^ bits[one]).sum(1, dtype=np.int64)) // 2
                ok = 7 * np.minimum(shared, np.minimum(size[before], size[one])) >= 3 * both
                if many[blank][at[one]] > 1:  # in a cell of two blocks a line meets those of the other
                    ok &= (block[before] != block[one]) == apart
                pairs.append(own[one] * len(lines) + own[before[ok]])
    # Many lists of a line name the same partners, so they are united line by line.
    lists = np.flatnonzero(~has & ~blank)
    lists = lists[np.argsort(ids[lists], kind="stable")]
    for rows in np.split(lists, np.flatnonzero(np.diff(ids[lists])) + 1) if len(lists) else ():
        k = rows[0]
        other = np.unique(np.concatenate([np.frombuffer(others[r].as_buffer(), np.uint32) for r in rows.tolist()])).astype(np.int64)
        if many[k] > 1:  # in a cell of two blocks a line meets those of the other, else those of its own
            other = other[other % many[k] == x[k] + y[k] - (ids[k] & LOW) % many[k]]
        begin = np.searchsorted(low, other)
        count = np.searchsorted(low, other, "right") - begin
        if not count.all():
            raise ValueError("a candidate's set is not in its cell")
        spot = by_low[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)]
        own = np.searchsorted(lines, ids[k])
        spot = spot[spot != own]
        pairs.append(np.maximum(spot, own) * len(lines) + np.minimum(spot, own))
    at = np.stack(np.divmod(np.unique(np.concatenate(pairs)), max(1, len(lines))), 1)
    ok = similar(sets, at)
    i, j = at[ok, 0], at[ok, 1]
    links = np.bincount(np.concatenate([i, j]), minlength=len(lines))
    late = (age[i, 0] > age[j, 0]) | ((age[i, 0] == age[j, 0]) & (age[i, 1] > age[j, 1]))
    gone = np.zeros(len(lines), bool)
    gone[np.where(late, i, j)] = True
    some = np.flatnonzero(links)
    root = lines[_reached(len(lines), i, j)]
    return pa.table({"id": pa.array(lines[some]), "links": pa.array(links[some]), "gone": pa.array(gone[some]), "root": pa.array(root[some])})


def _wanted_members(asking: KeyFilter):
    """Runs of lines -> the members of the prefixes of lines that are asking."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, *_, member, line, _ = _run_of(batch, k)
                member = member[asking(keys)[line]]
                if len(member):
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(member).view(np.int64))], ["member"])

    return run


@frugal
def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, others, root, many -> the blocks in which a line has partners (low: null), and these, by the bits that name them, with the line's block."""
    for batch in batches:
        ids, roots, many = (batch.column(c).to_numpy() for c in (0, 2, 3))
        size = [len(x.as_buffer()) // 4 for x in batch.column(1)]
        low = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(1)]).astype(np.int64)
        row = np.repeat(np.arange(len(ids)), size)
        ahead = np.unique(np.stack([ids[row], many[row], roots[row], low % many[row]]), axis=1)
        back = np.unique(np.stack([many[row], roots[row], low, (ids[row] & LOW) % many[row]]), axis=1)
        n, k = ahead.shape[1], back.shape[1]
        lows = pa.array(np.concatenate([np.zeros(n, np.int64), back[2]]), mask=np.arange(n + k) < n)
        out = [pa.array(np.concatenate([ahead[0], np.zeros(k, np.int64)])), *(pa.array(np.concatenate([a, b])) for a, b in ((ahead[1], back[0]), (ahead[2], back[1])))]
        yield pa.RecordBatch.from_arrays([*out, lows, pa.array(np.concatenate([ahead[3], back[3]]))], ["id", "many", "root", "low", "block"])


def _verified(plain: DataFrame, classes: DataFrame, found: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(id, links, gone, root) for lines that have links among the candidates `found`; an id may come several times. And the sets of
    equal lines (id, b, first, n) of all candidates."""
    comps = components.components(found.where("root is not null").select("a", F.col("root").alias("b")))
    sizes = comps.groupBy("root").agg(F.ceil(F.count("*") / CELL).alias("many"))
    held = materialize(comps.join(sizes, "root").join(classes.withColumnRenamed("a", "id"), "id"), "held")
    placed = held.groupBy("id", "root", "many").agg(F.min("first").alias("first")).select("id", "root", "many", F.col("first.key").alias("first_key"), F.col("first.line").alias("first_line"))
    placed = materialize(placed, "placed")
    cells = max(1, -(-placed.count() // CELL))
    documents, lines = KeyFilter(placed.select("first_key").distinct()), KeyFilter(placed.select("id"))
    sets = plain.mapInArrow(_fetch(documents, lines, least), "id long, key long, line long, members binary").join(placed, "id").where("key = first_key and line = first_line")
    sets = sets.groupBy("id").agg(F.first(F.struct("members", "root", "many", "first_key", "first_line")).alias("s")).select("id", "s.*")
    places = placed.select(F.col("id").alias("a"), "root", "many")
    lists = found.where("length(others) > 0").select("a", "others").join(places, "a").withColumnRenamed("a", "id")
    blank = materialize(found.where("length(others) = 0").select("a", "others").distinct().join(places, "a").withColumnRenamed("a", "id"), "blank")
    # A component that fits in one cell shares it with others. The lines of a larger one are dealt into blocks, of which two meet where
    # they have candidates: a line's set and lists go to the blocks of its partners, and a partner's set to the line's block. A line with
    # an empty list goes to all blocks.
    block = F.pmod(F.col("id").bitwiseAND(F.lit(LOW).cast("long")), "many")
    own, other = lists.where("many > 1").mapInArrow(_partners, "id long, many long, root long, low long, block long"), F.col("low").isNull()
    met = materialize(own.distinct(), "met")
    low = F.col("id").bitwiseAND(F.lit(LOW).cast("long"))
    back = met.where(~other).select("root", "low", "block").join(placed.where("many > 1").select("id", "root", low.alias("low")), ["root", "low"]).select("id", "block")
    ahead = met.where(other).select("id", "block")
    around = blank.where("many > 1").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("block"))
    dealt = lambda df, blocks: df.join(blocks, "id", "left").withColumn("x", F.coalesce(F.least(block, "block"), F.lit(0).cast("long"))).withColumn("y", F.coalesce(F.greatest(block, "block"), F.lit(0).cast("long")))
    cell = F.when(F.col("many") == 1, F.pmod("root", F.lit(cells))).otherwise(F.col("root")).alias("cell")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    where = [cell, *(F.when(F.col("many") == 1, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("x", "y"))]
    sets = dealt(sets, ahead.unionByName(back).unionByName(around).distinct()).select(*where, "id", "many", "members", null("binary", "others"), "first_key", "first_line")
    lists = dealt(lists, ahead).select(*where, "id", "many", null("binary", "members"), "others", null("long", "first_key"), null("long", "first_line"))
    named, blank = blank, dealt(blank, around).select(*where, "id", "many", null("binary", "members"), "others", F.col("root").alias("first_key"), null("long", "first_line"))
    rows = sets.unionByName(lists).unionByName(blank).withColumn("whole", F.col("many") == 1)
    decided = materialize(rows.groupBy("whole", "cell", "x", "y").applyInArrow(_decided, DECIDED), "decided")
    discard(placed, met, named)
    return decided, held.drop("root", "many")


def line_tables(docs: DataFrame, key: str = "doc_id", text: str = "text", every: bool = False, least: tuple[int, int] = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (key, lines, short), lines (key, line, a, b), sets of equal lines (a, b, first, gone): those of several lines or with
    links (without `every`: with an earlier match).

    With `every`, these also have n (lines), links (to other sets) and root (first line that links and equal words reach).
    """
    prepare(docs.sparkSession)
    one_file_a_task(docs.sparkSession)
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    parts = materialize(plain.mapInArrow(_survey(least), PARTS), "lines")
    rarity = np.empty(RARITY, np.uint16)
    rarity[np.argsort(_table(parts.where("kind = 1").select(F.col("key").alias("part"), "spots", "counts"), RARITY), kind="stable")] = np.arange(RARITY) * (1 << 16) // RARITY
    lines = parts.where("kind = 0").select("key", F.inline(F.arrays_zip(F.col("a").alias("line"), F.col("b").alias("a"), F.col("c").alias("b"))))
    classes = materialize(lines.groupBy("a", "b").agg(F.min(F.struct("key", "line")).alias("first"), F.count("*").alias("n")), "classes")
    begun = materialize(plain.mapInArrow(_begun(rarity, least), BEGUN), "begun")
    held = _table(begun.where("part is not null").select("part", "spots", "counts"), HELD)
    runs = begun.where("part is null")
    # A bucket counts as hot by what it holds beyond a few times the mean.
    blocks = 1 + np.maximum(0, held - 4 * held.sum() // HELD) // BLOCK
    dealt = int((held * blocks).sum())
    groups = max(GROUPS, dealt // GROUP)
    rounds = max(1, min(-(-dealt // ROUND), -(-ROUNDS * dealt // max(1, int(held.sum()))), groups))
    packed = "group long, " + ", ".join(f"{c} binary" for c in (*PLAIN, *SHORT))

    def candidates(members: KeyFilter | None = None, **how) -> DataFrame:
        some = [runs.mapInArrow(_prefixes(blocks, groups, k, rounds, members, not how.get("every")), packed).groupBy("group").applyInArrow(_candidates(**how), FOUND) for k in range(rounds)]
        return reduce(DataFrame.unionByName, [materialize(x, "found") for x in some])

    gone = F.bool_or("gone").alias("gone")
    if every:
        found = candidates(every=True)
        discard(begun)
        decided, held = _verified(plain, classes, found, least)
        discard(found)
        firsts = held.groupBy("id").agg(F.min("first").alias("first"))
        roots = materialize(components.components(decided.select(F.col("id").alias("a"), F.col("root").alias("b"))).join(firsts, "id"), "roots")
        roots = roots.join(roots.groupBy("root").agg(F.min("first").alias("place")), "root").select("id", "place")
        linked = materialize(decided.groupBy("id").agg(gone, F.sum("links").alias("links")).join(roots, "id"), "linked")
        several = classes.where("n > 1").withColumnRenamed("a", "id").join(linked, "id", "left")
        told = several.unionByName(held.where("n = 1").join(linked, "id"))
        told = told.select(F.col("id").alias("a"), "b", "first", F.coalesce("gone", F.lit(False)).alias("gone"), "n", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("place", "first").alias("root"))
        return parts.where("kind = 0").select("key", "lines", "short"), lines, materialize(told, "told")

    found = candidates()
    out = _verified(plain, classes, found, least)[0].where("gone").select("id")
    # Lines with pairs that weren't tried, and no earlier match so far: of these all pairs are tried.
    asking = materialize(found.where("root is null").select(F.col("a").alias("id")).distinct().join(out, "id", "left_anti"), "asking")
    if not asking.isEmpty():
        keys = KeyFilter(asking)
        members = KeyFilter(materialize(runs.mapInArrow(_wanted_members(keys), "member long").distinct(), "members"))
        out = out.unionByName(_verified(plain, classes, candidates(members, asking=keys), least)[0].where("gone").select("id"))
    discard(begun)
    told = classes.join(out.distinct().select(F.col("id").alias("a"), F.lit(True).alias("gone")), "a", "left")
    told = told.where("gone or n > 1").select("a", "b", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    return parts.where("kind = 0").select("key", "lines", "short"), lines, materialize(told, "told")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """A row for each key with lines: key, n_lines, n_removed, n_near (lines that match an earlier line of other words), removed (line numbers from 0, ascending)."""
    rows, lines, classes = line_tables(docs, key, text, least=least)
    marked = lines.join(classes, ["a", "b"]).select("key", "line", "gone", (F.col("gone") | (F.struct("key", "line") != F.col("first"))).alias("out"))
    own = marked.groupBy("key").agg(F.count_if("gone").alias("n_near"), F.array_sort(F.collect_set(F.when(F.col("out"), F.col("line")))).alias("removed"))
    rows = rows.groupBy("key").agg(F.max("lines").alias("n_lines")).join(own, "key", "left")
    removed = F.coalesce("removed", F.array().cast("array<bigint>"))
    return rows.select("key", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), removed.alias("removed"))


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """A row for each document: key, n_lines, n_short, n_removed, n_near, n_links, removed, class_ids.

    n_short: lines with words that are too short to be looked at. n_links: links of its lines to sets of lines with other words. removed: line numbers, comma-joined. class_ids: line=key:line of
    each line that equals or matches another, comma-joined; the second half is the earliest line of the class.
    """
    rows, lines, sets = line_tables(docs, key, text, True, least)
    marked = lines.join(sets, ["a", "b"]).withColumn("out", F.col("gone") | (F.struct("key", "line") != F.col("first")))
    told = F.struct("line", F.concat_ws(":", "root.key", "root.line").alias("root"))
    own = marked.groupBy("key").agg(
        F.count_if("gone").alias("n_near"), F.sum("links").alias("n_links"), F.array_sort(F.collect_set(F.when(F.col("out"), F.col("line")))).alias("removed"),
        F.array_sort(F.collect_set(F.when((F.col("n") > 1) | (F.col("links") > 0), told))).alias("classes"),
    )
    own = rows.groupBy("key").agg(F.max("lines").cast("long").alias("n_lines"), F.max("short").cast("long").alias("n_short")).join(own, "key", "left").withColumn("n_removed", F.size(F.coalesce("removed", F.array().cast("array<bigint>"))).cast("long"))
    zero, blank = F.lit(0).cast("long"), F.lit("")
    rows = docs.select(key).join(own.withColumnRenamed("key", "__key"), F.col(key).cast("long") == F.col("__key"), "left")
    classes = F.array_join(F.transform("classes", lambda x: F.concat_ws("=", x["line"], x["root"])), ",")
    return rows.select(key, *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_short", "n_removed", "n_near", "n_links")], F.coalesce(F.array_join("removed", ","), blank).alias("removed"), F.coalesce(classes, blank).alias("class_ids"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", least: tuple[int, int] = LEAST) -> DataFrame:
    """docs with the removed lines gone from the texts; the column `length`, if there is one, tells the new length of changed texts."""
    told = removed_lines(docs, key, text, least).where("n_removed > 0").select(F.col("key").alias("__key"), F.col("removed").alias("__removed"))
    rows = docs.join(told, F.col(key).cast("long") == F.col("__key"), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda line, k: ~F.array_contains("__removed", k.cast("long"))), "\n")
    changed = F.col("__removed").isNotNull()
    rows = rows.withColumn(text, F.when(changed, kept).otherwise(F.col(text)))
    if length in docs.columns:
        rows = rows.withColumn(length, F.when(changed, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return rows.select(*docs.columns)
