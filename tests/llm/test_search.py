"""Vector codes, ranked search and decontamination, against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from kindred.llm import compress, decontaminate, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, rank int, n_words int, runs string, items string, key long, term long"
ITEMS = "item_id long, text string, term long, gram string"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def texts(rng, n, vocabulary):
    return [" ".join(rng.choice(vocabulary) + rng.choice(["", ".", " -", "\n", "_"]) for _ in range(rng.randrange(60))) for _ in range(n)]


# Vector codes


@pytest.mark.parametrize("dim", [1, 3, 4])
def test_tree(dim):
    rng = np.random.default_rng(dim)
    for n in (1, 7, 9, 300, 3000):
        points = rng.integers(-9, 9, (n, dim)).astype(np.int32)
        book = rng.integers(-9, 9, (17, dim)).astype(np.int64)
        book[5] = book[3]
        near = ((points[:, None].astype(np.int64) - book) ** 2).sum(2).argmin(1)
        tree = compress.Tree(points)
        again = compress.Tree(tree.points, tree.order)
        total = np.zeros_like(book)
        np.add.at(total, near, points)
        for t in (tree, again):
            assert (t.assigned(book) == near).all()
            sums, count = t.sums(book)
            assert (sums == total).all() and (count == np.bincount(near, minlength=17)).all()


def test_tree_assigns_whole_nodes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 4))
    points = (centres[rng.integers(0, 16, 8192)] + rng.integers(-20, 20, (8192, 4))).astype(np.int32)
    tree = compress.Tree(points)
    looked = sum(int((np.diff(tree.cuts[level])[nodes]).sum()) for level, nodes, entry, open_ in tree.filtered(centres.astype(np.int64)) if open_ is not None)
    assert looked < 400


def plain_codes(rows, parts=16, entries=64, rounds=2):
    fine = [(k, v, label) for k, v, label in rows if v is not None and len(v) and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(k, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v], label) for k, v, label in fine]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [r for r in whole if len(r[1]) == len(first[0][1])] if first else []
    first = [r for r in first if len(r[1]) == len(first[0][1])][:entries]
    width = len(first[0][1]) // parts if first else 0
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    nearest = lambda x, book: min((apart(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, v, _ in whole:
                own[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], collections.Counter()
    for k, v, label in whole:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((k is None, k or 0, c, e, by_label[label], digest) for k, c, e, label in out)


@pytest.mark.parametrize("n", [0, 1, 40, 300])
def test_codes(spark, monkeypatch, n):
    monkeypatch.setattr(compress, "BLOCK", 64)
    rng = random.Random(n)
    rows = [(k * 3 % 1000, [np.float32(rng.choice([0.0, -0.001, 0.25, rng.gauss(0, 1)])).item() for _ in range(32)], rng.choice([None, 1, 2])) for k in range(n)]
    if n > 100:
        rows += [rows[5], (None, rows[7][1], 1), (9, None, 1), (10**6, [None] * 32, 1), (10**6 + 1, [float("nan")] + [0.0] * 31, 1), (10**6 + 2, [float("inf")] + [0.0] * 31, 2)]
        rows += [(10**6 + 3, [1.0] * 16, 1), (10**6 + 4, [1.0] * 33, 1), (10**6 + 5, [], 2), (10**6 + 6, [3e38, -3e38] * 16, 7), (rows[3][0], rows[4][1], 2)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, code string, error long, key int").repartition(3)
    got = compress.coded(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got.collect()) == plain_codes(rows)


# Ranked search


def plain_search(docs, items, k=20):
    bags = [(key, collections.Counter(terms(text))) for key, text in docs]
    bags = [(key, bag, bag.total()) for key, bag in bags if bag]
    total, df = sum(n for _, _, n in bags), collections.Counter(t for _, bag, _ in bags for t in bag)
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        if item is not None:
            asked[item].update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for key, bag, n in bags:
            m = 75 + 25 * n * len(bags) // total
            score = sum(times * math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, times in wanted.items() if t in bag)
            if score > 0 and key is not None:
                found.append((-score, key))
        out += [(item, rank, key, -score) for rank, (score, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, monkeypatch, odd_rows, small):
    if small:
        for name, value in (("POSTINGS", 300), ("DOCUMENTS", 70), ("ENTRIES", 40)):
            monkeypatch.setattr(ranked, name, value)
    rng = random.Random(1)
    vocabulary = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(300)] + ["ÜBER", "Über", "x1", "漢字", "A"]
    docs = [(rng.randrange(400), t) for t in texts(rng, 500, vocabulary)] + [r[:2] for r in odd_rows] + [(2000 + k, "same words in all of these") for k in range(50)]
    items = list(enumerate(texts(rng, 30, vocabulary))) + [(100, None), (101, ""), (102, "words these SAME"), (102, "same w3"), (None, "w1"), (103, "nowhere1 to"), (104, "lorem " * 3000)]
    got = ranked.search(ranked.built(spark.createDataFrame([(*d, 1, 2, 3, "r", "i", 4, 5) for d in docs], DOCS).repartition(4)), spark.createDataFrame([(*i, 1, "g") for i in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items)


def test_search_in_nothing(spark):
    none, items, docs = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 1, "g")], ITEMS), spark.createDataFrame([(1, "a", 1, 2, 3, "r", "i", 4, 5)], DOCS)
    assert ranked.search(ranked.built(none), items).count() == 0 == ranked.search(ranked.built(docs), items.where("false")).count()


def test_bitwise_sums_and_bests():
    rng = np.random.default_rng(3)
    total, plain = np.zeros((40, 5), np.uint64), np.zeros(320, np.int64)
    for _ in range(60):
        places = np.unique(rng.integers(0, 320, rng.integers(1, 200)))
        values = rng.integers(0, 1 << 30, len(places))
        slices, word, _ = ranked.bitmaps(values, places, np.zeros(len(places), np.int64))
        ranked.added(total, word, slices)
        plain[places] += values
    assert all(sum(int(total[b, p >> 6] >> np.uint64(p & 63) & np.uint64(1)) << b for b in range(40)) == plain[p] for p in range(320))
    scores = rng.integers(0, 6, (7, 128))
    scores[6] = 0
    maps, word, owner = ranked.bitmaps(scores.ravel(), np.tile(np.arange(128), 7), np.repeat(np.arange(7), 128))
    for k in (1, 5, 40, 128):
        row, place = ranked.largest(maps.reshape(len(maps), 7, 2), k)
        want = [(r, p) for r in range(7) for p in sorted(sorted((p for p in range(128) if scores[r, p]), key=lambda p: (-scores[r, p], p))[:k])]
        assert list(zip(row.tolist(), place.tolist(), strict=True)) == want


def test_search_in_small_steps(monkeypatch):
    """The same bests, however many items are looked at together."""
    rng = np.random.default_rng(4)
    starts = np.concatenate([[0], np.cumsum(rng.integers(1, 50, 30))])
    places = np.concatenate([np.sort(rng.choice(100, z - a, replace=False)) for a, z in zip(starts[:-1], starts[1:], strict=True)])
    value = rng.integers(1, 1 << 20, starts[-1])
    slices = [np.packbits((value >> b & 1).astype(bool), bitorder="little") for b in range(20)]
    first = np.arange(0, 41, 5)
    items = ranked.Items(np.arange(8), first, np.concatenate([np.sort(rng.choice(40, 5, replace=False)) for _ in range(8)]).astype(np.uint64), rng.integers(1, 9000, 40))
    want = None
    for step in (1 << 25, 1):
        monkeypatch.setattr(ranked, "SUMS", step)
        got = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*items.found(np.arange(100) * 2, np.arange(30, dtype=np.uint64), starts, places, slices, 6), strict=True)), strict=True))
        want = want or got
        assert got == want and len(got) > 30


# Decontamination


def plain_hits(docs, items, window=10):
    grams = collections.defaultdict(set)
    for item, text in items:
        w = terms(text)
        if item is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                grams[tuple(w[k : k + n])].add(str(item))
    out = []
    for key, text in docs:
        w, hit, found = terms(text), set(), set()
        for n in range(1, window + 1):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k : k + n])]
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), hit))
    return out


def contaminated_rows(odd_rows):
    rng = random.Random(8)
    vocabulary = ["Haus", "a", "b", "ÄRGER", "x9", "漢字"]
    items = list(enumerate(texts(rng, 12, vocabulary))) + [(50, "one TWO three"), (51, None), (52, " . "), (53, "b"), (None, "x9"), (54, "one two three"), (50, "one TWO three"), (55, "lorem ipsum " * 6)]
    items = [i for i in items if len(terms(i[1])) != 1 or i[0] == 53]
    docs = [(k, t) for k, t in enumerate(texts(rng, 60, vocabulary))] + [r[:2] for r in odd_rows]
    docs += [(1000 + k, f"{' '.join(rng.choice(vocabulary[:1] + vocabulary[2:]) for _ in range(9))} {text or ''}! tail-{k}") for k, (_, text) in enumerate(items)] + [(2000, "ONE, two; three. One two-three"), (2000, "one two four")]
    return docs, items


@pytest.mark.parametrize("block", [None, 7])
def test_contamination(spark, odd_rows, block):
    docs, items = contaminated_rows(odd_rows)
    df = spark.createDataFrame([(*d, 1, 2, 3, "r", "i", 4, 5) for d in docs], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(*i, 1, "g") for i in items], ITEMS)
    want = plain_hits(docs, items)
    order = lambda rows: sorted(rows, key=str)
    got = decontaminate.contamination(df, benchmark, block=block)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert order(map(tuple, got.collect())) == order(w[:6] for w in want) and 10 < sum(w[5] for w in want) < len(want)
    left = decontaminate.decontaminated(df, benchmark, spans=False, block=block)
    assert left.columns == df.columns and order((r.doc_id, r.text) for r in left.collect()) == order(d for d, w in zip(docs, want, strict=True) if not w[5])
    clean = []
    for (key, text), w in zip(docs, want, strict=True):
        own, out, at = [m.span() for m in TERM.finditer(text or "")], "", 0
        for k in sorted(w[6]):
            if k - 1 not in w[6]:
                out += text[at : own[k][0]]
            at = own[k][1]
        clean.append((key, None if text is None else out + text[at:]))
    cut = decontaminate.decontaminated(df, benchmark, block=block)
    assert cut.columns == df.columns and order((r.doc_id, r.text) for r in cut.collect()) == order(clean)


def test_contamination_of_nothing(spark):
    none, docs = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 1, 2, 3, "r", "i", 4, 5)], DOCS)
    items = spark.createDataFrame([(1, "a b", 1, "g")], ITEMS)
    assert decontaminate.contamination(none, items).count() == 0
    assert [tuple(r)[:4] for r in decontaminate.contamination(docs, items.where("false")).collect()] == [(1, 2, 0, 0)]


def test_windows_are_verified():
    """A hash that meets another's isn't a hit."""
    import pyarrow as pa

    from kindred.llm.words import ALNUM, words

    table = pa.table({"hash": pa.array([0], pa.int64()), "n": pa.array([2], pa.int32()), "gram": pa.array([b"a b"], pa.binary()), "item": ["1"]})
    data = np.frombuffer(b"a c a b", np.uint8)
    found = words(data, np.array([0, len(data)]), ALNUM)
    windows = decontaminate.Windows.of(table)
    assert not list(windows.scan(data, *found))
    run = dict(decontaminate._runs(found[2], [2]))[2]
    windows.hashes, windows.bitmap[:] = np.sort(run)[:1], 255
    windows.hashes = run[:1]
    assert not list(windows.scan(data, *found))
    windows.hashes = run[2:]
    assert list(windows.scan(data, *found)) == [(2, 2, 0)]
