"""Operators over a whole corpus, against brute force."""

import collections
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import ann, components, langid, linedup, mixing, neardup, quality, queries, shards
from kindred.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def line_matches(rows):
    """The removed line numbers of each document, by all pairs of lines."""
    lines = []
    for key, text in sorted((r for r in set(rows) if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, line in enumerate(text.split("\n")):
            words = WORD.findall(lower(line))
            if len(words) >= 5 or sum(len(w.encode()) for w in words) >= 16:
                lines.append((key, k, collections.Counter(words), len(words)))
    gone, holders = collections.defaultdict(list), collections.defaultdict(list)
    for n, (key, k, bag, size) in enumerate(lines):
        shared = collections.Counter()
        for w, m in bag.items():
            for o, c in holders[w]:
                shared[o] += min(m, c)
        if any(4 * s >= 3 * (size + lines[o][3] - s) for o, s in shared.items()):
            gone[key].append(k)
        for w, m in bag.items():
            holders[w].append((n, m))
    return gone


def test_line_dedup(spark, documents, odd, odd_rows, none):
    base = [(k, t) for k, t in documents.items() if k < 150]
    base += [(10**6, "a b c d e\na b c d f\nA B c d e e x y\n\nb a c e d"), (10**6 + 1, "x\n\nTHE quick brown fox jumps over it all day long\nquick the brown fox jumps over it all day long now")]
    df = spark.createDataFrame(base, "doc_id long, text string").repartition(3)
    want = line_matches(base)
    for r in linedup.line_report(df).collect():
        assert r.removed == ",".join(map(str, sorted(want[r.doc_id]))) and r.n_removed == len(want[r.doc_id])
    want = line_matches([r[:2] for r in odd_rows])
    texts = {r[0]: r[1] for r in odd_rows}
    out = linedup.deduplicated(odd).collect()
    assert len(out) == len(odd_rows) and out[0].__fields__ == odd.columns
    for r in out:
        text = texts[r.doc_id]
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in want[r.doc_id]))
    assert linedup.line_report(none).count() == 0


def shingle_set(text):
    words = WORD.findall(lower(text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_components(rows):
    sets = {k: shingle_set(t) for k, t in rows if k is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: (len(sets[k]), find(k)) for k in sets}


def copies(n, seed):
    """A group of near copies around the limit, exact copies, and texts of their own."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(n + k, rows[0][1]) for k in range(20)]
    return rows + [(n + 20 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for k in range(40)]


def test_near_duplicates(spark, odd, odd_rows, none):
    rows = copies(150, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = near_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == want
    want = near_components([r[:2] for r in odd_rows])
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert neardup.near_duplicates(none).count() == 0


def test_sketches():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 2**63, 400, dtype=np.uint64)
    one = neardup.registers(np.concatenate([a, b]), np.array([0, 500, 900]))
    both = neardup.registers(np.concatenate([a, b]), np.array([0, 900]))
    assert (neardup.merge(one[0], one[1]) == both[0]).all()
    assert (neardup.from_bands(neardup.bands(one).ravel()) == one).all()
    c = rng.integers(0, 2**63, 900, dtype=np.uint64)
    two = neardup.registers(np.concatenate([c[:600], c[300:]]), np.array([0, 600, 1200]))
    like = neardup.likelihoods(two[:1], two[1:], np.array([600.0]), np.array([600.0]))
    assert abs(neardup._GRID[like[0].argmax()] - 1 / 3) < 0.2


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    df = spark.createDataFrame(links, "a long, b long")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components.components(df).collect()}
    assert got == {k: find(k) for k in root}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[10] = x[900]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (None, x[0].tolist()), (2050, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        cos = unit @ unit[q]
        cos[q] = -2
        best = sorted(range(1500), key=lambda k: (-cos[k], k))[:5]
        hits += len(set(best) & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5] and all(abs(s - cos[v]) < 1e-12 for _, v, s in got[q])
    assert hits >= 0.9 * 150 and set(got) == set(range(0, 1500, 50))
    assert ann.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0


def test_lookup_finds_all_near_values():
    rng = np.random.default_rng(9)
    values, asked, near = rng.integers(0, 1 << 10, 3000), rng.integers(0, 1 << 10, 40), rng.integers(0, 4, 40)
    got = sorted((int(a), int(b)) for i, j in ann.lookup(values, 10, asked, near) for a, b in zip(i, j, strict=True))
    assert got == [(k, int(b)) for k in range(40) for b in np.flatnonzero(np.bitwise_count(values ^ asked[k]) <= near[k])]


def true_neighbours(ids, x, queries, near=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        cos = unit @ unit[q]
        cos[q] = -2
        out[int(ids[q])] = [(int(ids[k]), cos[k]) for k in sorted(range(len(ids)), key=lambda k: (-cos[k], ids[k]))[:near]]
    return out


def test_nearest_on_the_table(spark):
    """Recall against brute force on `embeddings`, and the share of queries that the indexes answer alone."""
    path = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    want = true_neighbours(ids, x, np.flatnonzero(ids % 50 == 0))
    got = collections.defaultdict(list)
    rows = queries.op3_multi_index_hashing(spark, path).orderBy("query_id", "rank").collect()
    for r in rows:
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want) and sum(r.by_index for r in rows) >= 0.99 * len(rows)
    scores = {(q, v): s for q in want for v, s in want[q]}
    assert all(abs(s - scores[q, v]) < 1e-12 for q in got for v, s in got[q] if (q, v) in scores)


def test_nearest_splits_cells_and_copies(spark, monkeypatch):
    """Small blocks, many cells and a third of all rows alike give the same neighbours."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16))
    x[:400] = x[0]
    want = true_neighbours(np.arange(1200), x, range(0, 1200, 50))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(ann, "ROWS", 40)
    monkeypatch.setattr(ann, "QUERIES", 2)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert all([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in range(0, 400, 50))
    assert sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("kind", ["offset", "tight", "groups", "scaled"])
def test_nearest_of_vectors_that_lie_close(spark, kind):
    """Vectors with one large common part, near copies, groups in which they hardly differ, and multiples of few vectors."""
    rng = np.random.default_rng(7)
    noise = rng.normal(size=(2000, 32))
    x = {"offset": 200 + noise, "tight": rng.normal(size=32) + noise * 1e-4, "groups": rng.normal(size=(8, 32))[np.arange(2000) % 8] + noise * 1e-3, "scaled": noise[np.arange(2000) % 20] * (1 << np.arange(2000) // 20 % 16)[:, None]}[kind]
    want = true_neighbours(np.arange(2000), x, range(0, 2000, 50))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    if kind == "scaled":  # the last digits of equal cosines depend on the order of adding up
        assert all(abs(s - w) < 1e-12 for q in want for (_, s), (_, w) in zip(got[q], want[q], strict=True))
    else:
        assert sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_language(spark, sf_dir, odd, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op6_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    out = {r.doc_id: r for r in langid.predicted(odd, langid.train(docs)).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[8].lang_pred == "und" and out[9].lang_pred != "und" and all(0 <= r.score <= 1 for r in out.values())
    assert langid.predicted(none, langid.train(none)).count() == 0 and langid.predicted(odd, None).first().lang_pred == "und"


def test_convolution():
    """The folded tables against a plain convolution, filter by filter."""
    rng = np.random.default_rng(12)
    size = langid.EMBEDDED
    net = langid.Network(["a", "b", "c"], rng.normal(size=(256, size)), [rng.normal(size=(w * size, langid.PER_WIDTH)) for w in langid.WIDTHS], rng.normal(size=langid.FILTERS), rng.normal(size=(langid.FILTERS, 3)), rng.normal(size=3))
    x = rng.integers(0, 256, (5, langid.WINDOW), dtype=np.uint8)
    for window, got in zip(x, net.probabilities(x, net.tables()), strict=True):
        tops = []
        for w, kernel in zip(langid.WIDTHS, net.kernels, strict=True):
            for f in range(langid.PER_WIDTH):
                tops.append(max(sum(float(net.embedding[window[p + j]] @ kernel[j * size : (j + 1) * size, f]) for j in range(w)) for p in range(langid.WINDOW - max(langid.WIDTHS) + 1)))
        z = np.maximum(np.array(tops) + net.shift, 0) @ net.out + net.out_shift
        want = np.exp(z - z.max())
        assert np.allclose(got, want / want.sum(), atol=1e-3)


def test_quality(spark, sf_dir, odd, none):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op10_quality(spark, sf_dir).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    machine = quality.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality.scored(odd, machine).collect()) and quality.scored(none, machine).count() == 0
    assert {r.score for r in quality.scored(odd, quality.train(none, labels)).collect()} == {0.5}


def test_pairwise_sum():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.INPUTS), rng.normal(size=(quality.INPUTS, quality.FACTORS)), np.zeros(quality.STATS), np.ones(quality.STATS))
    places, values = np.array([3, 7, 11, 4]), np.array([0.5, 1.0, -2.0, 0.25])
    z, _, _ = m.raw(places, values, np.array([0, 4]))
    pairs = sum(values[i] * values[j] * (m.factor[places[i]] @ m.factor[places[j]]) for i in range(4) for j in range(i))
    assert abs(z[0] - (0.3 + (m.weight[places] * values).sum() + pairs)) < 1e-9


def divided(offers, weights, wanted):
    """A family's division: the surplus of full members goes to the others by weight until it is used up."""
    out, open_ = [0] * len(offers), set(range(len(offers)))
    left = wanted
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if offers[k] * total <= left * weights[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] // total
            return out
        for k in full:
            out[k] = offers[k]
            left -= offers[k]
        open_ -= full
    return out


def test_mixing(spark, documents, sf_dir, odd, none):
    rng = random.Random(8)
    for _ in range(3):
        offers = [rng.randrange(1, 1000) for _ in range(6)]
        names = {f"d{k}": rng.randrange(1, 50) for k in range(6)}
        leaves = spark.createDataFrame([(f"d{k}", "l", "s", o) for k, o in enumerate(offers)], "domain string, lang string, source string, tokens long")
        got = {r.domain: r.budget for r in mixing.budgets(leaves, mixing.Targets({"domain": names}, share=(1, 2), epochs=1)).collect()}
        assert [got.get(f"d{k}", 0) for k in range(6)] == divided(offers, [names[f"d{k}"] for k in range(6)], sum(offers) // 2)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = docs.select(mixing.domain_of(F.col("source")).alias("domain"), "lang", "source", mixing.tokens(F.col("text")).alias("tokens"))
    budget = {(r.domain, r.lang, r.source): r for r in mixing.budgets(leaves.groupBy("domain", "lang", "source").agg(F.sum("tokens").alias("tokens")), mixing.PRODUCTION).collect()}
    took, most = collections.Counter(), collections.Counter()
    rows = queries.op8_mixing(spark, sf_dir).collect()
    for r in rows:
        assert r.n_tokens == len(WORD.findall(documents[r.doc_id]))
        took[r.domain, r.lang, r.source] += r.n_tokens
        most[r.domain, r.lang, r.source] = max(most[r.domain, r.lang, r.source], r.n_tokens)
    assert all(took[leaf] <= b.budget for leaf, b in budget.items()) and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    longest = max(len(WORD.findall(t)) for t in documents.values())
    assert all(b.budget - took[leaf] <= longest for leaf, b in budget.items())
    out = mixing.mixed(odd).collect()
    assert all(r.doc_id is not None and (r.text or "").strip() for r in out) and mixing.chosen(none).count() == 0


def drawn(rows, budget, targets, ranges):
    """Of one leaf's documents (key, tokens) those of each epoch, by the seeded order, drawn one by one."""
    total = sum(n for _, n in rows)
    whole, rest = divmod(budget, total)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def place(key):
        h = xxhash.xxh64(targets.seed.to_bytes(4, "little"), 42).intdigest()
        for part in (whole, key):
            h = xxhash.xxh64(part.to_bytes(8, "little", signed=True), h).intdigest()
        return int((h >> 33) / 2**31 * ranges), signed(h), key

    out, used = [(key, e) for key, _ in rows for e in range(whole)], 0
    for key, n in sorted(rows, key=lambda r: place(r[0])):
        used += n
        if used > rest:
            break
        out.append((key, whole))
    return out


def test_mixing_draws(spark, documents, sf_dir, monkeypatch):
    """Each leaf's epochs and seeded prefix against drawing one by one; also with many ranges, and with names of weight 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    domains = {r.source: r.domain for r in docs.select("source").distinct().select("source", mixing.domain_of(F.col("source")).alias("domain")).collect()}
    leaves, n = collections.defaultdict(list), 0
    for r in docs.collect():
        if count := len(WORD.findall(r.text or "")):
            leaves[domains[r.source], r.lang, r.source].append((r.doc_id, count))
            n += 1
    frame = spark.createDataFrame([(*leaf, sum(c for _, c in rows)) for leaf, rows in leaves.items()], "domain string, lang string, source string, tokens long")
    none = mixing.Targets({"domain": {"web": 0}, "lang": {"en": 0}}, share=(1, 2), epochs=3)
    for per, targets in ((1000, mixing.PRODUCTION), (7, mixing.PRODUCTION), (7, none)):
        monkeypatch.setattr(mixing, "RANGE", per)
        want = set()
        for b in mixing.budgets(frame, targets).collect():
            want |= set(drawn(leaves[b.domain, b.lang, b.source], b.budget, targets, -(-n // per)))
        got = [(r.doc_id, r.epoch, r.domain, r.lang) for r in mixing.chosen(docs, targets).collect()]
        assert len(got) == len(want) and {g[:2] for g in got} == want
        if targets is none:
            assert want and all(d != "web" and lang != "en" for _, _, d, lang in got)


def test_pipeline_on_odd_rows(spark, sf_dir, odd, none):
    """Each stage by itself: nulls, repeats, very long and empty texts, other columns, and an empty table."""
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (odd, none):
            out = stage(spark, docs, sf_dir)
            rows = out.collect()
            assert len(rows) <= docs.count() and (k + 1 == len(corpus_pipeline.STAGES) or out.columns == docs.columns)
            if docs is odd and name == "MinHash near-dedup":
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, k) for k in (1, 2, 3, 5, 5, 7, 8, 9, 10)] + [(True, 0)]
            if docs is odd and name == "line dedup":
                assert len(rows) == docs.count()


def test_shards(spark, documents, sf_dir, odd, odd_rows, none):
    for rows, texts, n in ((queries.op9_karmarkar_karp_shards(spark, sf_dir).collect(), documents, len(documents)), (shards.byte_shards(odd).collect(), {r[0]: r[1] for r in odd_rows}, len(odd_rows))):
        assert len(rows) == n
        slots, home = collections.defaultdict(list), {}
        for r in rows:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
            slots[r.shard].append(r.slot)
            assert home.setdefault(raw, r.shard) == r.shard
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sums = collections.Counter()
    for r in queries.op9_karmarkar_karp_shards(spark, sf_dir).collect():
        sums[r.shard] += r.size
    assert len(sums) == 16 and max(sums.values()) - min(sums.values()) <= 100
    assert shards.byte_shards(none).count() == 0


@pytest.mark.parametrize("block", [32, 300])
def test_shards_of_many_blocks(spark, monkeypatch, block):
    """Sizes over four orders of magnitude, a group of very many copies, and several levels of blocks: as even as one differencing of all groups."""
    monkeypatch.setattr(shards, "BLOCK", block)
    rng = random.Random(block)
    rows = [(k, "x" * int(10 ** rng.uniform(0, 4)) + str(k)) for k in range(2500)] + [(10_000 + k, "copy" * 20) for k in range(2000)]
    rows.append((20_000, "y" * 150_000))
    out = shards.byte_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes, parts, home = collections.Counter(), collections.Counter(), {}
    texts = dict(rows)
    for r in out:
        sizes[texts[r.doc_id]] += r.size
        parts[r.shard] += r.size
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
    alone = np.zeros((len(sizes), 16), np.int64)
    alone[:, -1] = list(sizes.values())
    plain = np.bincount(shards.combine(alone)[:, -1], alone[:, -1], 16)
    assert len(out) == len(rows) and len(parts) == 16
    assert max(parts.values()) - min(parts.values()) <= max(100, plain.max() - plain.min())


def test_differencing():
    parts = np.array([[0, 8], [0, 7], [0, 6], [0, 5], [0, 4]])
    shard = shards.combine(parts)[:, -1]
    assert abs(sum(parts[shard == 0, 1]) - sum(parts[shard == 1, 1])) == 2  # the differencing's known result


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        own = [(r.doc_id, r.text) for r in docs.collect()] if name in ("line dedup", "MinHash near-dedup") else []
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        rows = docs.collect()
        assert len(rows) <= before
        if name == "quality classifier":
            left = {r.doc_id for r in rows}
            assert sum((d in left) == (q == 1) for d, q in labels.items()) >= 0.97 * len(labels)
        if name == "line dedup":
            gone, texts = line_matches(own), dict(own)
            assert all(r.text == "\n".join(x for n, x in enumerate(texts[r.doc_id].split("\n")) if n not in gone[r.doc_id]) and r.n_chars == len(r.text) for r in rows)
        if name == "MinHash near-dedup":
            assert {r.doc_id for r in rows} == {k for k, (_, c) in near_components(own).items() if k == c}
        before = len(rows)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and before > 0


def test_oracles(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.sql(sql)
        got = queries.QUERIES[name](spark, sf_dir)
        columns = want.columns
        assert sorted(columns) == sorted(got.columns)
        assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.fetchall())


def test_short_lines(spark):
    """Left alone and counted, or removed like others if the parameter says so."""
    df = spark.createDataFrame([(1, "thank you all\nx\n\n  \nthank you all"), (2, "x\nThank  you all\nno"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_short, r.removed) for r in linedup.line_report(df).collect()} == {1: (5, 3, ""), 2: (3, 3, ""), 3: (0, 0, "")}
    assert {r.doc_id: (r.n_short, r.removed) for r in linedup.line_report(df, least=(1, 1)).collect()} == {1: (0, "4"), 2: (0, "0,1"), 3: (0, "")}
    assert {r.doc_id: r.text for r in linedup.deduplicated(df, least=(1, 1)).collect()} == {1: "thank you all\nx\n\n  ", 2: "no", 3: None}


def test_sets_go_only_where_they_have_candidates(spark, monkeypatch):
    """Many lines that candidates join but that hardly match: few copies of their sets."""
    monkeypatch.setattr(linedup, "CELL", 60)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(400):
        words = list(base)
        for place in rng.sample(range(40), 5):
            words[place] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    want = line_matches(rows)
    for r in linedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        assert r.removed == ",".join(map(str, sorted(want[r.doc_id])))


def test_a_large_group_of_near_lines(spark):
    """Pairs are left out at first here, so the second round has work."""
    rng = random.Random(3)
    base, lines = [f"w{k}" for k in range(40)], []
    for _ in range(250):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(40)] = f"v{rng.randrange(10**6)}"
        lines.append(" ".join(words))
    keys = list(range(250))
    rng.shuffle(keys)
    rows = [(keys[k], f"{lines[k]}\n{' '.join(f'u{rng.randrange(10**6)}' for _ in range(12))}\n{lines[k * 7 % 250] if k % 10 == 0 else 'x'}") for k in range(250)]
    want = line_matches(rows)
    for r in linedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        assert r.removed == ",".join(map(str, sorted(want[r.doc_id])))


@pytest.mark.parametrize("small", [False, True])
def test_links_and_classes_of_near_lines(spark, monkeypatch, small):
    """Every pair of near lines of a group counts, and each line has the earliest line of its class; also if members and components are split."""
    if small:
        monkeypatch.setattr(linedup, "CELL", 16)
        monkeypatch.setattr(linedup, "BLOCK", 20)
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(40)], []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(40)] = f"v{rng.randrange(10**6)}"
        rows.append((k * 7 % 120, f"{' '.join(words)}\n{' '.join(f'u{rng.randrange(10**6)}' for _ in range(12))}\nalpha beta gamma delta row {k // 2}"))
    bags = {}
    for key, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            bags.setdefault(tuple(sorted(line.split())), []).append((key, k))
    sets = [(collections.Counter(b), places) for b, places in bags.items()]
    near = collections.defaultdict(set)
    for x, (p, _) in enumerate(sets):
        for y, (q, _) in enumerate(sets[:x]):
            shared = (p & q).total()
            if 4 * shared >= 3 * (p.total() + q.total() - shared):
                near[x].add(y)
                near[y].add(x)
    links, told = collections.Counter(), collections.defaultdict(list)
    for x, (_, places) in enumerate(sets):
        reached, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - reached
            reached |= new
            todo += new
        first = min(place for y in reached for place in sets[y][1])
        for key, k in places:
            links[key] += len(near[x])
            if near[x] or len(places) > 1:
                told[key].append((k, f"{k}={first[0]}:{first[1]}"))
    assert max(links.values()) > 60
    for r in linedup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        assert (r.n_links, r.class_ids) == (links[r.doc_id], ",".join(x for _, x in sorted(told[r.doc_id])))


def test_words_hashed_by_the_word():
    import numpy as np

    from kindred.llm.words import solid_words

    texts = [b"The cat  THE", b"tHe", b"", b"\tinternationalizations x\n" + b"y" * 70, b"y" * 70 + b" " + b"Y" * 71, b"", b"a\x00 a"]
    bounds = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, hashes = solid_words(data, bounds)
    found = [data[a:z].tobytes().lower() for a, z in zip(starts, ends, strict=True)]
    assert found == [w.lower() for t in texts for w in t.split()]
    assert len(set(found)) == len(set(hashes.tolist())) == len(set(zip(found, hashes.tolist(), strict=True)))


def test_only_sets_of_several_lines_or_with_links_are_joined_back(spark):
    words = [f"w{k}" for k in range(10)]
    texts = [" ".join(words), " ".join([*words, "more"]), "this line is found here once only", "one two three four five six", "six five four three two one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for every in (True, False):
        told = linedup.line_tables(df, every=every)[2].collect()
        assert sorted((r.first.key, r.gone) for r in told) == ([(0, False), (1, True), (3, False)] if every else [(1, True), (3, False)])
    report = {r.doc_id: (r.n_removed, r.n_near, r.n_links, r.class_ids) for r in linedup.line_report(df).collect()}
    assert report == {0: (0, 0, 1, "0=0:0"), 1: (1, 1, 1, "0=0:0"), 2: (0, 0, 0, ""), 3: (0, 0, 0, "0=3:0"), 4: (1, 0, 0, "0=3:0")}


def test_a_shuffle_of_default_partitions_writes_one_file_a_task(spark):
    from kindred.llm.common import one_file_a_task

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, want in (("4", "4"), ("200", "256"), ("2000", "2000")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            one_file_a_task(spark)
            assert spark.conf.get("spark.sql.shuffle.partitions") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("block", [linedup.BLOCK, 20])
def test_prefixes_are_dealt_out_in_rounds(spark, documents, monkeypatch, block):
    """A round has a part of the prefixes on disk; all rounds together find what one does, also if members are dealt into blocks."""
    rng, base = random.Random(8), [f"w{k}" for k in range(40)]
    rows = [(k, t) for k, t in documents.items() if k < 100]
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(9)):
            words[rng.randrange(40)] = f"v{rng.randrange(10**6)}"
        rows.append((1000 + k * 7 % 60, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    report, kept = sorted(linedup.line_report(df).collect()), sorted(linedup.deduplicated(df).collect())
    written = []
    monkeypatch.setattr(linedup, "BLOCK", block)
    monkeypatch.setattr(linedup, "ROUND", 100)
    monkeypatch.setattr(linedup, "materialize", lambda rows, name: written.append(name) or materialize(rows, name))
    assert sorted(linedup.line_report(df).collect()) == report
    assert written.count("found") >= linedup.ROUNDS
    assert sorted(linedup.deduplicated(df).collect()) == kept
    want = line_matches(rows)
    assert all(r.removed == ",".join(map(str, sorted(want[r.doc_id]))) for r in report)


def test_a_written_table_leaves_no_shuffle_files(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for k in range(blocks.size()) if (name := blocks.apply(k).toString()).startswith("shuffle_")}

    df = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.collect_list("id").alias("ids"))
    before, out = files(), materialize(df, "lists")
    deadline = time.monotonic() + 10
    while files() - before and time.monotonic() < deadline:  # they are deleted a moment later
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 100


def test_lists_of_partners_do_not_grow_with_the_square():
    """Where many lines match each other, a line's lists name few partners; what they leave out, the cell finds."""
    import pyarrow as pa

    rng, base = random.Random(21), [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(40)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["key", "text"])
    runs = [b for b in linedup._begun(np.zeros(linedup.RARITY, np.uint16), linedup.LEAST)(iter([docs])) if b.column("part").null_count]
    packed = pa.Table.from_batches(list(linedup._prefixes(np.ones(linedup.HELD, np.int64), 16, aged=False)(iter(runs))))
    entries = sum(len(x.as_py()) // 4 for x in packed.column("token"))
    found = [r for k in range(packed.num_rows) for r in linedup._candidates(every=True)(packed.slice(k, 1)).to_pylist()]
    assert sum(len(r["others"] or b"") // 4 for r in found) <= 8 * entries
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    f = linedup.Lines(data, bounds)
    keys, member = f.key().tolist(), f.members()
    cell = [dict(id=k, many=1, members=np.sort(member[a:z]).tobytes(), others=None, first_key=n, first_line=0) for n, (k, a, z) in enumerate(zip(keys, f.start[:-1], f.start[1:], strict=True))]
    cell += [dict(id=r["a"], many=1, members=None, others=r["others"], first_key=0, first_line=None) for r in found if r["others"] is not None]
    schema = pa.schema([("id", pa.int64()), ("many", pa.int64()), ("members", pa.binary()), ("others", pa.binary()), ("first_key", pa.int64()), ("first_line", pa.int64())])
    table = pa.Table.from_pylist(cell, schema).append_column("x", pa.array([0] * len(cell), pa.int64())).append_column("y", pa.array([0] * len(cell), pa.int64()))
    told = {r["id"]: r["links"] for r in linedup._decided(table).to_pylist()}
    sets = {k: collections.Counter(t.split(" ")) for k, t in zip(keys, texts, strict=True)}
    for k, p in sets.items():
        near = sum(4 * (s := (p & q).total()) >= 3 * (p.total() + q.total() - s) for j, q in sets.items() if j != k)
        assert told.get(k, 0) == near
