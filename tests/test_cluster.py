"""Groups and chains of records, against plain Python."""

import random

import pytest

from kindred.operators import cluster

PERSON = "rec_ord long, full_name string, emails array<string>, phones array<string>"


def folded(name):
    return name.lower().replace(".", " ").replace(",", " ").split()


def whole(a, b):
    """Whether name a, the later one, matches b by all words of the shorter."""
    least = min(len(a), len(b))
    return least > 1 and sum(w in b for w in a) == least


def groups(order, match):
    """The group of each record: the first that holds a match, else its own."""
    found, group = [], {}
    for r in order:
        to = next((g for g in found if any(match(r, e) for e in g)), None)
        if to is None:
            found.append(to := [])
        to.append(r)
        group[r] = to[0]
    return group


def test_roots_hold_a_row_for_each_record(spark, monkeypatch):
    """A ladder, where each record is linked to the one and the two before, and a chain; the rows of a round stay those of the links."""
    from kindred.plans import tables

    kept, most = tables.kept, []

    def counted(df, name):
        out = kept(df, name)
        most.append(out.count())
        return out

    monkeypatch.setattr(tables, "kept", counted)
    monkeypatch.setattr(cluster, "kept", counted)
    n = 300
    records = spark.range(1, n + 1).selectExpr("id as rec_ord")
    links = spark.createDataFrame([(k, k - d) for k in range(2, n + 1) for d in (1, 2) if k > d], "later long, earlier long")
    assert {r.group_id for r in cluster.roots(records, links).collect()} == {1}
    assert max(most) <= 2 * n and len(most) < 30
    most.clear()
    assert {tuple(r) for r in cluster.roots(records, links.where("later = earlier + 1 and later != 151")).collect()} == {(k, 1 if k < 151 else 151) for k in range(1, n + 1)}
    assert max(most) <= n and len(most) < 30


def test_roots_of_any_links(spark):
    rng = random.Random(4)
    n = 400
    links = {(k, rng.randrange(max(0, k - 60), k)) for k in range(1, n) for _ in range(rng.choice([0, 1, 1, 2, 3])) if k > 0}
    want = {}
    for k in range(n):
        want[k] = min((want[e] for later, e in links if later == k), default=k)
    got = cluster.roots(spark.range(n).selectExpr("id as rec_ord"), spark.createDataFrame(list(links), "later long, earlier long"))
    assert {r.rec_ord: r.group_id for r in got.collect()} == want


@pytest.mark.parametrize("hot", [False, True])
def test_greedy_groups(spark, monkeypatch, hot):
    """Emails and phones that many hold, and names with repeats, initials and many words; values are cut into ranges if hot."""
    if hot:
        monkeypatch.setattr(cluster, "HOT", 5)
        monkeypatch.setattr(cluster, "RANGES", 7)
        monkeypatch.setattr(cluster, "PAIRED", 3)
    rng = random.Random(9)
    words = ["ann", "bo", "lee", "kim", "x", "poe", "roy", "van", "zed"]
    rows = []
    for k in rng.sample(range(1000), 160):
        name = " ".join(rng.choices(words, weights=[9, 5, 3, 3, 2, 2, 1, 1, 1], k=rng.choice([1, 2, 2, 3, 4, 5]))) if rng.random() < 0.4 else rng.choice([None, "", "Kim", "Lee, Bo.", "Lee Bo"])
        rows.append((k, name, [f"m{rng.randrange(30)}"] * 2 if rng.random() < 0.3 else [], [f"p{rng.randrange(6)}"] if rng.random() < 0.04 else None))
    by = {r[0]: r for r in rows}

    def match(r, e):
        a, b = by[r], by[e]
        return bool(set(a[2]) & set(b[2]) or set(a[3] or ()) & set(b[3] or ()) or (a[1] and b[1] and whole(folded(a[1]), folded(b[1]))))

    people = spark.createDataFrame(rows, PERSON)
    want = groups(sorted(by), match)
    assert {r.rec_ord: r.group_id for r in cluster.cluster(people).collect()} == want and 10 < len(set(want.values())) < 130
    assert all(match(r.later, r.earlier) for r in cluster.match_links(people).collect())


def test_equal_names_are_chained(spark):
    rows = [(k, "Maria Lopez" if k % 3 else "Lopez, Maria J.", [], []) for k in range(90)]
    links = cluster.whole_overlap_links(spark.createDataFrame(rows, PERSON))
    assert links.count() <= 59 + 29 + 2 * 30
    one = cluster.whole_overlap_links(spark.createDataFrame([(k, "Maria Lopez", [], []) for k in range(50)], PERSON))
    assert sorted(map(tuple, one.collect())) == [(k + 1, k) for k in range(49)]


def test_names_that_overlap_meet(spark, monkeypatch):
    """Candidates of names with initials, repeats and many words, against all pairs."""
    from pyspark.sql import functions as F

    from kindred.functions import fuzzy

    monkeypatch.setattr(cluster, "PAIRED", 4)
    rng = random.Random(3)
    words = ["ann", "a", "al", "b", "bo", "bea", "c", "cy"]
    names = {tuple(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 4, 5, 7]))) for _ in range(150)} | {("j", "j", "j"), ("john", "smith"), ("j", "j"), ("john",)}
    df = spark.createDataFrame([(list(n),) for n in names], "words array<string>")
    got = {(tuple(r.later), tuple(r.earlier)) for r in cluster.overlapping_names(df).collect()}
    both = df.select(F.col("words").alias("a")).crossJoin(df.select(F.col("words").alias("b")))
    want = {(tuple(r.a), tuple(r.b)) for r in both.where(fuzzy.overlap(F.col("a"), F.col("b")) >= fuzzy.OVERLAP).collect()}
    assert got == want and (("j", "j", "j"), ("john", "smith")) in want


def test_close_names_of_the_tables(spark, sf_dir, monkeypatch):
    """The query against the first group that holds a match, over all pairs."""
    from kindred.functions import fuzzy
    from kindred.plans import queries

    seen = []
    links = cluster.close_name_links
    monkeypatch.setattr(cluster, "close_name_links", lambda records: seen.append(records) or links(records))
    got = {r.rec_ord: r.group_id for r in queries.QUERIES["cluster_close_names"](spark, sf_dir).collect()}
    people = {r.rec_ord: r for r in seen[0].collect()}
    words = {k: folded(r.full_name) for k, r in people.items()}
    half = lambda w, b: any((len(w) == 1 and v.startswith(w)) or (len(v) == 1 and w.startswith(v)) for v in b)

    def match(r, e):
        if people[r].location.country != people[e].location.country and not set(people[r].companies) & set(people[e].companies):
            return False
        a, b = words[r], words[e]
        if a == b or sum(1.0 if w in b else 0.5 if half(w, b) else 0.0 for w in a) / min(len(a), len(b)) >= fuzzy.OVERLAP:
            return True
        score = fuzzy.approximate(" ".join(a), " ".join(b), fuzzy.NAME_LIMIT)
        return score is not None and score <= fuzzy.NAME_LIMIT

    assert got == groups(sorted(people), match) and len(set(got.values())) < len(people)


def test_overlaps_of_initials_and_repeats(spark):
    """Words of a longer name that share a letter, or repeat, and count for one word of a shorter name."""
    rng = random.Random(5)
    words = ["a", "b", "ann", "amy", "al", "bob", "ben", "c", "cy", "q"]
    names = sorted({tuple(rng.choices(words, k=rng.choice([1, 1, 2, 2, 3, 3, 4, 5]))) for _ in range(260)} | {("ann", "amy", "al", "bob"), ("a", "z"), ("num1", "n", "q"), ("num1", "z"), ("u", "u", "n1"), ("u", "z")})

    def share(x, y):
        half = lambda w: any((len(w) == 1 and v.startswith(w)) or (len(v) == 1 and w.startswith(v)) for v in y)
        return sum(1.0 if w in y else 0.5 if half(w) else 0.0 for w in x) / min(len(x), len(y))

    df = spark.createDataFrame([(list(n),) for n in names], "words array<string>")
    got = [(tuple(r.later), tuple(r.earlier), r.ratio) for r in cluster.overlapping_names(df).collect()]
    assert sorted(got) == sorted((x, y, share(x, y)) for x in names for y in names if share(x, y) >= 0.75)


def test_names_with_common_words_do_not_all_meet(spark):
    """Two words and an initial that all names have make no candidates; their own word does."""
    rows = [(["customer", f"num{k}"],) for k in range(300)] + [(["customer", "x", f"num{k}"],) for k in range(300)]
    assert cluster.overlap_candidates(spark.createDataFrame(rows, "words array<string>")).count() <= 4 * 300


@pytest.mark.parametrize("name", ["cluster_hot_keys", "cluster_hot_names", "cluster_close_names"])
def test_no_table_of_records_goes_through_the_driver(spark, sf_dir, name):
    """Tables that look small in compressed files aren't broadcast."""
    from kindred.plans import queries

    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsCount()
    queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    told = plans.executionsList()
    assert plans.executionsCount() > before
    assert not [k for k in range(max(0, told.size() - (plans.executionsCount() - before)), told.size()) if "BroadcastExchange" in told.apply(k).physicalPlanDescription()]
