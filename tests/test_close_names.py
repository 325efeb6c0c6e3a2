"""Links of close names against all pairs."""

import random

import pytest

from kindred.functions import fuzzy
from kindred.operators import cluster

SCHEMA = "rec_ord long, full_name string, companies array<string>, location struct<city: string, region: string, country: string>, skills array<struct<name: string>>"


def share(a, b):
    half = lambda w: any((len(w) == 1 and v.startswith(w)) or (len(v) == 1 and w.startswith(v)) for v in b)
    return sum(1.0 if w in b else 0.5 if half(w) else 0.0 for w in a) / min(len(a), len(b))


def close(a, b):
    """Whether folded name a, the later one, is close to b."""
    x, y = " ".join(a), " ".join(b)
    score = fuzzy.approximate(x, y, fuzzy.NAME_LIMIT)
    return x == y or share(a, b) >= fuzzy.OVERLAP or (score is not None and score <= fuzzy.NAME_LIMIT)


def reached(links, n):
    """What each record reaches over links."""
    out = {}
    for k in range(n):
        out[k] = set().union(*({e} | out[e] for later, e in links if later == k))
    return out


def test_no_close_pair_is_lost(spark):
    rng = random.Random(2)
    names = ["Catherine", "Katherine", "Joann", "Ann", "Al", "Hal", "Maria Lopez", "Aria Lopez", "Bo", "X", "J J J", "John Smith", "J. Smith", "S J"]
    for base in ("Wilhelmina", "Bartholomew Vandenberg", "Maximiliana Featherstonehaugh Junior"):
        for _ in range(12):
            name = list(base)
            for _ in range(rng.randrange(4)):
                name[rng.randrange(len(name))] = rng.choice(["", "z", "qu"])
            names.append("".join(name)[rng.randrange(2) :])
    names = sorted(set(names))
    rng.shuffle(names)
    rows = [(k, n, ["Acme"], None, None) for k, n in enumerate(names)]
    people = spark.createDataFrame(rows, SCHEMA)
    words = {r.rec_ord: r.words for r in cluster.named(people).collect()}
    want = {(x, y) for x in words for y in range(x) if close(words[x], words[y])}
    assert frozenset(("Catherine", "Katherine")) in {frozenset((names[x], names[y])) for x, y in want}
    # Each name is a unit of one record, so no link is left out.
    assert {(r.later, r.earlier) for r in cluster.close_name_links(people).collect()} == want


@pytest.mark.parametrize("block", [4096, 3])
def test_close_names_with_signals(spark, monkeypatch, block):
    """Names that several records have, with companies, places and skills: what links reach is what all pairs reach."""
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = random.Random(7)
    base = ["Catherine", "Katherine", "Ann", "Joann", "Maria Lopez", "M. Lopez", "Maria Lopes", "Bo", "J J J", "John Smith"]
    rows = []
    for k in range(90):
        skills = [{"name": rng.choice("abcdEF")} for _ in range(rng.randrange(6))] if rng.random() < 0.5 else None
        place = {"city": rng.choice(["Rome", " rome", "", None]), "region": None, "country": rng.choice(["IT", "DE", "FR", None])} if rng.random() < 0.4 else None
        rows.append((k, rng.choice(base), rng.choice([None, [], ["Acme "], ["acme", "Beta"], ["Gamma", None]]) if rng.random() < 0.5 else None, place, skills))
    people = spark.createDataFrame(rows, SCHEMA)
    words = {r.rec_ord: r.words for r in cluster.named(people).collect()}
    text = lambda v: (v or "").strip().lower()

    def signal(a, b):
        if {text(c) for c in a[2] or ()} & {text(c) for c in b[2] or ()} - {""}:
            return True
        if a[3] and b[3] and any(text(a[3][c]) and text(a[3][c]) == text(b[3][c]) for c in ("city", "region", "country")):
            return True
        own = {text(s["name"]) for s in b[4] or ()}
        return sum(text(s["name"]) in own for s in a[4] or ()) >= 3

    want = {(x, y) for x in words for y in range(x) if signal(rows[x], rows[y]) and close(words[x], words[y])}
    got = {(r.later, r.earlier) for r in cluster.close_name_links(people).collect()}
    assert got <= want and reached(got, 90) == reached(want, 90) and 50 < len(want)
