"""Approximate substring scores by bit-parallel search, and word overlap with initials."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The known skills, in the order that decides ties.
TAXONOMY = (
    "JavaScript", "TypeScript", "Python", "Java", "C++", "C#", "Ruby", "PHP", "Go", "Rust", "Swift", "HTML", "CSS", "React", "Angular", "Vue", "Node.js",
    "Express", "Django", "Flask", "Spring Boot", "MongoDB", "PostgreSQL", "MySQL", "SQL", "Docker", "Kubernetes", "AWS", "Git", "CI/CD", "Machine Learning",
    "Deep Learning", "NLP", "PyTorch", "TensorFlow",
)
SKILL_LIMIT, NAME_LIMIT, OVERLAP = 0.35, 0.15, 0.75


def approximate(pattern: str, text: str, limit: float, distance: int = 100) -> float | None:
    """Score of the best place of pattern in text, 0 best; None beyond the limit. Errors count by the pattern's length, places by distance.

    Rows of bits hold, for each number of errors, the ends at which the pattern's prefixes can lie (substitutions, and
    insertions and deletions as in a shift of the row with fewer errors).
    """
    pattern, text = pattern.lower(), text.lower()
    if pattern == text:
        return 0.0
    if not pattern or not text:
        return None
    size = min(len(pattern), 32)
    pattern = pattern[:size]
    masks: dict[str, int] = {}
    for k, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << k
    goal = 1 << (size - 1)
    best = None
    rows = [(1 << e) - 1 for e in range(size)]
    for at, ch in enumerate(text):
        mask, old = masks.get(ch, 0), rows
        rows = [((old[0] << 1) | 1) & mask]
        for e in range(1, size):
            rows.append((((old[e] << 1) | 1) & mask) | ((old[e - 1] | rows[e - 1]) << 1) | old[e - 1] | 1)
        for e, bits in enumerate(rows):
            if bits & goal:
                score = e / size + max(0, at - size + 1) / distance
                if best is None or score < best:
                    best = score
                break
    if best is None or best > limit:
        return None
    norm = round(1 / math.sqrt(len(text.split(" "))), 3)
    return max(best, 0.001) ** norm


def best_skill(skill: str | None) -> tuple[str, float]:
    """The taxonomy's name for a skill and how sure that is."""
    s = (skill or "").strip()
    if not s:
        return "Unknown", 0.1
    for known in TAXONOMY:
        if known.lower() == s.lower():
            return known, 1.0
    scores = [(x, k) for k, t in enumerate(TAXONOMY) if (x := approximate(s, t, SKILL_LIMIT)) is not None]
    if scores and min(scores)[0] <= SKILL_LIMIT:
        score, k = min(scores)
        return TAXONOMY[k], float(f"{1 - score:.2f}")
    return s, 0.4


def skill(c: Column) -> Column:
    """struct<name, confidence> of a skill. A pandas UDF: apply it to distinct values."""

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_skill(v) for v in values], columns=["name", "confidence"])

    return F.pandas_udf(run, "name string, confidence double")(c)


def close_names(a: Column, b: Column) -> Column:
    """Whether two folded names are approximately equal. A pandas UDF: apply it to candidate pairs."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        scores = (approximate(p, q, NAME_LIMIT) if p and q else None for p, q in zip(x, y, strict=True))
        return pd.Series([s is not None and s <= NAME_LIMIT for s in scores], dtype=bool)

    return F.pandas_udf(run, "boolean")(a, b)


def pieces(pattern: Column) -> Column:
    """The first three letters of each of k + 1 pieces of a name, whose first 32 letters can have k errors within NAME_LIMIT.

    k errors leave one of the pieces unchanged, so a name that close_names finds in another has one of these among the other's grams.
    """
    size = F.least(F.length(pattern), F.lit(32))
    parts = F.floor(size * NAME_LIMIT + 1e-9).cast("int") + 1
    start = lambda k: F.floor(k * size / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.substring(pattern, start(k) + 1, F.least(start(k + 1) - start(k), F.lit(3))))


def grams(text: Column) -> Column:
    """All parts of a name of one to three letters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(at, lambda k: F.array(*[F.substring(text, k, F.lit(n)) for n in (1, 2, 3)]))))


def shared_words(a: Column, b: Column) -> Column:
    """How many words of a are in b, as a double; an initial and a word that it begins count one half."""
    half = lambda w: F.exists(b, lambda v: ((F.length(w) == 1) & v.startswith(w)) | ((F.length(v) == 1) & w.startswith(v)))
    return F.aggregate(a, F.lit(0.0), lambda s, w: s + F.when(F.array_contains(b, w), 1.0).when(half(w), 0.5).otherwise(0.0))


def overlap(a: Column, b: Column) -> Column:
    """The share of the shorter name's words that the names have in common."""
    return shared_words(a, b) / F.least(F.size(a), F.size(b))


def whole_overlap(a: Column, b: Column) -> Column:
    """Whether the later name a has as many words in b as the shorter name has words, which are two or more."""
    least = F.least(F.size(a), F.size(b))
    return (least > 1) & (F.size(F.filter(a, lambda w: F.array_contains(b, w))) == least)
