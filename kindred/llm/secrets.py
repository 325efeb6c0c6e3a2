"""Secret scans by a trigram inverted index.

Each rule is a regex with a Boolean trigram query that every match satisfies (`trigram_query` derives it from the regex).
Texts are indexed in segments of about half a megabyte: the postings of a trigram are the segment's rows whose ASCII-lowered bytes
hold it. A query's candidates are the and/or of postings; only they are verified by the regex. A rule without a mandatory
trigram (a run of hex digits) scans each text fully. Segments lie in tasks, so the index needs no shuffle, and a trigram that
is in very many documents is a bitmap in each segment rather than one long list.

Spans count code points, the end exclusive. Null and empty texts have none. Very long texts are segments of their own. Spans of one
start come in the order of the rules. A row's result depends on its text alone, so repeated rows have the same; an empty table
gives an empty one, and columns of any other name stay or are left out untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, prepare, text_steps

try:  # Python's own regex parser, which re itself uses
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # older Pythons
    import sre_constants as K
    import sre_parse as parser

#: An "and" of "or"s of "and"s: each member of the outer tuple offers alternatives, each of which is a set of trigrams.
Query = tuple[tuple[frozenset[bytes], ...], ...]
#: Alternatives of a character class or literal set that are followed; a wider one ends the known piece of text.
ALTERNATIVES = 64


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """Trigrams, of ASCII-lowered text, that a match must hold. () if none is mandatory.

    Without regard to case and outside re.ASCII, k and s also match two letters beyond ASCII, and so are not known.
    """
    parsed = parser.parse(pattern, flags)

    def known(letter: int, flags: int) -> bool:
        return letter < 128 and not (flags & re.IGNORECASE and not flags & re.ASCII and chr(letter) in "ksKS")

    def merge(found: list, run: list[str]) -> None:
        wanted = [frozenset(s[i : i + 3].encode() for i in range(len(s) - 2)) for s in dict.fromkeys(run)]
        if wanted and all(wanted):
            found.append(tuple(x for x in dict.fromkeys(wanted) if not any(y < x for y in wanted)))

    def strings(items, flags: int) -> list[str] | None:
        """All strings that the items can match, lowered, if they are few."""
        out = [""]
        for op, arg in items:
            if op is K.LITERAL:
                more = [chr(arg).lower()] if known(arg, flags) else None
            elif op is K.SUBPATTERN:
                more = strings(arg[3], (flags | arg[1]) & ~arg[2])
            elif op is K.BRANCH:
                parts = [strings(x, flags) for x in arg[1]]
                more = None if any(p is None for p in parts) else [s for p in parts for s in p]
            elif op is K.IN and all(o is K.LITERAL and known(a, flags) for o, a in arg):
                more = [chr(a).lower() for _, a in arg]
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] <= 1:
                part = strings(arg[2], flags)
                more = None if part is None else ([""] if arg[0] == 0 else []) + part
            else:
                return None
            if more is None:
                return None
            out = list(dict.fromkeys(a + b for a, b in product(out, more)))
            if len(out) > ALTERNATIVES:
                return None
        return out

    found: list = []

    def walk(items, flags: int) -> None:
        run = [""]
        for item in items:
            more = strings([item], flags)
            joined = None if more is None else list(dict.fromkeys(a + b for a, b in product(run, more)))
            if joined is not None and len(joined) <= ALTERNATIVES:
                run = joined
                continue
            merge(found, run)
            run = [""] if more is None else more
            op, arg = item
            if op is K.SUBPATTERN:
                walk(arg[3], (flags | arg[1]) & ~arg[2])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2], flags)
        merge(found, run)

    walk(parsed, parsed.state.flags)
    return tuple(found)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `keep` tells whether a match counts; matches that fail it are dropped after matching."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern, self.flags)


#: The base kinds, in the order in which spans with one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: m.end(2) - m.start(2) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: m.end() - m.start() >= 20),
    Rule("hex", r"[0-9a-f]+", re.ASCII, lambda m: m.end() - m.start() >= 24),
)
#: Further kinds with fixed openings, whose mandatory trigrams make them almost free.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


class Segment:
    """The inverted index of some texts over the trigrams that the rules ask for."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, wanted: list[bytes], slots: np.ndarray):
        self.rows = len(bounds) - 1
        self.slot = {t: k for k, t in enumerate(wanted)}
        self.postings = np.zeros((len(wanted), self.rows), bool)
        if len(data) < 3:
            return
        low = LOWER[data]
        codes = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        hits = slots[codes]
        at = np.flatnonzero(hits)
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + 3 <= bounds[row + 1]
        self.postings[hits[at[inside]] - 1, row[inside]] = True

    def candidates(self, query: Query) -> np.ndarray:
        """The rows that a query leaves."""
        left = np.ones(self.rows, bool)
        for alternatives in query:
            some = np.zeros(self.rows, bool)
            for trigrams in alternatives:
                some |= np.logical_and.reduce([self.postings[self.slot[t]] for t in trigrams])
            left &= some
        return np.flatnonzero(left)


def scan(texts: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, place of the rule, end), in that order."""
    queries = [r.query for r in rules]
    regexes = [r.regex for r in rules]
    wanted = sorted({t for q in queries for alternatives in q for x in alternatives for t in x})
    slots = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
    for k, t in enumerate(wanted):
        slots[int.from_bytes(t, "big")] = k + 1
    out: list[list[tuple[int, int, int]]] = []
    for _, _, data, bounds in text_steps(texts):
        segment = Segment(data, bounds, wanted, slots)
        raw = data.tobytes()
        known: dict[int, str] = {}
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(segment.rows)]
        for k, (rule, query, regex) in enumerate(zip(rules, queries, regexes, strict=True)):
            for row in segment.candidates(query) if query else range(segment.rows):
                text = known.get(row)
                if text is None:
                    text = known[row] = raw[bounds[row] : bounds[row + 1]].decode("utf-8", "replace")
                found[row] += [(m.start(), k, m.end()) for m in regex.finditer(text) if rule.keep(m)]
        out += [sorted(x) for x in found]
    return out


def spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    """An array of struct<kind, start, end> for each text."""
    kinds = [r.kind for r in rules]
    form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    @frugal
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": kinds[k], "start": a, "end": z} for a, k, z in x] for x in scan(texts, rules)], form)

    return found(text)


def secret_spans(docs: DataFrame, text: str = "text", out: str = "secrets", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with the spans of every kind in the column `out`."""
    prepare(docs.sparkSession)
    return docs.withColumn(out, spans(F.col(text), rules))


def secret_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """A row for each document: how many spans of each base kind, a digest of the base spans, and all spans as text."""
    base = [r.kind for r in BASE]
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = secret_spans(docs.select(key, text), text, "found", rules).select(key, "found")
    own = F.filter("found", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in base]
    return found.select(key, *counts, F.sha2(line(own), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def brute_force(text: str | None) -> tuple[list[int], str, str]:
    """The base counts and digest of one text by plain scans, for tests."""
    spots = sorted((m.start(), k, m.end()) for k, r in enumerate(BASE) for m in r.regex.finditer(text or "") if r.keep(m))
    line = ",".join(f"{BASE[k].kind}:{a}:{z}" for a, k, z in spots)
    return [sum(k == j for _, j, _ in spots) for k in range(len(BASE))], hashlib.sha256(line.encode()).hexdigest(), line
