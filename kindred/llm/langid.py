"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A window of 192 bytes goes through filters of widths 2, 3 and 4 over byte embeddings, ReLU, the largest value of each filter
and a softmax. A text is all its windows, the last one filled up with zero bytes; its prediction is the language with the
largest mean probability. For prediction the embedding is folded into the filters, so that a filter is a sum of table rows.

Only text is an input of a prediction. A text that is null or has no letter is `und` with score 0; so is every text if there is
nothing to learn from. Very long texts are all their windows. Ties go to the language that sorts first. A row's result depends on
its text alone, so repeated rows have the same; an empty table gives no rows, and other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, prepare, sample, text_steps

WINDOW, EMBEDDED, PER_WIDTH = 192, 8, 8
WIDTHS = (2, 3, 4)
FILTERS = PER_WIDTH * len(WIDTHS)
#: At most so many labelled rows are learned from, those with the least hash of their key; two windows of each.
LEARNED = 4000
EPOCHS, BATCH, STEP = 6, 64, 0.004
#: With few rows there are more epochs, for at least so many steps.
STEPS = 700
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    kernels: list[np.ndarray]  # of each width: (width * EMBEDDED, PER_WIDTH)
    shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each place in a filter, what each byte adds to the filters that reach so far: those from the widest back."""
        found = []
        for j in range(max(WIDTHS)):
            parts = [self.embedding @ k[j * EMBEDDED : (j + 1) * EMBEDDED] for w, k in zip(WIDTHS, self.kernels, strict=True) if w > j]
            found.append(np.ascontiguousarray(np.concatenate(parts, 1), dtype=np.float32))
        return found

    def probabilities(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)))
        reach = WINDOW - max(WIDTHS) + 1
        for lo in range(0, len(windows), 64):
            x = windows[lo : lo + 64]
            total = tables[0].take(x[:, :reach], axis=0)
            for j, t in enumerate(tables[1:], 1):
                total[:, :, FILTERS - t.shape[1] :] += t.take(x[:, j : j + reach], axis=0)
            top = np.maximum(total.max(1) + self.shift, 0)
            z = top @ self.out + self.out_shift
            e = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + 64] = e / e.sum(1, keepdims=True)
        return out


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and each text's first; an empty text has one of zeros."""
    size = np.diff(bounds)
    count = np.maximum(-(-size // WINDOW), 1)
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((int(start[-1]), WINDOW), np.uint8)
    flat = out.ravel()
    if len(data):
        flat[np.arange(len(data)) + np.repeat(start[:-1] * WINDOW - bounds[:-1], size)] = data
    return out, start


def fit(rows: list[tuple[str, bytes]], seed: int = 11) -> Network | None:
    """A network for rows of language and a window's bytes; None without rows."""
    rows = [(lang, text) for lang, text in rows if text]
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for k, (_, text) in enumerate(rows):
        own = np.frombuffer(text[:WINDOW], np.uint8)
        x[k, : len(own)] = own
    y = np.searchsorted(languages, [lang for lang, _ in rows])
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = (1 / np.maximum(share, 0.02))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    f32 = np.float32
    p = {"e": rng.normal(0, 0.5, (256, EMBEDDED)).astype(f32), "o": rng.normal(0, 0.3, (FILTERS, len(languages))).astype(f32), "s": np.zeros(FILTERS, f32), "b": np.zeros(len(languages), f32)}
    p |= {f"k{w}": rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, PER_WIDTH)).astype(f32) for w in WIDTHS}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    reach = WINDOW - max(WIDTHS) + 1
    for _ in range(max(EPOCHS, STEPS * BATCH // len(rows) if len(rows) > BATCH else EPOCHS)):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            n, each = len(own), np.arange(len(own))[:, None]
            e = p["e"][x[own]]
            tops, ats, seen = [], [], []
            for i, w in enumerate(WIDTHS):
                cols = np.concatenate([e[:, j : j + reach] for j in range(w)], 2)
                z = cols @ p[f"k{w}"]
                at = z.argmax(1)
                tops.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + p["s"][i * PER_WIDTH : (i + 1) * PER_WIDTH])
                ats.append(at)
                seen.append(cols)
            top = np.concatenate(tops, 1)
            h = np.maximum(top, 0)
            z = h @ p["o"] + p["b"]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(n), y[own]] -= 1
            dz = q * (weight[own] / n)[:, None]
            dh = (dz @ p["o"].T) * (top > 0)
            g = {"o": h.T @ dz, "b": dz.sum(0), "s": dh.sum(0), "e": np.zeros_like(p["e"])}
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * PER_WIDTH : (i + 1) * PER_WIDTH]
                picked = seen[i][each, ats[i]]  # (n, PER_WIDTH, w * EMBEDDED)
                g[f"k{w}"] = np.einsum("nf,nfc->cf", d, picked)
                back = d[:, :, None] * p[f"k{w}"].T[None]
                for j in range(w):
                    np.add.at(g["e"], x[own[:, None], ats[i] + j], back[:, :, j * EMBEDDED : (j + 1) * EMBEDDED])
            t += 1
            for k, a in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                a -= STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Network(languages, p["e"], [p[f"k{w}"] for w in WIDTHS], p["s"], p["o"], p["b"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learned: int = LEARNED, held_out: tuple[int, int] = (5, 0)) -> Network | None:
    """Fits a network to two windows of each of at most `learned` documents with a language that aren't held out; only the windows reach the driver."""
    prepare(docs.sparkSession)
    own = F.col(key).cast("string")
    free = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & (F.crc32(own) % held_out[0] != held_out[1]))
    place = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.greatest(F.length(text) - WINDOW, F.lit(1))).cast("int") + 1
    piece = lambda salt: F.substring(F.col(text), place(salt), F.lit(WINDOW)).alias(f"w{salt}")
    rows = sample(free.select(F.col(key).alias("key"), F.col(lang).alias("lang"), piece(1), piece(2)), "key", learned).collect()
    return fit([(r.lang, piece.encode()[:WINDOW]) for r in rows for piece in (r.w1, r.w2)])


def has_letter(texts: pa.Array) -> np.ndarray:
    out = [np.empty(0, bool)]
    for lo, _, data, bounds in text_steps(texts):
        some = np.diff(np.concatenate([[0], np.cumsum(_LETTER[data])])[bounds]) > 0
        wide = np.diff(np.concatenate([[0], np.cumsum(data > 127)])[bounds]) > 0
        for k in np.flatnonzero(wide & ~some):
            some[k] = any(map(str.isalpha, texts[lo + int(k)].as_py()))
        out.append(some)
    return np.concatenate(out)


def predicted(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """A row for each document: key, held_out, lang_pred, score."""
    prepare(docs.sparkSession)
    form = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @frugal
    def guess(texts: pa.Array) -> pa.Array:
        if network is None:
            return pa.array([{"lang_pred": UNKNOWN, "score": 0.0}] * len(texts), form)
        tables = network.tables()
        names, scores = [], []
        for _, _, data, bounds in text_steps(texts):
            x, start = windows(data, bounds)
            mean = np.add.reduceat(network.probabilities(x, tables), start[:-1]) / np.diff(start)[:, None]
            names += [network.languages[k] for k in mean.argmax(1)]
            scores += mean.max(1).clip(0, 1).tolist()
        known = has_letter(texts)
        return pa.array([{"lang_pred": a if k else UNKNOWN, "score": s if k else 0.0} for a, s, k in zip(names, scores, known, strict=True)], form)

    away = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % held_out[0] == held_out[1]
    return docs.select(key, away.alias("held_out"), F.arrow_udf(guess, "struct<lang_pred:string,score:double>")(F.col(text)).alias("told")).select(key, "held_out", "told.*")
