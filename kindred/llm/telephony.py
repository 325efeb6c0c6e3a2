"""Media columns: 8-bit telephony audio in WAV containers.

`store` turns bytes into mu-law samples of a WAV file (8 kHz, one channel, one byte a sample, so nothing is lost); `read`
parses such a file again. `expand_mu`, `expand_a` are lookup tables of 256 16-bit values; `encode_adpcm` and `decode_adpcm` go
through IMA ADPCM blocks step by step with every step done for all blocks at once; `resample` doubles the rate by a fixed half-band
filter in whole numbers. `media_column`, `resampled` and `telephony` are the Spark operators; each text is one file, so every task
works on its own rows.

Null and empty texts are 64 zero bytes. Very long texts are one file each. Repeated rows give repeated results; an empty table
gives an empty table; other columns are left out of the report, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import frugal, prepare

RATE = 8000
BLOCK = 64
#: ADPCM blocks that are decoded together; the arrays of one step then stay in cache.
BLOCKS = 1 << 14
HEADER = 58


def _mu_law() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 128, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    low, part = ((code & 15).astype(np.int32) << 4) + 8, (code >> 4) & 7
    size = np.where(part > 0, (low + 0x100) << np.maximum(part.astype(np.int32) - 1, 0), low)
    return np.where(code & 128, size, -size).astype(np.int16)


MU_LAW, A_LAW = _mu_law(), _a_law()
# Fixed values of the IMA ADPCM format: the step sizes and the change of the step index by a code's three low bits.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX_CHANGE = [-1, -1, -1, -1, 2, 4, 6, 8]


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + code: the change of the sample, and the next step index * 16."""
    code = np.arange(16)
    step = STEPS[:, None]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    index = np.clip(np.arange(89)[:, None] + np.array(INDEX_CHANGE * 2), 0, 88) * 16
    return np.where(code & 8, -size, size).ravel().astype(np.int32), index.ravel().astype(np.int32)


CHANGE, NEXT = _adpcm_tables()


def expand_mu(samples: np.ndarray) -> np.ndarray:
    return MU_LAW[samples]


def expand_a(samples: np.ndarray) -> np.ndarray:
    return A_LAW[samples]


def decode_adpcm(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """IMA ADPCM mono: blocks of a 16-bit sample, a step index (held to 0..88), an unused byte, then two codes a byte. A row of samples for each block."""
    blocks = data.reshape(-1, block)
    out = np.empty((len(blocks), 2 * (block - 4) + 1), np.int16)
    for lo in range(0, len(blocks), BLOCKS):
        part = np.ascontiguousarray(blocks[lo : lo + BLOCKS].T)
        sample = (part[0].astype(np.int32) | part[1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
        at = np.minimum(part[2], 88).astype(np.int32) * 16
        rows = np.empty((out.shape[1], part.shape[1]), np.int16)
        rows[0] = sample
        k = 1
        for byte in part[4:]:
            for code in (byte & 15, byte >> 4):
                at += code
                sample += CHANGE[at]
                np.minimum(sample, 32767, out=sample)
                np.maximum(sample, -32768, out=sample)
                at = NEXT[at]
                rows[k] = sample
                k += 1
        out[lo : lo + BLOCKS] = rows.T
    return out


def encode_adpcm(pcm: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Rows of 2 * (block - 4) + 1 samples -> rows of `block` bytes that decode_adpcm reads: each code takes the sample as near as its step allows."""
    out = np.zeros((len(pcm), block), np.uint8)
    for lo in range(0, len(pcm), BLOCKS):
        part = np.ascontiguousarray(pcm[lo : lo + BLOCKS].T).astype(np.int32)
        sample, at = part[0].copy(), np.zeros(part.shape[1], np.int32)
        codes = np.empty((part.shape[0] - 1, part.shape[1]), np.uint8)
        for k, wanted in enumerate(part[1:]):
            apart = wanted - sample
            # A code's three low bits count quarters of the step, at most seven.
            code = np.minimum((np.abs(apart) << 2) // STEPS[at >> 4], 7).astype(np.int32) | (apart < 0) << 3
            at += code
            sample += CHANGE[at]
            np.clip(sample, -32768, 32767, out=sample)
            at = NEXT[at]
            codes[k] = code
        rows = out[lo : lo + BLOCKS]
        rows[:, 0], rows[:, 1] = part[0] & 255, (part[0] >> 8) & 255
        rows[:, 4:] = (codes[0::2] | codes[1::2] << 4).T
    return out


def blocks_of(pcm: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Samples as rows for encode_adpcm; the last sample is held to fill the last row."""
    width = 2 * (block - 4) + 1
    return np.concatenate([pcm, np.full(-len(pcm) % width, pcm[-1] if len(pcm) else 0, pcm.dtype)]).reshape(-1, width)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the value half way to the next by the taps -1, 9, 9, -1 over 16; ends are held."""
    if not len(pcm):
        return pcm
    p = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4, -32768, 32767)
    return out


def store(payload: bytes, law: int = 7) -> bytes:
    """A WAV file with the payload as 8-bit samples; law 7 is mu-law, 6 A-law."""
    u4, u2 = (lambda x: int(x).to_bytes(4, "little")), (lambda x: int(x).to_bytes(2, "little"))
    n = len(payload)
    form = u2(law) + u2(1) + u4(RATE) + u4(RATE) + u2(1) + u2(8) + u2(0)
    body = b"WAVEfmt " + u4(18) + form + b"fact" + u4(4) + u4(n) + b"data" + u4(n) + payload + b"\0" * (n & 1)
    return b"RIFF" + u4(len(body)) + body


def read(media: bytes) -> tuple[int, memoryview]:
    """The law and the samples of a WAV file with 8-bit mu-law or A-law samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, law, view = 12, None, memoryview(media)
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            law = int.from_bytes(media[at + 8 : at + 10], "little")
        elif kind == b"data":
            if law not in (6, 7):
                raise ValueError("neither mu-law nor A-law")
            return law, view[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no samples")


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + b"\0" * ((-len(text)) % BLOCK or (0 if text else BLOCK))


@frugal
def media_file(texts: pa.Array) -> pa.Array:
    raw = texts.fill_null("").cast(pa.binary())
    return pa.array([store(padded(x.as_py())) for x in raw], pa.binary())


FEATURES = pa.struct([
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()), ("pcm", pa.binary()),
])
TOLD = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string,pcm:binary>"


def features(media: bytes) -> tuple[tuple, np.ndarray]:
    """What is told of a file, all from its own bytes, and its samples."""
    law, samples = read(media)
    codes = np.frombuffer(samples, np.uint8)
    table, other = (MU_LAW, A_LAW) if law == 7 else (A_LAW, MU_LAW)
    pcm = table[codes]
    counts = np.bincount(codes, minlength=256)
    told = (
        f"peak={int(np.abs(pcm.astype(np.int32)).max(initial=0))};energy={int(counts @ table.astype(np.int64) ** 2)}"
        f";crossings={int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))};other={zlib.crc32(other[codes])}"
    )
    return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), told), pcm


@frugal
def media_features(media: pa.Array) -> pa.Array:
    """What is told of each file, with its samples at twice the rate to be stored. All files' ADPCM blocks are coded together, whatever file they are of."""
    told, out = [features(x.as_py()) for x in media], []
    lo = 0
    while lo < len(told):
        hi, n = lo, 0
        while hi < len(told) and (hi == lo or n + len(told[hi][1]) <= BLOCKS * BLOCK):
            n += len(told[hi][1])
            hi += 1
        rows = [blocks_of(pcm) for _, pcm in told[lo:hi]]
        heard = decode_adpcm(encode_adpcm(np.concatenate(rows)).ravel())
        at = 0
        for (about, pcm), own in zip(told[lo:hi], rows, strict=True):
            again = heard[at : at + len(own)].ravel()[: len(pcm)]
            at += len(own)
            away = int(np.abs(again.astype(np.int64) - pcm).sum())
            out.append((*about[:5], f"{about[5]};adpcm={zlib.crc32(again)};adpcm_away={away}", resample(pcm).tobytes()))
        lo = hi
    return pa.array([dict(zip([f.name for f in FEATURES], x, strict=True)) for x in out], FEATURES)


@frugal
def pcm_16k(media: pa.Array) -> pa.Array:
    out = []
    for x in media:
        law, samples = read(x.as_py())
        out.append(resample((expand_mu if law == 7 else expand_a)(np.frombuffer(samples, np.uint8))).tobytes())
    return pa.array(out, pa.binary())


def media_column(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the text's bytes as a WAV file in the column `media`, which takes the place of one of that name."""
    prepare(docs.sparkSession)
    return docs.withColumn(media, F.arrow_udf(media_file, "binary")(F.col(text)))


def resampled(media: Column) -> Column:
    """16 kHz 16-bit PCM of a media column, as bytes to be stored."""
    return F.arrow_udf(pcm_16k, "binary")(media)


def telephony(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: the digests of its stored form and of what is read back from that, and features of the audio."""
    files = media_column(docs.select(key, F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), text), text)
    told = files.select(key, "n_bytes", F.arrow_udf(media_features, TOLD)("media").alias("told")).select(key, "n_bytes", "told.*")
    # The resampled samples are a column, and these figures are read back from it.
    about = F.concat_ws(";", "feature", F.concat(F.lit("pcm16k="), F.crc32("pcm")))
    return told.withColumn("feature", about).withColumn("pcm_bytes", F.octet_length("pcm").cast("long")).withColumn("pcm_sha256", F.sha2("pcm", 256)).drop("pcm")
