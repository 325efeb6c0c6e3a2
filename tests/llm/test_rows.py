"""Operators that work row by row, against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken

from kindred.llm import bpe, queries, secrets, telephony


def test_trigram_queries():
    assign, access, hexa = (r.query for r in secrets.BASE)
    assert hexa == () and access == ((frozenset({b"aki", b"kia"}),),)
    assert frozenset({b"tok", b"oke", b"ken"}) in assign[0]
    assert secrets.trigram_query("ab+c") == () and secrets.trigram_query("x(abc|abd)y") == ((frozenset({b"xab", b"abc", b"bcy"}), frozenset({b"xab", b"abd", b"bdy"})),)


def test_secrets(spark, sf_dir, documents, odd, odd_rows, none):
    for rows, texts in ((queries.op1_secret_scan(spark, sf_dir), documents), (secrets.secret_digests(odd), {r[0]: r[1] for r in odd_rows})):
        for r in rows.collect():
            counts, digest, line = secrets.brute_force(texts[r.doc_id])
            assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (counts, digest)
            assert set(filter(None, line.split(","))) <= set(r.spans.split(","))
    assert secrets.secret_digests(none).count() == 0


def test_secret_forms():
    rng = random.Random(4)
    bits = ["password", "Passwd:", "api_key", "APIKEY", "=", ":", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "tokenſ", "secret=x", "é", "ghp_" + "a" * 36]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)]
    import pyarrow as pa

    for text, found in zip(texts, secrets.scan(pa.array(texts), secrets.BASE), strict=True):
        assert found == sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.BASE) for m in r.regex.finditer(text) if r.keep(m))


def test_secret_rules_without_case():
    """Letters beyond ASCII that match without regard to case; texts against plain scans of all rules, the further ones too."""
    import re

    import pyarrow as pa

    rules = (*secrets.BASE, *secrets.MORE, secrets.Rule("open", "token=[a-z]+", re.IGNORECASE), secrets.Rule("part", "(?i:key)-[0-9]{3}", 0), secrets.Rule("inline", "(?i)secret:x", 0))
    rng = random.Random(6)
    bits = ["to\u212aen=abc", "TOKEN=x", "\u212aey-123", "KEY-777", "\u017fecret:x", "Secret:X", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-" + "1a" * 6, "AIza" + "b" * 35, "sk_live_" + "9" * 20, "eyJabcdefghij.eyJabcdefghij.abcdefghij_-", " ", "\n", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(8))) for _ in range(300)]
    for text, found in zip(texts, secrets.scan(pa.array(texts), rules), strict=True):
        assert found == sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in r.regex.finditer(text) if r.keep(m))


def test_telephony(spark, sf_dir, documents, odd, odd_rows, none):
    same = {}
    for rows, texts in ((queries.op4_telephony(spark, sf_dir), documents), (telephony.telephony(odd), {r[0]: r[1] for r in odd_rows})):
        for r in rows.collect():
            raw = (texts[r.doc_id] or "").encode()
            payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            media = telephony.store(payload)
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
            assert same.setdefault(raw, r.feature) == r.feature
    assert telephony.telephony(none).count() == 0


def plain_adpcm(samples):
    """IMA ADPCM through an encoder and its decoder, a sample at a time: what is heard of each block of 121 samples."""
    heard = []
    for lo in range(0, len(samples), 121):
        block = samples[lo : lo + 121]
        sample, index = block[0], 0
        heard.append(sample)
        for wanted in block[1:]:
            step = int(telephony.STEPS[index])
            code = min(abs(wanted - sample) * 4 // step, 7)
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - change if wanted < sample else sample + change))
            index = max(0, min(88, index + telephony.INDEX_CHANGE[code]))
            heard.append(sample)
    return heard


def plain_feature(payload):
    """The feature string and the resampled samples of a payload as mu-law, by plain Python."""
    def mu(code):
        code = ~code & 255
        size = ((((code & 15) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
        return -size if code & 128 else size

    def a_law(code):
        code ^= 0x55
        part, size = (code >> 4) & 7, ((code & 15) << 4) + 8
        size = (size + 0x100) << (part - 1) if part else size
        return size if code & 128 else -size

    pcm = [mu(c) for c in payload]
    ends = [pcm[0], *pcm, pcm[-1], pcm[-1]]
    up = [x for k, p in enumerate(pcm) for x in (p, max(-32768, min(32767, (9 * (ends[k + 1] + ends[k + 2]) - ends[k] - ends[k + 3] + 8) >> 4)))]
    heard = plain_adpcm(pcm)
    raw = lambda x: np.array(x, "<i2").tobytes()
    told = f"peak={max(map(abs, pcm))};energy={sum(p * p for p in pcm)};crossings={sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:], strict=False))};other={zlib.crc32(raw([a_law(c) for c in payload]))}"
    return told + f";adpcm={zlib.crc32(raw(heard))};adpcm_away={sum(abs(a - b) for a, b in zip(heard, pcm, strict=True))};pcm16k={zlib.crc32(raw(up))}", raw(up)


def test_telephony_features(spark, sf_dir, documents):
    rows = queries.op4_telephony(spark, sf_dir).collect()
    some = sorted(rows, key=lambda r: (r.n_bytes, r.doc_id))
    for r in [*some[:6], *some[:: len(some) // 25], some[-1]]:
        told, up = plain_feature(telephony.padded((documents[r.doc_id] or "").encode()))
        assert (r.feature, r.pcm_bytes, r.pcm_sha256) == (told, len(up), hashlib.sha256(up).hexdigest())


def test_audio():
    assert (telephony.MU_LAW[0], telephony.MU_LAW[128], telephony.MU_LAW[255], telephony.A_LAW[0x55], telephony.A_LAW[0xD5], telephony.A_LAW[0x2A]) == (-32124, 32124, 0, -8, 8, -32256)
    data = np.random.default_rng(1).integers(0, 256, 64 * 40, dtype=np.uint8)
    got = telephony.decode_adpcm(data)
    for block, row in zip(data.reshape(-1, 64).tolist(), got.tolist(), strict=True):
        sample, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88)
        want = [sample]
        for code in (c for b in block[4:] for c in (b & 15, b >> 4)):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + telephony.INDEX_CHANGE[code & 7]))
            want.append(sample)
        assert row == want
    assert telephony.resample(np.array([0, 16, 16], np.int16)).tolist()[0::2] == [0, 16, 16]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})


def test_bpe(spark, sf_dir, documents, odd, odd_rows, none):
    enc = reference()
    for rows, texts in ((queries.op5_byte_bpe(spark, sf_dir), documents), (bpe.token_digests(odd), {r[0]: r[1] for r in odd_rows})):
        for r in rows.collect():
            text = texts[r.doc_id] or ""
            ids = np.array(enc.encode_ordinary(text), "<u4")
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.token_digests(none).count() == 0


def test_bpe_forms():
    rng, enc, path = random.Random(3), reference(), public_tokenizers.path(bpe.VOCABULARY)
    texts = ["".join(rng.choice("aabbccdeéß漢字 \n\t'x1239!<|endof😀   lloo") for _ in range(rng.randrange(200))) for _ in range(1500)] + ["a" * 5000, "ab" * 4000, "\n" * 3000]
    for text, ids in zip(texts, bpe.Encoder(path)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text) and bpe.decode(ids, path) == text.encode()
