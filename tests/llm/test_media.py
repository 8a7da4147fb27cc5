"""Media columns: exact round trips, sample-by-sample decoders, degenerate texts."""

import hashlib
import zlib

import numpy as np

from sluiceflow.llm import media

TEXTS = [(1, "abc"), (2, None), (3, ""), (3, ""), (4, "x" * 64), (5, "é" * 50_000), (None, "abc"), (6, "last " * 301)]


def one_block(block: bytes) -> list[int]:
    """The ADPCM format, nibble by nibble."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for nibble in [n for b in block[4:] for n in (b & 15, b >> 4)]:
        step = media.STEP_SIZES[index]
        change = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
        value = max(-32768, min(32767, value - change if nibble & 8 else value + change))
        index = max(0, min(88, index + media.INDEX_STEPS[nibble & 7]))
        out.append(value)
    return out


def one_resampled(pcm: list[int]) -> list[int]:
    weights, out = media.half_band().tolist(), []
    for n, sample in enumerate(pcm):
        taps = range(n + 1 - len(weights) // 2, n + 1 + len(weights) // 2)
        total = sum(w * pcm[t] for w, t in zip(weights, taps) if 0 <= t < len(pcm))
        out += [sample, max(-32768, min(32767, (total + 8192) >> 14))]
    return out


def test_tables_are_g711():
    mu, a = media.mulaw_table(), media.alaw_table()
    assert (mu[0x00], mu[0x80], mu[0x7F], mu[0xFF]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def test_blocks_decode_as_one_by_one():
    data = np.random.default_rng(1).integers(0, 256, 40 * media.BLOCK, dtype=np.uint8)
    want = [v for k in range(40) for v in one_block(data[64 * k : 64 * k + 64].tobytes())]
    assert media.decode_ima(data).tolist() == want


def test_recordings_are_resampled_apart():
    rng = np.random.default_rng(2)
    parts = [rng.integers(-32768, 32768, n).tolist() for n in (5, 1, 64, 130)]
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    got = media.resample(np.array(sum(parts, []), dtype=np.int16), starts)
    assert got.tolist() == [v for p in parts for v in one_resampled(p)]


def test_payloads_come_back_whole(spark):
    docs = spark.createDataFrame([(i, t, "clash", b"m") for i, t in TEXTS], "doc_id long, text string, codec string, media binary")
    stored = media.store(docs)
    files = {(r.doc_id, r.n_bytes): bytes(r.media) for r in stored.collect()}
    rows = media.features(stored, with_pcm=True).collect()
    assert len(rows) == len(TEXTS)
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    for i, text in TEXTS:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r, file = by[i, len(data)], files[i, len(data)]
        codec, stored_bytes = media.parse_wav(file)
        assert stored_bytes == payload and int.from_bytes(file[4:8], "little") + 8 == len(file)
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.media_sha256 == hashlib.sha256(file).hexdigest()
        assert r.pcm_sha256 == hashlib.sha256(r.pcm).hexdigest() and f"codec={codec};" in r.feature
        if len(payload) < 2000:
            table = {"mulaw": media.mulaw_table(), "alaw": media.alaw_table()}.get(codec)
            pcm = [v for k in range(0, len(payload), 64) for v in one_block(payload[k : k + 64])] if table is None else table[list(payload)].tolist()
            assert np.frombuffer(r.pcm[44:], "<i2").tolist() == one_resampled(pcm)
            assert f"peak={max(map(abs, one_resampled(pcm)))};" in r.feature
    assert by[1, 3].feature == by[None, 3].feature
    assert {media.parse_wav(f)[0] for f in files.values()} <= set(media.CODECS)
    assert media.features(media.store(docs.limit(0))).count() == 0
