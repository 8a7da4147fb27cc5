"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM in WAV, expanded to resampled PCM.

Bytes are stored as they are: as 8-bit companded samples, or as ADPCM blocks of
64 bytes. Decoding looks samples up in 256-entry tables, or steps through all
blocks of a batch at once, and resamples to twice the rate with a fixed-point
half-band filter, so results are the same on every machine.

A null or empty text is stored as one block of zeros; null ids and repeated rows
stay rows, an empty table stays empty. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
RATE = 8_000
CODECS = {"mulaw": 7, "alaw": 6, "ima": 17}  # WAV format tags
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)
# Fixed values of the ADPCM format.
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)
STEP_SIZES = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def decode_ima(data: np.ndarray) -> np.ndarray:
    """Samples of all blocks, one step of every block at a time."""
    blocks = data.reshape(-1, BLOCK)
    steps, moves = np.array(STEP_SIZES, dtype=np.int32), np.array(INDEX_STEPS, dtype=np.int32)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(steps) - 1)
    nibbles = np.empty((2 * (BLOCK - 4), len(blocks)), dtype=np.uint8)
    nibbles[0::2], nibbles[1::2] = blocks[:, 4:].T & 0x0F, blocks[:, 4:].T >> 4
    out = np.empty((BLOCK_SAMPLES, len(blocks)), dtype=np.int16)
    out[0] = value
    for at, code in enumerate(nibbles, 1):
        step, size = steps[index], code & 7
        change = step >> 3
        change += np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + moves[size], 0, len(steps) - 1)
        out[at] = value
    return np.ascontiguousarray(out.T).reshape(-1)


def half_band(taps: int = 8) -> np.ndarray:
    """Weights, in 1/16384, of the samples around the point between two samples."""
    at = np.arange(taps) - (taps - 1) / 2
    window = 0.5 + 0.5 * np.cos(np.pi * at / (taps / 2 + 0.5))
    weights = np.sinc(at) * window
    return np.round(weights / weights.sum() * 16384).astype(np.int32)


def resample(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the rate for several recordings in a row; beyond its ends a recording is silent."""
    weights = half_band()
    half = len(weights) // 2
    lengths = np.diff(np.append(starts, len(pcm)))
    gaps = np.repeat(np.arange(len(starts)) * len(weights), lengths)
    place = np.arange(len(pcm)) + gaps
    spaced = np.zeros(len(pcm) + len(starts) * len(weights) + half, dtype=np.int32)
    spaced[place] = pcm
    between = np.zeros(len(spaced), dtype=np.int32)
    for k, weight in enumerate(weights.tolist(), 1 - half):
        part = spaced[max(k, 0) : len(spaced) + min(k, 0)] * np.int32(weight)
        between[max(-k, 0) : max(-k, 0) + len(part)] += part
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((between[place] + 8192) >> 14, -32768, 32767)
    return out


def wav(codec: str, payload: bytes) -> bytes:
    """A RIFF file with format, fact and data chunks."""
    ima = codec == "ima"
    samples = len(payload) // BLOCK * BLOCK_SAMPLES if ima else len(payload)
    per_second = RATE * BLOCK // BLOCK_SAMPLES if ima else RATE
    form = struct.pack("<HHIIHHH", CODECS[codec], 1, RATE, per_second, BLOCK if ima else 1, 4 if ima else 8, 2 if ima else 0)
    form += struct.pack("<H", BLOCK_SAMPLES) if ima else b""
    return _riff((b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", payload))


def pcm_wav(samples: np.ndarray, rate: int) -> bytes:
    form = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
    return _riff((b"fmt ", form), (b"data", samples.astype("<i2").tobytes()))


def _riff(*chunks: tuple[bytes, bytes]) -> bytes:
    body = b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for name, data in chunks)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and stored bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    chunks, at = {}, 12
    while at + 8 <= len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        chunks[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    (tag,) = struct.unpack_from("<H", chunks[b"fmt "])
    return next(name for name, number in CODECS.items() if number == tag), chunks[b"data"]


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + b"\0" * (-len(data) % BLOCK if data else BLOCK)


def codec_of(payload: bytes) -> str:
    """One of the codecs, by the payload alone, so that equal payloads have equal files."""
    return list(CODECS)[zlib.crc32(payload) % len(CODECS)]


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts' bytes as media: doc_id, n_bytes, media (a WAV file)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [padded(t) for t in batch.column(1).to_pylist()]
            files = [wav(codec_of(payload), payload) for _, payload in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": pa.array([n for n, _ in rows], pa.int64()), "media": pa.array(files, pa.binary()),
            })

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")


FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
)
SLICE_BYTES = 4 * 1024 * 1024  # of media decoded at a time


def expand(codec: str, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """PCM at the doubled rate of recordings of one codec, in a row, and where each begins."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    if codec == "ima":
        pcm, sizes = decode_ima(data), sizes // BLOCK * BLOCK_SAMPLES
    else:
        pcm = (mulaw_table() if codec == "mulaw" else alaw_table())[data]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return resample(pcm, starts), 2 * starts


def features(media: DataFrame, with_pcm: bool = False) -> DataFrame:
    """Reads stored media back: digests of the payload, features of the resampled PCM, and the PCM as WAV if asked for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("media").nbytes
            step = max(1, batch.num_rows * SLICE_BYTES // max(size, 1))
            for at in range(0, batch.num_rows, step):
                yield table(batch.slice(at, step))

    def table(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column("media").to_pylist()
        parsed = [parse_wav(f) for f in files]
        out: list = [None] * len(files)
        for codec in CODECS:
            own = [i for i, (c, _) in enumerate(parsed) if c == codec]
            if not own:
                continue
            pcm, starts = expand(codec, [parsed[i][1] for i in own])
            wide = pcm.astype(np.int64)
            length = np.diff(np.append(starts, len(pcm)))
            power, level = np.add.reduceat(wide * wide, starts), np.add.reduceat(np.abs(wide), starts)
            peak = np.maximum.reduceat(np.abs(wide), starts)
            turns = np.append((pcm[1:] < 0) != (pcm[:-1] < 0), False)
            turns[starts[1:] - 1] = False  # not from one recording to the next
            crossed = np.add.reduceat(turns.astype(np.int64), starts)
            for k, i in enumerate(own):
                rms = np.sqrt(power[k] / length[k])
                said = (
                    f"codec={codec};rate={2 * RATE};samples={length[k]};rms={rms:.3f};mean={level[k] / length[k]:.3f};"
                    f"peak={peak[k]};crossings={crossed[k]}"
                )
                out[i] = (said, pcm_wav(pcm[starts[k] : starts[k] + length[k]], 2 * RATE))
        payloads = [p for _, p in parsed]
        sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values])
        sizes = lambda values: pa.array([len(v) for v in values], pa.int64())
        columns = {
            "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": sizes(payloads),
            "payload_sha256": sha(payloads), "tail_crc32": pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
            "media_bytes": sizes(files), "media_sha256": sha(files), "feature": pa.array([f for f, _ in out]),
            "pcm_bytes": sizes([p for _, p in out]), "pcm_sha256": sha([p for _, p in out]),
        }
        if with_pcm:
            columns["pcm"] = pa.array([p for _, p in out], pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, FEATURES + (", pcm binary" if with_pcm else ""))
