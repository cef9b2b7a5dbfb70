"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled 16-bit PCM.

mu-law and A-law bytes are expanded by 256-entry lookup tables. ADPCM blocks carry their own
predictor and step index, so all blocks of a batch are decoded together: one numpy step for
each sample position, across blocks. Resampling is a polyphase windowed-sinc filter applied to
a whole batch at once, with silent gaps between recordings so that none leaks into the next.

Defined results: a null payload gives null pcm and samples; an empty one 0 samples and empty
pcm; a codec that is null or unknown gives null pcm, samples and rate (codec names are
case-insensitive); an ADPCM tail of fewer than 4 bytes holds no block and is dropped; step
indices beyond the table are clamped. Ids may be null or repeat; other columns are ignored; an
empty table gives no rows. One narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, take

SCHEMA = "doc_id long, codec string, n_samples int, sample_rate int, pcm binary"


@cache
def mulaw_table() -> np.ndarray:
    """ITU-T G.711 mu-law: byte to 16-bit sample."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """ITU-T G.711 A-law: byte to 16-bit sample."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = (a & 0x70) >> 4, ((a & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(a & 0x80, size, -size).astype(np.int16)


@cache
def ima_steps() -> np.ndarray:
    """The 89 published step sizes of IMA ADPCM."""
    text = (
        "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 "
        "143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 "
        "1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 "
        "7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767"
    )
    return np.array(text.split(), np.int32)


@cache
def ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + nibble: what is added to the predictor, and the next step index."""
    index, nibble = np.divmod(np.arange(89 * 16), 16)
    step = ima_steps()[index]
    change = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0)
    change = change + np.where(nibble & 4, step, 0)
    move = np.array([-1, -1, -1, -1, 2, 4, 6, 8])[nibble & 7]
    after = np.clip(index + move, 0, 88)
    return np.where(nibble & 8, -change, change).astype(np.int32), (after * 16).astype(np.int32)


def ima_blocks(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, bytes) of mono IMA ADPCM to samples (n, 1 + 2 * (bytes - 4)), all blocks at once."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    state = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = value
    change, after = ima_tables()
    body = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for k in range(width - 4):
        for half, nibble in enumerate((body[k] & 15, body[k] >> 4)):
            at = state + nibble
            value = np.clip(value + change[at], -32768, 32767)
            state = after[at]
            out[1 + 2 * k + half] = value
    return out.T


def decode_adpcm(payloads: list[bytes], block: int) -> list[np.ndarray]:
    """Samples of each payload; every payload is a run of blocks, the last may be short."""
    counts = [-(-len(p) // block) for p in payloads]
    padded = b"".join(p.ljust(c * block, b"\0") for p, c in zip(payloads, counts))
    samples = ima_blocks(np.frombuffer(padded, np.uint8).reshape(-1, block))
    per = samples.shape[1]
    out, at = [], 0
    for p, c in zip(payloads, counts):
        tail = len(p) - (c - 1) * block if c else 0
        keep = 0 if not c else (c - 1) * per + (1 + 2 * (tail - 4) if tail >= 4 else 0)
        out.append(samples[at : at + c].reshape(-1)[:keep])
        at += c
    return out


@cache
def filter_taps(up: int, down: int, half: int) -> np.ndarray:
    """Taps by phase (up, 2 * half): out[m] = sum_k taps[phase, k] * x[centre - half + 1 + k]."""
    cut = min(1.0, up / down)
    k = np.arange(2 * half) - half + 1
    rows = []
    for phase in range(up):
        t = k - phase / up
        w = np.where(np.abs(t) < half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0.0)
        row = cut * np.sinc(cut * t) * w
        rows.append(row / row.sum())
    return np.array(rows, np.float32)


def resample(x: np.ndarray, rate: int, to: int, half: int = 12) -> np.ndarray:
    """A whole signal at another rate; length is ceil(n * to / rate)."""
    return resample_many([x], rate, to, half)[0]


def resample_many(signals: list[np.ndarray], rate: int, to: int, half: int = 12) -> list[np.ndarray]:
    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return list(signals)
    half = max(half, -(-half * down // up))
    taps = filter_taps(up, down, half)
    # With a gap of 2*half zeros, rounded so that every signal starts on phase 0.
    starts, at = [], half
    for s in signals:
        starts.append(at)
        at += -(-(len(s) + 2 * half) // down) * down
    x = np.zeros(at + half, np.float32)
    for s, i in zip(signals, starts):
        x[i : i + len(s)] = s
    span = len(x) - 2 * half + 1
    if down == 1:
        y = np.empty((span, up), np.float32)
        for phase in range(up):
            row = taps[phase]
            if phase == 0 and np.count_nonzero(np.abs(row) > 1e-6) == 1:
                y[:, 0] = x[half - 1 : half - 1 + span]  # this phase passes the input through
            else:
                y[:, phase] = np.convolve(x, row[::-1], "valid")
        y = y.ravel()
        first = [(i - half + 1) * up for i in starts]
    else:
        m = np.arange((len(x) - half - starts[0]) * up // down)
        centre, phase = starts[0] + m * down // up, m * down % up
        y = np.zeros(len(m), np.float32)
        for k in range(2 * half):
            y += taps[phase, k] * x[np.minimum(centre - half + 1 + k, len(x) - 1)]
        first = [(i - starts[0]) * up // down for i in starts]
    out = []
    for s, i in zip(signals, first):
        n = -(-len(s) * up // down)
        out.append(np.clip(np.rint(y[i : i + n]), -32768, 32767).astype("<i2"))
    return out


def decode_telephony(
    df: DataFrame,
    id_col: str = "doc_id",
    payload_col: str = "payload",
    codec_col: str = "codec",
    rate: int = 8000,
    to: int = 16000,
    adpcm_block: int = 256,
) -> DataFrame:
    """PCM of every payload. codec: 'mulaw', 'alaw' or 'adpcm' (IMA, mono, blocks of adpcm_block bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            payloads, codecs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            known = {"mulaw": [], "alaw": [], "adpcm": []}
            for i, (p, c) in enumerate(zip(payloads, codecs)):
                if p is not None and c in known:
                    known[c].append(i)
            at, signals = [], []
            for name, rows in known.items():
                if name == "adpcm":
                    parts = decode_adpcm([payloads[i] for i in rows], adpcm_block)
                else:
                    lut = mulaw_table() if name == "mulaw" else alaw_table()
                    parts = [lut[np.frombuffer(payloads[i], np.uint8)] for i in rows]
                at += rows
                signals += parts
            pcm: list[bytes | None] = [None] * len(payloads)
            size: list[int | None] = [None] * len(payloads)
            for i, y in zip(at, resample_many(signals, rate, to)):
                pcm[i], size[i] = y.astype("<i2").tobytes(), len(y)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(size, pa.int32()),
                    pa.array([None if n is None else to for n in size], pa.int32()),
                    pa.array(pcm, pa.binary()),
                ],
                names=["doc_id", "codec", "n_samples", "sample_rate", "pcm"],
            )

    calls = take(df, doc_id=id_col, payload=payload_col, codec=codec_col).select(
        F.col("doc_id").cast("long"), F.col("payload").cast("binary"), F.lower(F.col("codec").cast("string")).alias("codec")
    )
    return calls.mapInArrow(run, SCHEMA)
