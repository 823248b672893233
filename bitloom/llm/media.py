"""Operator 1, media columns: telephony audio (mu-law, A-law, IMA ADPCM) in WAV containers, and resampled PCM.

G.711 codes expand by 256-entry tables. ADPCM blocks are independent, so the decoder steps through the samples of a
block once and works on all blocks of a slice of rows at each step.
Edge cases: null and empty texts or media count as empty; equal inputs give equal outputs; media that is no WAV of one
of the three codecs gives null PCM; extra columns are ignored by the query and kept by `store_pcm`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import settle, slices, table

RATE, TARGET_RATE, UNIT, BLOCK_HEADER, SLICE = 8000, 16000, 192, 4, 4 << 20
MULAW, ALAW, ADPCM = 7, 6, 0x11
CODECS = (MULAW, ALAW, ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima_adpcm"}


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 255
    t = (((u & 15) << 3) + 132) << ((u & 0x70) >> 4)
    return np.where(u & 128, 132 - t, t - 132).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    seg, t = (a & 0x70) >> 4, (a & 15) << 4
    t = np.where(seg == 0, t + 8, (t + 0x108) << np.maximum(seg - 1, 0))
    return np.where(a & 128, t, -t).astype(np.int16)


EXPAND = {MULAW: _mulaw(), ALAW: _alaw()}


def _steps() -> np.ndarray:
    """The 89 IMA step sizes: each is 1.1 times the one before, as the public table has them."""
    head = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494]
    tail = [544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
    return np.array(head + tail, np.int32)


STEPS = _steps()
MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM, mono: uint8 (blocks, block_align) to int16 (blocks, 1 + 2 * data bytes), all blocks at each step."""
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    nibbles = np.empty((2 * (width - BLOCK_HEADER), n), np.uint8)
    nibbles[0::2], nibbles[1::2] = (blocks[:, BLOCK_HEADER:] & 15).T, (blocks[:, BLOCK_HEADER:] >> 4).T
    out = np.empty((len(nibbles) + 1, n), np.int16)
    out[0] = value
    for k, code in enumerate(nibbles):
        step = STEPS[index]
        move = step >> 3
        move += np.where(code & 4, step, 0)
        move += np.where(code & 2, step >> 1, 0)
        move += np.where(code & 1, step >> 2, 0)
        value += np.where(code & 8, -move, move)
        np.clip(value, -32768, 32767, out=value)
        index += MOVE[code]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, source: int, target: int, half: int = 8) -> np.ndarray:
    """Polyphase windowed-sinc resampling of int16 samples, rounded and clipped to int16."""
    if source == target or not len(pcm):
        return pcm.astype(np.int16)
    g = gcd(source, target)
    up, down = target // g, source // g
    cut = min(1.0, target / source)
    half = int(np.ceil(half / cut))
    x = np.concatenate([np.zeros(half, np.float32), pcm.astype(np.float32), np.zeros(half + down, np.float32)])
    n = -(-len(pcm) * up // down)
    out = np.empty(n, np.int16)
    for first in range(min(up, n)):
        base, phase = divmod(first * down, up)
        if phase == 0 and cut == 1.0:
            y = x[half + base :: down]
        else:
            t = np.arange(-half + 1, half + 1) - phase / up
            taps = cut * np.sinc(cut * t) * np.cos(np.pi * t / (2 * half)) ** 2
            taps = (taps / taps.sum()).astype(np.float32)
            y = np.convolve(x[base + 1 :], taps[::-1], "valid")[::down]
        own = out[first::up]
        own[:] = np.clip(np.rint(y[: len(own)]), -32768, 32767)
    return out


def wav(codec: int, data: bytes, unit: int = UNIT) -> bytes:
    """A WAV file of mono 8 kHz audio. G.711: data are the samples. ADPCM: data are the blocks' nibbles, `unit` a block, each after a zero header."""
    if codec == ADPCM:
        rows = np.frombuffer(data, np.uint8).reshape(-1, unit)
        data = np.concatenate([np.zeros((len(rows), BLOCK_HEADER), np.uint8), rows], axis=1).tobytes()
        align, per_block = unit + BLOCK_HEADER, 2 * unit + 1
        fmt = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * align // per_block, align, 4, 2, per_block)
        samples = len(rows) * per_block
    else:
        fmt, samples = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0), len(data)
    pad = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes] | None:
    """(codec, rate, block align, data), or None if it isn't a mono WAV file of a known codec."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt " and size >= 16 and at + 24 <= len(media):
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif kind == b"data" and fmt:
            ok = fmt[0] in CODECS and fmt[1] == 1 and fmt[2] > 0 and (fmt[0] != ADPCM or fmt[4] > BLOCK_HEADER)
            return (fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]) if ok else None
        at += 8 + size + (size & 1)
    return None


def payload_of(codec: int, align: int, data: bytes) -> bytes:
    """The stored 8-bit units of a parsed file."""
    return np.frombuffer(data, np.uint8).reshape(-1, align)[:, BLOCK_HEADER:].tobytes() if codec == ADPCM else data


def decode_many(parsed: list[tuple[int, int, int, bytes] | None]) -> list[np.ndarray | None]:
    """PCM of each parsed file; the ADPCM blocks of all files are decoded together by block size."""
    out: list[np.ndarray | None] = [None if p is None else EXPAND[p[0]][np.frombuffer(p[3], np.uint8)] if p[0] != ADPCM else None for p in parsed]
    for align in {p[2] for p in parsed if p and p[0] == ADPCM}:
        own = [(i, np.frombuffer(p[3], np.uint8)[: len(p[3]) // align * align].reshape(-1, align)) for i, p in enumerate(parsed) if p and p[0] == ADPCM and p[2] == align]
        pcm, at = decode_adpcm(np.concatenate([b for _, b in own])), 0
        for i, b in own:
            out[i] = pcm[at : at + len(b)].reshape(-1)
            at += len(b)
    return out


def store_pcm(df: DataFrame, media: str = "media", rate: int = TARGET_RATE, out: str = "pcm") -> DataFrame:
    """Add a column of little-endian int16 PCM at `rate`, decoded from WAV media; null where the media is not such a file."""
    schema = df.drop(out).schema.add(out, "binary")
    return df.drop(out).mapInArrow(lambda batches: with_pcm(batches, media, rate, out), schema)


def with_pcm(batches: Iterable[pa.RecordBatch], media: str = "media", rate: int = TARGET_RATE, out: str = "pcm") -> Iterator[pa.RecordBatch]:
    """Batches with the column of PCM, in slices of bounded size."""
    for b in slices(batches, media, SLICE):
        parsed = [parse_wav(m) if m else None for m in b.column(b.schema.get_field_index(media)).to_pylist()]
        pcm = [None if x is None else resample(x, p[1], rate).astype("<i2").tobytes() for p, x in zip(parsed, decode_many(parsed))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pcm, pa.binary())], names=[*b.schema.names, out])


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" ")


def feature(codec: int, rate: int, pcm: np.ndarray) -> str:
    """Figures of the resampled samples."""
    x = pcm.astype(np.float32)
    rms = float(np.sqrt(np.mean(np.square(x, dtype=np.float64))))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{NAMES[codec]}:{rate}:{len(pcm)}:peak={int(np.abs(x).max())}:rms={rms:.3f}:zc={crossings}:crc={zlib.crc32(pcm.tobytes()):08x}"


SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in SCHEMA.split(", ")]


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each whole text, as telephony audio. The codec follows from the payload's crc32, so equal texts are equal media."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            raws = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            media = [wav(CODECS[zlib.crc32(p) % 3], p) for p in map(pad, raws)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """Payload and features of stored media (doc_id, n_bytes, media): the media are read back and decoded, and their PCM column described."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in with_pcm(batches):
            rows = []
            for doc, n, m, pcm in zip(*(c.to_pylist() for c in b.columns)):
                codec, _, align, data = parse_wav(m)
                back = payload_of(codec, align, data)
                rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(codec, TARGET_RATE, np.frombuffer(pcm, "<i2"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=FIELDS)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)


def text_media(docs: DataFrame) -> DataFrame:
    """Store each whole text as telephony audio in the shared folder, read it back and describe it."""
    return describe(settle(store_media(docs)))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents", "doc_id", "text"))
