"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled PCM, all numpy across rows and blocks.

``wave``/``parse`` pack bytes losslessly into RIFF files and read them back; ``decoded`` expands the two laws by lookup
tables and ADPCM a step at a time across all blocks of all values with the same block size and channels; ``to_pcm`` is the
column operator and stores resampled 16-bit PCM files. Payloads of a batch lie back to back, so nothing runs row by row but
the container, the digests and resampling at other ratios than two.

A file's header says how it is read: mu-law, A-law, IMA ADPCM (any block size that the format allows, a last block that is
shorter included) or 16-bit PCM, of one or two channels, which stay apart and are interleaved in the result.

Defined results: null and empty texts give a payload of 64 zero bytes; a media value that is null or no RIFF file of these
kinds gives null PCM; equal bytes give equal values; repeated rows are kept; very long values are decoded
whole. Only the named columns are read, so other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, sliced, spread, texts_of

MULAW, ALAW, IMA, PCM = 7, 6, 17, 1
#: IMA block: four bytes of header, then two samples a byte; the unit that payloads are padded to.
BLOCK = 64
#: Text bytes decoded at once: the signal of a byte takes some 60 bytes of memory.
SLICE_BYTES = 3 << 20

_b = np.arange(256)
_u = ~_b & 255
_mag = (((_u & 15) << 3) + 132 << ((_u >> 4) & 7)) - 132
MULAW_TABLE = np.where(_u & 128, -_mag, _mag).astype(np.int16)
_a = _b ^ 0x55
_e, _m = (_a >> 4) & 7, (_a & 15) << 4
_mag = np.where(_e == 0, _m + 8, (_m + 264) << np.maximum(_e - 1, 0))
ALAW_TABLE = np.where(_a & 128, _mag, -_mag).astype(np.int16)
#: The 89 step sizes grow by about a tenth each; the standard lists them rounded as follows.
STEPS = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_n = np.arange(16)[None]
#: Change of the predictor by step index and nibble.
_d = (STEPS[:, None] >> 3) + (STEPS[:, None] * (_n & 1) >> 2) + (STEPS[:, None] * (_n >> 1 & 1) >> 1) + STEPS[:, None] * (_n >> 2 & 1)
DELTAS = np.where(_n & 8, -_d, _d).astype(np.int32)
NEXT = np.clip(np.arange(89)[:, None] + MOVES[None], 0, 88).astype(np.int32)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value followed by zero bytes up to a positive multiple of BLOCK, and the new offsets."""
    size = np.diff(offsets)
    full = np.maximum(1, -(-size // BLOCK)) * BLOCK
    to = np.append(0, np.cumsum(full))
    out = np.zeros(to[-1], np.uint8)
    out[spread(to[:-1], size)] = data
    return out, to


def wave(payload: bytes, codec: int, rate: int = 8000, channels: int = 1, block: int = BLOCK) -> bytes:
    """A RIFF file that holds the payload as it is."""
    if codec == PCM:
        head = struct.pack("<HHIIHH", PCM, channels, rate, 2 * rate * channels, 2 * channels, 16)
    elif codec == IMA:
        samples = 2 * (block // channels - 4) + 1
        head = struct.pack("<HHIIHHHH", IMA, channels, rate, rate * block // samples, block, 4, 2, samples)
    else:
        head = struct.pack("<HHIIHHH", codec, channels, rate, rate * channels, channels, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(stored: bytes | None) -> tuple[int, int, bytes, int, int] | None:
    """(codec, rate, payload, channels, block size) of a RIFF file, else None."""
    if not stored or stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        return None
    at, codec, rate, channels, block, bits = 12, None, 0, 0, 0, 0
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt " and size >= 16 and at + 24 <= len(stored):
            codec, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif kind == b"data" and codec is not None:
            fit = {MULAW: bits == 8, ALAW: bits == 8, PCM: bits == 16, IMA: bits == 4 and block > 4 * channels and block % (4 * channels) == 0 if channels else False}.get(codec, False)
            return (codec, rate, stored[at + 8 : at + 8 + size], channels, block) if fit and channels in (1, 2) and rate else None
        at += 8 + size + (size & 1)
    return None


def ima(data: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """PCM of IMA ADPCM blocks: one step of every block at a time. Returns blocks x samples."""
    blocks = data.reshape(-1, block)
    pred = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (block - 4) + 1, len(blocks)), np.int16)
    out[0] = pred
    for k in range(block - 4):
        byte = blocks[:, 4 + k]
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            pred += DELTAS[index, nibble]
            np.clip(pred, -32768, 32767, out=pred)
            index = NEXT[index, nibble]
            out[2 * k + half + 1] = pred
    return out.T


def doubled(pcm: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation within each value (a value's last sample is held)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    last = offsets[1:][np.diff(offsets) > 0] - 1
    out[2 * last + 1] = pcm[last]
    return out


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """One value at another rate, by linear interpolation."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        return doubled(pcm, np.array([0, len(pcm)]))
    at = np.arange(max(1, len(pcm) * to // rate)) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def adpcm(data: np.ndarray, block: int, channels: int) -> np.ndarray:
    """PCM of IMA blocks of one or two channels, interleaved: blocks x (samples x channels)."""
    if channels == 1:
        return ima(data, block)
    blocks = data.reshape(-1, block)
    heads, body = blocks[:, : 4 * channels].reshape(-1, channels, 4), blocks[:, 4 * channels :].reshape(len(blocks), -1, channels, 4)
    each = [ima(np.concatenate([heads[:, c], body[:, :, c].reshape(len(blocks), -1)], 1).ravel(), block // channels) for c in range(channels)]
    return np.stack(each, 2).reshape(len(blocks), -1)


def decoded(found: list[tuple[int, int, bytes, int, int] | None]) -> list[np.ndarray | None]:
    """Samples x channels of each parsed value."""
    out: list[np.ndarray | None] = [None] * len(found)
    whole: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    parts: dict[int, list[np.ndarray]] = {}
    for i, x in enumerate(found):
        if x is None:
            continue
        codec, _, payload, channels, block = x
        data = np.frombuffer(payload, np.uint8)
        if codec == IMA:
            full = len(data) // block * block
            whole.setdefault((block, channels), []).append((i, data[:full]))
            short = (len(data) - full) // (4 * channels) * 4 * channels  # of a last block, what is there in whole groups
            parts[i] = [data[full : full + short]] if short > 4 * channels else []
        else:
            pcm = data[: len(data) // 2 * 2].view("<i2") if codec == PCM else (MULAW_TABLE if codec == MULAW else ALAW_TABLE)[data]
            out[i] = pcm[: len(pcm) // channels * channels].reshape(-1, channels)
    for (block, channels), group in whole.items():
        samples = adpcm(np.concatenate([d for _, d in group]), block, channels)
        at = 0
        for i, d in group:
            n = len(d) // block
            own = [samples[at : at + n].ravel(), *(adpcm(p, len(p), channels).ravel() for p in parts[i])]
            out[i], at = np.concatenate(own).reshape(-1, channels), at + n
    return out


def to_pcm(rows: DataFrame, id_col: str, media_col: str, rate: int = 16000) -> DataFrame:
    """id, rate and a RIFF file of 16-bit PCM at the wanted rate for each media value; null where it can't be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, media_col):
            found = [parse(x) for x in batch.column(1).to_pylist()]
            out = []
            for x, pcm in zip(found, decoded(found)):
                if x is None:
                    out.append(None)
                    continue
                each = [resampled(np.ascontiguousarray(pcm[:, c]), x[1], rate) for c in range(x[3])]
                out.append(wave(np.stack(each, 1).astype("<i2").tobytes(), PCM, rate, x[3]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rate] * len(out), pa.int32()), pa.array(out, pa.binary())], ["id", "rate", "pcm"])

    return rows.select(id_col, media_col).mapInArrow(run, f"id {dict(rows.dtypes)[id_col]}, rate int, pcm binary")


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: int = MULAW) -> DataFrame:
    """id and the media value of every text: its padded UTF-8 bytes as the samples (or ADPCM blocks) of a RIFF file."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, to = padded(*texts_of(batch.column(1)))
        out = [wave(data[a:b].tobytes(), codec) for a, b in zip(to[:-1], to[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "media"])

    return arrow_map(docs, [id_col, text_col], run, f"id {dict(docs.dtypes)[id_col]}, media binary", text_col)


def features(data: np.ndarray, to: np.ndarray, pcm: np.ndarray) -> list[str]:
    """Per value: length, energy, zero crossings and peak of the resampled mu-law signal; energy of the A-law one; energy and last sample of the ADPCM one; CRC-32 of the resampled PCM."""
    heads = to[:-1]
    wide = pcm.astype(np.int64)
    power = np.add.reduceat(wide * wide, 2 * heads)
    peak = np.maximum.reduceat(np.abs(wide), 2 * heads)
    turn = np.append(False, (pcm[1:] >= 0) != (pcm[:-1] >= 0))
    turn[2 * heads] = False
    crossings = np.add.reduceat(turn.astype(np.int64), 2 * heads)
    a = np.add.reduceat(np.abs(ALAW_TABLE[data].astype(np.int64)), heads)
    blocks = ima(data)
    each = np.abs(blocks.astype(np.int32)).sum(1, dtype=np.int64)
    b = np.add.reduceat(each, heads // BLOCK)
    final = blocks[to[1:] // BLOCK - 1, -1]
    raw = memoryview(pcm.astype("<i2", copy=False)).cast("B")
    return [
        f"n={2 * int(n)};rms={int(np.sqrt(p / (2 * n)))};zc={z};peak={k};alaw={x};ima={y};last={e};pcm={zlib.crc32(raw[4 * s : 4 * t]):08x}"
        for n, p, z, k, x, y, e, s, t in zip(np.diff(to), power, crossings, peak, a, b, final, heads.tolist(), to[1:].tolist())
    ]


def digest(batch: pa.RecordBatch, codec: int = MULAW) -> pa.RecordBatch:
    """Store every text as media, read the stored bytes back, store their resampled PCM, and describe all three."""
    source, offsets = texts_of(batch.column(1))
    data, to = padded(source, offsets)
    stored = [wave(data[s:e].tobytes(), codec) for s, e in zip(to[:-1], to[1:])]
    back = [parse(x)[2] for x in stored]
    joined, ends = np.frombuffer(b"".join(back), np.uint8), np.append(0, np.cumsum([len(x) for x in back]))
    pcm = doubled(MULAW_TABLE[joined], ends)
    raw = memoryview(pcm.astype("<i2", copy=False)).cast("B")
    files = [wave(bytes(raw[4 * s : 4 * t]), PCM, 16000) for s, t in zip(ends[:-1].tolist(), ends[1:].tolist())]
    columns = {
        "doc_id": batch.column(0),
        "n_bytes": pa.array(np.diff(offsets), pa.int64()),
        "payload_bytes": pa.array([len(x) for x in back], pa.int64()),
        "payload_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
        "tail_crc32": pa.array([zlib.crc32(x[-64:]) for x in back], pa.int64()),
        "media_bytes": pa.array([len(x) for x in stored], pa.int64()),
        "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in stored]),
        "feature": pa.array(features(joined, ends, pcm)),
        "pcm_bytes": pa.array([len(x) for x in files], pa.int64()),
        "pcm_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in files]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every text's stored telephony form, one row for each input row."""
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return arrow_map(docs, [id_col, text_col], digest, schema, text_col, SLICE_BYTES)
