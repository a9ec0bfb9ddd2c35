"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE files, decoded with numpy and resampled to 16 kHz PCM.

`encode_media` stores bytes losslessly as 8-bit G.711 code words or as 4-bit ADPCM codes in blocks; `decode_media`
parses the stored file, expands code words by lookup tables, decodes ADPCM blocks in step across all blocks of a
batch, and resamples to 16 kHz by a half-band filter.

The file is stored (`store_media`, Parquet in the shared folder) and read back; what comes out holds the resampled PCM.

Defined results: a null or empty text is one block of 255s. Equal texts give equal files and features. A null media
value decodes to nulls. Extra columns pass through, but for those with the names that the operator makes (`media`, or
OWN), which it replaces. Tables of any size stream in slices of half a MB; one long text is a slice of its own, whose
samples are handled CHUNK at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, text_or_empty

BLOCK = 576
RATE, TARGET_RATE = 8000, 16000
MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
CODECS = (MULAW, ALAW, ADPCM)
#: Bytes of stored files in a slice; samples that arithmetic wider than 16 bits is done on at once.
SLICE_BYTES, CHUNK = 1 << 19, 1 << 20
#: Columns that decoding makes.
OWN = ("payload_bytes", "payload_sha256", "tail_crc32", "feature", "pcm16k")

# WAVE format tags of the three codecs.
FORMAT_TAG = {MULAW: 7, ALAW: 6, ADPCM: 17}
# IMA ADPCM index changes by code, and step sizes.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEP_SIZE = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: 256 code words to 16-bit linear samples."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: 256 code words to 16-bit linear samples."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, value = (code >> 4) & 7, (code & 0x0F) << 4
    magnitude = np.where(segment == 0, value + 8, (value + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, magnitude, -magnitude).astype(np.int16)


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)


def codec_of(payload: bytes) -> str:
    return CODECS[zlib.crc32(payload[-32:]) % 3]


def wave_file(payload: bytes, codec: str) -> bytes:
    """A RIFF/WAVE file whose data chunk holds the payload: code words as they are, or ADPCM blocks with a header of
    predictor 0 and index 0 before each 576 bytes of codes."""
    if codec == ADPCM:
        body = np.zeros((len(payload) // BLOCK, 4 + BLOCK), dtype=np.uint8)
        body[:, 4:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCK)
        data, samples, align, bits = body.tobytes(), len(body) * (1 + 2 * BLOCK), 4 + BLOCK, 4
        extra = struct.pack("<HH", 2, 1 + 2 * BLOCK)
    else:
        data, samples, align, bits, extra = payload, len(payload), 1, 8, struct.pack("<H", 0)
    rate = RATE if align == 1 else RATE * align // (1 + 2 * BLOCK)
    fmt = struct.pack("<HHIIHH", FORMAT_TAG[codec], 1, RATE, rate, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(media: bytes) -> tuple[str, bytes]:
    """The codec and the payload bytes of a stored file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, data = 12, None, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(k for k, v in FORMAT_TAG.items() if v == tag)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if codec is None:
        raise ValueError("no format chunk")
    if codec == ADPCM:
        data = np.frombuffer(data, dtype=np.uint8).reshape(-1, 4 + BLOCK)[:, 4:].tobytes()
    return codec, data


def decode_adpcm(codes: np.ndarray) -> np.ndarray:
    """(blocks, 576) bytes to (blocks, 1153) samples; every step handles one code of all blocks."""
    nibbles = np.empty((codes.shape[1] * 2, codes.shape[0]), dtype=np.int32)
    nibbles[0::2], nibbles[1::2] = (codes & 15).T, (codes >> 4).T
    out = np.zeros((nibbles.shape[0] + 1, codes.shape[0]), dtype=np.int16)
    value = np.zeros(codes.shape[0], dtype=np.int32)
    index = np.zeros(codes.shape[0], dtype=np.int32)
    for k, code in enumerate(nibbles):
        step = STEP_SIZE[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code], 0, 88)
        out[k + 1] = value
    return out.T


def upsample(pcm: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Twice the rate for several signals that lie end to end (starts: their first samples): given samples stay, those
    between come from a 4-tap half-band filter; signals are continued by their end samples."""
    x = pcm.astype(np.int32)
    ends = np.append(starts[1:], len(x)) - 1
    left, right, far = np.roll(x, 1), np.roll(x, -1), np.roll(x, -2)
    left[starts] = x[starts]
    right[ends] = x[ends]
    far[ends] = x[ends]
    before = ends[ends > starts] - 1
    far[before] = x[before + 1]
    out = np.empty(2 * len(x), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip((9 * (x + right) - left - far + 8) >> 4, -32768, 32767)
    return out


def measure(pcm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peak, energy and sign changes of each signal, and all signals at twice the rate. Signals longer than CHUNK are
    taken in runs of samples with their neighbours, with the same result."""
    if len(pcm) <= CHUNK or len(starts) > 1:
        wide = pcm.astype(np.int64)
        flips = np.zeros(len(pcm), dtype=np.int64)
        flips[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
        flips[starts] = 0
        return np.maximum.reduceat(np.abs(wide), starts), np.add.reduceat(wide * wide, starts), np.add.reduceat(flips, starts), upsample(pcm, starts)
    peak = energy = crossings = 0
    out = np.empty(2 * len(pcm), dtype=np.int16)
    for a in range(0, len(pcm), CHUNK):
        b, low, high = min(len(pcm), a + CHUNK), max(0, a - 1), min(len(pcm), a + CHUNK + 2)
        wide = pcm[a:b].astype(np.int64)
        peak, energy = max(peak, int(np.abs(wide).max())), energy + int((wide * wide).sum())
        crossings += int(np.count_nonzero(np.diff(pcm[low:b] < 0)))
        out[2 * a : 2 * b] = upsample(pcm[low:high], np.zeros(1, dtype=np.int64))[2 * (a - low) : 2 * (b - low)]
    return np.array([peak]), np.array([energy]), np.array([crossings]), out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "_text", SLICE_BYTES):
            media = []
            for t in part.column("_text").to_pylist():
                payload = padded((t or "").encode())
                media.append(wave_file(payload, codec_of(payload)))
            rest = [c for c in part.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(media, pa.binary())], [*rest, "media"])


def _decoded(media: list[bytes | None]) -> list[tuple | None]:
    """For each file (payload, codec, samples, peak, energy, crossings, 16 kHz PCM bytes)."""
    out: list[tuple | None] = [None] * len(media)
    read = [read_wave(m) if m is not None else None for m in media]
    for codec in CODECS:
        at = [i for i, r in enumerate(read) if r and r[0] == codec and r[1]]
        if not at:
            continue
        sizes = np.array([len(read[i][1]) for i in at])
        data = np.frombuffer(b"".join(read[i][1] for i in at), dtype=np.uint8)
        if codec == ADPCM:
            codes = data.reshape(-1, BLOCK)
            run = CHUNK // (2 * BLOCK)
            pcm = np.concatenate([decode_adpcm(codes[k : k + run]).reshape(-1) for k in range(0, len(codes), run)])
            sizes = sizes // BLOCK * (1 + 2 * BLOCK)
        else:
            pcm = _TABLES[codec][data]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        peak, energy, crossings, wideband = measure(pcm, starts)
        for k, i in enumerate(at):
            a, n = starts[k], sizes[k]
            out[i] = (read[i][1], codec, int(n), int(peak[k]), int(energy[k]), int(crossings[k]), wideband[2 * a : 2 * (a + n)].tobytes())
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    kinds = dict(zip(OWN, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True))
    for batch in batches:
        for part in slices(batch, "media", SLICE_BYTES):
            made: dict[str, list] = {k: [] for k in OWN}
            for got in _decoded(part.column("media").to_pylist()):
                if got is None:
                    row = [None] * len(OWN)
                else:
                    payload, codec, n, peak, energy, crossings, pcm = got
                    row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), f"{codec};samples={n};peak={peak};energy={energy};crossings={crossings}", pcm]
                for k, v in zip(OWN, row, strict=True):
                    made[k].append(v)
            rest = [c for c in part.schema.names if c != "media"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(v, kinds[k]) for k, v in made.items())], [*rest, *made])


def encode_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `text` replaced by `media`, the WAVE file of its padded bytes."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "media", "_text")]
    df = docs.select(*[F.col(f"`{f.name}`") for f in rest], text_or_empty(text).alias("_text"))
    return df.mapInArrow(_encode, T.StructType([*rest, T.StructField("media", T.BinaryType())]))


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """encode_media, written to the shared folder and read back."""
    return materialize(encode_media(docs, text), "media", {"parquet.block.size": str(16 << 20)})


def decode_media(stored: DataFrame) -> DataFrame:
    """stored with `media` replaced by OWN: payload_bytes, payload_sha256, tail_crc32, feature and the resampled 16 kHz
    PCM samples (`pcm16k`, little-endian 16-bit)."""
    rest = [f for f in stored.schema.fields if f.name not in ("media", *OWN)]
    made = zip(OWN, (T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.BinaryType()), strict=True)
    return stored.select(*[F.col(f"`{f.name}`") for f in rest], "media").mapInArrow(_decode, T.StructType([*rest, *(T.StructField(n, t) for n, t in made)]))


def media_digest(media: Column) -> Column:
    return F.sha2(media, 256)
