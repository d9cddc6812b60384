"""Media columns: telephony audio.

Payload bytes are kept as 8-bit mu-law or A-law samples or as blocks of 4-bit ADPCM codes inside a WAVE
container.  ``store_telephony`` writes the container, reads the payload back out of it, expands the
samples to linear PCM (lookup tables for the logarithmic codes, numpy across all blocks of a slice for
ADPCM) and stores PCM resampled from 8 to 16 kHz.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_slices

RATE, OUT_RATE, UNIT = 8000, 16000, 64
#: WAVE format tags (fixed values of the public registry).
TAGS = {"alaw": 6, "ulaw": 7, "adpcm": 17}
CODECS = ("ulaw", "alaw", "adpcm")
#: Step sizes of the IMA ADPCM recommendation (fixed values).
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
#: Index steps by the magnitude bits of a code (fixed values).
INDEX_STEPS = (-1, -1, -1, -1, 2, 4, 6, 8)


def ulaw_table() -> np.ndarray:
    """G.711 mu-law: complemented sign, 3 exponent bits, 4 mantissa bits, bias 132."""
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, sign bit set for positive values."""
    code = np.arange(256, dtype=np.int64) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference and next step index for each (step index, code), flat."""
    step, code = np.array(STEPS, np.int64)[:, None], np.arange(16)[None, :]
    size = (step >> 3) + (code >> 2 & 1) * step + (code >> 1 & 1) * (step >> 1) + (code & 1) * (step >> 2)
    moved = np.clip(np.arange(len(STEPS))[:, None] + np.array(INDEX_STEPS)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), moved.astype(np.int32).ravel()


LINEAR = {"ulaw": ulaw_table(), "alaw": alaw_table()}
DIFFERENCE, MOVED = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Decode blocks (rows of header and code bytes) together: one numpy step for each code position."""
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    body = blocks[:, 4:]
    out = np.empty((len(blocks), 1 + 2 * body.shape[1]), np.int16)
    out[:, 0] = value
    for j in range(2 * body.shape[1]):
        at = index * 16 + (body[:, j >> 1] >> (4 if j & 1 else 0) & 15)
        value = np.clip(value + DIFFERENCE[at], -32768, 32767)
        index = MOVED[at]
        out[:, j + 1] = value
    return out


def container(codec: str, payload: bytes) -> bytes:
    """A WAVE file that holds ``payload`` losslessly: one byte a sample, or 64 code bytes an ADPCM block."""
    if codec == "adpcm":
        blocks = np.zeros((len(payload) // UNIT, UNIT + 4), np.uint8)
        blocks[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        data, align, bits, samples = blocks.tobytes(), UNIT + 4, 4, len(blocks) * (2 * UNIT + 1)
        extra = struct.pack("<HH", 2, 2 * UNIT + 1)
    else:
        data, align, bits, samples, extra = payload, 1, 8, len(payload), struct.pack("<H", 0)
    rate = RATE if align == 1 else RATE * align // (2 * UNIT + 1)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, rate, align, bits) + extra
    body = b"WAVE" + b"".join(tag + struct.pack("<I", len(x)) + x for tag, x in ((b"fmt ", fmt), (b"fact", struct.pack("<I", samples)), (b"data", data)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_container(media: bytes) -> tuple[str, bytes, np.ndarray | None]:
    """Codec, payload and, for ADPCM, the blocks of a stored WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, chunks = 12, {}
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        chunks[media[at : at + 4]] = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    tag, align = struct.unpack_from("<H", chunks[b"fmt "])[0], struct.unpack_from("<H", chunks[b"fmt "], 12)[0]
    codec = next(k for k, v in TAGS.items() if v == tag)
    if codec != "adpcm":
        return codec, chunks[b"data"], None
    blocks = np.frombuffer(chunks[b"data"], np.uint8).reshape(-1, align)
    return codec, blocks[:, 4:].tobytes(), blocks


def resample(pcm: np.ndarray) -> np.ndarray:
    """8 to 16 kHz by linear interpolation; the last sample is held."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1:-1:2] = wide[:-1] + wide[1:] >> 1
    out[-1:] = pcm[-1:]
    return out


def pcm_file(pcm: np.ndarray) -> bytes:
    data = pcm.astype("<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, OUT_RATE, 2 * OUT_RATE, 2, 16)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, sample count, peak, mean energy and sign changes, all integers."""
    wide = pcm.astype(np.int64)
    changes = int(np.count_nonzero(np.diff(pcm < 0)))
    return f"{codec};samples={len(pcm)};peak={int(np.abs(wide).max())};energy={int((wide * wide).sum()) // len(pcm)};crossings={changes}"


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


SCHEMA = "{id} {kind}, n_bytes long, codec string, media binary, payload binary, pcm binary, feature string"


def store_telephony(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the stored media, the payload read back, resampled PCM and a feature line.

    The payload is the text as UTF-8 with zero bytes up to a positive multiple of 64; the codec is
    chosen by the payload's CRC-32, so equal texts give equal values.  Null and empty texts give 64
    zero bytes.  Rows with a null or repeated id stay rows of their own.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        schema = None
        for part in byte_slices(batches, budget=2 << 20):
            texts = part.column(1).to_pylist()
            media, codes, back, blocks = [], [], [], {}
            for i, text in enumerate(texts):
                payload = padded(text)
                media.append(container(CODECS[zlib.crc32(payload) % len(CODECS)], payload))
                codec, read, own = read_container(media[-1])
                codes.append(codec)
                back.append(read)
                if own is not None:
                    blocks[i] = own
            pcm = [None if i in blocks else LINEAR[c][np.frombuffer(p, np.uint8)] for i, (c, p) in enumerate(zip(codes, back, strict=True))]
            if blocks:
                flat, at = decode_adpcm(np.concatenate(list(blocks.values()))), 0
                for i, own in blocks.items():
                    pcm[i] = flat[at : at + len(own)].ravel()
                    at += len(own)
            schema = schema or pa.schema([part.schema.field(0), ("n_bytes", pa.int64()), ("codec", pa.string()), ("media", pa.binary()), ("payload", pa.binary()), ("pcm", pa.binary()), ("feature", pa.string())])
            sizes = [len((t or "").encode()) for t in texts]
            yield batch_of(schema, [part.column(0), sizes, codes, media, back, [pcm_file(resample(x)) for x in pcm], [feature(c, x) for c, x in zip(codes, pcm, strict=True)]])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA.format(id=f"`{id_col}`", kind=kind))


def media_digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's digest columns, derived natively from what ``store_telephony`` returns."""
    return df.select(
        id_col,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
