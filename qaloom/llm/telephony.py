"""Telephony audio: G.711 expansion by lookup tables, IMA ADPCM decoded across blocks, resampling, WAV containers.

Codes are kept losslessly in a WAV file (format tags 7 mu-law, 6 A-law, 17 IMA ADPCM) and expanded to 16-bit PCM at
another rate.  mu-law and A-law samples are one table gather; ADPCM is sequential inside a block, so all blocks of a
stream advance together, one numpy step per sample position.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of

RATE, OUT_RATE = 8000, 16000
ADPCM_BLOCK = 256
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: Index changes of the IMA ADPCM code (fixed values of the format).
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
#: Step sizes of the IMA ADPCM code (fixed values of the format).
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
     130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
     1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
     7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int64)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: code -> 16-bit sample, from the segment rule."""
    u = ~np.arange(256) & 255
    size = ((((u & 15) << 3) + 132) << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: code -> 16-bit sample, from the segment rule."""
    a = np.arange(256) ^ 85
    seg, low = a >> 4 & 7, ((a & 15) << 4) + 8
    size = np.where(seg > 0, (low + 256) << np.maximum(seg - 1, 0), low)
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_adpcm(blocks: np.ndarray, predictor: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Mono IMA nibbles (low one first) of many blocks at once: (blocks, 1 + 2 * bytes) samples.

    ``blocks`` is (n, bytes); ``predictor`` and ``index`` are each block's header state, the predictor being the first sample.
    """
    codes = np.stack([blocks & 15, blocks >> 4], axis=2).reshape(len(blocks), -1)
    out = np.empty((len(codes), 1 + codes.shape[1]), np.int16)
    p, k = predictor.astype(np.int64), index.astype(np.int64)
    out[:, 0] = p
    for t in range(codes.shape[1]):
        c, step = codes[:, t].astype(np.int64), STEPS[k]
        diff = (step >> 3) + (step >> 2) * (c & 1) + (step >> 1) * (c >> 1 & 1) + step * (c >> 2 & 1)
        p = np.clip(np.where(c & 8, p - diff, p + diff), -32768, 32767)
        k = np.clip(k + INDEX_STEP[c], 0, 88)
        out[:, t + 1] = p
    return out


def resample(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """Linear interpolation on the output grid; the last sample is held.  Integer arithmetic, so results are exact."""
    if rate == out_rate or not len(pcm):
        return pcm.astype(np.int16)
    n = len(pcm) * out_rate // rate
    if out_rate == 2 * rate:
        x = pcm.astype(np.int32)
        out = np.empty(2 * len(x), np.int16)
        out[0::2] = x
        out[1:-1:2] = (x[:-1] + x[1:]) >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(n, dtype=np.int64) * rate
    i, frac = at // out_rate, at % out_rate
    a, b = pcm[i].astype(np.int64), pcm[np.minimum(i + 1, len(pcm) - 1)].astype(np.int64)
    return (a + (b - a) * frac // out_rate).astype(np.int16)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_wav(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV that holds ``payload`` unchanged as the codec's units.

    mu-law and A-law: one byte a sample.  ADPCM: two samples a byte, in blocks of ``ADPCM_BLOCK`` bytes with the standard
    four-byte header (predictor 0, index 0) and zero-filled last block.  The fact chunk holds the number of samples: one a block
    from its header and two a payload byte, so the payload's length can be read back from it.
    """
    if codec == "adpcm":
        size = ADPCM_BLOCK - 4
        n = -(-len(payload) // size)
        body = np.zeros((n, ADPCM_BLOCK), np.uint8)
        flat = np.zeros(n * size, np.uint8)
        flat[: len(payload)] = np.frombuffer(payload, np.uint8)
        body[:, 4:] = flat.reshape(n, size)
        data, samples = body.tobytes(), n + 2 * len(payload)
        per_block = 2 * size + 1
        fmt = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * ADPCM_BLOCK // per_block, ADPCM_BLOCK, 4, 2, per_block)
    else:
        data, samples, fmt = payload, len(payload), struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    rest = b"WAVE" + _chunk(b"fmt ", fmt) + _chunk(b"fact", struct.pack("<I", samples)) + _chunk(b"data", data)
    return b"RIFF" + struct.pack("<I", len(rest)) + rest


def parse_wav(media: bytes) -> tuple[str, int, bytes, np.ndarray]:
    """(codec, rate, payload, codes) of a mono file; codes: bytes, or ADPCM blocks with their headers.

    The payload is as long as the fact chunk's samples say, or all there is where that chunk is missing; a broken last block
    of ADPCM is filled with zeros.
    """
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, parts = 12, {}
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        parts[name] = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    tag, _, rate, _, block = struct.unpack_from("<HHIIH", parts[b"fmt "])
    codec = {v: k for k, v in TAGS.items()}[tag]
    data = parts[b"data"]
    samples = struct.unpack("<I", parts[b"fact"])[0] if b"fact" in parts else None
    if codec != "adpcm":
        data = data[:samples]
        return codec, rate, data, np.frombuffer(data, np.uint8)
    blocks = np.frombuffer(data + bytes(-len(data) % block), np.uint8).reshape(-1, block)
    n = blocks.size if samples is None else max(0, samples - len(blocks)) // 2
    return codec, rate, blocks[:, 4:].reshape(-1)[:n].tobytes(), blocks


def read_many(files: list[bytes]) -> list[tuple[str, int, bytes, np.ndarray]]:
    """(codec, rate, payload, 16-bit PCM) of each file; the ADPCM blocks of all files advance together."""
    parsed = [parse_wav(m) for m in files]
    by_width: dict[int, list[int]] = {}
    for i, (codec, *_, codes) in enumerate(parsed):
        if codec == "adpcm":
            by_width.setdefault(codes.shape[1], []).append(i)
    pcm: dict[int, np.ndarray] = {}
    for width, which in by_width.items():
        blocks = np.concatenate([parsed[i][3] for i in which])
        heads = blocks[:, :4].copy().view("<i2")
        out = np.empty((len(blocks), 1 + 2 * (width - 4)), np.int16)
        for at in range(0, len(blocks), 1 << 14):
            some = slice(at, at + (1 << 14))
            out[some] = decode_adpcm(blocks[some, 4:], heads[some, 0], np.minimum(blocks[some, 2], 88))
        at = 0
        for i in which:
            n = len(parsed[i][3])
            pcm[i] = out[at : at + n].reshape(-1)[: n + 2 * len(parsed[i][2])]
            at += n
    table = {"mulaw": MULAW, "alaw": ALAW}
    return [(c, rate, payload, pcm[i] if i in pcm else table[c][codes]) for i, (c, rate, payload, codes) in enumerate(parsed)]


def features(pcm: np.ndarray, rate: int) -> str:
    """Duration, level, peak, sign changes and a coarse energy envelope, from integer sums (exact on every machine)."""
    x = pcm.astype(np.int64)
    n = max(1, len(x))
    level = int((x * x).sum()) // n
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    edges = np.linspace(0, len(x), 9).astype(np.int64)
    envelope = [int(np.abs(x[a:b]).sum()) // max(1, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return f"ms={len(x) * 1000 // rate};power={level};peak={int(np.abs(x).max(initial=0))};cross={changes};env={','.join(map(str, envelope))}"


def store_payloads(rows: DataFrame, payload: str, codec: str, keep: list[str]) -> DataFrame:
    """``keep`` columns plus ``media`` (the WAV file) of each binary ``payload`` under the codec named in column ``codec``.

    A null payload or codec gives a null file, an unknown codec raises.  Repeated rows get equal files, an empty table gives an
    empty result, and a kept column named ``media`` gets an underscore.
    """
    rows, keep = clear_of(rows, keep, ["media"])
    src = rows.select(*keep, F.col(payload).alias("__p"), F.col(codec).alias("__c"))
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("media", T.BinaryType())])
    k = len(keep)

    def run(batches):
        for whole in batches:
            for b in _slices(whole, k):
                media = [None if p is None or c is None else write_wav(c, p) for p, c in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(media, pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def decode_media(rows: DataFrame, media: str, keep: list[str], out_rate: int = OUT_RATE) -> DataFrame:
    """``keep`` columns plus what a stored file holds: ``codec, payload, rate, pcm`` (resampled, little-endian 16-bit), ``feature``.

    A null file gives nulls; a damaged one raises.  Kept columns named like a new one get an underscore.
    """
    rows, keep = clear_of(rows, keep, ["codec", "payload", "rate", "pcm", "feature"])
    src = rows.select(*keep, F.col(media).alias("__m"))
    k = len(keep)
    fields = (("codec", T.StringType()), ("payload", T.BinaryType()), ("rate", T.IntegerType()), ("pcm", T.BinaryType()), ("feature", T.StringType()))
    schema = T.StructType([*src.schema.fields[:k], *(T.StructField(n, t) for n, t in fields)])

    def run(batches):
        for whole in batches:
            for b in _slices(whole, k):
                cols: list[list] = [[], [], [], [], []]
                files = b.column(k).to_pylist()
                heard_all = iter(read_many([m for m in files if m is not None]))
                for m in files:
                    if m is None:
                        got = (None,) * 5
                    else:
                        codec, rate, payload, pcm = next(heard_all)
                        heard = resample(pcm, rate, out_rate)
                        got = (codec, payload, out_rate, heard.astype("<i2").tobytes(), features(pcm, rate))
                    for c, v in zip(cols, got, strict=True):
                        c.append(v)
                kinds = (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    return src.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20):
    """Slices of about ``limit`` bytes of one binary column, so that a batch of long media stays small in memory."""
    sizes = np.array([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()])
    at = 0
    ends = np.cumsum(sizes)
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def payload_of(text: str = "text") -> F.Column:
    """UTF-8 bytes of a text (null: none), with zero bytes up to a positive multiple of 64."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(64)).otherwise((F.lit(64) - n % 64) % 64)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def codec_of(payload: F.Column) -> F.Column:
    """One of the three codecs by the payload's checksum, so that equal payloads have equal files."""
    return F.element_at(F.array(*(F.lit(c) for c in TAGS)), (F.crc32(payload) % len(TAGS)).cast("int") + 1)
