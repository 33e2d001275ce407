"""SentencePiece models encoded and decoded with the tokenizers library.

The model file's protobuf is read here; normaliser, white-space marker, scores (unigram) or merge order (byte-pair) and
byte fallback are rebuilt from it.  Where no piece holds a marker after another character, or a newline among others,
texts split exactly at those places, and batches of unseen chunks are encoded by the library's threads.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of
from .wordcache import ChunkCache, by_size

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    suffix_mark: bool = False


def _fields(buf: bytes) -> Iterable[tuple[int, int | bytes]]:
    """(field number, value) pairs of one protobuf message; varints as int, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, buf[at : at + n]
            at += n


def parse_model(buf: bytes) -> Model:
    """Pieces, trainer and normaliser settings of a serialised model."""
    m = Model()
    for number, value in _fields(buf):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 24:
                    m.suffix_mark = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def build_tokenizer(m: Model):
    """A tokenizers.Tokenizer for already marked text (see ``marked``)."""
    from tokenizers import Tokenizer, models

    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == UNIGRAM:
        low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0) - 1e4
        table = [(p, s if k in (NORMAL, USER) else low) for p, s, k in m.pieces]
        return _with_user_pieces(m, Tokenizer(models.Unigram(table, unknown, m.byte_fallback)))
    if m.kind != BPE:
        raise ValueError("only unigram and byte-pair models are known")
    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    plain = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
    merges = []
    for p, i in plain.items():
        for c in range(1, len(p)):
            if p[:c] in plain and p[c:] in plain:
                merges.append((-m.pieces[i][1], plain[p[:c]], plain[p[c:]], p[:c], p[c:]))
    merges.sort()
    return _with_user_pieces(m, Tokenizer(models.BPE(vocab, [x[3:] for x in merges], unk_token=m.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=m.byte_fallback)))


def _with_user_pieces(m: Model, tok):
    """User-defined pieces are matched first, longest first, and never split."""
    from tokenizers import AddedToken

    user = [p for p, _, k in m.pieces if k == USER]
    if user:
        tok.add_tokens([AddedToken(p, normalized=False, special=False) for p in user])
    return tok


class Codec:
    """Encode and decode with one model file; ``threads`` bounds the library's threads in this process."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the library first runs in this process
        with open(path, "rb") as f:
            m = self.model = parse_model(f.read())
        if m.suffix_mark or not m.escape_whitespaces:
            raise ValueError("markers at word ends, or none, are not supported")
        self.tok = build_tokenizer(m)
        self.charsmap = None
        if m.charsmap:
            from tokenizers.normalizers import Precompiled

            self.charsmap = Precompiled(m.charsmap)
        usable = [p for p, _, k in m.pieces if k in (NORMAL, USER)]
        inner = any(MARK in p.lstrip(MARK) for p in usable)
        newline = any("\n" in p for p in usable)
        # cutting before a marker run and around newlines is exact if no piece spans such a place, and neither does a run of
        # unknown characters, which are fused into one piece where bytes do not stand in for them
        self.chunk = None if inner or newline or not m.byte_fallback else re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.cache = ChunkCache(self._encode)
        self.raw = [self._piece_bytes(p, k) for p, _, k in m.pieces]
        self.verify(path)

    def verify(self, path: str, probes: int = 400) -> None:
        """Hold texts made of the model's own pieces, and odd ones, against the reference library; a difference raises.

        So does the library's absence: a codec that nothing has been held against is not handed out.
        """
        import sentencepiece

        known = [p.replace(MARK, " ") for p, _, k in self.model.pieces if k in (NORMAL, USER)]
        step = max(1, len(known) // (4 * probes))
        some = known[::step]
        texts = ["".join(some[i : i + 4]) for i in range(0, len(some), 4)] + ["", " ", "  two  blanks ", "line\nbreak\n", "é̂ 日本 \U0001f600 \x07"]
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for text, got in zip(texts, self.encode(texts), strict=True):
            want = sp.encode(text)
            if np.frombuffer(got, "<u4").tolist() != want or self.decode(got) != sp.decode(want):
                raise ValueError(f"parity with the reference library fails on {text!r}")

    @staticmethod
    def _piece_bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def _encode(self, chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), 1 << 14):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(chunks[at : at + (1 << 14)], add_special_tokens=False)]
        return out

    def marked(self, text: str) -> str:
        """The normalised text with markers for spaces."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.model.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.model.add_dummy_prefix else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> Iterable[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        for some in by_size(texts):
            marked = [self.marked(t) for t in some]
            if self.chunk is None:
                yield from self._encode(marked)
            else:
                yield from self.cache.join([self.chunk.findall(t) for t in marked])

    def decode(self, ids: bytes) -> str:
        """The text of an id sequence: markers are spaces, the dummy prefix goes, broken byte runs become U+FFFD."""
        raw = self.raw
        out = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return out[1:] if self.model.add_dummy_prefix and out.startswith(" ") else out


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = 2) -> Codec:
    if (path, threads) not in _codecs:
        _codecs[path, threads] = Codec(path, threads)
    return _codecs[path, threads]


def _map(docs: DataFrame, column: F.Column, keep: list[str], out: str, kind: T.DataType, arrow: pa.DataType, work) -> DataFrame:
    docs, keep = clear_of(docs, keep, [out])
    src = docs.select(*keep, column.alias("__v"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, kind)])
    k, names = len(keep), schema.names

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(work(b.column(k).to_pylist()), arrow)], names=names)

    return src.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, out: str = "ids", threads: int = 2) -> DataFrame:
    """``keep`` columns plus the ids of each text as little-endian unsigned 32-bit binary.  Null counts as empty: no ids.

    Repeated rows are coded alike, an empty table gives an empty result, a kept column named like ``out`` gets an underscore.
    """
    text_col = F.coalesce(F.col(text), F.lit(""))
    return _map(docs, text_col, keep or ["doc_id"], out, T.BinaryType(), pa.binary(), lambda v: list(codec(path, threads).encode(v)))


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None, out: str = "decoded", threads: int = 2) -> DataFrame:
    """``keep`` columns plus the text of each id sequence; null ids give null, else as ``encode``."""
    return _map(rows, F.col(ids), keep or ["doc_id"], out, T.StringType(), pa.string(), lambda v: [None if x is None else codec(path, threads).decode(x) for x in v])
