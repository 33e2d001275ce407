"""A bounded two-generation cache from text chunks to token ids, for tokenizers that never merge across chunks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Chunks kept per generation; at most two generations live, about 200 bytes an entry.
CACHE_CAP = 300_000
#: Characters that ``SpacedBpe`` splits before it looks their chunks up, few enough for these to stay in the processor's cache.
SLICE = 1 << 14


class ChunkCache:
    """``ids(chunks)`` of many documents at once; ``encode`` turns a list of distinct unseen chunks into id bytes.

    A full young generation becomes the old one, and entries that are used again move back, so memory stays bounded
    whatever the vocabulary of the corpus.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], cap: int = CACHE_CAP):
        self.encode, self.cap = encode, cap
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fill(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Ids of the given chunks, none of which is young."""
        got, unseen = {}, []
        for c in set(chunks):
            if (v := self.old.get(c)) is None:
                unseen.append(c)
            else:
                got[c] = v
        if unseen:
            got.update(zip(unseen, self.encode(unseen), strict=True))
        if len(self.young) + len(got) > self.cap:
            self.old, self.young = self.young, {}
        self.young.update(got)
        return got

    def join(self, docs: list[list[str]]) -> list[bytes]:
        """Per document the concatenated ids of its chunks."""
        get = self.young.get
        parts = [list(map(get, d)) for d in docs]
        missing = {c for d, p in zip(docs, parts, strict=True) if None in p for c, v in zip(d, p, strict=True) if v is None}
        if missing:
            got = self.fill(missing)
            for d, p in zip(docs, parts, strict=True):
                if None in p:
                    p[:] = [got[c] if v is None else v for c, v in zip(d, p, strict=True)]
        return [b"".join(p) for p in parts]


def by_size(texts: list, limit: int = 1 << 21) -> Iterable[list]:
    """Consecutive slices of ``texts`` of about ``limit`` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordMerges:
    """Byte-pair merges of single words whose last symbol carries an end mark, run on a byte-pair core.

    The end mark is the byte 0xFF, which no UTF-8 text holds: (x, 0xFF) merges before anything else, and every other
    merge keeps its order.
    """

    END = b"\xff"

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        import tiktoken

        letters = byte_letters()

        def raw(token: str) -> bytes:
            body, end = (token[: -len(suffix)], self.END) if token.endswith(suffix) and token != suffix else (token, b"")
            return bytes(letters[c] for c in body) + end

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + self.END: 256 + b for b in range(256)}
        for m in merges:
            left, right = m if not isinstance(m, str) else m.split(" ")
            joined = raw(left) + raw(right)
            if joined in ranks:
                raise ValueError("two merges make one token")
            ranks[joined] = len(ranks)
        known = {}
        for token, i in vocab.items():
            if all(c in letters for c in token.removesuffix(suffix)):
                known[raw(token)] = i
        #: None: a symbol that the vocabulary lacks; meeting it is an error, never another id
        self.id_bytes = [np.array([known[t]], "<u4").tobytes() if t in known else None for t, _ in sorted(ranks.items(), key=lambda kv: kv[1])]
        self.core = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode(self, word: bytes) -> bytes:
        ids = self.id_bytes
        got = [ids[r] for r in self.core.encode_single_piece(word + self.END)]
        if None in got:
            raise ValueError("the vocabulary lacks a symbol of " + repr(word))
        return b"".join(got)


_BLANK = str.maketrans("\t\n\r\x0b\x0c", "     ")


class SpacedBpe:
    """A lower-casing tokenizer whose pre-tokenizer drops white space and never joins across it: texts are encoded by chunk.

    A Latin-1 text is lower-cased whole, and a full stop or comma that ends a word is set apart (the split pattern does
    that anyway), so that chunks are mostly bare words.  An unseen chunk of plain letters, digits and ASCII punctuation is split by ``pieces``, the
    tokenizer's own split pattern, and its pieces are merged here; any other chunk goes to the tokenizer as it is.
    """

    SAFE = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    ODD = re.compile(r"[.,](?<=(?:[^\w\s]|_)[.,])(?:\s|$)")  # a search for the stop first: few places to look at
    CONTROL = re.compile(r"[\x1c-\x1f]")

    def __init__(self, path: str, pieces: str, cap: int = CACHE_CAP):
        from tokenizers import Tokenizer

        self.tok, self.pieces = Tokenizer.from_file(path), regex.compile(pieces)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merges = WordMerges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.chunks = ChunkCache(self._chunks, cap)

    def _plain(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(chunks, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(chunks)
        plain, merge, safe = [], self.merges.encode, self.SAFE.fullmatch
        for i, c in enumerate(chunks):
            if not safe(c) or "<|" in c:
                plain.append(i)
            elif c.isalpha():
                out[i] = merge(c.lower().encode())
            else:
                out[i] = b"".join([merge(p.encode()) for p in self.pieces.findall(c.lower())])
        if plain:
            for i, v in zip(plain, self._plain([chunks[i] for i in plain]), strict=True):
                out[i] = v
        return out

    def _split(self, t: str) -> list[str]:
        if self.CONTROL.search(t):  # str.split takes these for white space, the tokenizer does not
            return t.translate(_BLANK).split(" ")
        try:
            t.encode("latin-1")
        except UnicodeEncodeError:
            return t.split()
        t = t.lower()
        if not self.ODD.search(t):
            t = t.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n")
        return t.split()

    def encode(self, texts: list[str]) -> Iterable[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order."""
        for some in by_size(texts, SLICE):
            yield from self.chunks.join([self._split(t) for t in some])
