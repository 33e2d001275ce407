"""Token counts by field and section: whole documents are encoded once and tokens are attributed by their spans.

A document is rendered from its fields, encoded as a whole (so that no token depends on where a section was cut), and the
sorted token spans are joined with the sorted section spans by binary search.  A token that crosses a boundary is
allocated by an explicit rule.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of

#: first: the section of a token's first byte; last: of its last byte; most: of most of its bytes (ties: the earlier one).
RULES = ("first", "last", "most")
#: The split pattern of the byte-level vocabulary (a fixed value of that tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict = {}


def byte_encoder(path: str, pattern: str = PATTERN):
    """(encode, byte length of each id) of a byte-level vocabulary file with one base64 token and rank a line."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _encoders[path] = enc.encode_ordinary, size
    return _encoders[path]


def attribute(starts: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section; sections are given by their starts and cover everything."""
    a = np.searchsorted(section_starts, starts, "right") - 1
    b = np.searchsorted(section_starts, ends - 1, "right") - 1
    n = len(section_starts)
    if rule == "first":
        owner = a
    elif rule == "last":
        owner = b
    elif rule == "most":
        owner = a.copy()
        edge = np.append(section_starts, ends[-1] if len(ends) else 0)
        for i in np.flatnonzero(a != b):
            parts = [min(ends[i], edge[s + 1]) - max(starts[i], edge[s]) for s in range(a[i], b[i] + 1)]
            owner[i] = a[i] + int(np.argmax(parts))
    else:
        raise ValueError(f"unknown rule {rule}")
    return np.bincount(owner, minlength=n), np.bincount(owner[a != b], minlength=n)


def section_counts(docs: DataFrame, vocabulary: str, fields: list[str], body: str = "text", keep: list[str] | None = None, rule: str = "first", pattern: str = PATTERN) -> DataFrame:
    """One row per section: ``keep`` columns plus ``field, section, char_start, char_end, n_tokens, n_crossing``.

    A document is its ``fields`` and then its ``body``, each ended by a newline (the body is not); every field is a section
    and so is every line of the body with its newline.  Null fields count as empty.  A section that is empty (as of an empty body) still has a row.
    Repeated rows are counted each, an empty table gives an empty result, a kept column named like a new one gets an underscore.
    Counts of a document's sections sum to the tokens of the whole document.  Character offsets are in code points.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    docs, keep = clear_of(docs, keep or ["doc_id"], ["field", "section", "char_start", "char_end", "n_tokens", "n_crossing"])
    whole = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{i}") for i, c in enumerate([*fields, body])]
    src = docs.select(*keep, *whole)
    own = (("field", T.StringType()), ("section", T.IntegerType()), ("char_start", T.LongType()), ("char_end", T.LongType()), ("n_tokens", T.LongType()), ("n_crossing", T.LongType()))
    schema = T.StructType([*src.schema.fields[: len(keep)], *(T.StructField(n, t) for n, t in own)])
    k, names = len(keep), schema.names

    def run(batches):
        encode, size = byte_encoder(vocabulary, pattern)
        label = np.array([*fields, body], object)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                row, cols = [], [[], [], [], [], [], []]
                for i, parts in enumerate(zip(*(c.to_pylist() for c in b.columns[k:]), strict=True)):
                    text = "".join(p + "\n" for p in parts[:-1]) + parts[-1]
                    raw = text.encode()
                    buf = np.frombuffer(raw, np.uint8)
                    lens = [len(p.encode()) + 1 for p in parts[:-1]]
                    head = np.cumsum([0, *lens])
                    lines = head[-1] + 1 + np.flatnonzero(buf[head[-1] :] == 10)
                    starts = np.concatenate([head, lines])
                    ends = np.cumsum(size[np.array(encode(text), np.int64)]) if raw else np.zeros(0, np.int64)
                    n, crossing = attribute(np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends, starts, rule)
                    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                    row.append(np.full(len(starts), i))
                    edge = chars[np.append(starts, len(raw))]
                    section = np.maximum(np.arange(len(starts)) - len(fields), 0)
                    for c, v in zip(cols, (label[np.minimum(np.arange(len(starts)), len(fields))], section, edge[:-1], edge[1:], n, crossing), strict=True):
                        c.append(v)
                if row:
                    take = pa.array(np.concatenate(row))
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:k]), *(pa.array(np.concatenate(c), t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return src.mapInArrow(run, schema)
