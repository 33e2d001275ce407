"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins; cyclic boosting visits the features in turn and adds a small step of a shallow
regression tree over the feature's bins to that feature's lookup table.  The pairs with the largest residual gain then get
two-dimensional tables, boosted in the same way.  A score is a sum of table entries, so scoring is vectorised binning and
addition.  Training runs on the driver, on at most ``MAX_TRAIN`` labelled rows chosen by a hash of their ids.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of, crc_bucket, text_bytes

MAX_TRAIN = 20_000
FOLDS = 5
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "symbol_share", "bang_share", "upper_share", "digit_share", "wide_share", "distinct_words",
    "adjacent_repeats", "stops_per_word", "line_words", "ended_lines", "repeated_lines", "squeeze", "longest_word",
)
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"
_WIDE = bytes(range(128, 256))


def features(text: bytes, squeeze: zstandard.ZstdCompressor) -> list[float]:
    """Measures of one text; an empty text has zeros throughout."""
    n = len(text)
    w = text.split()
    if not w:
        return [0.0] * len(FEATURES)
    share = lambda chars: (n - len(text.translate(None, chars))) / n
    lines = [x for x in map(bytes.rstrip, text.split(b"\n")) if x]
    return [
        float(np.log1p(len(w))), sum(map(len, w)) / len(w), share(_SYMBOLS), text.count(b"!") / n, share(_UPPER), share(_DIGITS),
        share(_WIDE), len(set(w)) / len(w), sum(map(eq, w, w[1:])) / len(w), (text.count(b".") + text.count(b",")) / len(w),
        len(w) / len(lines), sum(x[-1] in b".!?" for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
        len(squeeze.compress(text)) / n, float(max(map(len, w))),
    ]


def add_features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus one array column ``x`` of features."""
    src = docs.select(*keep, text_bytes(text).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))])
    k, names = len(keep), schema.names

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            x = [features(t.as_py(), c) for t in b.column(k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(x, pa.list_(pa.float64()))], names=names)

    return src.mapInArrow(run, schema)


@dataclass
class Gam:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    u = np.unique(x)
    if len(u) > bins:
        u = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)))
    return (u[1:] + u[:-1]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values over ordered bins: the best splits one after another, ``leaves`` parts at most."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-12, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            ok = (ch[at] - ch[a] >= least) & (ch[b] - ch[at] >= least)
            if ok.any():
                v = np.where(ok, gain(a, at) + gain(at, b) - gain(a, b), -1)
                i = int(v.argmax())
                if v[i] > best[0]:
                    best = (v[i], k, int(at[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Best cross of one cut on each axis over a two-dimensional histogram: (gain, leaf values)."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    score = lambda a, b: a * a / (b + ridge)
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = lambda c, t: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], t - c[i, -1] - c[-1, j] + c[i, j])
    total = sum(score(a, b) for a, b in zip(parts(cg, tg), parts(ch, th), strict=True)) - score(tg, th)
    if not total.size:
        return 0.0, np.zeros_like(g)
    at = np.unravel_index(total.argmax(), total.shape)
    a, b = int(i[at]), int(j[at])
    out = np.empty_like(g)
    for rows in (slice(0, a), slice(a, None)):
        for cols in (slice(0, b), slice(b, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(total[at]), out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, n_pairs: int = 6, ridge: float = 1.0, least: float = 2.0) -> Gam:
    """Fit by cyclic boosting of the logistic loss.  Without rows the score is 0.5; with one class it is the smoothed base rate."""
    if not len(y):
        return Gam(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES))
    p = (y.sum() + 1) / (len(y) + 2)
    d = x.shape[1]
    edges = [_cuts(x[:, j], bins) for j in range(d)]
    binned = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    model = Gam(float(np.log(p / (1 - p))), edges, [np.zeros(len(e) + 1) for e in edges])
    if y.min() == y.max():
        return model
    f = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        return q - y, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            n = len(edges[j]) + 1
            step = rate * _tree(np.bincount(binned[j], g, n), np.bincount(binned[j], h, n), 3, ridge, least)
            model.tables[j] += step
            f += step[binned[j]]
    model.coarse = [_cuts(x[:, j], 8) for j in range(d)]
    small = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    shape = lambda i, j: (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)

    def histogram(i: int, j: int, v: np.ndarray) -> np.ndarray:
        s = shape(i, j)
        return np.bincount(small[i] * s[1] + small[j], v, s[0] * s[1]).reshape(s)

    g, h = slopes()
    gains = {(i, j): _quadrants(histogram(i, j, g), histogram(i, j, h), ridge)[0] for i, j in combinations(range(d), 2)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    model.pair_tables = [np.zeros(shape(*k)) for k in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = rate * _quadrants(histogram(i, j, g), histogram(i, j, h), ridge)[1]
            table += step
            f += step[small[i], small[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", max_train: int = MAX_TRAIN) -> Gam:
    """Train on labelled documents outside the held-out fold (crc32 of the id, modulo 5, is 0).

    At most ``max_train`` rows are used, those with the smallest id hashes; only they cross to the driver, as features.
    An id with several labels counts as 1 if at least half of them are; of an id's texts the one with the smallest hash
    counts.  Null labels and ids are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", FOLDS) != 0))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    n = known.count()
    span = 1 << 20
    part = min(span, int(span * 0.97 * max_train / max(1, n)))
    known = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(span)) < part)
    # one text an id, and no more than max_train of them, before anything crosses to the driver
    some = docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")).alias("one")).join(F.broadcast(known), "doc_id")
    place = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(span)).alias("__place")
    some = some.groupBy("doc_id").agg(F.min_by("one.text", "one.hash").alias("__one"), F.first("__y").alias("__y"))
    some = add_features(some.select("doc_id", "__one", "__y", place), ["__place", "doc_id", "__y"], "__one")
    rows = some.orderBy("__place", "doc_id").limit(max_train).toPandas()
    if rows.empty:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    return train(np.stack(rows["x"].to_numpy()), rows["__y"].to_numpy(float))


def score(docs: DataFrame, model: Gam, keep: list[str] | None = None, text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns plus the score of each row as column ``out``.  A null or empty text is scored on zero features; repeated rows alike.

    An empty table gives an empty result; a kept column named like ``out`` gets an underscore.
    """
    docs, keep = clear_of(docs, keep or ["doc_id"], [out])
    src = docs.select(*keep, text_bytes(text).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField(out, T.DoubleType())])
    k, names = len(keep), schema.names

    def run(batches):
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            x = np.array([features(t.as_py(), c) for t in b.column(k)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(model.scores(x))], names=names)

    return src.mapInArrow(run, schema)
