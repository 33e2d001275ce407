"""Reproducible shuffling into shards by a Feistel permutation over global row numbers (DataFrame functions only).

A row's number is its rank in the order of (id, size, content checksum).  The permutation is a Feistel network over the
rectangle a x b that just covers the row count, with cycle walking back into range; position p then means shard
``p % shards`` and slot ``p // shards``, so shard sizes differ by one at most, and the place of any row is computable
from its number alone.  Texts are read once; only (id, size, checksum) are sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 6
SEED = 20_24
#: Fixed odd multipliers of the round function.
MULTIPLIERS = (1_103_515_245, 1_812_433_253, 1_566_083_941, 1_540_483_477, 1_664_525, 22_695_477)
_M31 = (1 << 31) - 1


def _mix(x: Column, i: Column, seed: int) -> Column:
    """Round function on a value below 2^31: two multiply-xorshift steps modulo 2^31."""
    mult = F.array(*(F.lit(m).cast("long") for m in MULTIPLIERS))
    m31 = F.lit(_M31).cast("long")
    k = (i * F.lit(104_729).cast("long") + F.lit(seed * 7919 + 12_345)).bitwiseAND(m31)
    t = ((x + k).bitwiseAND(m31) * F.element_at(mult, (i + 1).cast("int"))).bitwiseAND(m31)
    t = t.bitwiseXOR(F.shiftright(t, 15))
    t = (t * F.element_at(mult, ((i + 3) % ROUNDS + 1).cast("int"))).bitwiseAND(m31)
    return t.bitwiseXOR(F.shiftright(t, 13))


def sides(n: int) -> tuple[int, int]:
    """a and b with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int = SEED, passes: int = 1) -> Column:
    """Feistel passes over a permutation of 0 .. a * b - 1; of several passes, the first that ends below ``n`` counts.

    A state is (l, r) with l < a and r < b; rounds alternate l = (l + F(r)) mod a and r = (r + F(l)) mod b.
    """
    a, b = (F.lit(v).cast("long") for v in sides(n))
    n = F.lit(n).cast("long")

    def body(s: Column, k: Column) -> Column:
        i = k % ROUNDS
        ended = s["done"] | ((i == 0) & (k > 0) & (s["l"] * b + s["r"] < n))
        left = F.when(~ended & (i % 2 == 0), (s["l"] + _mix(s["r"], i, seed)) % a).otherwise(s["l"])
        right = F.when(~ended & (i % 2 == 1), (s["r"] + _mix(s["l"], i, seed)) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"), ended.alias("done"))

    state = F.struct(F.call_function("div", x, b).alias("l"), (x % b).cast("long").alias("r"), F.lit(False).alias("done"))
    rounds = F.sequence(F.lit(0).cast("long"), F.lit(passes * ROUNDS - 1).cast("long"))
    return F.aggregate(rounds, state, body, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """Position of row number ``x`` among ``n``: Feistel passes until the value is below ``n`` (cycle walking).

    Fewer than a of the a * b points lie outside, about one in sqrt(n), so walks are short and only their rows pay for
    them: a walk never visits a point twice, so 64 passes cover every walk for n up to 4,096 and all but 1 in 10^115
    beyond.  A walk that were still outside then raises an error.
    """
    if n <= 1:
        return F.lit(0).cast("long")
    a, b = sides(n)
    first = feistel(x, n, seed)
    if a * b == n:
        return first
    stuck = F.raise_error(F.lit("cycle walk did not end")).cast("long")
    walked = feistel(x, n, seed, passes=65)
    return F.when(first < n, first).when(walked < n, walked).otherwise(stuck)


def number_rows(keys: DataFrame, order: list[str], out: str = "row_number") -> DataFrame:
    """``keys`` plus its global 0-based row number in ``order``.

    The table is range-sorted and checkpointed, so partition numbers and places in them stay fixed; partition sizes (one
    row a partition) are summed up and joined back.  No window runs over the whole table.
    """
    spark = keys.sparkSession
    placed = cut(keys.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__local", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n")).collect()  # one row a partition
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["__part"]):
        before[r["__part"]] = at
        at += r["__n"]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "__part long, __before long")
    return placed.join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + F.col("__local")).drop("__at", "__part", "__local", "__before")


def shard_rows(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, row_number, position, shard, slot``.

    size is the UTF-8 length plus 1; a null text has size 1 and the checksum of no bytes.  Null ids sort first; repeated
    rows get numbers of their own.  An empty table gives an empty result; extra columns are not read.
    """
    text_col = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keys = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(text_col) + 1).cast("long").alias("size"), F.crc32(text_col).alias("text_crc32"))
    numbered = cut(number_rows(keys, ["doc_id", "size", "text_crc32"]))
    n = numbered.count()
    placed = numbered.withColumn("position", permute(F.col("row_number"), n, seed))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.call_function("div", F.col("position"), F.lit(shards).cast("long")))


def place_of(row_number: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, in plain arithmetic (what ``shard_rows`` computes for it)."""
    if n <= 1:
        return 0, 0
    a, b = sides(n)

    def f(x: int, r: int) -> int:
        t = ((x + ((seed * 7919 + r * 104_729 + 12_345) & _M31)) & _M31) * MULTIPLIERS[r % 6] & _M31
        t ^= t >> 15
        t = t * MULTIPLIERS[(r + 3) % 6] & _M31
        return t ^ t >> 13

    p = row_number
    while True:
        left, right = divmod(p, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + f(left, i)) % b
            else:
                left = (left + f(right, i)) % a
        p = left * b + right
        if p < n:
            return p % shards, p // shards


def oracle(table: str = "documents", shards: int = 8, seed: int = SEED) -> str:
    """The sharding query in DuckDB SQL: checksum by a table built from its rule, Feistel rounds, cycle walking by recursion."""
    crc_table = "(SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || list_transform(range(8), lambda k: k), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"
    crc = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])))"
    step = "SELECT w.rn, w.it, n, a, b, w.p // b AS l, w.p % b AS r FROM walk w, size WHERE w.it = 0 OR w.p >= n"
    for i in range(ROUNDS):
        k = i * 104_729 + seed * 7919 + 12_345
        x, size = ("l", "b") if i % 2 else ("r", "a")
        step = f"SELECT *, (((({x} + {k}) & {_M31}) * {MULTIPLIERS[i]}) & {_M31}) AS t FROM ({step})"
        step = f"SELECT * EXCLUDE t, ((xor(t, t >> 15) * {MULTIPLIERS[(i + 3) % ROUNDS]}) & {_M31}) AS t FROM ({step})"
        new = {"l": "l", "r": "r"} | {("r" if i % 2 else "l"): f"({'r' if i % 2 else 'l'} + xor(t, t >> 13)) % {size}"}
        step = f"SELECT rn, it, n, a, b, {new['l']} AS l, {new['r']} AS r FROM ({step})"
    return f"""
WITH RECURSIVE hexed AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM {table}),
keyed AS (SELECT doc_id, size::BIGINT AS size, {crc}::BIGINT AS text_crc32 FROM hexed, {crc_table}),
base AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS rn FROM keyed),
size AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT count(*) AS n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS a FROM base)),
walk AS (SELECT rn, rn AS p, 0 AS it FROM base UNION ALL SELECT rn, l * b + r, it + 1 FROM ({step}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, (p // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, rn::BIGINT AS row_number
FROM base JOIN (SELECT rn, arg_max(p, it) AS p FROM walk GROUP BY rn) USING (rn)
"""
