"""URL verdicts from rules and from trust that flows over the host link graph.

Rules are matched on host and path.  For urls that no rule fits, the host decides: personalised PageRank carries trust
from hosts with mostly allowed pages along their links, and distrust from mostly blocked hosts against the links (whoever
links to a blocked host is suspect).  A host whose distrust share reaches the threshold is blocked; a host without
evidence is allowed.  Edges are counted per host pair before anything is joined, and ranks stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, cut, drop, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#\s>]+)"""
DAMPING = 0.85
SETTLED = 1e-7
#: More rounds than any graph needs at this damping: 0.85 ** 400 is 6e-29.  Reaching them is an error.
ROUNDS = 400
#: Rounds after which the ranks are compared with the last ones.
STRIDE = 6
BLOCK_SHARE = 0.5

Rules = list[tuple[str, str]]


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    c = F.col(url) if isinstance(url, str) else url
    return F.translate(F.regexp_extract(F.coalesce(c, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    c = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(c, F.lit("")), PARTS, 2)


def match_rules(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; a rule is ``host/path`` and fits subdomains too."""
    rule = verdict = F.lit(None).cast("string")
    for what, pattern in sorted(rules, key=lambda r: len(r[1])):
        cutoff = pattern.index("/")
        name, start = pattern[:cutoff], pattern[cutoff:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(pattern)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(src, dst, n)``: pages of host src that link to another host dst, counted."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER)))).alias("dst"))
    return links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """Personalised PageRank: ``(host, rank)`` from ``seeds`` (``host, weight``; weights are normalised) over ``src -> dst``.

    rank = (1 - damping) * seed + damping * sum of the ranks of linking hosts, each split over its links by count; a host
    without links passes nothing on.  Goes on until a round changes the ranks by less than ``settled`` in sum, and raises if ``rounds``
    do not reach that; with ``settled`` 0 it makes just these rounds.
    """
    total = seeds.agg(F.sum("weight")).first()[0] or 0.0
    start = cut(seeds.where("weight > 0").select("host", (F.col("weight") / F.lit(total or 1.0) * (1 - damping)).alias("seed")))
    rank = start.select("host", F.col("seed").alias("rank"))
    if edges.isEmpty() or not total:
        return rank
    # sums are materialised before they are joined, so that both sides are plain shuffles and a hub can be split
    out = cut(edges.groupBy("src").agg(F.sum("n").alias("all")))
    share = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("part")))

    def after(r: DataFrame) -> DataFrame:
        flow = share.join(r.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.col("part") * F.col("rank") * damping).alias("v"))
        return flow.unionByName(start.select("host", F.col("seed").alias("v"))).groupBy("host").agg(F.sum("v").alias("rank"))

    # every round's ranks are materialised: the next join then has plain shuffles on both sides, and a hub's links can be split
    rank = cut(rank)
    for done in range(1, rounds + 1):
        was, rank = rank, cut(after(rank))
        if settled and (done % STRIDE == 0 or done == rounds):
            change = rank.join(was.withColumnRenamed("rank", "was"), "host", "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0]
            if change < settled:
                drop(was)
                return rank
        drop(was)
    if settled:
        raise RuntimeError("ranks did not settle")
    return rank


def judge_urls(pages: DataFrame, rules: Rules, url: str = "url", html: str = "html", keep: list[str] | None = None, share: float = BLOCK_SHARE, damping: float = DAMPING) -> DataFrame:
    """``keep`` columns plus ``host, path, rule, verdict, trust, distrust`` of every page.

    Null urls have empty host and path and are allowed; null html has no links; repeated pages are judged alike and count
    each as a seed.  An empty table gives an empty result; a kept column that is named like a new one gets an underscore.
    """
    pages, keep = clear_of(pages, keep or ["page_id"], ["host", "path", "rule", "verdict", "trust", "distrust"])
    host, path = host_of(url), path_of(url)
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    base = pages.select(*[F.col(c) for c in keep], host.alias("host"), path.alias("path"), F.col(html).alias("__html"))
    ruled = base.withColumn("rule", rule).withColumn("__verdict", verdict)
    good, bad = (F.count_if(F.coalesce(F.col("__verdict") == v, F.lit(False))).cast("double") for v in ("allow", "block"))
    counted = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), good.alias("good"), bad.alias("bad")).where("good + bad > 0")
    with scratch() as s:
        # a host is a blocked seed if rules block most of its pages, a trusted one if they allow more than they block
        seeds = cut(counted.select("host", F.when(F.col("good") > F.col("bad"), F.col("good")).otherwise(0.0).alias("good"), F.when(2 * F.col("bad") >= F.col("n"), F.col("bad")).otherwise(0.0).alias("bad")))
        edges = cut(host_edges(base, "__html"))
        trust = propagate(seeds.select("host", F.col("good").alias("weight")), edges, damping).withColumnRenamed("rank", "trust")
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
        distrust = propagate(seeds.select("host", F.col("bad").alias("weight")), back, damping).withColumnRenamed("rank", "distrust")
        hosts = trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
        hosts = s.keep(cut(hosts.withColumn("__bad", (F.col("distrust") > 0) & (F.col("distrust") >= share * (F.col("trust") + F.col("distrust"))))))
    joined = ruled.drop("__html").join(hosts, "host", "left")
    own = F.when(F.coalesce("__bad", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    zero = F.lit(0.0)
    return joined.select(*keep, "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))


def oracle(rules: Rules, table: str = "pages", share: float = BLOCK_SHARE, damping: float = DAMPING, rounds: int = 120) -> str:
    """The URL query in DuckDB SQL, ranks rounded to five decimals after ``rounds`` rounds
    (0.85 ** 120 is 3e-9); a node ``*`` that links to all seeds restarts the walk."""
    host = f"translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}')"
    fits = []
    for what, pattern in sorted(rules, key=lambda r: -len(r[1])):
        cutoff = pattern.index("/")
        name, start = pattern[:cutoff], pattern[cutoff:]
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')", pattern, what))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{p}'" for c, p, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    link = LINK.replace("'", "''")

    def walk(name: str, seed: str, src: str, dst: str) -> str:
        return f"""{name}_seed AS (SELECT host, {seed} / (SELECT sum({seed}) FROM seeds) * {1 - damping} AS s FROM seeds WHERE {seed} > 0),
{name}_part AS (SELECT {src} AS src, {dst} AS dst, n / sum(n) OVER (PARTITION BY {src}) AS part FROM edges
  UNION ALL SELECT '*', host, s / {damping} FROM {name}_seed UNION ALL SELECT '*', '*', 1 / {damping}),
{name} AS (SELECT 0 AS it, host, s AS v FROM {name}_seed UNION ALL SELECT 0, '*', 1.0::DOUBLE
  UNION ALL SELECT it + 1, dst, sum(part * v * {damping}) FROM {name} JOIN {name}_part ON src = host WHERE it < {rounds} GROUP BY it, dst)"""

    return f"""
WITH RECURSIVE p AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path, html FROM {table}),
ruled AS (SELECT *, {rule} AS rule, {verdict} AS said FROM p),
counted AS (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM ruled WHERE host <> '' GROUP BY host),
seeds AS (SELECT host, CASE WHEN good > bad THEN good ELSE 0 END::DOUBLE AS good, CASE WHEN 2 * bad >= n THEN bad ELSE 0 END::DOUBLE AS bad FROM counted WHERE good + bad > 0),
edges AS (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{link}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS dst FROM p WHERE host <> '') WHERE src <> dst GROUP BY src, dst),
{walk('good_rank', 'good', 'src', 'dst')},
{walk('bad_rank', 'bad', 'dst', 'src')},
ranks AS (SELECT coalesce(g.host, b.host) AS host, coalesce(g.v, 0) AS trust, coalesce(b.v, 0) AS distrust
  FROM (SELECT host, v FROM good_rank WHERE it = {rounds}) g FULL JOIN (SELECT host, v FROM bad_rank WHERE it = {rounds}) b ON g.host = b.host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust > 0 AND distrust >= {share} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
 round(coalesce(trust, 0), 5) AS trust, round(coalesce(distrust, 0), 5) AS distrust FROM ruled LEFT JOIN ranks USING (host)
"""
