"""URL filters, native: prefix rules first, then trust and distrust propagated over host edges.

Host edges come from the pages' links (absolute and scheme-relative targets; a relative link is an edge
to the page's own host) and from the name hierarchy (a host and the domain it belongs to, both ways),
counted per pair before anything else moves. Trust is the personalised PageRank whose restart weights are
the hosts' pages that a rule allows; distrust is the same walk over reversed edges from the pages that a
rule blocks. A host is blocked where its distrust is more than ``ratio`` times its trust, by more than the
relative ``margin`` that rounding could explain.

Both ranks move in one pass per round. What a host would send itself is solved for at once (the rest is
divided by 1 minus it), so hosts whose links are mostly their own settle in a few rounds. Hosts without
out-edges send what they hold back to the seeds (by way of one more place, ``BACK``), so a walk's ranks add up to 1.
After ``every`` rounds the ranks are replaced by that mean of the rounds' ranks, weights adding up to 1, whose
residual is least (reduced rank extrapolation, from the products of the rounds' changes, a few sums per walk); if that ever
makes the residual larger, plain rounds go on alone. The walk ends when the changes of a round add up to ``tolerance`` at most, which
leaves damping / (1 - damping) times that; if that isn't reached in ``rounds`` rounds, the walk fails.

A round is one join and one aggregation: a place's own columns travel along an edge to itself. The state is written every
``every`` rounds, so a lost executor costs its tasks only. Edges are one row per pair of hosts; a page-rich host is one row.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed;
repeated rows are judged each; null html has no links; an empty table gives no rows; other columns aren't
read. Host and path are compared as they stand (only A-Z of the host is lower-cased).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, quoted
from .graph import Unsettled

#: Verdict and host-and-path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Params:
    rules: tuple = RULES
    damping: float = 0.85
    #: Sum of a round's changes that ends the walk, the rounds in which it must, and those between two tests.
    tolerance: float = 1e-9
    rounds: int = 480
    every: int = 8
    ratio: float = 1.0
    #: Relative distance of the two sides that is no tie.
    margin: float = 1e-6
    #: Weight of a name edge, in links.
    name_weight: float = 1.0
    #: Rows of host verdicts that may be broadcast.
    broadcast_hosts: int = 200_000
    salts: int = 64


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    # up to the first of / ? # behind the first ://
    return F.when(F.instr(url, "://") > 0, _lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_columns(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # later, longer ones win
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html: str, host: str, p: Params) -> DataFrame:
    """``src, dst, weight``: one row for each pair of hosts."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    target = lambda x: F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(x)).when(x.startswith("//"), host_of(F.concat(F.lit("x:"), x))).when(~x.rlike("^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(""))
    linked = pages.filter(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.transform(links, target)).alias("dst")).filter("dst IS NOT NULL")
    linked = linked.select("src", F.when(F.col("dst") == "", F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return linked.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def name_edges(hosts: DataFrame, p: Params) -> DataFrame:
    """Edges between a host, its parent domain and so on up to a domain of two labels."""
    parts = F.split("host", r"\.")
    chain = hosts.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))).alias("c")).distinct()
    up = chain.select(F.col("c").alias("src"), F.expr("substring(c, instr(c, '.') + 1)").alias("dst")).filter("instr(dst, '.') > 0 AND src <> dst")
    both = up.union(up.select("dst", "src"))
    return both.withColumn("weight", F.lit(p.name_weight))


#: What hosts without out-edges hold passes through here; no host has a blank.
BACK = " "


def _shares(edges: DataFrame) -> DataFrame:
    """``walk, src, dst, share`` in both directions."""
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), "dst", "src", "weight"))
    out = both.groupBy("walk", "src").agg(F.sum("weight").alias("total"))
    return both.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def walk(edges: DataFrame, seeds: DataFrame, p: Params, stash: Stash) -> DataFrame:
    """Personalised PageRanks ``walk, host, rank`` of edges (walk, src, dst, share) from seeds (walk, host, seed).

    Shares of a source add up to 1, and seeds of a walk do.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hosts = edges.select("walk", F.col("src").alias("host"), F.lit(True).alias("sends")).union(edges.select("walk", "dst", F.lit(False))).union(seeds.select("walk", "host", F.lit(False)))
    hosts = stash.put(hosts.groupBy("walk", "host").agg(F.max("sends").alias("sends")))
    kept = edges.filter("src = dst").select("walk", F.col("src").alias("host"), F.col("share").alias("kept"))
    places = hosts.join(kept, ["walk", "host"], "left").join(seeds, ["walk", "host"], "left").select("walk", "host", F.lit(p.damping).alias("damped"), zero("kept").alias("kept"), zero("seed").alias("seed"))
    # a round late, but the ranks at rest are the same: the mass moves on undamped and is damped where it arrives
    places = stash.put(places.union(places.select("walk").distinct().select("walk", F.lit(BACK), F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    away = edges.filter("src <> dst").select("walk", "src", "dst", "share")
    away = away.union(hosts.filter("NOT sends").select("walk", "host", F.lit(BACK), F.lit(1.0))).union(seeds.select("walk", F.lit(BACK), "host", "seed"))
    away = away.union(places.select("walk", "host", "host", F.lit(None).cast("double")))  # the edges to itself
    away = stash.put(away.withColumnRenamed("src", "host"))
    state = places.withColumn("x0", F.col("seed"))
    steps, plain, last = range(p.every), False, None
    for _ in range(0, p.rounds, p.every):
        for i in steps:
            held = ["damped", "kept", "seed", *[f"x{j}" for j in range(i + 1)]]
            got = state.join(away, ["walk", "host"]).groupBy("walk", F.col("dst").alias("host")).agg(
                F.sum(F.col(f"x{i}") * F.col("share")).alias("got"), *[F.max(F.when(F.col("share").isNull(), F.col(c))).alias(c) for c in held]
            )
            new = (F.col("seed") * (1 - p.damping) + F.col("damped") * zero("got")) / (1 - F.col("damped") * F.col("kept"))
            state = got.select("walk", "host", *held, new.alias(f"x{i + 1}"))
        state = stash.put(state)
        change = [F.col(f"x{i + 1}") - F.col(f"x{i}") for i in steps]
        sums = state.groupBy("walk").agg(F.sum(F.abs(change[-1])).alias("moved"), *[F.sum(change[i] * change[j]).alias(f"g{i}_{j}") for i in steps for j in range(i + 1)]).collect()  # a row per walk
        if all(r["moved"] <= p.tolerance for r in sums):
            return state.filter(F.col("host") != BACK).select("walk", "host", F.col(f"x{p.every}").alias("rank"))
        plain = plain or last is not None and any(r["g0_0"] > last[r["walk"]] for r in sums if r["moved"] > p.tolerance)
        last = {r["walk"]: r[f"g{p.every - 1}_{p.every - 1}"] for r in sums}
        start = F.col(f"x{p.every}")
        for r in sums:
            if not plain and r["moved"] > p.tolerance:
                weights = _weights([[r[f"g{max(i, j)}_{min(i, j)}"] for j in steps] for i in steps])
                mean = weights[0] * F.col("x1")
                for i in steps[1:]:
                    mean = mean + weights[i] * F.col(f"x{i + 1}")
                start = F.when(F.col("walk") == r["walk"], mean).otherwise(start)
        state = state.select("walk", "host", "damped", "kept", "seed", start.alias("x0"))
    raise Unsettled(f"ranks still move by {max(r['moved'] for r in sums)} after {p.rounds} rounds")


def _weights(products: list[list[float]]) -> list[float]:
    """Weights, adding up to 1, of the mean of vectors that is shortest, from the vectors' products."""
    n, scale = len(products), max(products[i][i] for i in range(len(products)))
    rows = [[products[i][j] / scale + (1e-13 if i == j else 0.0) for j in range(n)] + [1.0] for i in range(n)]
    for i in range(n):  # elimination with pivots
        best = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for r in range(n):
            if r != i and rows[i][i]:
                f = rows[r][i] / rows[i][i]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[i])]
    out = [row[n] / row[i] if row[i] else 0.0 for i, row in enumerate(rows)]
    total = sum(out)
    return [x / total for x in out] if total else [0.0] * (n - 1) + [1.0]


def host_scores(hosts: DataFrame, edges: DataFrame, p: Params, stash: Stash) -> DataFrame:
    """``host, trust, distrust`` from ``hosts`` (host, allowed, blocked: numbers of pages) and ``edges``."""
    total = hosts.agg(F.sum("allowed"), F.sum("blocked")).first()
    seeds = None
    for name, column, n in (("trust", "allowed", total[0]), ("distrust", "blocked", total[1])):
        part = hosts.filter(F.col(column) > 0).select(F.lit(name).alias("walk"), "host", (F.col(column) / F.lit(float(n or 1))).alias("seed"))
        seeds = part if seeds is None else seeds.union(part)
    seeded = [name for name, n in (("trust", total[0]), ("distrust", total[1])) if n]  # a walk without seeds has no ranks
    shares = stash.put(_shares(edges).filter(F.col("walk").isin(*seeded) if seeded else F.lit(False)))
    ranks = walk(shares, stash.put(seeds), p, stash)
    of = lambda name: F.coalesce(F.sum(F.when(F.col("walk") == name, F.col("rank"))), F.lit(0.0)).alias(name)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", p: Params | None = None) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``."""
    p = p or Params()
    stash = Stash(pages.sparkSession)
    u = F.col(quoted(url)).cast("string")
    parsed = pages.select(F.col(quoted(id_col)).alias("id"), F.coalesce(host_of(u), F.lit("")).alias("host"), F.coalesce(path_of(u), F.lit("")).alias("path"), F.col(quoted(html)).alias("html"))
    rule, said = rule_columns(F.col("host"), F.col("path"), p.rules)
    judged = stash.put(parsed.select("id", "host", "path", rule.alias("rule"), said.alias("said")))
    hosts = stash.put(judged.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")))
    edges = host_edges(parsed, "html", "host", p).union(name_edges(hosts.select("host"), p))
    edges = stash.put(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    scores = stash.put(host_scores(hosts, edges, p, stash))
    if scores.count() <= p.broadcast_hosts:
        joined = judged.join(F.broadcast(scores), "host", "left")
    else:  # a hot host's pages are spread over all salts
        laid = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))))
        joined = judged.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(p.salts)).cast("int")).join(laid, ["host", "salt"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("said", F.when(distrust > trust * (p.ratio * (1 + p.margin)), "block").otherwise("allow"))
    return joined.select("id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``."""
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


#: Rounds of the SQL, a plain power iteration: damping to this power is far below the margin.
SQL_ROUNDS = 130


def _walk_sql(p: Params) -> str:
    """Both walks, one recursion: each round sends all ranks along all edges, hosts that keep theirs to the seeds."""
    d = f"CAST({p.damping} AS DOUBLE)"
    sides = {"trust": ("allowed", "src", "dst"), "distrust": ("blocked", "dst", "src")}
    seeds = " UNION ALL ".join(f"SELECT '{w}' AS walk, host, CAST({n} AS DOUBLE) / (SELECT sum({n}) FROM hosts) AS seed FROM hosts WHERE {n} > 0" for w, (n, _, _) in sides.items())
    shares = " UNION ALL ".join(f"SELECT '{w}' AS walk, {s} AS src, {t} AS dst, weight / sum(weight) OVER (PARTITION BY {s}) AS share FROM edges" for w, (_, s, t) in sides.items())
    return f"""seeds AS MATERIALIZED ({seeds}),
shares AS MATERIALIZED ({shares}),
ends AS MATERIALIZED (SELECT walk, host FROM (SELECT walk, dst AS host FROM shares UNION SELECT walk, host FROM seeds) EXCEPT SELECT walk, src FROM shares),
ranks AS (SELECT 0 AS i, walk, host, seed AS rank FROM seeds UNION ALL
  SELECT i, walk, host, sum(part) AS rank FROM (
    SELECT r.i + 1 AS i, r.walk, s.dst AS host, {d} * r.rank * s.share AS part FROM ranks r JOIN shares s ON r.walk = s.walk AND r.host = s.src WHERE r.i < {SQL_ROUNDS}
    UNION ALL SELECT r.i + 1, s.walk, s.host, s.seed * (1 - {d} + {d} * r.back) FROM seeds s JOIN (SELECT walk, max(i) AS i, coalesce(sum(rank) FILTER ((walk, host) IN (SELECT (walk, host) FROM ends)), 0) AS back FROM ranks GROUP BY walk) r ON r.walk = s.walk WHERE r.i < {SQL_ROUNDS}
  ) GROUP BY i, walk, host)"""


def sql_text(p: Params = Params()) -> str:
    fits = []
    for said, text in sorted(p.rules, key=lambda r: -len(r[1])):
        name, _, rest = text.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", text, said))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
j AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {case(1)} AS rule, {case(2)} AS said FROM j),
hosts AS (SELECT host, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked FROM r WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS x FROM r WHERE host <> ''),
t AS (SELECT src, CASE WHEN regexp_matches(x, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') THEN translate(regexp_extract(x, '//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  WHEN NOT regexp_matches(x, '^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN '' END AS d FROM l),
le AS (SELECT src, CASE WHEN d = '' THEN src ELSE d END AS dst, CAST(count(*) AS DOUBLE) AS weight FROM t WHERE d IS NOT NULL GROUP BY ALL),
lab AS (SELECT string_split(host, '.') AS p FROM hosts),
ch AS (SELECT DISTINCT array_to_string(p[i:], '.') AS c FROM (SELECT p, unnest(range(1, greatest(len(p), 2))) AS i FROM lab)),
up AS (SELECT c AS src, substr(c, strpos(c, '.') + 1) AS dst FROM ch WHERE strpos(c, '.') > 0 AND strpos(substr(c, strpos(c, '.') + 1), '.') > 0),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM le UNION ALL SELECT src, dst, {p.name_weight} FROM up UNION ALL SELECT dst, src, {p.name_weight} FROM up) GROUP BY src, dst),
{_walk_sql(p)},
last AS (SELECT host, sum(rank) FILTER (walk = 'trust') AS trust, sum(rank) FILTER (walk = 'distrust') AS distrust FROM ranks WHERE i = {SQL_ROUNDS} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0.0) > coalesce(trust, 0.0) * {p.ratio * (1 + p.margin)} THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN last ON r.host = last.host
"""


QUERIES = {"op7_url_filters": op7_url_filters}
SQL = {"op7_url_filters": sql_text()}
