"""Rules on hand-made urls, the walk against a plain power iteration, and the query against its SQL."""

import random

import pytest

from beaconry.llm import url_filters as u
from beaconry.llm.common import Stash
from beaconry.llm.graph import Unsettled


def test_rules(spark):
    cases = [
        (1, "http://A.Example.ORG/en/1x?q#f", "a.example.org", "/en/1x", "example.org/en/1", "block"), (2, "https://x.org/", "x.org", "/", "org/", "allow"), (3, "x://forg/", "forg", "/", None, "allow"),
        (4, "http://org?x", "org", "", None, "allow"), (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"), (7, "http://b.com/fr/1", "b.com", "/fr/1", "com/fr/", "allow"),
        (8, "http://b.com/de/#x", "b.com", "/de/", "com/de/", "block"), (9, "http://example.org/es/a://b/c", "example.org", "/es/a://b/c", "example.org/es/", "block"), (9, "http://É.net\n/a", "É.net\n", "/a", None, "allow"),
    ]
    pages = spark.createDataFrame([(c[0], c[1], None, "x") for c in cases], "page_id long, url string, html string, host string")
    for broadcast in (1000, 0):
        got = u.url_filter(pages, p=u.Params(broadcast_hosts=broadcast, damping=0.5, tolerance=1e-6)).select("id", "host", "path", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(c[0], *c[2:]) for c in cases], key=str)
    assert u.url_filter(pages.limit(0)).count() == 0


def test_links_decide(spark):
    """A host that trusted pages link to stays; one that links to blocked hosts goes."""
    rows = [(1, "http://good.org/a", '<a href="http://friend.net/x">f</a><a href=/own>o</a>'), (2, "http://friend.net/y", None), (3, "http://spam.net/", '<a class=x href="//bad.com/de/1">b</a> <a href="mailto:a@b.c">m</a>'), (4, "http://bad.com/de/1", ""), (5, "http://bad.com/other", "")]
    out = {r["id"]: r for r in u.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r["verdict"] for i, r in out.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block"}
    assert out[2]["trust"] > 0 == out[2]["distrust"] and out[3]["distrust"] > 0 == out[3]["trust"]


def power(edges, seeds, damping=0.5):
    """Plain power iteration over weighted edges; hosts without out-edges send all back to the seeds."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    out = {h: sum(w for (s, _), w in edges.items() if s == h) for h in hosts}
    total = sum(seeds.values())
    rank = dict.fromkeys(hosts, 1 / len(hosts))
    for _ in range(100):
        back = sum(rank[h] for h in hosts if not out[h])
        new = {h: seeds.get(h, 0) / total * (1 - damping + damping * back) for h in hosts}
        for (s, d), w in edges.items():
            new[d] += damping * rank[s] * w / out[s]
        rank = new
    return rank


def scored(spark, edges, allowed, blocked, p=u.Params(damping=0.5)):
    hosts = spark.createDataFrame([(h, allowed.get(h, 0), blocked.get(h, 0)) for h in {x for e in edges for x in e} | set(allowed) | set(blocked)], "host string, allowed long, blocked long")
    table = spark.createDataFrame([(*k, float(w)) for k, w in edges.items()], "src string, dst string, weight double")
    return {r["host"]: (r["trust"], r["distrust"]) for r in u.host_scores(hosts, table, p, Stash(spark)).collect()}


def test_ranks_add_up(spark):
    """A leaf, loops, a hub, links across many hosts."""
    assert scored(spark, {("a", "b"): 1}, {"a": 1}, {}) == {"a": (pytest.approx(1 / 1.5), 0), "b": (pytest.approx(0.5 / 1.5), 0)}
    r = random.Random(6)
    edges = {("a", "a"): 30, ("a", "b"): 1, ("b", "leaf"): 2, ("c", "c"): 5}
    for _ in range(400):
        edges[f"h{r.randrange(80)}", r.choice(["hub", f"h{r.randrange(80)}"])] = r.randrange(1, 9)
    edges |= {("hub", f"h{i}"): 1 for i in range(0, 80, 3)} | {("h1", "a"): 1}
    allowed, blocked = {"a": 5, "h3": 2, "alone": 1}, {"h7": 4, "leaf": 1}
    got = scored(spark, edges, allowed, blocked)
    back = {(d, s): w for (s, d), w in edges.items()}
    for side, want in enumerate((power(edges, allowed), power(back, blocked))):
        assert sum(v[side] for v in got.values()) == pytest.approx(1)
        assert all(got.get(h, (0, 0))[side] == pytest.approx(x, abs=1e-8) for h, x in want.items())


def test_slow_walks_end_or_fail(spark):
    """A long cycle hands the mass on almost whole: it takes many rounds, and too few of them are an error."""
    cycle = {(f"c{i:02}", f"c{(i + 1) % 40:02}"): 1 for i in range(40)}
    got = scored(spark, cycle, {"c00": 1}, {}, u.Params(tolerance=1e-4))
    assert got["c39"][0] == pytest.approx(0.85**39 * 0.15 / (1 - 0.85**40), abs=1e-3)
    with pytest.raises(Unsettled):
        scored(spark, cycle, {"c00": 1}, {}, u.Params(rounds=8))


def test_query_against_sql(spark, tmp_path):
    """Links across hosts of several sites; the SQL walks on its own."""
    import duckdb

    r = random.Random(2)
    hosts = [f"{a}.{b}" for a in ("www", "x", "y", "shop") for b in ("one.org", "two.com", "bad.com", "four.net", "five.info")]
    rows = []
    for i in range(200):
        links = " ".join(f'<a href="//{r.choice(hosts)}/p">x</a>' for _ in range(r.randrange(4)))
        rows.append((i, f"http://{r.choice(hosts)}/{r.choice(['de/', 'fr/', 'en/1', ''])}{i}", links + '<a href="/own">o</a>' * r.randrange(3)))
    spark.createDataFrame([*rows, (900, None, None), (901, "x", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(db.sql(u.SQL["op7_url_filters"]).fetchall(), key=str)
    got = sorted(map(tuple, u.op7_url_filters(spark, str(tmp_path)).collect()), key=str)
    assert got == want and len({(x[3], x[4]) for x in got}) >= 5
