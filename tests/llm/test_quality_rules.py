"""Counts against plain Python, also where window hashes collide; the fences' effects and edge cases."""

import random
import re

from pyspark.sql import functions as F

from beaconry.llm import quality_rules as q


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    spots = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(spots)


def texts():
    r = random.Random(2)
    out = [None, "", " \n\t", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "x#y\n\nx#y\n \nx#y \r\nx#y \r", "é𝄞 ñ|<>\x0b b\x1cc", "w " * 3000]
    return out + [" ".join(r.choices("abcd", k=r.randrange(3, 60))) for _ in range(60)]


def test_counts(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "m int, text string")
    for shift in (0, 50):  # 50: for long texts hardly a hash bit is left
        rows = q.measure(docs, "text", "out", shift).collect()
        assert [tuple(x["out"]) for x in rows] == [counts(x["text"]) for x in rows]


def test_sketch_is_mergeable_and_close(spark):
    values = spark.range(20_000).select((F.col("id") * 37 % 9_973).alias("v"), F.lit("a").alias("k"), (F.col("id") % 3).alias("part"))
    whole = q.sketch(values, ["k"], "v")
    parts = q.merge(q.sketch(values, ["k", "part"], "v"), ["k"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    r = q.quartiles(whole, ["k"]).first()
    exact = sorted(i * 37 % 9_973 for i in range(20_000))
    assert r["n"] == 20_000 and 0 <= r["q1"] - exact[4_999] <= exact[4_999] / 64 and 0 <= r["q3"] - exact[14_999] <= exact[14_999] / 64


def prose(r, n=120):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


def test_rules(spark):
    r = random.Random(1)
    rows = [(i, prose(r), "en", "s", i) for i in range(150)] + [(i, prose(r), None, None, i) for i in range(150, 160)]
    rows += [(200, re.sub(" ", "### ", prose(r)), "en", "s", 0), (201, "short", "en", "s", 0), (202, None, "en", "s", 0), (203, "a b c d " * 50, "en", "s", 0), (204, re.sub(" ", " aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", prose(r)), None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    for rules in (q.Rules(min_docs=5), q.Rules(min_docs=5, broadcast_groups=0, salts=3)):
        judged, m = q.quality_rules(docs, rules=rules)
        kept = {x["doc_id"] for x in judged.filter(f"{m}.kept").collect()}
        assert kept == set(range(160)) and judged.count() == len(rows)
        assert {x["doc_id"] for x in judged.filter(f"{m}.base_failed").collect()} == {201, 202, 203}
    out = q.stage(spark, docs, "")
    assert out.columns == docs.columns and q.stage(spark, docs.limit(0), "").count() == 0


def test_sketch_sets_the_fence(spark):
    """Where nearly all documents have no symbols, 5 % of them are too many; where a tenth has 5 %, they are usual."""
    r = random.Random(5)
    marked = lambda k: "$" * k + prose(r)  # about 600 characters
    rows = [(i, prose(r), "en", "plain") for i in range(200)] + [(300 + i, marked(30), "en", "plain") for i in range(8)] + [(400, marked(3), "en", "plain")]
    rows += [(1000 + i, prose(r) if i % 5 else marked(30), "en", "marked") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {x["doc_id"] for x in q.stage(spark, docs, "").collect()}
    assert kept & set(range(300, 308)) == set()
    assert kept >= {*range(200), 400, *range(1000, 1200)}
