"""The pipeline stage by stage against plain versions, and run() as their sequence."""

import random
import re

import pytest

import corpus_pipeline
from beaconry.llm import token_ids
from beaconry.llm.common import Stash
from test_minhash import brute as brute_groups
from test_pii import brute as brute_spans
from test_quality_rules import counts


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    texts = [prose(r, r.randrange(60, 200)) for _ in range(220)]
    near = texts[3].split()
    near[10] = "changed"
    texts += [texts[1]] * 4 + [" ".join(near), texts[5] + " write to joe@mail.org or 10.20.30.40", "too short", None, "", "a b c d " * 40, re.sub(" ", " ### ", texts[7]), prose(r, 20_000)]
    rows = [(i, t, "en" if i % 3 else "de", "web", len(t or "")) for i, t in enumerate(texts)] + [(9, texts[9], "en", "web", 0), (None, prose(r, 80), None, None, None)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), int(i % 20 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def fence(values, spread=3):
    """Upper and lower fence of whole numbers, by the sketch's bucket ends."""

    def end(v):
        e = max(0, v.bit_length() - 7)
        return v if v < 128 else ((v >> e) + 1 << e) - 1

    v = sorted(map(end, values))
    at = lambda q, of: v[-(-len(v) * q // of) - 1]
    gap = spread * max(at(3, 4) - at(1, 4), at(9, 10) - at(3, 4))
    return at(3, 4) + gap, at(1, 4) - gap


def plain_quality(rows):
    def measures(c):
        words, chars, symbols, lines, repeated, windows = c
        return chars * 100 // words, symbols * 10_000 // chars, repeated * 10_000 // lines, windows * 10_000 // words

    counted = [counts(r["text"]) for r in rows]
    good = [c[0] >= 50 and 100 * c[5] <= 50 * c[0] for c in counted]
    kept = []
    for r, c, ok in zip(rows, counted, good):
        if not ok:
            continue
        # these groups have under 100 documents or are their language's only ones, so the language decides
        group = [measures(x) for q, x, g in zip(rows, counted, good) if g and q["lang"] == r["lang"]]
        most, least = zip(*(fence([g[k] for g in group]) for k in range(4)))
        slack = (0, 30_000 // c[1], 30_000 // c[3], 180_000 // c[0])
        m = measures(c)
        if all(m[k] <= most[k] + slack[k] for k in range(4)) and m[0] >= least[0]:
            kept.append(tuple(r))
    return kept


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stash, outputs = Stash(spark), []
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(stash.put(stage(spark, docs, folder)))
        assert name == "packing" or outputs[-1].schema == docs.schema
        docs = outputs[-1] if name != "packing" else docs
    raw = spark.read.parquet(f"{folder}/documents.parquet").collect()
    quality, unique, clean, mixed = ([tuple(r) for r in o.collect()] for o in outputs[:4])
    order = lambda rows: sorted(rows, key=str)
    assert order(quality) == order(plain_quality(raw))
    with_ids = sorted({r[0]: r for r in sorted(quality, key=lambda r: r[2] or "") if r[0] is not None}.values())  # of equal texts the last language
    label = brute_groups([r[1] for r in with_ids], 5)
    assert order(unique) == order([r for i, (r, (_, c)) in enumerate(zip(with_ids, label)) if c == i] + [r for r in quality if r[0] is None])
    by_id = {r[0]: r for r in unique}
    assert len(clean) == len(unique)
    for r in clean:
        before = by_id[r[0]][1]
        assert not brute_spans(r[1]) and (r[1] == before or brute_spans(before)) and r[4] == len(r[1])
    assert set(mixed) <= set(clean) and len(mixed) > 100
    p = token_ids.Params(token_ids.public_vocabulary())
    tokens, places = {}, {}
    for r in token_ids.lengths(outputs[3], p).collect():
        tokens[r["id"]] = tokens.get(r["id"], 0) + r["n"]
    for r in outputs[4].collect():
        places[r["doc_id"]] = places.get(r["doc_id"], 0) + r["length"]
    assert places == tokens
    assert order(map(tuple, corpus_pipeline.run(spark, folder).collect())) == order(map(tuple, outputs[4].collect()))


def test_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    live = len(Stash.live)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0 and len(Stash.live) == live + 1
    assert corpus_pipeline.queries().keys() == {"pipeline"} and [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash", "pii", "mixing", "packing"]
