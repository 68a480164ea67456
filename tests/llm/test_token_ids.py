"""Exact round trips of the coding, and the query against encoding each text at once."""

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beaconry.llm import simple8b, token_ids

ROOT = str(Path(__file__).resolve().parents[2])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400), st.integers(1, 300))
def test_round_trip(values, block):
    data = simple8b.encode(np.array(values, np.uint64), block)
    assert simple8b.decode(data).tolist() == values
    for b in range(0, -(-len(values) // block), 3):
        assert simple8b.decode(data, b, b + 1).tolist() == values[b * block : (b + 1) * block]


def test_every_selector():
    values = np.concatenate([np.full(250, (1 << bits) - 1, np.uint64) for _, bits in simple8b.SELECTORS.values()] + [np.full(5, 2**64 - 16, np.uint64)])
    data = simple8b.encode(values, 4096)
    assert (simple8b.decode(data) == values).all()
    assert len(simple8b.encode(np.zeros(12_000, np.uint64), 12_000)) < 1000


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a b", "a  b", "a \n b", "a\n b c", "\n\na b", "it's   x y  z", "x" * 30_000, "one one. one, two. .. , é. 日. 1. a", "a\tb c\x1cd e", "<|endoftext|> x <|endoftext|>", "é ñ 𝄞 日本 語"])
def test_pieces_encode_as_the_whole(text):
    e = token_ids.Encoder(token_ids.public_vocabulary())
    whole = e.model.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.batch([text, text])[1], "<u4").tolist() == whole
    assert token_ids.Encoder(token_ids.public_vocabulary(), counts=True).batch([text, text, text + " " + text])[:2] == [len(whole)] * 2


def test_query(spark, tmp_path):
    texts = [(3, "three words here"), (1, None), (2, "two  blanks\n and more"), (2, "again"), (None, "no id"), (9, "z " * 5000)]
    spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, start int").write.parquet(f"{tmp_path}/documents.parquet")
    model = token_ids.Encoder(token_ids.public_vocabulary()).model
    want, start = [], 0
    hashes = {t: spark.createDataFrame([(t or "",)], "t string").select(F.xxhash64("t")).first()[0] for t in ("two  blanks\n and more", "again")}
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, hashes.get(x[1], 0))):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_ids.op8_token_ids(spark, str(tmp_path)).collect()), key=lambda r: r[1]) == want
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_ids.op8_token_ids(spark, f"{tmp_path}/none").count() == 0


READER = """
import sys
from pyspark.sql import SparkSession
from beaconry.llm import token_ids
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print(sorted(map(tuple, token_ids.documents(token_ids.read_shards(spark, sys.argv[1])).collect())))
"""


def test_another_session_reads_the_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"document {i} " * (i % 5)) for i in range(40)], "doc_id long, text string")
    p = token_ids.Params(token_ids.public_vocabulary(), segment_ids=30)
    written = sorted(map(tuple, token_ids.documents(token_ids.write_shards(docs, str(tmp_path / "kept"), p)).collect()))
    manifest = spark.read.parquet(str(tmp_path / "kept/manifest")).orderBy("start").collect()
    assert [r["start"] for r in manifest] == [sum(x["n_ids"] for x in manifest[:i]) for i in range(len(manifest))] and len(manifest) > 3
    assert {(r["vocabulary"], r["end_id"]) for r in manifest} == {("byte_bpe_50k.json", 2)} and sum(r["n_docs"] for r in manifest) == 40
    out = subprocess.run([sys.executable, "-c", READER, str(tmp_path / "kept")], capture_output=True, text=True, cwd=ROOT, timeout=120)
    assert eval(out.stdout.strip().splitlines()[-1]) == written, out.stderr[-500:]
