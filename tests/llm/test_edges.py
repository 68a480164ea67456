"""Every operator on one awkward table: nulls in every column, empty and long texts, repeated rows and ids, clashing and dotted names."""

import pytest
from pyspark.sql import functions as F

from beaconry.llm import embedding_dups, lattice_lm, minhash, mixing, packing, pii, quality_classifier, quality_rules, token_ids, url_filters
from beaconry.llm.common import own

#: Names that operators use inside, prefixes of these, and names with dots, blanks and quotes.
NAMES = [
    "__pii", "__pii_t", "__pii_f_email", "__PII_p_ip", "__pii_a", "__pii_b", "__words", "__wordss", "__lines", "__bits", "__grams", "__spots", "__fence", "__salt", "__saltf", "__quality", "__id", "__t", "__y",
    "__mix", "__grade", "__copy", "row", "x", "t", "p", "r", "id", "n", "m", "u", "v", "key", "host", "path", "rule", "said", "salt", "c", "rep", "print", "bands", "shard", "start", "piece", "length", "a.b", "a b", "a`b", "doc.id",
]
LONG = "word " * 30_000 + "joe@mail.org " + "a b c d e f g " * 2000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "plain words about a thing " * 12, "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, LONG, "en", None), (None, "no id but a text", None, "s"), (5, "same", "en", "s"), (5, "same", "en", "s"), (6, " \t\n ", "en", "s"),
        (7, "call +1 555 123 4567 now, joe@mail.org", "de", "s"), (7, None, "de", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, F.lit(i)).alias(n) for i, n in enumerate(NAMES)]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 1), (5, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def passes_through(docs, out, added):
    """All rows and columns of ``docs``, as they were, and ``added``."""
    assert out.columns == [*docs.columns, added]
    kept = out.select(*own(docs))
    assert kept.exceptAll(docs).count() == docs.exceptAll(kept).count() == 0


def test_columns_pass_through(spark, docs, labels):
    passes_through(docs, *pii.find_pii(docs))
    passes_through(docs, *mixing.mix(docs, labels))
    passes_through(docs, *quality_classifier.grade(docs, labels))
    for groups in (50_000, 0):
        passes_through(docs, *quality_rules.quality_rules(docs, rules=quality_rules.Rules(min_docs=1, broadcast_groups=groups)))


def test_stages_return_the_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (quality_rules.stage, minhash.stage, pii.stage, mixing.stage):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString() and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.mode("overwrite").parquet(f"{tmp_path}/out")
    assert minhash.stage(spark, docs, "").filter("doc_id = 7").select("text").collect() == [("call +1 555 123 4567 now, joe@mail.org",)]
    assert "<EMAIL>" in pii.redact(docs).filter("doc_id = 4").first()["text"]


def test_one_row_for_each(spark, docs, tmp_path):
    n = docs.count()
    assert minhash.near_duplicates(docs).count() == n and lattice_lm.lm_scores(docs).count() == n
    p = token_ids.Params(token_ids.public_vocabulary())
    back = token_ids.documents(token_ids.write_shards(docs, str(tmp_path / "shards"), p)).collect()
    assert len(back) == n and sum(r["n_tokens"] for r in back) == sum(r["n"] for r in token_ids.lengths(docs, p).collect())
    pieces = packing.pack_documents(docs).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in back) and {r["doc_id"] for r in pieces} == {1, 2, 3, 4, 5, 6, 7, None}
    vectors = docs.withColumn("embedding", F.when(F.col("doc_id") > 2, F.array(F.lit(1.0), F.col("doc_id").cast("double")))).withColumn("label", F.lit(1))
    assert embedding_dups.near_duplicate_vectors(vectors, "doc_id").count() == n
    assert url_filters.url_filter(docs.drop("host", "path").withColumn("url", F.concat(F.lit("http://h.net/"), "doc_id")), "doc_id", html="text").count() == n


def test_dotted_names_can_be_given(docs, labels):
    renamed = docs.withColumnRenamed("doc_id", "the.id").withColumnRenamed("text", "the.text")
    assert pii.redact(renamed, "the.text").columns == renamed.columns
    assert minhash.near_duplicates(renamed, "the.id", "the.text").count() == docs.count()
    graded, g = quality_classifier.grade(renamed, labels.withColumnRenamed("doc_id", "the.id"), None, "the.text", "the.id")
    assert graded.count() == docs.count()
