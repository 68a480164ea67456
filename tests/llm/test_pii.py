"""The base spans against the contract's patterns in Python, the added kinds, redaction and edge cases."""

import hashlib
import re

import pytest

from beaconry.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", " ", "no data", "a@b.c", "a@b.cx%y@d.e f@g", "é𝄞 joe.23@mail9.example.com, 1.2.3.4.5.6.7.8 and 300.1.1.1 0001.2.3.4",
    "+1 (017) 555-7713 rest +49 30 1234567890123456", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111",
    "12.13.14.15@x.y 1.2.3.4+5 555 1234", "%%a@b.c%%d@e.f", "+1 ()--5 x +1 ()-5-555-1234 .",
]
#: Texts on which Python's own search takes quadratic time, with their number of base spans.
LONG = [("x" * 5000 + "@" + "y." * 3000 + "z", 1), ("1" * 100_000, 0), ("1-" * 20_000 + "1", 0), ("a" * 200_000, 0), ("a@b" + ".c" * 20_000, 1), ("1.1.1." * 5000, 3750)]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    found, spans = pii.find_pii(docs)
    for r in found.collect():
        own = [(s["kind"], s["start"], s["end"]) for s in r[spans] if s["kind"] in pii.BASE]
        assert own == brute(r["text"]), (r["doc_id"], own[:5])


@pytest.mark.parametrize("text,kinds", [
    ("IBAN DE89 3704 0044 0532 0130 00.", ["iban"]), ("GB82WEST12345698765432", ["iban"]), ("GB83WEST12345698765432", []),
    ("amex card 3782 822463 10005 ok", ["card_short"]), ("nothing 378282246310005 here", []), ("call 555 123 4567 now", ["phone_local"]), ("order 555 123 4567 now", []),
])
def test_added_kinds(spark, text, kinds):
    found, spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [s["kind"] for s in found.first()[spans] if s["kind"] not in pii.BASE] == kinds


def test_long_texts(spark):
    found, spans = pii.find_pii(spark.createDataFrame([(n, t) for t, n in LONG], "n long, text string"))
    for r in found.select("n", spans).collect():
        assert sum(s["kind"] in pii.BASE for s in r[spans]) == r["n"]


def test_redact_and_names(spark):
    docs = spark.createDataFrame([(1, "hi é a@b.c and 1.2.3.4!", "k"), (2, None, None), (3, "plain", "z")], "doc_id long, text string, __pii string")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["hi é <EMAIL> and <IP>!", None, "plain"]
    assert pii.redact(docs.limit(0)).count() == 0


def test_digest(spark, tmp_path):
    spark.createDataFrame([(1, "x a@b.c"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = pii.op4_pii(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a["spans"], a["base_sha256"], a["n_email"]) == ("email:2:7", hashlib.sha256(b"email:2:7").hexdigest(), 1)
    assert (b["spans"], b["base_sha256"], b["n_added"]) == ("", hashlib.sha256(b"").hexdigest(), 0)


def test_stage_counts_characters(spark):
    docs = spark.createDataFrame([(1, "é a@b.c", "en", "s", 7), (2, None, "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars int")
    out = pii.stage(spark, docs, "")
    assert out.schema == docs.schema
    assert [(r["text"], r["n_chars"]) for r in out.orderBy("doc_id").collect()] == [("é <EMAIL>", 9), (None, 5)]


def test_base_columns_against_sql(spark):
    """The contract's columns in DuckDB, from the same patterns: matches and the pieces between them."""
    import duckdb

    def spans(kind, pattern, check):
        return f"""{kind}_a AS (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS h, regexp_split_to_array(t, '{pattern}') AS p FROM d),
        {kind}_b AS (SELECT doc_id, unnest(h) AS h, unnest(range(1, len(h) + 1)) AS i, h AS hs, p FROM {kind}_a),
        {kind}_c AS (SELECT doc_id, '{kind}' AS kind, h, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i-1], lambda x: length(x))), 0) AS s FROM {kind}_b),
        {kind} AS (SELECT * FROM {kind}_c WHERE {check})"""

    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    doubled = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN CAST({digits}[i] AS INT) ELSE (CAST({digits}[i] AS INT) * 2) // 10 + (CAST({digits}[i] AS INT) * 2) % 10 END))"
    checks = {"email": "true", "ip": "list_max(list_transform(string_split(h, '.'), lambda x: CAST(x AS HUGEINT))) <= 255", "card": f"length({digits}) BETWEEN 16 AND 19 AND {doubled} % 10 = 0", "phone": f"length({digits}) BETWEEN 8 AND 15"}
    parts = ",\n".join(spans(k, p.replace("(", "(?:").replace(r"\+[0-9][\x20(?:)", r"\+[0-9][\x20()"), checks[k]) for k, p in PATTERNS.items())
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(PATTERNS))
    folder = "/root/testdata/sf0.001"
    sql = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM '{folder}/documents.parquet'), {parts},
    every AS ({' UNION ALL '.join(f'SELECT doc_id, kind, h, s FROM {k}' for k in PATTERNS)})
    SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k}')" for k in PATTERNS)}, sha256(coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(h) AS BIGINT), ',' ORDER BY CASE kind {order} END, s), ''))
    FROM d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id"""
    got = pii.op4_pii(spark, folder).select("doc_id", *[f"n_{k}" for k in PATTERNS], "base_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(sql).fetchall())
