"""Personal data, native: patterns propose spans, checksums confirm them, nearby words move the score.

Positions come from two passes of the same pattern: the matches and the pieces between them, whose
lengths in code points add up. The base patterns are written with possessive loops and, where a match
begins with a run of characters, ``(?:\\G|(?<!run))``: that finds the same leftmost matches in linear
time and without Java's recursion, however long the text is.

Base kinds (email, ip, card, phone) stay whenever their check passes. The method adds ``iban`` (mod 97),
``card_short`` (13 to 15 digits, Luhn) and ``phone_local``; each starts from its pattern's score, gains by its
checksum and by context words within 40 characters before or 20 after it, loses by words that speak
against it, and stays from ``least`` on, unless it overlaps a base span.

Defined results: a null text is an empty one and has no spans (the hash is that of the empty string);
repeated rows are searched each; an empty table gives no rows; other columns pass through ``find_pii`` and
``redact`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, own, quoted, whole_text

# The base patterns, in an equivalent form that never backtracks over a run.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9+().-])\(?[0-9]{2,5}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"

#: kind: pattern, sure sign that it may occur, check (SQL over hit h), start score, gain by the check, context that speaks for it.
BASE = {
    "email": (EMAIL, "contains({t}, '@')", "true"),
    "ip": (IP, r"{t} rlike '[0-9]\\.[0-9]'", r"h rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}$'"),
    "card": (CARD, r"{t} rlike '[0-9][\\x20-]?[0-9]'", "{luhn_16_19}"),
    "phone": (PHONE, "contains({t}, '+')", "length(regexp_replace(h, '[^0-9]', '')) BETWEEN 8 AND 15"),
}
ADDED = {
    "iban": (IBAN, "{t} rlike '[A-Z][A-Z][0-9][0-9]'", "{mod97}", 0.3, 0.5, "iban|account|konto|compte|cuenta|bank"),
    "card_short": (CARD, r"{t} rlike '[0-9][\\x20-]?[0-9]'", "{luhn_13_15}", 0.1, 0.3, "card|visa|amex|karte|carte|tarjeta|payment"),
    "phone_local": (LOCAL_PHONE, "{t} rlike '[0-9]{{3,4}}[\\\\x20.-][0-9]{{3,4}}'", "length(regexp_replace(h, '[^0-9]', '')) BETWEEN 8 AND 12", 0.2, 0.1, "phone|tel|call|mobile|fax|telefon|anruf"),
}
AGAINST = "invoice|order|version|isbn|part no|serial|rechnung"
#: From this score on an added span stays. A checksum alone is enough for an IBAN only.
LEAST = 0.6


def _luhn(low: int, high: int) -> str:
    return f"""element_at(transform(array(regexp_replace(h, '[^0-9]', '')), d -> CASE WHEN length(d) BETWEEN {low} AND {high} THEN
        aggregate(sequence(1, length(d)), 0, (a, i) -> a + element_at(transform(array(cast(substring(d, length(d) - i + 1, 1) as int) * (2 - i % 2)),
        x -> x - CASE WHEN x > 9 THEN 9 ELSE 0 END), 1)) % 10 = 0 ELSE false END), 1)"""


#: The first four characters go last, a letter counts as 10 to 35, and the number's remainder by 97 is 1.
_MOD97 = """element_at(transform(array(regexp_replace(h, ' ', '')), d -> length(d) BETWEEN 15 AND 34 AND
        aggregate(sequence(1, length(d)), 0, (a, i) -> element_at(transform(array(ascii(substring(d, (i + 3) % length(d) + 1, 1))),
        c -> CASE WHEN c >= 65 THEN (a * 100 + c - 55) % 97 ELSE (a * 10 + c - 48) % 97 END), 1)) = 1), 1)"""


def _check(sql: str) -> str:
    return sql.format(luhn_16_19=_luhn(16, 19), luhn_13_15=_luhn(13, 15), mod97=_MOD97)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


SPAN = "array<struct<kind:string,start:int,end:int,score:double,near:string>>"


def find_pii(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with an array column of spans (kind, start, end, score) and that column's name.

    Base kinds come first, as listed, then the added ones; within a kind by start.
    """
    out = fresh(docs, "__pii")
    t = f"{out}_t"
    kinds = {k: (*v, 1.0, 0.0, "") for k, v in BASE.items()} | ADDED
    patterns = {"card": "card", "card_short": "card"}  # one search for both
    step = docs.select("*", whole_text(text).alias(t))
    searched = [k for k in kinds if patterns.get(k, k) == k]
    for k in searched:
        pattern, sign = kinds[k][:2]
        step = step.withColumn(f"{out}_f_{k}", F.expr(f"CASE WHEN {sign.format(t=t)} THEN regexp_extract_all({t}, {_quoted(pattern)}, 0) ELSE cast(array() as array<string>) END"))
    step = step.select("*", *[F.expr(f"CASE WHEN size({out}_f_{k}) > 0 THEN split({t}, {_quoted(kinds[k][0])}, -1) END").alias(f"{out}_p_{k}") for k in searched])
    spans = []
    for k, (_, _, check, start, gain, words) in kinds.items():
        f, p = f"{out}_f_{patterns.get(k, k)}", f"{out}_p_{patterns.get(k, k)}"
        near = f"lower(concat(right({p}[i], 40), ' ', left({p}[i+1], 20)))" if words else "''"
        score = f"""{start} + {gain} + CASE WHEN near rlike '(?:^|[^a-z])(?:{words})' THEN 0.3 ELSE 0.0 END
            - CASE WHEN near rlike '(?:^|[^a-z])(?:{AGAINST})' THEN 0.2 ELSE 0.0 END""" if words else "1.0"
        score = score.replace("near", "x.near")
        checked = _check(check)
        found = f"""aggregate(sequence(0, size({f}) - 1), named_struct('pos', 0, 'out', cast(array() as {SPAN})), (a, i) ->
            element_at(transform(array(named_struct('h', {f}[i], 'start', a.pos + length({p}[i]), 'end', a.pos + length({p}[i]) + length({f}[i]))), s -> named_struct('pos', s.end,
            'out', CASE WHEN element_at(transform(array(s.h), h -> {checked}), 1)
                THEN array_append(a.out, named_struct('kind', '{k}', 'start', s.start, 'end', s.end, 'score', cast(0.0 as double), 'near', {near})) ELSE a.out END)), 1), a -> a.out)"""
        kept = f"""filter(transform({found}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'score', cast({score} as double))), x -> x.score >= {LEAST})"""
        spans.append(f"CASE WHEN size({f}) > 0 THEN {kept} ELSE cast(array() as array<struct<kind:string,start:int,end:int,score:double>>) END")
    n = len(BASE)
    step = step.select(*own(docs), F.expr(f"concat({', '.join(spans[:n])})").alias(f"{out}_b"), F.expr(f"concat({', '.join(spans[n:])})").alias(f"{out}_a"))
    free = f"filter({out}_a, x -> NOT exists({out}_b, b -> b.start < x.end AND x.start < b.end))"
    return step.select(*own(docs), F.expr(f"CASE WHEN size({out}_a) > 0 THEN concat({out}_b, {free}) ELSE {out}_b END").alias(out)), out


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_base(span: Column) -> Column:
    return span["kind"].isin(*BASE)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text``'s spans replaced by ``<KIND>``; overlapping spans become neighbouring marks."""
    found, spans = find_pii(docs, text)
    t = quoted(text)
    cut = f"""aggregate(array_sort({spans}, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.end - a.end END),
        named_struct('pos', 0, 'out', cast(array() as array<string>)), (a, s) -> CASE WHEN s.end <= a.pos THEN a ELSE named_struct('pos', s.end, 'out',
        array_append(a.out, concat(CASE WHEN s.start > a.pos THEN substring({t}, a.pos + 1, s.start - a.pos) ELSE '' END, '<', upper(s.kind), '>'))) END,
        a -> concat(array_join(a.out, ''), substring({t}, a.pos + 1)))"""
    new = F.expr(f"CASE WHEN size({spans}) > 0 THEN {cut} ELSE {t} END").alias(text)
    return found.select(*[new if c == text else F.col(quoted(c)) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced; ``n_chars`` follows the new text."""
    out = redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found, spans = find_pii(docs)
    base = F.filter(spans, is_base)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col(spans)).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_added"),
        F.array_join(F.transform(spans, lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}
