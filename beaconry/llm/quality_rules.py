"""Quality rules with adaptive thresholds, native.

Per document four integer measures are taken from the whole text. Documents that pass the fixed base
rules feed log-linear quantile sketches, one per language, source and measure: a value falls into one
of 64 buckets per power of two, so a bucket's upper end is within 1/64 of each of its values. A sketch is its
bucket counts, and sketches merge by adding counts; the order and the number of partitions do not
change them, and so not the thresholds. Sources with fewer than ``min_docs`` documents use the merged
sketch of their language. The verdict is Tukey's far fence: a measure above
``q3 + spread * max(q3 - q1, q9 - q3)`` rejects the document, where ``q9`` is the last decile (most groups'
quartiles of symbols, repeated lines and repeated words are all 0); short words have a lower fence too. A document
may exceed the fence by ``units`` symbols, lines or three-word windows, as far as its own share is rounded.

Defined results: a null text is an empty text, has no words and fails the base; null languages and
sources form groups of their own; repeated rows are judged each; an empty table gives no rows; other
columns pass through ``quality_rules`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import BLANK, WORD, Stash, fresh, own, quoted, whole_text

#: Whole numbers: characters a word times 100, and three shares in parts of 10,000.
MEASURES = ("word_length", "symbols", "dup_lines", "repeats")
#: The least step of a measure: so much of its numerator, over its denominator.
STEPS = {"symbols": (1, "word_chars"), "dup_lines": (1, "n_lines"), "repeats": (6, "n_words")}


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 3
    min_docs: int = 100
    #: Steps of its own measure by which a document may exceed a fence.
    units: int = 3
    #: Groups of thresholds that may be broadcast (about 100 bytes each).
    broadcast_groups: int = 50_000
    salts: int = 64


def measure(docs: DataFrame, text: str, out: str, hash_shift: int = 0) -> DataFrame:
    """``docs`` and a struct ``out``: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Three-word windows are compared by sorting 64-bit numbers that hold a hash above the window's
    position. Neighbours with equal hashes are compared word by word; if a hash has met two different
    windows, that document is sorted by the words themselves. ``hash_shift`` drops more hash bits (tests).
    """
    words, lines, bits, grams, spots = (fresh(docs, f"__{x}") for x in ("words", "lines", "bits", "grams", "spots"))
    t = whole_text(text)
    keep = own(docs)
    step = docs.select(
        *keep,
        F.array_remove(F.split(t, f"{BLANK}+", -1), "").alias(words),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias(lines),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias(f"{words}s"),
    )
    n = f"cast(size({words}) as bigint)"
    # bits for the position, the rest of the 64 for the hash
    step = step.select("*", F.expr(f"length(bin({n})) + {hash_shift}").alias(bits))
    step = step.select(
        "*",
        F.expr(f"""CASE WHEN {n} >= 4 THEN sort_array(transform(sequence(0, size({words}) - 3), i ->
            shiftleft(xxhash64({words}[i], {words}[i+1], {words}[i+2]), {bits}) | cast(i as bigint))) END""").alias(grams),
    )
    place = f"cast(k & (shiftleft(1L, {bits}) - 1) as int)"
    before = f"cast({grams}[j-1] & (shiftleft(1L, {bits}) - 1) as int)"
    same = f"shiftright({grams}[j-1], {bits}) = shiftright(k, {bits})"
    by_hash = f"""filter({grams}, (k, j) -> (j > 0 AND {same}) OR
        (j + 1 < size({grams}) AND shiftright({grams}[j+1], {bits}) = shiftright(k, {bits})))"""
    clash = f"""exists(transform({grams}, (k, j) -> j > 0 AND {same} AND NOT ({words}[{place}] = {words}[{before}]
        AND {words}[{place}+1] = {words}[{before}+1] AND {words}[{place}+2] = {words}[{before}+2])), x -> x)"""
    step = step.select("*", F.expr(by_hash).alias(spots))
    by_words = f"""element_at(transform(array(array_sort(transform(sequence(0, size({words}) - 3), i ->
            struct({words}[i] AS a, {words}[i+1] AS b, {words}[i+2] AS c, i AS p)))), s ->
        transform(filter(s, (x, j) ->
            (j > 0 AND s[j-1].a = x.a AND s[j-1].b = x.b AND s[j-1].c = x.c) OR
            (j + 1 < size(s) AND s[j+1].a = x.a AND s[j+1].b = x.b AND s[j+1].c = x.c)), x -> x.p)), 1)"""
    starts = f"""sort_array(CASE WHEN {clash} THEN {by_words} ELSE transform({spots}, k -> {place}) END)"""
    covered = f"""CASE WHEN {spots} IS NULL OR size({spots}) = 0 THEN 0L ELSE
        aggregate(transform(array({starts}), q -> aggregate(transform(q, (p, j) ->
            CASE WHEN j + 1 < size(q) THEN least(3, q[j+1] - p) ELSE 3 END), 0L, (a, x) -> a + x)), 0L, (a, x) -> a + x) END"""
    return step.select(
        *keep,
        F.struct(
            F.expr(n).alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.col(f"{words}s").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.expr(covered).alias("n_repeat_words"),
        ).alias(out),
    )


def bucket(value: str) -> str:
    """SQL: the log-linear bucket of a whole number of at least 0; exact below 128."""
    e = f"(length(bin({value})) - 7)"
    return f"CASE WHEN {value} < 128 THEN {value} ELSE cast({e} as bigint) * 128 + shiftright({value}, {e}) END"


def bucket_end(b: str) -> str:
    """SQL: the largest whole number of bucket ``b``."""
    return f"CASE WHEN {b} < 128 THEN {b} ELSE shiftleft(pmod({b}, 128) + 1, cast({b} div 128 as int)) - 1 END"


def sketch(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key and bucket: ``bucket``, ``n``. Merging sketches is summing ``n``."""
    return values.groupBy(*keys, F.expr(bucket(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the total ``n``, the sketch's ``q1`` and ``q3``, and its last decile ``q9``.

    A group's buckets are few (under 64 for each power of two), so the window holds no large group.
    """
    group = Window.partitionBy(*keys)
    run = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    s = sketches.select(*keys, "bucket", "n", F.sum("n").over(run).alias("upto"), F.sum("n").over(group).alias("total"))
    end = F.expr(bucket_end("bucket"))
    at = lambda q, of: F.min(F.when(F.col("upto") * of >= F.col("total") * q, end))
    return s.groupBy(*keys).agg(F.first("total").alias("n"), at(1, 4).alias("q1"), at(3, 4).alias("q3"), at(9, 10).alias("q9"))


def measures(m: str) -> dict[str, Column]:
    """The judged measures, whole numbers, of a document with words and the struct ``m``."""
    x = lambda a, b, k: F.expr(f"cast({m}.{a} * {k} div greatest({m}.{b}, 1L) as bigint)")
    return {
        "word_length": x("word_chars", "n_words", 100),
        "symbols": x("n_symbols", "word_chars", 10_000),
        "dup_lines": x("n_dup_lines", "n_lines", 10_000),
        "repeats": x("n_repeat_words", "n_words", 10_000),
    }


def slack(k: str, m: str, rules: Rules) -> Column:
    """What measure ``k`` of a document may exceed its fence by: ``units`` steps of that document's own measure."""
    if k not in STEPS:
        return F.lit(0).cast("long")
    step, of = STEPS[k]
    return F.expr(f"cast({rules.units * step * 10_000} div greatest({m}.{of}, 1L) as bigint)")


def base_failed(m: str, rules: Rules) -> Column:
    return F.expr(f"{m}.n_words < {rules.min_words} OR 100 * {m}.n_repeat_words > {rules.max_repeat_percent} * {m}.n_words")


def thresholds(measured: DataFrame, m: str, lang: str, source: str, rules: Rules) -> DataFrame:
    """One row per language and source of ``measured``: the fence of every measure."""
    good = measured.filter(~base_failed(m, rules))
    long = good.select(
        F.col(quoted(lang)).alias("lang"),
        F.col(quoted(source)).alias("source"),
        F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in measures(m).items()])).alias("x"),
    ).select("lang", "source", "x.measure", "x.value")
    by_source = sketch(long, ["lang", "source", "measure"], "value")
    own_q = quartiles(by_source, ["lang", "source", "measure"])
    lang_q = quartiles(merge(by_source, ["lang", "measure"]), ["lang", "measure"]).select(
        F.col("lang").alias("l"), F.col("measure").alias("k"), *[F.col(q).alias(f"lang_{q}") for q in ("q1", "q3", "q9")]
    )
    both = own_q.join(lang_q, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("k")))
    q1, q3, q9 = (F.when(F.col("n") >= rules.min_docs, F.col(q)).otherwise(F.col(f"lang_{q}")) for q in ("q1", "q3", "q9"))
    gap = F.lit(rules.spread) * F.greatest(q3 - q1, q9 - q3)
    rows = both.select("lang", "source", "measure", (q3 + gap).alias("most"), (q1 - gap).alias("least"))
    at = lambda k, c: F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"{k}_{c}")
    return rows.groupBy("lang", "source").agg(*[at(k, "most") for k in MEASURES], at("word_length", "least"))


def verdict(measured: DataFrame, fences: DataFrame, m: str, lang: str, source: str, rules: Rules) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept`` added to its struct ``m``, by a join with the fences."""
    name = fresh(measured, "__fence")
    f = fences.select(F.struct(*fences.columns).alias(name))
    on = F.col(quoted(lang)).eqNullSafe(F.col(f"{name}.lang")) & F.col(quoted(source)).eqNullSafe(F.col(f"{name}.source"))
    if fences.count() <= rules.broadcast_groups:
        joined = measured.join(F.broadcast(f), on, "left")
    else:  # a hot source is spread over all salts
        salt = fresh(measured, "__salt")
        f = f.withColumn(f"{salt}f", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))
        salted = measured.withColumn(salt, F.pmod(F.xxhash64(m), F.lit(rules.salts)).cast("int"))
        joined = salted.join(f, on & (F.col(salt) == F.col(f"{salt}f")), "left")
    values, bad = measures(m), F.lit(False)
    for k in MEASURES:
        bad = bad | F.coalesce(values[k] > F.col(f"{name}.{k}_most") + slack(k, m, rules), F.lit(False))
    bad = bad | F.coalesce(values["word_length"] < F.col(f"{name}.word_length_least"), F.lit(False))
    failed = base_failed(m, rules)
    return joined.select(
        *[F.col(quoted(c)) for c in measured.columns if c != m],
        F.struct(F.col(f"{m}.*"), failed.alias("base_failed"), (~failed & ~bad).alias("kept")).alias(m),
    )


def quality_rules(docs: DataFrame, text="text", lang="lang", source="source", rules: Rules | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of the counts, ``base_failed`` and ``kept``, and that column's name."""
    rules = rules or Rules()
    m = fresh(docs, "__quality")
    stash = Stash(docs.sparkSession)
    measured = stash.put(measure(docs, text, m))
    fences = stash.put(thresholds(measured, m, lang, source, rules))
    return verdict(measured, fences, m, lang, source, rules), m


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``."""
    judged, m = quality_rules(docs)
    return judged.filter(F.col(f"{m}.kept")).select(*own(docs))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every row of ``documents``; the text is measured once and not carried along."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rules, stash = Rules(), Stash(spark)
    measured = stash.put(measure(docs, "text", "m").drop("text"))
    fences = stash.put(thresholds(measured, "m", "lang", "source", rules))
    return verdict(measured, fences, "m", "lang", "source", rules).select(
        "doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    )


SQL_TEXT = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p+1], w[p+2]) AS c FROM pos),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p+1, p+2]) AS q FROM g WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  word_chars * 100 // greatest(n_words, 1) AS v1, n_symbols * 10000 // greatest(word_chars, 1) AS v2,
  n_dup_lines * 10000 // greatest(n_lines, 1) AS v3, n_repeat_words * 10000 // greatest(n_words, 1) AS v4 FROM m),
x AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([v1, v2, v3, v4]) AS v FROM b WHERE NOT base_failed),
s AS (SELECT lang, source, k, CASE WHEN v < 128 THEN v ELSE (length(bin(v)) - 7) * 128 + (v >> CAST(length(bin(v)) - 7 AS BIGINT)) END AS bucket, count(*) AS n
  FROM x GROUP BY ALL),
c AS (SELECT lang, source, k, bucket, n, sum(n) OVER (PARTITION BY lang, source, k ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, k) AS total FROM s),
sl AS (SELECT lang, k, bucket, sum(n) AS n FROM s GROUP BY ALL),
cl AS (SELECT lang, k, bucket, n, sum(n) OVER (PARTITION BY lang, k ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, k) AS total FROM sl),
e AS (SELECT lang, source, k, upto, total, CASE WHEN bucket < 128 THEN bucket ELSE ((bucket % 128 + 1) << CAST(bucket // 128 AS BIGINT)) - 1 END AS u FROM c),
el AS (SELECT lang, k, upto, total, CASE WHEN bucket < 128 THEN bucket ELSE ((bucket % 128 + 1) << CAST(bucket // 128 AS BIGINT)) - 1 END AS u FROM cl),
q AS (SELECT lang, source, k, min(total) AS n, min(u) FILTER (upto * 4 >= total) AS q1, min(u) FILTER (upto * 4 >= total * 3) AS q3, min(u) FILTER (upto * 10 >= total * 9) AS q9 FROM e GROUP BY ALL),
ql AS (SELECT lang, k, min(u) FILTER (upto * 4 >= total) AS q1, min(u) FILTER (upto * 4 >= total * 3) AS q3, min(u) FILTER (upto * 10 >= total * 9) AS q9 FROM el GROUP BY ALL),
y AS (SELECT q.lang, q.source, q.k, CASE WHEN n >= 100 THEN q.q1 ELSE ql.q1 END AS q1, CASE WHEN n >= 100 THEN q.q3 ELSE ql.q3 END AS q3, CASE WHEN n >= 100 THEN q.q9 ELSE ql.q9 END AS q9
  FROM q JOIN ql ON q.lang IS NOT DISTINCT FROM ql.lang AND q.k = ql.k),
z AS (SELECT lang, source, k, q3 + 3 * greatest(q3 - q1, q9 - q3) AS most, q1 - 3 * greatest(q3 - q1, q9 - q3) AS least FROM y),
f AS (SELECT lang, source, max(most) FILTER (k = 1) AS m1, max(most) FILTER (k = 2) AS m2, max(most) FILTER (k = 3) AS m3, max(most) FILTER (k = 4) AS m4,
  max(least) FILTER (k = 1) AS l1 FROM z GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(v1 > m1, false) OR coalesce(v2 > m2 + 30000 // greatest(word_chars, 1), false) OR coalesce(v3 > m3 + 30000 // greatest(n_lines, 1), false) OR coalesce(v4 > m4 + 180000 // greatest(n_words, 1), false) OR coalesce(v1 < l1, false)) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {"op2_quality_rules": SQL_TEXT}
