"""Language-model scores by a subword lattice: the marginal probability of a text over all segmentations.

The pieces are an existing subword vocabulary's. A word's probability is the sum over all its
segmentations into pieces of the product of the pieces' unigram probabilities, by a forward recursion in
log space; pieces begin at most at a word's start (its mark), so a text's marginal is the product over its
words and the closing end token. The vocabulary file ranks its pieces by merges and holds no unigram
probabilities, so these are learned from the training documents: pieces counted in the vocabulary's own
segmentation of every training word, add-one smoothed. A character that no piece covers takes the path
of its bytes' pieces.

Both the word counts (for the base score) and the piece counts come from all training documents. Words
are counted per partition before anything moves; the ``frequent`` most frequent words (a fixed number, so
their broadcast is bounded) are scored where the text is, the other words of a text move as one row per
distinct word and meet the counts in a join on the word. Nothing is dropped.

Defined results: a null text is an empty one (only the end token); a null id has the empty text's checksum,
which trains; repeated rows count and are scored each; an empty table gives no rows; a table whose rows are
all held out has N = 0 and V = 0; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash

MARK = "▁"
#: Names the end token in tables of words; no word holds a blank.
END = b" end"


@dataclass(frozen=True)
class Params:
    vocabulary: str
    frequent: int = 250_000
    #: Distinct words that a partition counts before it passes them on.
    held_words: int = 400_000


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


class Lattice:
    """Piece log-probabilities (natural) and the forward recursion."""

    def __init__(self, pieces: dict[str, float], bytes_: list[float]):
        self.pieces, self.bytes = pieces, bytes_
        self.longest = max(map(len, pieces), default=1)
        self.chars = {c for p in pieces for c in p}

    def word(self, word: str) -> float:
        """log of the sum over all segmentations of the marked word."""
        text, get, longest, singles = MARK + word, self.pieces.get, self.longest, self.pieces
        forward = [0.0]
        for j in range(1, len(text) + 1):
            paths = []
            for i in range(max(0, j - longest), j):
                p = get(text[i:j])
                if p is not None:
                    paths.append(forward[i] + p)
            if text[j - 1] not in singles:  # no piece of its own: its bytes
                paths.append(forward[j - 1] + sum(self.bytes[b] for b in text[j - 1].encode("utf-8", "surrogatepass")))
            top = max(paths)
            forward.append(top + math.log(sum([math.exp(x - top) for x in paths])) if len(paths) > 1 else top)
        return forward[-1]


_models: dict[str, object] = {}


def vocabulary(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def lattice(path: str, counts: np.ndarray) -> Lattice:
    """The lattice of add-one smoothed piece counts (by id)."""
    model = vocabulary(path)
    logs = np.log((counts + 1) / (counts.sum() + len(counts)))
    pieces, bytes_ = {}, [0.0] * 256
    for i in range(len(counts)):
        if model.is_byte(i):
            bytes_[int(model.id_to_piece(i)[3:5], 16)] = float(logs[i])
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[model.id_to_piece(i)] = float(logs[i])
    return Lattice(pieces, bytes_)


def _count(batches, p: Params):
    """``word, trained, c`` of a partition; a partial count goes out when it holds many words."""
    trained, other = Counter(), Counter()

    def out():
        keys = list(trained.keys() | other.keys())
        rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([trained[k] for k in keys], pa.int64())], ["word", "c"])
        trained.clear(), other.clear()
        return rows

    for batch in batches:
        for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if held:
                other.update(words)
            else:
                trained.update(words)
                trained[END] += 1
        if len(trained) + len(other) > p.held_words:
            yield out()
    yield out()


def _pieces(batches, p: Params):
    """Piece counts of a partition's words, weighted by the words' counts."""
    model = vocabulary(p.vocabulary)
    total = np.zeros(model.get_piece_size(), np.int64)
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        kept = [w != END for w in words]
        ids = model.encode([w.decode("utf-8") for w, k in zip(words, kept) if k])
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(lengths.sum()))
        total += np.bincount(flat, weights=np.repeat(counts[np.array(kept, bool)], lengths), minlength=len(total)).astype(np.int64)
        total[model.eos_id()] += int(counts[~np.array(kept, bool)].sum())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["piece", "c"])


def _score_words(batches, p: Params, counts):
    """``word, c, lp``: the words with their log10 probability under the lattice."""
    model = lattice(p.vocabulary, counts.value)
    end = float(np.log((counts.value[vocabulary(p.vocabulary).eos_id()] + 1) / (counts.value.sum() + len(counts.value))))
    for batch in batches:
        lp = [end if w == END else model.word(w.decode("utf-8")) for w in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(lp) / math.log(10), pa.float64())], ["word", "c", "lp"])


PARTS = "row long, doc_id long, held boolean, word binary, times long, tokens long, hits long, base double, score double"


def _score_texts(batches, table, n: int, v: int):
    """Per text one row of its frequent words' sums (word null), and a row for each other distinct word."""
    known, log, number = table.value, math.log10, TaskContext.get().partitionId() << 40
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part, rows = batch.slice(lo, 2000), []
            for doc, held, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                number += 1
                words = words_of(text)
                words.append(END)
                hits, base, score = 0, [], []
                for w, k in Counter(words).items():
                    hit = known.get(w)
                    if hit is None:
                        rows.append((number, None, None, w, k, 0, 0, 0.0, 0.0))
                    else:
                        c, lp = hit
                        hits += k * (c > 0)
                        base.append(k * log((c + 1) / (n + v + 1))), score.append(k * lp)
                rows.append((number, doc, held, None, 0, len(words), hits, math.fsum(base), math.fsum(score)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``."""
    p = p or Params(public_vocabulary())
    spark = docs.sparkSession
    stash = Stash(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held"))
    counted = texts.select("text", "held").mapInArrow(lambda b: _count(b, p), "word binary, c long")
    words = stash.put(counted.groupBy("word").agg(F.sum("c").alias("c")))
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    pieces = words.filter("c > 0").mapInArrow(lambda b: _pieces(b, p), "piece long, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()  # at most the vocabulary
    counts = np.zeros(vocabulary(p.vocabulary).get_piece_size(), np.int64)
    for r in pieces:
        counts[r["piece"]] = r["c"]
    shared = spark.sparkContext.broadcast(counts)
    scored = stash.put(words.mapInArrow(lambda b: _score_words(b, p, shared), "word binary, c long, lp double"))
    least = _least_count(scored, p.frequent)
    top = scored.filter(F.col("c") >= least).toArrow()  # at most p.frequent words
    table = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), zip(top.column(1).to_pylist(), top.column(2).to_pylist()))))
    del top
    parts = stash.put(texts.select("doc_id", "held", "text").mapInArrow(lambda b: _score_texts(b, table, n, v), PARTS))
    seen = F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))
    rare = parts.filter("word IS NOT NULL").select("row", "word", "times").join(scored, "word").groupBy("row").agg(
        F.sum(seen).alias("hits"), F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))).alias("base"), F.sum(F.col("times") * F.col("lp")).alias("score")
    )
    none = F.lit(None)
    rare = rare.select("row", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held"), F.lit(0).cast("long").alias("tokens"), "hits", "base", "score")
    whole = parts.filter("word IS NULL").select("row", "doc_id", "held", "tokens", "hits", "base", "score").union(rare)
    out = whole.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), *[F.sum(c).alias(c) for c in ("tokens", "hits", "base", "score")])
    return out.select(
        "doc_id", "held_out", F.col("tokens").alias("n_tokens"), F.col("hits").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("score").alias("score"),
    )


def _least_count(scored: DataFrame, most: int) -> int:
    """The least count c > 0 such that at most ``most`` words occur c times or more."""
    kinds = scored.filter("c > 0").groupBy(F.least("c", F.lit(100_000)).alias("c")).count().collect()  # at most 100,000 rows
    total, least = 0, None
    for r in sorted(kinds, key=lambda r: -r["c"]):
        total += r["count"]
        if total > most:
            break
        least = r["c"]
    return least if least is not None else 2**62


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, scored by a model of those whose remainder isn't 2."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_lattice_lm": op3_lattice_lm}
SQL: dict[str, str] = {}
