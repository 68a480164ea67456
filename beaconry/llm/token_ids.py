"""Token-id output: texts to ids, ids to Simple-8b segments in a shard table, and back.

A shard table is a folder: ``segments`` is Parquet with one row per segment, its place (shard, segment), the ids
and token counts of its documents in order, and the coded ids (see ``simple8b``); ``manifest`` is written after it, with each
segment's place, documents, ids and first id, and the vocabulary (file name and checksum), end id and block size. Spark's
writer commits both, so a lost executor's attempts leave nothing behind, and any store that Spark writes will do. ``read_shards``
opens the folder in any session. Documents are dealt by ranges of their id (rows of one id by their texts' hash too) and sorted
inside a range, so shard and segment order is id order.

Encoding goes through the tokenizers library. A text is cut at blanks and before newlines that stand alone between
characters that aren't white space: the vocabulary's pre-tokenizer always starts a new token there, and where marks
follow a letter, so each piece encodes alone as it does in place, and a worker encodes a piece once and remembers it (a
bounded number of pieces). Texts with other white space are cut more carefully.

Defined results: a null text is an empty one, which is the end id alone; rows that repeat an id stay rows,
ordered by their texts' hash, then text; a null id sorts first; an empty table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import Stash, lean, quoted, sole, whole_text

#: Pieces that a worker remembers in each of two generations; a piece that is met again moves to the young one.
CACHE = 250_000
#: Pieces that are encoded as one text.
JOINED = 200
#: Rows and bytes of texts that are worked off at once (a longer text alone).
ROWS, BYTES = 2_000, 8 << 20
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Marks that are of no letter's pre-token (an apostrophe may start an English ending).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class Params:
    tokenizer: str
    end_id: int = 2
    block: int = 256
    #: Ids that close a segment (a longer document is a segment of its own).
    segment_ids: int = 1_000_000
    broadcast_segments: int = 1_000_000


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to little-endian 32-bit ids, by the tokenizers library; or to their numbers of ids only."""

    def __init__(self, path: str, counts: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.counts, self.join, self.none = counts, sum if counts else b"".join, 0 if counts else b""
        #: Ids of a piece behind a blank, of a piece that starts with a newline, and under " " + marks of marks behind a letter.
        self.known: dict = {}
        self.old: dict = {}
        size = self.model.get_vocab_size()
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        #: By mark, whether a token starts with it.
        self.opens = {m: np.array([(self.model.id_to_token(i) or "").startswith(byte) for i in range(size)]) for m, byte in ((" ", "\u0120"), ("\n", "\u010a"))}

    def _raw(self, pieces: list[str]) -> list:
        if self.counts:
            return [len(e) for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def _led(self, pieces: list[str], mark: str) -> list:
        """The ids of pieces that ``mark`` leads, many pieces in one text: only a piece's first token starts with the mark."""
        out = []
        for i in range(0, len(pieces), JOINED):
            part = pieces[i : i + JOINED]
            (e,) = self.model.encode_batch_fast(["".join(part)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.opens[mark][ids])
            if len(cuts) != len(part):
                out += self._raw(part)
            elif self.counts:
                out += np.diff(np.append(cuts, len(ids))).tolist()
            else:
                data, at = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                out += [data[a:b] for a, b in zip(at, at[1:])]
        return out

    def _learn(self, new: set) -> None:
        """Remember pieces, from the old generation or from the model."""
        again = new & self.old.keys()
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        new -= again
        lines, marks = [p for p in new if p[0] == "\n"], [p for p in new if p[0] == " "]
        self.known.update(zip(lines, self._led(lines, "\n")))
        self.known.update(zip(marks, self._raw([p[1:] for p in marks])))
        new.difference_update(lines, marks)
        self.known.update(zip(new, self._led([" " + p for p in new], " ")))

    def _values(self, pieces: list[str]) -> list:
        """The ids of each distinct piece; None for one that doesn't encode alone."""
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        known = self.known
        out = list(map(known.get, pieces))
        places = [i for i, v in enumerate(out) if v is None]
        heads, tails = [], []
        for i in places:
            p = pieces[i]
            base = p.rstrip(MARKS)
            last = base[-1:]
            if base != p and last <= "\u024f" and last.isalpha():  # letters, then marks: two pre-tokens; the letters are often known
                heads.append(base), tails.append(" " + p[len(base) :])
            else:
                heads.append(p), tails.append(None)
        # pieces whose ends are white space don't encode alone, but for one newline that leads
        new = {p for p in {*heads}.difference(known) if p and not p[-1].isspace() and not p[p[0] == "\n"].isspace()}
        self._learn(new.union({*tails}.difference(known, (None,))))
        for i, base, tail in zip(places, heads, tails):
            v = known.get(base)
            out[i] = v if tail is None or v is None else v + known[tail]
        return out

    def batch(self, texts) -> list:
        """The ids of each text, of a list or an Arrow array without nulls."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        # a newline starts a new token where no other white space is beside it, as a blank does
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends, coded = cut.offsets.to_numpy().astype(np.int64), cut.flatten().dictionary_encode()
        starts = ends[:-1] - ends[0]
        pieces, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        firsts, alone = [pieces[i] for i in index[starts].tolist()], (np.diff(ends) == 1).tolist()
        index[starts] = len(pieces) + np.arange(len(firsts))  # no blank is before a text's first piece
        values = self._values(pieces)
        never = np.array([v is None for v in values] + [f[-1:].isspace() or not (f or one) for f, one in zip(firsts, alone)])
        careful = np.logical_or.reduceat(never[index], starts)
        for t in self.added:
            careful |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        values = [self.none if v is None else v for v in values] + self._raw(firsts)
        if self.counts:
            out = np.add.reduceat(np.array(values, np.int64)[index], starts).tolist()
        else:
            joined = pa.array(values, pa.large_binary()).take(pa.array(index))
            at = np.frombuffer(joined.buffers()[1], np.int64, len(index) + 1)[np.append(starts, len(index))].tolist()
            data = memoryview(joined.buffers()[2] or b"")
            out = [bytes(data[a:b]) for a, b in zip(at, at[1:])]
        for i in np.flatnonzero(careful).tolist():  # with pieces that don't encode alone
            out[i] = self._careful(texts[i].as_py())
        return out

    def _careful(self, text: str):
        """A text with longer or other white space: cut only where that is sure to be the same."""
        pieces = _SAFE.split(text)
        return self.join(self._raw([pieces[0], *(" " + p for p in pieces[1:])]))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, counts: bool = False) -> Encoder:
    if (path, counts) not in _encoders:
        _encoders[path, counts] = Encoder(path, counts)
    return _encoders[path, counts]


def _parts(batches):
    """Slices of batches (id, text), of at most ROWS rows and BYTES of text, or a row."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BYTES, "right"))
            hi = min(max(hi, lo + 1), lo + ROWS)
            yield batch.slice(lo, hi - lo)
            lo = hi


SEGMENTS = "shard int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, coded binary"


def _segments(batches, p: Params):
    sole(_encoders.clear)
    shard, number, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0
    end = np.array([p.end_id], "<u4").tobytes()

    def row():
        ids = np.frombuffer(b"".join(held), "<u4")
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())), pa.array([simple8b.encode(ids, p.block)], pa.binary())],
            ["shard", "segment", "n_ids", "doc_ids", "lengths", "coded"],
        )

    for part in _parts(batches):
        for doc, ids in zip(part.column(0).to_pylist(), encoder(p.tokenizer).batch(part.column(1))):
            docs.append(doc), held.append(ids + end)
            size += len(held[-1]) // 4
            if size >= p.segment_ids:
                yield row()
                number, docs, held, size = number + 1, [], [], 0
    if docs:
        yield row()


def _counted(batches, p: Params):
    sole(_encoders.clear)
    for part in lean(_parts(batches)):
        n = [x + 1 for x in encoder(p.tokenizer, counts=True).batch(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["id", "n"])


def _encoded(batches, p: Params):
    sole(_encoders.clear)
    for part in _parts(batches):
        ids = [np.append(np.frombuffer(x, "<u4"), p.end_id).astype(np.int32) for x in encoder(p.tokenizer).batch(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), whole_text(text_col).alias("text"))


def lengths(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n``: each row's number of ids, its end id included."""
    return _texts(docs, id_col, text_col).mapInArrow(lambda b: _counted(b, p), "id long, n long")


def encoded(docs: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids``: each row's ids, its end id included."""
    return _texts(docs, id_col, text_col).mapInArrow(lambda b: _encoded(b, p), "id long, ids array<int>")


def write_shards(docs: DataFrame, path: str, p: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shard table of ``docs`` into the folder ``path`` and return it as ``read_shards`` does."""
    spark = docs.sparkSession
    ordered = _texts(docs, id_col, text_col).withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text")
    ordered.select("id", "text").mapInArrow(lambda b: _segments(b, p), SEGMENTS).write.parquet(f"{path}/segments")
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    with open(p.tokenizer, "rb") as f:
        known = {"vocabulary": os.path.basename(p.tokenizer), "vocabulary_sha256": hashlib.sha256(f.read()).hexdigest(), "end_id": p.end_id, "block": p.block}
    _starts(segments).select("*", *[F.lit(v).alias(k) for k, v in known.items()]).write.parquet(f"{path}/manifest")
    return read_shards(spark, path, p.broadcast_segments)


def _starts(shards: DataFrame) -> DataFrame:
    """Each segment's place, documents and ids, and ``start``: the number of ids before it."""
    places = shards.select("shard", "segment", "n_ids", F.size("lengths").alias("n_docs"))
    totals = places.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # one window over all shards: a row for each, as many as the writer had tasks
    first = totals.select("shard", F.coalesce(F.sum("total").over(upto(Window.orderBy("shard"))), F.lit(0)).alias("first"))
    inside = places.withColumn("inside", F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("shard").orderBy("segment"))), F.lit(0)))
    return inside.join(first, "shard").select("shard", "segment", "n_docs", "n_ids", (F.col("first") + F.col("inside")).alias("start"))


def read_shards(spark: SparkSession, path: str, broadcast_segments: int = 1_000_000) -> DataFrame:
    """The segments of a shard table with their starts; fails if the table was never finished."""
    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "segment", "start")
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    return segments.join(F.broadcast(manifest) if manifest.count() <= broadcast_segments else manifest, ["shard", "segment"])


def documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a shard table."""
    return shards.select("start", "doc_ids", "lengths", "coded").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(batches):
    for batch in batches:
        starts, docs, lengths, coded = (batch.column(i) for i in range(4))
        for start, ids, sizes, data in zip(starts.to_pylist(), docs.to_pylist(), lengths.to_pylist(), coded):
            raw = simple8b.decode(data.as_py()).astype("<u4")
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, written as shards and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents(write_shards(docs, Stash(spark).place(), Params(public_vocabulary())))


QUERIES = {"op8_token_ids": op8_token_ids}
SQL: dict[str, str] = {}
