"""What a worker remembers: of one operator at a time, and letters once whatever marks or newlines are beside them."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from beaconry.llm import hashed_text, minhash, quality_classifier, token_ids

BATCH = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two three four five", "six seven"])], ["id", "text"])


def test_one_operator_at_a_time():
    tokens = token_ids.Params(token_ids.public_vocabulary())
    assert sum(b.num_rows for b in minhash._sets([BATCH], minhash.Params())) == 2 and minhash._words
    model = SimpleNamespace(value=(np.zeros(hashed_text.DIM), np.array([-1.0, 0.0])))
    texts = BATCH.select(["text"])
    assert sum(b.num_rows for b in quality_classifier._graded([texts], model)) == 2 and hashed_text._slots and not minhash._words
    counted = [n for b in token_ids._counted([BATCH], tokens) for n in b.column(1).to_pylist()]
    assert token_ids._encoders and not hashed_text._slots and not minhash._words
    again = [n for b in token_ids._counted([BATCH], tokens) for n in b.column(1).to_pylist()]
    assert counted == again and len(token_ids._encoders) == 1
    list(minhash._sets([BATCH], minhash.Params()))
    assert not token_ids._encoders


class Spy:
    def __init__(self, model):
        self.model, self.seen = model, []

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.model.encode_batch_fast(texts, **options)


def test_known_letters_are_not_encoded_again():
    e = token_ids.Encoder(token_ids.public_vocabulary())
    e.batch(["x Mirabilis quodlibet\nZephyrine", "x a; b%%% c.\nA"])
    text = "x Mirabilis%%% quodlibet.\nZephyrine; Mirabilis.\nZephyrine%%%"
    want = e.model.encode(text, add_special_tokens=False).ids
    e.model = spy = Spy(e.model)
    assert np.frombuffer(e.batch([text])[0], "<u4").tolist() == want
    assert not any(word in seen for seen in spy.seen for word in ("Mirabilis", "quodlibet", "Zephyrine"))


def test_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_ids, "ROWS", 3)
    monkeypatch.setattr(token_ids, "BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["", "", "", "", "x" * 6, "x" * 4, "x", "x" * 30, "x"])], ["id", "text"])
    parts = [p.column(0).to_pylist() for p in token_ids._parts([batch.slice(0, 0), batch])]
    assert sum(parts, []) == list(range(9)) and parts == [[0, 1, 2], [3, 4, 5], [6], [7], [8]]


def test_hard_texts():
    pieces = ["a", "Word", "é", "日本", "'s", "12", ".", ",", "...", "%%", " ", "  ", "\n", "\n\n", "\t", "\r\n", "<|endoftext|>", "<|", "|>", "ª", "²", "\xa0", "\x1c", "𝄞", "ɐ", "Ġ", "Ċ", "\x00", "́", " x.\nY"]
    g = np.random.default_rng(5)
    texts = ["".join(g.choice(pieces, g.integers(0, 14))) for _ in range(3000)]
    e, n = (token_ids.Encoder(token_ids.public_vocabulary(), counts) for counts in (False, True))
    want = [x.ids for x in e.model.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.batch(texts)] == want and n.batch(texts) == [len(x) for x in want]
