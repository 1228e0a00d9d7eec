import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from orbitalis.llm import textkernel as tk
from orbitalis.llm.tokens import encoder, vocabulary_path
from tests.llm.fixtures import words_of

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab AB\t\n\x0b\x0c\r  éß\x1c\x85Z"), max_size=30)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_and_hashes(rows):
    data, off = tk.text_bytes(pa.array(rows, pa.string()))
    words = tk.Words(data, off)
    got = [data[s:e].tobytes().decode() for s, e in zip(words.start, words.end, strict=True)]
    assert got == [w for t in rows for w in words_of(t)]
    assert np.diff(words.first).tolist() == [len(words_of(t)) for t in rows]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) for w in got]
    for h, names in ((words.hashes(), [w.encode() for w in got]), (words.hashes(fold=True), low)):
        assert len(set(zip(names, h.tolist(), strict=True))) == len(set(names)) == len(set(h.tolist()))


def test_windows_depend_on_order_only():
    h = np.array([1, 2, 3, 1, 2, 3, 2], np.uint64)
    w = tk.windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4 and len(tk.windows(h, 8)) == 0


def test_long_text_in_blocks():
    text = "word " * (tk.BLOCK // 2)
    data, off = tk.text_bytes(pa.array([text, "word"]))
    assert len(np.unique(tk.Words(data, off).hashes())) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1é .,'s\n\t  <|>$  "), max_size=40), max_size=4))
def test_units_give_the_ids_of_the_whole(rows):
    e = encoder(vocabulary_path())
    rows = [*rows, "<|endoftext|> x", "it's  'd we'll 12 3"]
    assert e.encode(rows) == [x.tobytes() for x in e.whole(rows)]
    assert e.encode([None, ""]) == [b"", b""]


def test_scratch_tables_can_be_cleared(spark):
    from orbitalis.llm import storage

    storage.clear(spark)
    table = storage.materialize(spark.range(3), "t")
    assert table.count() == 3 and storage.clear(spark) == 1 and storage.clear(spark) == 0
