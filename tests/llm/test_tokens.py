from __future__ import annotations

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokens = pytest.importorskip("siftwire.llm.tokens")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary")

ODD = ["", " ", "\n\n  \n" * 9, "'re" * 40, "a" * 3000, " " * 500 + "x", "x'r" + "e" * 30, "<|endoftext|> <|endoftext|>", "é́" * 80, "12 34'5" * 30, "\x1c.\x1d a", "كلمة، أخرى؟ " * 40, "中文，没有空格。" * 60, "🙂👩‍👩‍👧 " * 20, "a b　c\r\nd"]


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    with open(tokens.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [3, 17, 100, 16384])
@pytest.mark.parametrize("text", ODD)
def test_tree_equals_one_pass(plain, leaf, text):
    assert list(tokens.Encoder(leaf=leaf).encode(text)) == plain.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'resSTx1 .,\n\t \x1céم؟中", max_size=60), st.integers(1, 12))
def test_tree_on_any_text(text, leaf):
    e = _small(leaf)
    assert list(e.encode(text)) == e._coder.encode_ordinary(text)
    assert e.decode(e.encode(text)) == text


_CACHE: dict = {}


def _small(leaf):
    if leaf not in _CACHE:
        _CACHE[leaf] = tokens.Encoder(leaf=leaf)
    return _CACHE[leaf]


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "hello world", "k"), (3, "hello world", "k")], "doc_id bigint, text string, key string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encode_documents(df).collect())
    assert got[:2] == [(1, []), (2, [])] and len(got) == 4 and got[2] == got[3] and len(got[2][1]) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokens.encode_documents(df).count() == tokens.pack_documents(df).count() == tokens.split_documents(df).count() == 0


def test_packing(spark):
    e = tokens.encoder()
    docs = [(i, "word " * (7 * i % 97)) for i in range(300)] + [(900, "long " * 500), (901, None), (902, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = tokens.pack_documents(df, capacity=100).collect()
    size = {}
    for r in rows:
        size[r.container_id] = size.get(r.container_id, 0) + r.n_tokens
    assert max(size.values()) <= 100
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert set(pieces) == {d for d, _ in docs}
    for d, t in docs:
        n = len(e.encode(t))
        p = sorted(pieces[d])
        assert sum(x[2] for x in p) == n and len(p) == max(1, -(-n // 100))
        assert [x[1] for x in p] == [100 * i for i in range(len(p))]
    assert sum(size.values()) / (100 * len(size)) > 0.95


def test_best_fit_never_overfills():
    import numpy as np

    sizes = np.random.default_rng(3).integers(0, 101, 500)
    bins = tokens.best_fit(sizes, 100)
    assert np.bincount(bins, weights=sizes).max() <= 100
    assert len(np.unique(bins)) <= sizes.sum() / 100 * 1.05 + 2


def test_hilbert_key_walks_to_neighbours():
    at = {}
    for x in range(8):
        for y in range(8):
            for z in range(8):
                at[tokens.hilbert_key([x, y, z], 3)] = (x, y, z)
    assert sorted(at) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(511))


@pytest.mark.parametrize("limit, overlap", [(16, 4), (64, 0), (128, 16)])
@pytest.mark.parametrize("text", [*ODD, "One sentence. Another one, longer than that; still going.\n\nA new paragraph! " * 12])
def test_split(text, limit, overlap):
    e = tokens.encoder()
    pieces = tokens.split_text(text, e, limit, overlap)
    assert "".join(text[o:z] for _, z, o, _ in pieces) == text
    for s, z, o, n in pieces:
        assert n <= limit and n == len(e._coder.encode_ordinary(text[s:z])) and s <= o
    assert len(pieces) == 1 or len(e.encode(text)) > limit


def test_split_prefers_paragraphs():
    e = tokens.encoder()
    text = "\n\n".join("This is sentence one. And this is two." for _ in range(8))
    cuts = [text[o : o + 2] for _, _, o, _ in tokens.split_text(text, e, 48, 0)[1:]]
    assert cuts and set(cuts) == {"\n\n"}


def test_overlap_repeats_the_end(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta. " * 30), (2, None)], "doc_id bigint, text string")
    rows = sorted(tokens.split_documents(df, 40, 8).collect())
    one = [r for r in rows if r.doc_id == 1]
    assert all(0 < r.own_start - r.start for r in one[1:]) and all(r.piece == ("alpha beta gamma delta. " * 30)[r.start : r.end] for r in one)
    assert [(r.piece_no, r.n_tokens, r.piece) for r in rows if r.doc_id == 2] == [(0, 0, "")]
    with pytest.raises(ValueError):
        tokens.split_documents(df, 8, 8)


@pytest.mark.parametrize("text", ["".join(f"Thebanksaidthatitsbookgrewby{i}.7%inMay,whilefeesfell." for i in range(120)), "中文，没有空格。" * 300, "a" * 30000, "Words before. " * 5 + "".join(f"x{i}" for i in range(2000)) + " words behind it." * 60])
def test_overlap_inside_an_unbroken_run(text):
    e = tokens.encoder()
    pieces = tokens.split_text(text, e, 512, 64)
    assert len(pieces) > 1 and "".join(text[o:z] for _, z, o, _ in pieces) == text
    for s, z, o, n in pieces:
        assert n == len(e._coder.encode_ordinary(text[s:z])) <= 512
    assert all(s < o and (s == 0 or 32 <= len(e._coder.encode_ordinary(text[s:o]))) and len(e._coder.encode_ordinary(text[s:o])) <= 64 for s, _, o, _ in pieces[1:])


def test_runs_are_cut_behind_marks():
    text = "".join(f"Thebanksaidthatitsbookgrewby{i}.7%inMay,whilefeesfell." for i in range(120))
    pieces = tokens.split_text(text, tokens.encoder(), 512, 64)
    assert all(text[o - 1] == "." and not text[o].isdigit() for _, _, o, _ in pieces[1:])


def _windows(sizes, capacity, window):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes)), pa.int64()), pa.array(sizes, pa.int64())], ["key", "n_tokens"])
    return [(names, part) for names, part in tokens.packed_windows(iter([batch]), capacity, window)]


def test_a_window_that_never_fills_is_not_carried_on():
    """Items of 1200 tokens leave every container at 59 %; none of them waits for more than PATIENCE windows."""
    out = _windows([1200] * 100 * 20, 2048, 100)
    done = 0
    for i, (_, part) in enumerate(out):
        done += part.num_rows
        assert (i + 1) * 100 - done <= (tokens.PATIENCE + 1) * 100
    assert done == 2000
    bins: dict = {}
    for names, part in out:
        for c, n in zip(names.tolist(), part["n_tokens"].to_pylist()):
            bins[c] = bins.get(c, 0) + n
    assert max(bins.values()) <= 2048


def test_vocabularies_of_any_size_are_projected():
    import numpy as np

    got = tokens._buckets(np.array([0, 150_000, 2_000_000_000], np.int32))
    assert got.min() >= 0 and got.max() < tokens._BUCKETS


def test_every_text_goes_through_the_tree(monkeypatch):
    e = _small(16)
    seen = []
    monkeypatch.setattr(e, "_join", lambda *a, f=type(e)._join: (seen.append(1), f(e, *a))[1])
    assert list(e.encode("one short text of words")) == e._coder.encode_ordinary("one short text of words") and seen
