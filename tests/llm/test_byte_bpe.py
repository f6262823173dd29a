import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.byte_bpe import ByteBpe, coded, decode_ids, default_path, encode_texts, read_ranks

DOCS = "doc_id long, text string, ids string, decoded long"


@lru_cache
def ranks():
    return read_ranks(default_path())


@lru_cache
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


@lru_cache
def coder(text_leaf, piece_leaf):
    return ByteBpe(ranks(), public_tokenizers.PATTERN, text_leaf, piece_leaf)


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"aabst  \t\n'relvmd.,!19é中　Ω", "'re", "  ", "ing", "the"]), max_size=70).map("".join), st.sampled_from([(1, 1), (2, 3), (5, 8), (40, 64)]))
def test_every_split_gives_the_librarys_ids(text, leaves):
    made = coder(*leaves).encode(text)
    assert ids(made) == library().encode_ordinary(text)
    assert coder(*leaves).decode(np.frombuffer(made, "<i4")) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aab 'r\n", max_size=12), st.text(alphabet="aab 'er\n", max_size=12), st.text(alphabet="ab 's\n", max_size=12))
def test_joins_are_associative(a, b, c):
    """Segments of any three neighbours join to the same ids in either order."""
    x, text = coder(3, 2), a + b + c
    i, j, n = len(a), len(a) + len(b), len(text)
    if 0 < i < j < n:
        one, two, three = x.segment(text, 0, i), x.segment(text, i, j), x.segment(text, j, n)
        left, right = x.join(text, x.join(text, one, two), three), x.join(text, one, x.join(text, two, three))
        assert left == right and ids(left.ids) == library().encode_ordinary(text)


def test_windows_grow_through_long_runs():
    """Of equal letters every token may move when one is added: the windows reach the ends."""
    for text in ("a" * 3001, "ab" * 700 + "c", "é" * 999, " " * 1501 + "x", "\n" * 400 + " x", "!?" * 800):
        assert ids(coder(16, 4).encode(text)) == ids(coder(8192, 64).encode(text)) == library().encode_ordinary(text)


def test_rows(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 12))) for _ in range(400)]
    texts = [None, "", " ", "same text", "same text", "x'll 12  y", " ".join(rng.choice(words, 60_000))] + [" ".join(rng.choice(words, 30)) for _ in range(50)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (3, "same text", "x", 1)]
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(map(tuple, coded(frame).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        found = library().encode_ordinary(t or "")
        want.append((i, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert coded(frame.limit(0)).collect() == []
    again = {r.doc_id: (r.ids, r.decoded) for r in decode_ids(encode_texts(frame)).collect()}
    assert again[6] == (library().encode_ordinary(texts[6]), bytearray(texts[6].encode()))


def test_parts_of_ids_decode(spark):
    """Cut ids give bytes that need not be text; null ids give null; ids that the file lacks fail."""
    frame = spark.createDataFrame([(1, library().encode_ordinary("中文é")[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode_ids(frame).collect()}
    assert got == {1: bytearray(library().decode_bytes(library().encode_ordinary("中文é")[:1])), 2: None, 3: bytearray()}
    with pytest.raises(Exception, match="KeyError"):
        decode_ids(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")).collect()
