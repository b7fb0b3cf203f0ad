"""The text kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
alphabet = st.text(alphabet=st.sampled_from(list("abAB \t\n\x0b\x1c é中.")), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), alphabet), max_size=8))
def test_words_are_the_same_words(texts):
    h, off = K.words(pa.array(texts, pa.string()))
    plain = [WORD.findall((t or "").translate(LOW)) for t in texts]
    assert np.diff(off).tolist() == [len(w) for w in plain]
    seen = {}
    for word, x in zip([w for ws in plain for w in ws], h.tolist(), strict=True):
        assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=200, deadline=None)
@given(st.lists(alphabet, max_size=8), st.integers(1, 6))
def test_sets_have_the_same_sizes(texts, k):
    s, off = K.distinct(*K.shingles(*K.words(pa.array(texts, pa.string())), k))
    for i, t in enumerate(texts):
        w = WORD.findall(t.translate(LOW))
        want = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        assert off[i + 1] - off[i] == len(want)


def test_blocks_do_not_change_hashes(monkeypatch):
    text = pa.array([" ".join(f"word{i}" for i in range(500)), "x" * 3000])
    want = K.words(text)[0]
    monkeypatch.setattr(K, "BLOCK", 64)
    assert (K.words(text)[0] == want).all()


def test_slices_and_large_strings():
    a = pa.array(["one two", None, "three", "four five six"])
    assert np.diff(K.words(a.slice(1, 3))[1]).tolist() == [0, 1, 3]
    assert np.diff(K.words(a.cast(pa.large_string()))[1]).tolist() == [2, 0, 1, 3]


def test_words_made_to_collide_do_not():
    """Thue-Morse words: any polynomial modulo a power of two takes one for its complement."""
    x = "a"
    while len(x) < 1 << 12:
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    h, _ = K.words(pa.array([x, y, x.upper()]))
    assert h[0] != h[1] and h[0] == h[2]


def test_slices_cover_a_column():
    col = pa.array(["a" * n for n in (0, 5, 900, 3, 0, 20)] + [None])
    parts = list(K.slices(col, 10))
    assert [i for i, _ in parts] == [0, 2, 3, 5, 6] and pa.concat_arrays([p for _, p in parts]).equals(col)
    assert list(K.slices(pa.array([], pa.string()))) == []
