import re

import numpy as np
import pyarrow as pa
import pytest

from pagelayout.llm import textops as t

TEXTS = ["", None, "one", "Ünï cödé  wörds\tand\nlines\x0bmore", " lead trail ", "a" * 5000, "A-b_C 12\x7f34 é" * 50, "x" + "\u3000" + "y"]


@pytest.mark.parametrize(("table", "pattern"), [(t.SPACE_WORDS, r"[^\x20\x09-\x0D]+"), (t.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_are_those_of_the_pattern(table, pattern):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    classes = table.copy()
    if table is t.ALNUM_WORDS:
        # A-Z count as the letters that they are lower-cased to
        classes[65:91] = True
    seen: dict[int, str] = {}
    rows = list(t.texts_words(pa.array(TEXTS), table))
    assert [r for r, *_ in rows] == list(range(len(TEXTS)))
    for (_, raw, h, s, e), text in zip(rows, TEXTS, strict=True):
        want = re.findall(pattern, (text or "").translate(lower))
        got = [bytes(raw[a:b]).decode().translate(lower) for a, b in zip(s, e, strict=True)]
        assert got == want
        for x, w in zip(h.tolist(), want, strict=True):
            assert seen.setdefault(x, w) == w


def test_long_texts_are_cut_at_separators(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + "z" * 500
    whole = next(iter(t.texts_words(pa.array([text]), t.SPACE_WORDS)))
    monkeypatch.setattr(t, "BLOCK_BYTES", 100)
    cut = next(iter(t.texts_words(pa.array([text]), t.SPACE_WORDS)))
    for a, b in zip(whole[1:], cut[1:], strict=True):
        assert np.array_equal(a, b)


def test_grams_tell_order():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], dtype=np.uint64)
    g = t.grams(h, 3)
    assert len(g) == 6 and g[0] == g[3] and len(set(g.tolist())) == 5
    assert len(t.grams(h[:2], 3)) == 0


def test_sliced_arrays():
    rows = list(t.texts_words(pa.array(["a b", "c", "d e f"])[1:], t.SPACE_WORDS))
    assert [len(h) for _, _, h, _, _ in rows] == [1, 3]
