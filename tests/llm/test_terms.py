import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from netweir.llm.terms import counted, slices, term_bytes, tokens

PATTERN = {True: r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", False: r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"}


def plain(text, digits):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x).encode() for x in re.findall(PATTERN[digits], text or "")]


@pytest.mark.parametrize("digits", [True, False])
@pytest.mark.parametrize("rows", [(0, 2002), (5, 77), (0, 0), (2000, 2002)])
def test_same_as_the_pattern(digits, rows):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB9 .É中😀\x00\x7f_") for _ in range(rnd.randint(0, 12))) for _ in range(2000)] + [None, ""]
    column, texts = pa.array(texts, pa.string())[rows[0] : rows[1]], texts[rows[0] : rows[1]]
    found, at = tokens(column, term_bytes(digits))
    assert found.to_pylist() == [x for t in texts for x in plain(t, digits)]
    assert at.tolist() == [i for i, t in enumerate(texts) for _ in plain(t, digits)]
    names, row, code, n = counted(column, term_bytes(digits))
    assert {(int(i), names[c]): int(k) for i, c, k in zip(row, code, n)} == {(i, w): k for i, t in enumerate(texts) for w, k in Counter(plain(t, digits)).items()}


def test_slices():
    texts = pa.array(["aa", "b" * 9, "", None, "c", "d" * 30, ""])
    assert list(slices(texts, 10)) == [(0, 1), (1, 5), (5, 6), (6, 7)]
    assert list(slices(pa.array([], pa.string()))) == []
