"""Terms of whole texts, a batch at a time: runs of bytes of a class, A-Z lower-cased.

A class holds ASCII letters (and digits, if asked for) and every byte of a character beyond
ASCII, so runs of bytes of UTF-8 are the runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20  # texts taken apart at once; a longer text is taken apart alone

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def term_bytes(digits: bool) -> np.ndarray:
    """Which bytes belong to terms."""
    inside = np.zeros(256, bool)
    inside[65:91] = inside[97:123] = inside[128:] = True
    inside[48:58] = digits
    return inside


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that cover ``texts``, of at most ``most`` bytes or one row each."""
    ends = np.cumsum(np.diff(_offsets(texts)))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def tokens(texts: pa.Array, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of ``texts`` with repeats, in order, and the row of each. Null has none."""
    if texts.null_count:
        texts = texts.fill_null("")
    cuts = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    solid = inside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    borders = cuts[:-1][cuts[:-1] < len(data)]
    first[borders] = solid[borders]  # a term ends with its text
    kept = LOWER[data[solid]]
    starts = np.flatnonzero(first[solid])
    rows = np.searchsorted(cuts, np.flatnonzero(first), "right") - 1
    ends = np.append(starts, len(kept)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())]), rows


def counted(texts: pa.Array, inside: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of ``texts``, and for every (row, term): row, place of the term, occurrences;
    sorted by row."""
    found, rows = tokens(texts, inside)
    coded = found.dictionary_encode()
    terms = coded.dictionary.to_pylist()
    if not terms:
        none = np.empty(0, np.int64)
        return [], none, none, none
    key = rows * len(terms) + coded.indices.to_numpy()
    key, n = np.unique(key, return_counts=True)
    return terms, key // len(terms), key % len(terms), n
