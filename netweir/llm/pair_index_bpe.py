"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch that a worker has not met yet are laid out in one array of
symbols. An index maps every adjacent pair that has a merge rank to its positions. Active ranks
are taken in ascending order; a rank merges at all its positions at once, and only the pairs
left and right of them are looked up anew and filed under their own ranks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import in_batches
from netweir.llm.packing import byte_letters

CACHE = 500_000  # text chunks that a worker remembers
#: White space as the vocabulary's own pattern sees it (fixed values): Unicode White_Space.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANK}\p{{L}}\p{{N}}]+")
#: Characters that str.split() takes for blanks and Unicode doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")
BLANKS = regex.compile(f"[{BLANK}]+")


class PairIndexBpe:
    """A word-level BPE file of the tokenizers library with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.base = max(self.tokens) + 1
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        left, right = (np.array([self.vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        keys = left * self.base + right
        self.new_symbol = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, ranks = keys[order], order
        last = np.append(keys[1:] != keys[:-1], True)  # of a pair listed twice the later rank counts
        self.keys, self.ranks = keys[last], ranks[last]
        self.left, self.right = left, right
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = byte_letters()
        self.symbols, self.end_symbols = (np.full(256, -1, np.int64) for _ in range(2))
        for byte in range(255):
            self.symbols[byte] = self.vocab[letters[byte]]
            self.end_symbols[byte] = self.vocab[letters[byte] + self.suffix]
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}
        self.passing_ids: dict[str, bytes] = {}  # beyond CACHE, for one batch
        self.passing_text: dict[str, str] = {}

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 where there is none. Symbols below 0 have none."""
        key = np.where((a >= 0) & (b >= 0), a * self.base + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word (already normalised, cut and not empty), all words together."""
        if not words:
            return []
        # 0xFF is no UTF-8 byte: it closes a word, and no pair spans two words.
        data = np.frombuffer(b"\xff".join([w.encode("utf-8", "surrogatepass") for w in words]) + b"\xff", np.uint8)
        s = self.symbols[data]
        closes = np.flatnonzero(data == 255)
        s[closes - 1] = self.end_symbols[data[closes - 1]]
        n = len(s)
        # before[i] and after[i] are the living neighbours of i.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(ranks: np.ndarray, at: np.ndarray) -> int:
            """Add positions to the index; the least rank among them."""
            has = ranks >= 0
            if not has.any():
                return 1 << 60
            ranks, at = ranks[has], at[has]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist()]
            for rank, x, y in zip(ranks[begins].tolist(), begins, [*begins[1:], len(at)]):
                if rank in index:
                    index[rank].append(at[x:y])
                else:
                    index[rank] = [at[x:y]]
                    heapq.heappush(heap, rank)
            return int(ranks[0])

        file(self._ranks_of(s[:-1], s[1:]), np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b, new = self.left[rank], self.right[rank], self.new_symbol[rank]
            at = at[alive[at] & (s[at] == a)]
            at = at[after[at] < n]
            nxt = after[at]
            ok = s[nxt] == b
            at, nxt = at[ok], nxt[ok]
            if not len(at):
                continue
            if a == b and len(at) > 1:
                # In a run of equal symbols every second pair merges, from the left.
                free, last = [], -1
                for i, (p, q) in enumerate(zip(at.tolist(), nxt.tolist())):
                    if p != last:
                        free.append(i)
                        last = q
                at, nxt = at[free], nxt[free]
            s[at] = new
            alive[nxt] = False
            s[nxt] = -2
            far = after[nxt]
            after[at] = far
            inside = far < n
            before[far[inside]] = at[inside]
            prev = before[at]
            had = prev >= 0
            left_at, right_at = prev[had], at[inside]
            pairs_at = np.concatenate((left_at, right_at))
            file(self._ranks_of(s[pairs_at], s[after[pairs_at]]), pairs_at)
        kept = s[alive]
        return [x[:-1] for x in np.split(kept, np.flatnonzero(kept < 0) + 1)[: len(words)]]

    def _chunks_of(self, text: str) -> list[str]:
        """Blank-separated chunks of a text without special tokens, normalised."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:  # lower-casing is letter by letter: no special sigma at the end of a word
            text = text.replace("\u03a3", "\u03c3")
        text = text.lower()
        return [c for c in BLANKS.split(text) if c] if SEPARATORS.search(text) else text.split()

    def _has_special(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def prepare(self, texts: list[str | None]) -> None:
        """Encode the chunks of ``texts`` that the worker doesn't know yet, all at once."""
        self.passing_ids.clear()
        self.passing_text.clear()
        new: set[str] = set()
        for text in texts:
            if text:
                for part in self.split_special.split(text)[::2] if self._has_special(text) else (text,):
                    new.update(self._chunks_of(part))
        new.difference_update(self.ids_of)
        chunks = list(new)
        cuts = [WORDS.findall(c) for c in chunks]
        words = list({w for cut in cuts for w in cut})
        ids = self.encode_words(words)
        tokens = self.tokens
        raw = dict(zip(words, [x.astype("<u4").tobytes() for x in ids]))
        shown = dict(zip(words, [" ".join([tokens[i] for i in x.tolist()]) for x in ids]))
        room = CACHE - len(self.ids_of)
        for k, (c, cut) in enumerate(zip(chunks, cuts)):
            a, b = (raw[cut[0]], shown[cut[0]]) if len(cut) == 1 else (b"".join([raw[w] for w in cut]), " ".join([shown[w] for w in cut]))
            if k < room:
                self.ids_of[c], self.text_of[c] = a, b
            else:
                self.passing_ids[c], self.passing_text[c] = a, b

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids (little-endian unsigned 32-bit) and the decoded text of a prepared text."""
        if not text:
            return b"", ""
        if not self._has_special(text):
            return self._look_up(self._chunks_of(text))
        ids, shown = [], []
        for i, part in enumerate(self.split_special.split(text)):
            a, b = (np.array([self.special[part]], "<u4").tobytes(), part) if i % 2 else self._look_up(self._chunks_of(part))
            if a:
                ids.append(a)
                shown.append(b)
        return b"".join(ids), " ".join(shown)

    def _look_up(self, chunks: list[str]) -> tuple[bytes, str]:
        ids_of, text_of = self.ids_of, self.text_of
        try:
            return b"".join([ids_of[c] for c in chunks]), " ".join([text_of[c] for c in chunks])
        except KeyError:
            ids, text = self.passing_ids, self.passing_text
            return (
                b"".join([ids_of[c] if c in ids_of else ids[c] for c in chunks]),
                " ".join([text_of[c] if c in text_of else text[c] for c in chunks]),
            )

    def decode(self, ids: bytes) -> str:
        """The file has no decoder, so tokens stand side by side with a space between them."""
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def bpe(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) of every whole text.

    Null and empty texts have no ids.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def make(doc_ids, texts):
        code = bpe(path)
        code.prepare(texts)
        return doc_ids, [code.encode(t)[0] for t in texts]

    return _texts(docs).mapInArrow(in_batches(["doc_id", "text"], make, schema), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: the decoded text of (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def make(doc_ids, ids):
        code = bpe(path)
        return doc_ids, [code.decode(x or b"") for x in ids]

    return encoded.select("doc_id", "ids").mapInArrow(in_batches(["doc_id", "ids"], make, schema), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass: ids and texts never leave the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make(doc_ids, texts):
        code = bpe(path)
        n, a, b = [], [], []
        code.prepare(texts)
        for text in texts:
            ids, decoded = code.encode(text)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
        return doc_ids, n, a, b

    return _texts(docs).mapInArrow(
        in_batches(["doc_id", "text"], make, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
