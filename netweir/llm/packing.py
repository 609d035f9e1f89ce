"""Packing of token sequences: shortest-pack-first over the length histogram.

Texts are tokenised and cut into pieces of at most the sequence length. Only the histogram of
piece lengths (one number per length) reaches the driver, where lengths are placed longest
first, each on the emptiest packs that still take it; what is kept are packing patterns and how
often each is used, at most one new pattern per length. Pieces find their place by their rank
among pieces of equal length, without any pass over the patterns' uses.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from netweir.llm.common import fresh

CACHE = 300_000  # text chunks whose ids a worker remembers
GPT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class ByteLevelEncoder:
    """Ids of a byte-level BPE file of the tokenizers library, special tokens found in the text included.

    Between single spaces the word pattern looks at nothing outside a chunk and the space before
    it, so a chunk's ids are looked up; a text with other runs of blanks is encoded as a whole.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {letter: byte for byte, letter in byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        self.fast = Encoding("file", pat_str=GPT_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [s for s in special if s]
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        first, *chunks = text.split(" ")
        known = self.known
        try:
            rest = b"".join([known[c] for c in chunks])
        except KeyError:
            rest = b"".join([known[c] if c in known else self._learn(c) for c in chunks])
        return np.array(self.fast.encode_ordinary(first), "<u4").tobytes() + rest

    def _learn(self, chunk: str) -> bytes:
        ids = np.array(self.fast.encode_ordinary(" " + chunk), "<u4").tobytes()
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(chunk) <= 48:
            self.known[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text, ...) as pieces of at most ``capacity`` ids.

    Returns doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens. The
    ids of a document are its text's and then ``end_id``; a null or empty text is ``end_id`` only.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        code = encoder(path)
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = (code.encode(text) if text else b"") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for column, x in zip(rows, (doc_id, at // 4, len(piece) // 4, piece, len(ids) // 4)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long"
    )


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs of the counted lengths: (lengths in a pack, number of such packs).

    Lengths go longest first onto the packs with the most room that still hold them; what fits
    nowhere opens new packs.
    """
    room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        left = histogram.get(length, 0)
        free = capacity
        while left and free >= length:
            while left and room[free]:
                count, pack = room[free].pop()
                take = min(count, left)
                left -= take
                if take < count:
                    room[free].append((count - take, pack))
                room[free - length].append((take, (*pack, length)))
            free -= 1
        if left:
            room[capacity - length].append((left, (length,)))
    return [(pack, count) for packs in room for count, pack in packs]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ranks at which a run of places begins, its first sequence, its offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for pack, count in packs:
        offset = 0
        for length in pack:
            runs.setdefault(length, []).append((used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        first += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*found)) for length, found in runs.items()}


def place(pieces: DataFrame, order: list[str], capacity: int = 1024) -> DataFrame:
    """pieces, with a column ``length`` from 1 to ``capacity``, with sequence_id and offset added.

    ``pieces`` is read twice, so it has to be a stored table. ``order`` names columns that tell
    pieces apart; rows that agree in all of them take their places in any order. Pieces of one
    length are ranked in about sqrt(count) buckets each, so that neither a common length nor the
    table of bucket sizes meets in one task. An empty table gives no rows.
    """
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    places = slots(patterns(histogram, capacity))
    bucket, rank, before, many = fresh(pieces.columns, "bucket", "rank", "before", "many")
    widths = {length: max(1, int(count**0.5)) for length, count in histogram.items()}
    # An array of one small number per length, looked up by position.
    width = F.element_at(F.array(*[F.lit(widths.get(n, 1)) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), width))
    sizes = dealt.groupBy("length", bucket).agg(F.count("*").alias(many))
    ahead = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", bucket, F.coalesce(F.sum(many).over(ahead), F.lit(0)).alias(before))
    within = Window.partitionBy("length", bucket).orderBy(*order)
    ranked = dealt.withColumn(rank, F.row_number().over(within) - 1).join(sizes, ["length", bucket])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before)).select(*pieces.columns, rank)
    kept = len(pieces.columns)
    shared = pieces.sparkSession.sparkContext.broadcast(places)  # at most two numbers per length and pattern

    def run(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column(kept).to_numpy()
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                start, first, offset = shared.value[int(length)]
                mine = np.flatnonzero(lengths == length)
                run_of = np.searchsorted(start, ranks[mine], side="right") - 1
                seq[mine], off[mine] = first[run_of] + ranks[mine] - start[run_of], offset[run_of]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(seq), pa.array(off)], [*batch.schema.names[:kept], "sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the pieces of each sequence (at most its capacity) joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("hex"))))
    return placed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(parts, lambda p: p["hex"]), "")).alias("ids"))
