"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a text into phrases: every position compares its symbol with the
one before it and keeps the place and value of the lowest differing bit; a few rounds leave a
handful of labels, and a phrase begins at every local maximum. A phrase's name is a hash of its
symbols, the names are the symbols of the next level, and so on. A cut depends on a bounded
neighbourhood only, so equal substrings get equal inner names wherever they stand. A fingerprint
keeps the least hash per bin of the names of all levels whose phrases are long enough to tell
texts apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweir.llm.common import in_batches, mix, partitions, random_words

LEVELS = 5
FIRST = 1  # names of this level and above enter the fingerprint: phrases of about a dozen characters and more
ROUNDS = 4  # of coin tossing: 64-bit symbols -> 128 -> 14 -> 8 -> 6 labels
BINS, EMPTY = 128, 0xFFFF
SALTS = random_words(LEVELS + 1, 3)
BATCH_CHARS = 500_000


def _phrase_starts(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a phrase begins at each symbol. ``begins`` marks the first symbol of each text;
    neighbours are never equal, except across texts."""
    label = symbols
    for _ in range(ROUNDS):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[begins] = label[begins] ^ np.uint64(1)
        low = label ^ before
        low &= ~low + np.uint64(1)  # the lowest differing bit
        bit = np.log2(low.astype(np.float64)).astype(np.uint64)
        label = (bit << np.uint64(1)) | ((label >> bit) & np.uint64(1))
    label = label.astype(np.int8)
    left = np.full(len(label), -1, np.int8)
    right = left.copy()
    left[1:], right[:-1] = label[:-1], label[1:]
    left[begins] = 127
    right[begins[1:] - 1] = -1
    start = (label > left) & (label > right)
    start[begins] = True
    return start


def _named(symbols: np.ndarray, start: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases and the positions at which they begin."""
    first = np.flatnonzero(start)
    sizes = np.diff(np.append(first, len(symbols)))
    place = (np.arange(len(symbols)) - np.repeat(first, sizes)).astype(np.uint64)
    codes = mix(symbols + (place + np.uint64(1)) * salt)
    return mix(np.add.reduceat(codes, first) + sizes.astype(np.uint64) * salt), first


def phrase_names(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, from 0: the names of all phrases of all texts and the text each belongs to.

    The last level names every whole text, so a text that is too short for phrases has a name too.
    """
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    symbols, out = mix(data + np.uint64(1)), []
    for level in range(LEVELS):
        if not len(symbols):
            break
        # Runs of one symbol become one, named by the symbol and the length.
        fresh_text = np.append(True, owner[1:] != owner[:-1])
        change = fresh_text.copy()
        change[1:] |= symbols[1:] != symbols[:-1]
        if not change.all():
            at = np.flatnonzero(change)
            sizes = np.diff(np.append(at, len(symbols))).astype(np.uint64)
            symbols = np.where(sizes > 1, mix(symbols[at] + sizes * SALTS[LEVELS]), symbols[at])
            owner, fresh_text = owner[at], fresh_text[at]
            # A run's name may equal its neighbour's only by a collision of 64-bit hashes.
            same = np.flatnonzero((symbols[1:] == symbols[:-1]) & ~fresh_text[1:]) + 1
            symbols[same] ^= np.uint64(1)
        symbols, at = _named(symbols, _phrase_starts(symbols, np.flatnonzero(fresh_text)), SALTS[level])
        owner = owner[at]
        out.append((symbols, owner))
    if len(symbols):
        begins = np.append(True, owner[1:] != owner[:-1])
        names, at = _named(symbols, begins, SALTS[LEVELS])
        out.append((names, owner[at]))
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """BINS values (16 bits, EMPTY if no name fell into the bin) for each text."""
    best = np.full(len(texts) * BINS, 0xFFFFFFFF, np.uint32)
    for names, owner in phrase_names(texts)[FIRST:]:
        h = mix(names)
        bin_of = owner * BINS + (h >> np.uint64(57)).astype(np.int64)
        np.minimum.at(best, bin_of, (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    values = np.where(best == 0xFFFFFFFF, EMPTY, mix(best.astype(np.uint64)) % np.uint64(EMPTY))
    return values.astype(np.uint16).reshape(len(texts), BINS)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated share of common names, from 0 to 1, row by row; two empty texts are alike."""
    used = (x != EMPTY) | (y != EMPTY)
    same = ((x == y) & (x != EMPTY)).sum(axis=-1)
    total = used.sum(axis=-1)
    return np.where(total == 0, 1.0, same / np.maximum(total, 1))


def as_text(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def fingerprint_texts(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: the text form of the fingerprint of every whole text (null: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def make(ids, texts):
        out = []
        for part in _parts([t or "" for t in texts]):
            out += [as_text(r) for r in fingerprints(part)]
        return ids, out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        in_batches(["doc_id", "text"], make, schema), "doc_id long, fingerprint string"
    )


def _parts(texts: list[str]):
    """Lists of texts of about BATCH_CHARS characters, to share the cost of array calls."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The next document is the one with the next smaller doc_id, after the last the first; equal
    ids follow each other by their texts, null ids come last. Texts are dealt once, by ranges of
    ids that an approximate quantile gives, and the first row of each range is sent to the range
    before it as well, so a task only meets its own range and one row more. One row per document;
    a single document is its own next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = 4 * partitions(spark)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # Range k holds the ids below cut k - 1 and not below cut k: an ordered search, as an expression.
    part = F.expr(f"size(filter(array({','.join(map(str, cuts))}), c -> c > coalesce(doc_id, {-(2**63) + 1}L)))") if cuts else F.lit(0)
    return _in_ranges(rows.withColumn("part", part), ranges)


def _in_ranges(rows: DataFrame, ranges: int) -> DataFrame:
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    # The first row of each range in the order: its id is the greatest. At most ``ranges`` rows.
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("head")).orderBy("part").collect()
    before = {heads[i]["part"]: heads[i - 1]["part"] for i in range(len(heads))}
    pairs = ",".join(f"{b}" for b in [before.get(p, -1) for p in range(ranges + 1)])
    tops = {r["part"]: r["head"] for r in heads}
    tops = ",".join(str(tops[p]) + "L" if tops.get(p) is not None else "CAST(NULL AS BIGINT)" for p in range(ranges + 1))
    also = F.expr(f"CASE WHEN doc_id <=> array({tops})[part] THEN array(part, array({pairs})[part]) ELSE array(part) END")
    if len(heads) < 2:
        also = F.array(F.col("part"), F.col("part"))
    dealt = rows.select("doc_id", "text", F.posexplode(also).alias("extra", "to"))
    dealt = dealt.repartition(partitions(rows.sparkSession), "to").sortWithinPartitions("to", "extra", *order)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def pack(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All texts but the last, which is only the next one of the last but one."""
        new = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, changed = fingerprints(texts), fingerprints(new)
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
        columns = [
            ids[:-1], [len(t) for t in texts[:-1]], sha, [as_text(r) for r in own[:-1]], [as_text(r) for r in changed],
            likeness(own[:-1], changed), likeness(own[:-1], own[1:]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        # Rows arrive by range; within one the own rows in order, then the head of the next range.
        ids, texts, size, now, closed = [], [], 0, None, False
        for batch in batches:
            for i, t, to, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "to", "extra"))):
                if to != now:
                    ids, texts, size, now, closed = [], [], 0, to, False
                if closed:
                    continue  # rows that share the head's id: only the first of them comes next
                ids.append(i)
                texts.append(t)
                size += len(t)
                closed = extra == 1
                if closed or (size >= BATCH_CHARS and len(ids) > 1):
                    yield pack(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    return dealt.mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
