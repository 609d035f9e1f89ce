"""Ranked lexical search by Block-Max MaxScore.

``build_index`` cuts the documents into shards of bounded size. A shard has one row per term:
its postings in compressed blocks, and for every block the best pairs of (occurrences, document
length) in it, from which the block's highest score follows once the corpus counts are known.
``search`` takes a shard and a block of queries together. The highest score of a whole list
splits a query's lists into essential ones, which propose candidates, and the rest; the block
maxima of the rest reject candidates before their blocks are decompressed. The best of each
shard are merged at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweir.llm.common import stored
from netweir.llm.terms import counted, slices, term_bytes
from netweir.operators.joins import fits_broadcast

BLOCK = 128  # postings of a block
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 15  # a shard has at most so many, or one longer text
QUERIES = 512  # queries, about, that one task handles with one shard
FIRST_WINDOW = 1024  # documents taken at once at first; each window is twice the last
NULL_ID = np.iinfo(np.int64).max  # sorts behind every id

INDEX = pa.schema(
    [
        ("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("total", pa.int64()),
        ("last", pa.binary()), ("form", pa.binary()), ("fronts", pa.binary()), ("front", pa.binary()), ("body", pa.binary()),
    ]
)
INDEX_DDL = "shard long, term binary, df long, total long, last binary, form binary, fronts binary, front binary, body binary"


def _binaries(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per entry of ``ends``, which counts elements of ``values``."""
    cuts = np.concatenate(([0], ends)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


class Shard:
    """Documents gathered for one shard."""

    def __init__(self, number: int):
        self.number, self.bytes, self.docs = number, 0, 0
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: pa.Array, texts: pa.Array, inside: np.ndarray) -> None:
        terms, rows, codes, tf = counted(texts, inside)
        self.parts.append((terms, rows + self.docs, codes, tf))
        self.ids.append(ids)
        self.lengths.append(np.bincount(rows, tf, len(ids)).astype(np.int64))
        self.docs += len(ids)
        self.bytes += texts.nbytes

    def rows(self) -> pa.RecordBatch:
        """The row of the documents (term null), and one row per term."""
        ids, n = pa.concat_arrays(self.ids), np.concatenate(self.lengths)
        coded = pa.array([t for p in self.parts for t in p[0]], pa.binary()).dictionary_encode()
        place = coded.indices.to_numpy()
        codes, at = [], 0
        for terms, _, c, _ in self.parts:
            codes.append(place[at : at + len(terms)][c] if len(terms) else c)
            at += len(terms)
        code, doc, tf = np.concatenate(codes), np.concatenate([p[1] for p in self.parts]), np.concatenate([p[3] for p in self.parts])
        order = np.argsort(code, kind="stable")  # within a term by document already
        code, doc, tf = code[order], doc[order], tf[order]
        df = np.bincount(code, minlength=len(coded.dictionary))
        lists = _compressed(df, doc, tf, n[doc])
        head = {"term": pa.nulls(1, pa.binary()), "df": [int((n > 0).sum())], "total": [int(n.sum())]}
        head |= {"last": [n.astype("<i8").tobytes()], "form": [ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()]}
        head |= {"fronts": [None], "front": [None], "body": [ids.fill_null(NULL_ID).to_numpy().astype("<i8").tobytes()], "shard": [self.number]}
        first = pa.RecordBatch.from_arrays([head[f.name] if isinstance(head[f.name], pa.Array) else pa.array(head[f.name], f.type) for f in INDEX], schema=INDEX)
        if not len(df):
            return first
        body = {"shard": pa.array(np.full(len(df), self.number)), "term": coded.dictionary, "df": pa.array(df), "total": pa.nulls(len(df), pa.int64())} | lists
        both = pa.Table.from_batches([first, pa.RecordBatch.from_arrays([body[f.name] for f in INDEX], schema=INDEX)])
        return both.combine_chunks().to_batches()[0]


def _compressed(df: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray) -> dict[str, pa.Array]:
    """Blocks of the lists of a shard: gaps of one or two bytes, occurrences of none (all one),
    one or four bytes. Postings are sorted by term and document."""
    if not len(df):
        return {}
    begin = np.cumsum(df) - df
    within = np.arange(len(doc)) - np.repeat(begin, df)
    starts = np.flatnonzero(within % BLOCK == 0)
    sizes = np.diff(np.append(starts, len(doc)))
    block = np.repeat(np.arange(len(starts)), sizes)
    gap = np.diff(doc, prepend=0)
    gap[begin] = doc[begin] + 1
    wide = np.where(np.maximum.reduceat(gap, starts) < 256, 1, 2)
    most = np.maximum.reduceat(tf, starts)
    times = np.where(most == 1, 0, np.where(most < 256, 1, 4))
    ends = np.cumsum(sizes * (wide + times))
    base = (ends - sizes * (wide + times))[block]
    k = np.arange(len(doc)) - starts[block]
    out = np.zeros(ends[-1], np.uint8)
    for byte in range(2):
        on = wide[block] > byte
        out[(base + k * wide[block] + byte)[on]] = (gap >> (8 * byte) & 255)[on]
    base = base + sizes[block] * wide[block]
    for byte in range(4):
        on = times[block] > byte
        out[(base + k * times[block] + byte)[on]] = (tf >> (8 * byte) & 255)[on]
    # Pairs that no other pair of their block beats in both occurrences and length.
    order = np.lexsort((-tf, n, block))
    level = np.maximum.accumulate((block[order] << 32) + tf[order])
    best = order[np.diff(level, prepend=-1) > 0]
    front = np.stack((tf[best], n[best]), axis=1).astype("<i8")
    per_block = np.bincount(block[best], minlength=len(starts))
    blocks = np.cumsum(-(-df // BLOCK))  # where each term's blocks end
    return {
        "last": _binaries(doc[starts + sizes - 1].astype("<i4"), blocks),
        "form": _binaries((wide * 8 + times).astype(np.uint8), blocks),
        "fronts": _binaries(per_block.astype(np.uint8), blocks),
        "front": _binaries(front.reshape(-1), 2 * np.cumsum(per_block)[blocks - 1]),
        "body": _binaries(out, ends[blocks - 1]),
    }


def build_index(docs: DataFrame, digits: bool = True) -> DataFrame:
    """The index of ``docs`` (doc_id, text and any other columns), in the shared folder. Digits
    belong to terms, or else part them."""
    inside = term_bytes(digits)

    def make(batches):
        from pyspark import TaskContext

        shard = Shard(TaskContext.get().partitionId() << 24)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for lo, hi in slices(texts):
                while lo < hi:
                    to = min(hi, lo + SHARD_DOCS - shard.docs)
                    shard.add(ids[lo:to], texts[lo:to], inside)
                    lo = to
                    if shard.bytes >= SHARD_BYTES or shard.docs >= SHARD_DOCS:
                        yield shard.rows()
                        shard = Shard(shard.number + 1)
        if shard.docs:
            yield shard.rows()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return stored(plain.mapInArrow(make, INDEX_DDL), "index")


class Postings:
    """The list of one term in one shard; blocks are decompressed when they are first needed."""

    def __init__(self, row, weight: int, scale: tuple[int, int], m: np.ndarray):
        self.last, form = np.frombuffer(row.last, "<i4"), np.frombuffer(row.form, np.uint8).astype(np.int64)
        self.wide, self.times, self.body, self.weight, self.m = form // 8, form % 8, row.body, weight, m
        self.sizes = np.full(len(form), BLOCK)
        self.sizes[-1] = row.df - BLOCK * (len(form) - 1)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes * (self.wide + self.times))))
        self.front_at = np.concatenate(([0], np.cumsum(np.frombuffer(row.fronts, np.uint8).astype(np.int64))))[:-1]
        tf, n = np.frombuffer(row.front, "<i8").reshape(-1, 2).T
        self.most = np.maximum.reduceat(weight * part_score(tf, lengthened(n, *scale)), self.front_at)
        self.bound = int(self.most.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and what the term adds to their scores."""
        if b not in self.known:
            size, at, width, times = int(self.sizes[b]), int(self.begin[b]), int(self.wide[b]), int(self.times[b])
            gaps = np.frombuffer(self.body, f"<u{width}", size, at)
            doc = np.cumsum(gaps, dtype=np.int64) + (self.last[b - 1] if b else -1)
            tf = np.frombuffer(self.body, f"<u{times}", size, at + size * width).astype(np.int64) if times else np.ones(size, np.int64)
            self.known[b] = doc, self.weight * part_score(tf, self.m[doc])
        return self.known[b]


def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def lengthened(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    return 50 + (50 * n * docs) // total


def best_of_shard(lists: list[Postings], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` documents of a shard with the highest scores above 0 (equal
    scores: smallest ids)."""
    lists = sorted(lists, key=lambda p: p.bound)
    bounds = np.cumsum([p.bound for p in lists])
    top_id, top = np.empty(0, np.int64), np.empty(0, np.int64)
    least, lo, width = 1, 0, FIRST_WINDOW
    while lo < len(ids):
        hi = min(lo + width, len(ids))
        rest = int(np.searchsorted(bounds, least, "left"))  # lists that together stay below the least score
        if rest == len(lists):
            break
        score = np.zeros(hi - lo, np.int64)
        for p in lists[rest:]:
            b = int(np.searchsorted(p.last, lo))
            while b < len(p.last) and (b == 0 or p.last[b - 1] + 1 < hi):
                doc, add = p.block(b)
                if doc[0] >= lo and doc[-1] < hi:
                    score[doc - lo] += add
                else:
                    x, y = np.searchsorted(doc, (lo, hi))
                    score[doc[x:y] - lo] += add[x:y]
                b += 1
        found = np.flatnonzero(score)
        for at in range(rest - 1, -1, -1):
            p = lists[at]
            found = found[score[found] + bounds[at] >= least]
            if not len(found):
                break
            below = int(bounds[at - 1]) if at else 0
            block = np.searchsorted(p.last, found + lo)
            inside = np.append(p.most, 0)[block]
            near = score[found] + inside + below >= least
            found, block = found[near], block[near]
            for b in np.unique(block[block < len(p.last)]).tolist():
                doc, add = p.block(b)
                x, y = np.searchsorted(doc, (lo, hi))
                score[doc[x:y] - lo] += add[x:y]
        found = found[score[found] >= least]
        if len(found):
            top_id, top = np.concatenate((top_id, ids[found + lo])), np.concatenate((top, score[found]))
            if len(top) > k:
                order = np.lexsort((top_id, -top))[:k]
                top_id, top = top_id[order], top[order]
            if len(top) == k:
                least = int(top.min())
        lo, width = hi, width * 2
    return top_id, top


def _searched(docs: int, total: int, k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["term"].isna()].iloc[0]
        ids = np.frombuffer(head["body"], "<i8")
        m = lengthened(np.frombuffer(head["last"], "<i8"), docs, total)
        lists: dict[int, list[Postings]] = {}
        for row in pdf[pdf["term"].notna()].itertuples():
            p = Postings(row, int(row.weight), (docs, total), m)
            for item in row.items:
                lists.setdefault(int(item), []).append(p)
        out: tuple[list, list, list] = ([], [], [])
        for item, own in lists.items():
            doc, score = best_of_shard(own, ids, k)
            for column, values in zip(out, (np.full(len(doc), item), doc, score)):
                column.append(values)
        query, doc, score = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
        return pd.DataFrame({"query": query, "doc": pd.arrays.IntegerArray(doc, doc == NULL_ID), "score": score})

    return run


def query_terms(queries: DataFrame, digits: bool = True) -> DataFrame:
    """Distinct (item_id, term) of ``queries`` (item_id, text)."""
    inside = term_bytes(digits)

    def make(batches):
        for batch in batches:
            ids, texts = batch.column("item_id"), batch.column("text")
            for lo, hi in slices(texts):
                terms, rows, codes, _ = counted(texts[lo:hi], inside)
                yield pa.RecordBatch.from_arrays([ids[lo:hi].take(pa.array(rows)), pa.array(terms, pa.binary()).take(pa.array(codes))], ["item_id", "term"])

    plain = queries.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(make, "item_id long, term binary").distinct()


def search(index: DataFrame, queries: DataFrame, k: int = 50, digits: bool = True) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents for every query.

    queries: item_id, text and any other columns. Rows that share an item_id are one query with
    the terms of all of them; a null item_id is a query like any other. Null and empty texts, of
    documents or queries, have no terms, so such queries get no rows; documents without a term
    count nowhere. A repeated document row is a document each time; equal scores go by ascending
    doc_id, null behind all. Empty tables give no rows.
    """
    spark = index.sparkSession
    heads = index.filter("term is null")
    docs, total = heads.agg(F.sum("df"), F.sum("total")).first()
    if not docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    wanted = stored(query_terms(queries, digits), "terms")
    # Queries get numbers, so that a null item_id is one too.
    numbered = wanted.select("item_id").distinct().withColumn("query", F.xxhash64("item_id", F.col("item_id").isNull()))
    numbered = stored(numbered, "queries")
    blocks = max(1, -(-numbered.count() // QUERIES))
    by_term = (
        wanted.withColumn("query", F.xxhash64("item_id", F.col("item_id").isNull()))
        .withColumn("part", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
        .groupBy("term", "part").agg(F.collect_list("query").alias("items"))
    )
    lists = index.filter("term is not null")
    df = lists.join(_small(by_term.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("all_df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("all_df") + 1).cast("double"))).cast("long")
    weighted = stored(by_term.join(df, "term").withColumn("weight", weight).drop("all_df").filter("weight > 0"), "weights")
    met = lists.join(_small(weighted), "term")
    every = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"items": F.lit(None), "weight": F.lit(None)})
    columns = ["shard", "part", "term", "df", "weight", "items", "last", "form", "fronts", "front", "body"]
    both = met.select(*columns).unionAll(every.select(*columns))
    best = both.groupBy("shard", "part").applyInPandas(_searched(docs, total, k), "query long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    named = ranked.join(_small(numbered), "query")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what measures small; more is joined by a shuffle that splits hot keys."""
    return F.broadcast(df) if fits_broadcast(df) else df
