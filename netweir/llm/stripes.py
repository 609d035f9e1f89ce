"""Divergence of the sources of each language, by in-mapper stripes.

A task folds whole documents into stripes: for each (language, term) the number of documents
that hold it and its occurrences in every source. Full stripes are handed on before they outgrow
memory, merged by key in sorted order, and each merged stripe adds straight to the divergences
between its language's sources. Only what several stripes add to one pair of sources is summed
afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweir.llm.common import stored
from netweir.llm.terms import counted, slices, term_bytes
from netweir.operators.joins import fits_broadcast

LEAST_DOCS = 10  # documents of a language that a kept term is in
FOLDED = 1_500_000  # (language, source, term) entries that a task holds before it hands them on
BUCKET = 500_000  # such entries, about, that a task turns into divergences at once
SOURCES = 256  # sources that it compares with all others of the language
CELLS = 2_000_000  # cells of terms by sources that it looks at together
SCALE = 1_000_000_000
TOP = 10  # ranks of terms

STRIPE = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
STRIPE_DDL = "lang string, term binary, df long, sources array<string>, counts array<long>"


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys and, for each, the sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.empty(0, np.int64)
    return key[starts], [np.add.reduceat(v[order], starts) if len(key) else v for v in values]


def _stripes(langs: pa.Array, terms: pa.Array, sources: pa.Array, lang: np.ndarray, term: np.ndarray, source: np.ndarray, df: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Stripes of the entries (places in ``langs``, ``terms``, ``sources``; documents; occurrences)."""
    wide = max(len(sources), 1)
    stripe, (df, n) = _sums((lang * max(len(terms), 1) + term) * wide + source, df, n)
    source, stripe = stripe % wide, stripe // wide
    starts = np.flatnonzero(np.diff(stripe, prepend=-1))
    ends = pa.array(np.append(starts, len(stripe)).astype(np.int32))
    key = stripe[starts]
    columns = [
        langs.take(pa.array(key // max(len(terms), 1))), terms.take(pa.array(key % max(len(terms), 1))), pa.array(np.add.reduceat(df, starts) if len(starts) else df),
        pa.ListArray.from_arrays(ends, sources.take(pa.array(source))), pa.ListArray.from_arrays(ends, pa.array(n)),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, STRIPE)], schema=STRIPE)


class Fold:
    """The stripes of a task until they are handed on."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, langs: pa.Array, sources: pa.Array, texts: pa.Array, inside: np.ndarray) -> None:
        terms, rows, codes, n = counted(texts, inside)
        if not terms:
            return
        langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
        lang, source = langs.indices.to_numpy()[rows].astype(np.int64), sources.indices.to_numpy()[rows].astype(np.int64)
        key, (df, n) = _sums((lang * len(sources.dictionary) + source) * len(terms) + codes, np.ones(len(n), np.int64), n)
        group = key // len(terms)
        self.parts.append((langs.dictionary, pa.array(terms, pa.binary()), sources.dictionary, group // len(sources.dictionary), key % len(terms), group % len(sources.dictionary), df, n))
        self.size += len(key)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield _stripes(*_joined(self.parts))


def _joined(parts: list[tuple]) -> tuple:
    """Entries of several batches with places in common dictionaries."""
    out, places = [], []
    for k in range(3):
        coded = pa.concat_arrays([p[k] for p in parts]).dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        begin = np.cumsum([0] + [len(p[k]) for p in parts])
        out.append(coded.dictionary)
        places.append(np.concatenate([at[begin[i] + p[k + 3]] for i, p in enumerate(parts)]))
    return (*out, *places, np.concatenate([p[6] for p in parts]), np.concatenate([p[7] for p in parts]))


def fold(docs: DataFrame) -> DataFrame:
    """Stripes of whole documents; a key has one from each time that a task handed on its own."""
    inside = term_bytes(digits=False)

    def make(batches):
        held = Fold()
        for batch in batches:
            lang, source, text = (batch.column(c) for c in ("lang", "source", "text"))
            for lo, hi in slices(text):
                held.add(lang[lo:hi], source[lo:hi], text[lo:hi], inside)
                if held.size >= FOLDED:
                    yield from held.batches()
                    held = Fold()
        yield from held.batches()

    return docs.mapInArrow(make, STRIPE_DDL)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of one key become one; the rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        lang, term, sources = (table.column(c).combine_chunks() for c in ("lang", "term", "sources"))
        lang, term, flat = lang.dictionary_encode(), term.dictionary_encode(), sources.flatten().dictionary_encode()
        each = pc.list_value_length(sources).to_numpy()
        first = np.cumsum(each) - each
        df = np.zeros(len(flat), np.int64)
        df[first] = table.column("df").to_numpy()
        spread = lambda x: np.repeat(x.indices.to_numpy().astype(np.int64), each)
        return _stripes(lang.dictionary, term.dictionary, flat.dictionary, spread(lang), spread(term), flat.indices.to_numpy().astype(np.int64), df, table.column("counts").combine_chunks().flatten().to_numpy())

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < 20_000:
            continue
        table = pa.Table.from_batches(held)
        whole = table.num_rows - 1  # the last key may go on in the next batch
        key = (table["lang"][whole].as_py(), table["term"][whole].as_py())
        while whole and (table["lang"][whole - 1].as_py(), table["term"][whole - 1].as_py()) == key:
            whole -= 1
        if whole:
            yield flush(table.slice(0, whole))
        held = [flush(table.slice(whole))]
        rows = 1
    if held:
        yield flush(pa.Table.from_batches(held))


def chance(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / size), digit by digit, so that nothing overflows."""
    whole, rest = np.divmod(count + 2, size)
    for _ in range(9):
        digit, rest = np.divmod(rest * 10, size)
        whole = whole * 10 + digit
    return whole + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _divergences(key, stripes: pa.Table, groups: pa.Table) -> pa.Table:
    """What the stripes of a bucket add to the divergences of a block of sources, and the terms
    of the bucket that could be among a source's first."""
    lang, bucket, block = (k.as_py() for k in key)
    groups = groups.sort_by("source")
    names, occurs = groups["source"].combine_chunks(), groups["n"].to_numpy()
    kept = int(groups["kept"][0].as_py())
    own = range(block * SOURCES, min((block + 1) * SOURCES, len(names)))
    size, all_size = occurs + 2 * kept, int(occurs.sum()) + 2 * kept
    none = chance(np.zeros(len(names), np.int64), np.maximum(size, 1))
    plain = [gap(none[s], none) for s in own]
    given, taken = np.zeros((2, len(own), len(names)), np.int64)
    best: list[list[tuple[int, bytes]]] = [[] for _ in own]
    step = max(1, CELLS // max(len(names), 1))
    for at in range(0, stripes.num_rows, step):
        part = stripes.slice(at, step).combine_chunks()
        each = pc.list_value_length(part["sources"]).to_numpy()
        counts = np.zeros((part.num_rows, len(names)), np.int64)
        column = pc.index_in(part["sources"].combine_chunks().flatten(), value_set=names).to_numpy()
        counts[np.repeat(np.arange(len(each)), each), column] = part["counts"].combine_chunks().flatten().to_numpy()
        there, p = counts > 0, chance(counts, size)
        q = chance(counts.sum(axis=1), np.int64(all_size))
        terms = part["term"].combine_chunks()
        for k, s in enumerate(own):
            rows = np.flatnonzero(there[:, s])
            more = gap(p[rows, s, None], p[rows]) - plain[k]
            given[k] += more.sum(axis=0)
            taken[k] += np.where(there[rows], 0, more).sum(axis=0)
            rows = rows[p[rows, s] > q[rows]]
            value = gap(p[rows, s], q[rows])
            if len(rows) > TOP:
                high = value >= np.partition(value, -TOP)[-TOP]
                rows, value = rows[high], value[high]
            best[k] = sorted(best[k] + list(zip((-value).tolist(), terms.take(pa.array(rows)).to_pylist())))[:TOP]
    source, part, item, value = [], [], [], []
    for k, s in enumerate(own):
        name, others = names[s].as_py(), np.delete(np.arange(len(names)), s)
        base = kept * plain[k] if bucket == 0 else 0
        moved = others[taken[k][others] != 0]
        source += [name] * len(others) + names.take(pa.array(moved)).to_pylist() + [name] * len(best[k])
        part += ["pair"] * (len(others) + len(moved)) + ["term"] * len(best[k])
        item += names.take(pa.array(others)).to_pylist() + [name] * len(moved) + [t.decode() for _, t in best[k]]
        value += (given[k] + base)[others].tolist() + taken[k][moved].tolist() + [-v for v, _ in best[k]]
    return pa.table([pa.array(x, f.type) for x, f in zip(([lang] * len(source), source, part, item, value), FOUND)], schema=FOUND)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast what measures small; more is joined by a shuffle that splits hot keys."""
    return F.broadcast(df) if fits_broadcast(df) else df


def divergences(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    docs: text, lang, source and any other columns; null is ''. Part ``pair`` has every other
    source of the language as item, part ``term`` the ``TOP`` terms by which the source departs
    most from its language. A source without terms still has its pairs; a language without kept
    terms has values of 0; a language with one source has no pairs. A repeated row is a document
    each time; equal values go by item. An empty table gives no rows.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    folded = fold(docs).repartition("lang", "term").sortWithinPartitions("lang", "term")
    stripes = stored(folded.mapInArrow(_merged, STRIPE_DDL).filter(F.col("df") >= LEAST_DOCS), "stripes")

    occurs = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = docs.select("lang", "source").distinct().join(occurs, ["lang", "source"], "left")
    kept = stripes.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.size("sources")).alias("entries"))
    groups = stored(groups.join(_small(kept), "lang", "left").na.fill(0), "groups")
    langs = groups.groupBy("lang").agg(F.ceil(F.max("entries") / BUCKET).alias("buckets"), F.ceil(F.count("*") / SOURCES).alias("blocks"))
    langs = stored(langs.select("lang", *(F.greatest(F.col(c), F.lit(1)).cast("int").alias(c) for c in ("buckets", "blocks"))), "langs")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    to_groups = groups.join(_small(langs), "lang").withColumn("bucket", every("buckets")).withColumn("block", every("blocks"))
    to_stripes = stripes.join(_small(langs), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")).withColumn("block", every("blocks"))
    key = ["lang", "bucket", "block"]
    left = to_stripes.select(*key, "term", "sources", "counts").groupBy(*key)
    right = to_groups.select(*key, "source", "n", "kept").groupBy(*key)
    found = stored(left.cogroup(right).applyInArrow(_divergences, "lang string, source string, part string, item string, value long"), "divergences")

    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
