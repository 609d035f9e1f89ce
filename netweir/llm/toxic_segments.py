"""Toxicity: maximum-scoring segments over token log-odds.

Tokens are lower-cased words and their first letters, so that a word form that was never seen
still meets its stem. Their log-odds between toxic and other labelled texts use an informative
Dirichlet prior (the counts of both classes together). A token counts if its texts are shared
out between the classes as chance would hardly do it, with a bound on the false discoveries among
all tokens. Words that are no such tokens cost a constant, so a clean text drifts down; a linear scan finds every maximal scoring segment.
A segment's score is turned into an extreme-value exponent, and the evidence of all significant
passages of a text is put on a probability scale by a logistic curve fitted on labelled texts.

A lexicon of at most LEXICON_TOKENS tokens is sent to the tasks. A larger one stays a stored table:
the tokens of the texts are joined to it, and each text is read with its own entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netweir.llm.common import discard, fresh, stored
from netweir.operators.joins import fits_broadcast

WORD = re.compile(r"\w+")
STEMS = (5, 4, 3)
PRIOR = 20.0  # total weight of the Dirichlet prior, in texts of each class
FALSE_SHARE = 0.01  # bound on the expected share of chance tokens in the lexicon
CELLS = 20  # cells of evidence per unit of log p
MARGIN = 1.0  # taken off the log-odds, so that words that both classes use do not add up
LEXICON_TOKENS = 250_000  # of a lexicon that every task holds (about 50 MB of Python objects)
GRAINS = 1000  # cells of weight per unit, for the law of the scores
MAX_ROWS = 40_000  # labelled texts that the calibration is fitted on; all are scored
DRIFT = -0.5  # score of a word without significant log-odds
CLIP = 6.0
APART = 50  # a word counts against a text again after so many words
LEVEL = 0.01  # a passage counts from this chance of one as good in a clean text of the length


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def tokens_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def token_counts(docs: DataFrame) -> DataFrame:
    """docs: text, label (0/1). Per token: the number of labelled texts of each class that hold
    it. Counted in texts, so that one text that repeats a word a thousand times is one witness."""

    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            for label, counter in enumerate(seen):
                if counter:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(counter), pa.string()), pa.array([label] * len(counter), pa.int32()), pa.array(list(counter.values()), pa.int64())],
                        ["token", "label", "n"],
                    )
                counter.clear()

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[label].update({t for w in set(words_of(text)) for t in tokens_of(w)})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield from flush()
        yield from flush()

    counted = docs.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "token string, label int, n long")
    return counted.groupBy("token").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean")
    )


@dataclass(frozen=True)
class Segments:
    lexicon: dict[str, float]
    rate: float  # lambda of the score distribution
    size: float  # K of the score distribution
    slope: float = 1.0
    shift: float = 0.0
    table: str | None = None  # folder of (token, weight), if the lexicon is not held here

    def scores(self, words: list[str], seen: dict[str, float]) -> list[float]:
        """One score per word; the same word again within APART words is worth nothing more."""
        out, lexicon = [], self.lexicon
        last: dict[str, int] = {}
        for k, w in enumerate(words):
            s = seen.get(w)
            if s is None:
                s = next((lexicon[t] for t in tokens_of(w) if t in lexicon), DRIFT)
                if len(seen) < 300_000:
                    seen[w] = s
            if s > 0:
                if k - last.get(w, -APART) < APART:
                    s = 0.0
                else:
                    last[w] = k
            out.append(s)
        return out

    def passages(self, words: list[str], seen: dict[str, float]) -> list[tuple[int, int, float]]:
        """(start, end, score) of every maximal scoring segment that is significant."""
        found = maximal_segments(self.scores(words, seen))
        least = self.exponent(0.0, len(words))
        return [(a, b, s) for a, b, s in found if least + self.rate * s >= -np.log(-np.log1p(-LEVEL))]

    def exponent(self, score: float, n: int) -> float:
        """x of the Gumbel law exp(-exp(-x)) of the best score among n clean words."""
        return self.rate * score - np.log(self.size * max(n, 1))

    def evidence(self, words: list[str], seen: dict[str, float]) -> float:
        """Sum of the exponents of all significant passages, 0 if there is none."""
        return float(sum(self.exponent(s, len(words)) for _, _, s in self.passages(words, seen)))

    def probability(self, evidence) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(np.maximum(evidence, 0)) + self.shift, -30, 30)))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) in linear time (Ruzzo and Tompa)."""
    stack: list[list[float]] = []  # start, end, sum before, sum after, index of the last with a smaller left sum
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        now = [i, i + 1, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = int(stack[j][4])
            now[4] = j
            if j < 0 or stack[j][3] >= now[3]:
                stack.append(now)
                break
            # Everything from j on joins the new segment.
            now = [stack[j][0], now[1], stack[j][2], now[3], -1]
            del stack[j:]
    return [(int(a), int(b), r - l) for a, b, l, r, _ in stack]


def evidence_limit(tested: DataFrame) -> float:
    """The evidence from which tokens count: Benjamini and Hochberg's step-up rule on p <= exp(-evidence).

    tested: evidence, and most, what it could be at the token's number of texts. A token with
    most < x can't be a discovery at x, so it isn't counted among the tests at x (Tarone, Gilbert).
    Both are counted in cells, rounded down: a bounded table comes to the driver.
    """
    cells = 60 * CELLS
    cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(cells)).cast("int")
    both = tested.select(F.explode(F.array(
        F.struct(cell("evidence").alias("cell"), F.lit(1).alias("found"), F.lit(0).alias("able")), F.struct(cell("most").alias("cell"), F.lit(0).alias("found"), F.lit(1).alias("able"))
    )).alias("x")).select("x.*")
    found, able, least = 0, 0, math.inf
    for r in sorted(both.groupBy("cell").agg(F.sum("found").alias("found"), F.sum("able").alias("able")).collect(), key=lambda r: -r["cell"]):
        found, able = found + r["found"], able + r["able"]
        if able * math.exp(-r["cell"] / CELLS) <= FALSE_SHARE * found:
            least = r["cell"] / CELLS
    return least


def lexicon_of(counts: DataFrame, toxic: int, clean: int, most: int = LEXICON_TOKENS) -> tuple[dict[str, float] | str, float, float]:
    """Significant log-odds by token, lambda and K of the scores of a clean word. toxic, clean:
    the number of texts that were counted. More than ``most`` tokens stay in a stored table
    (token, weight), and its folder is returned in their place."""
    if not toxic or not clean:
        return {}, 1.0, 1.0
    nt, nc = float(toxic), float(clean)
    share = (F.col("toxic") + F.col("clean")) / (nt + nc)
    a, b = F.col("toxic") + share * PRIOR, F.col("clean") + share * PRIOR
    at, bt = F.lit(nt + PRIOR) - a, F.lit(nc + PRIOR) - b
    odds = F.log(a / F.greatest(at, F.lit(0.5))) - F.log(b / F.greatest(bt, F.lit(0.5)))
    # The log-likelihood ratio of a token's share of toxic texts against the share of all texts. Its
    # exponent bounds the exact (hypergeometric) tail on one side at any count, zero included; the
    # factor two is for the two sides.
    pt, pc, n = nt / (nt + nc), nc / (nt + nc), F.col("toxic") + F.col("clean")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / n / p)).otherwise(0.0)
    weight = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), odds - MARGIN))
    tested = counts.select(
        "token", weight.alias("weight"), "clean", (part("toxic", pt) + part("clean", pc) - math.log(2)).alias("evidence"), (n * -math.log(min(pt, pc)) - math.log(2)).alias("most")
    )
    tested = stored(tested, "tokens")
    kept = stored(tested.filter(F.floor(F.col("evidence") * CELLS) / CELLS >= evidence_limit(tested)).select("token", "weight", "clean"), "lexicon")
    discard(tested)
    # Lambda solves sum p(s) exp(lambda s) = 1 over the scores of clean words, in at most 2 * CLIP * GRAINS + 1 cells.
    cells = kept.filter(~F.endswith(F.col("token"), F.lit("*"))).groupBy(F.round(F.col("weight") * GRAINS).cast("int").alias("cell")).agg(F.sum("clean").alias("n"))
    whole = cells.orderBy("cell").collect()
    s = np.array([r["cell"] / GRAINS for r in whole] + [DRIFT, CLIP])
    p = np.array([r["n"] for r in whole] + [20.0 * nc, 1.0])
    p /= p.sum()
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    law = max(lo, 0.05), float(max(1e-6, (p[s > 0]).sum()))
    if kept.count() > most:
        return kept.stored_at, *law
    lexicon = {r["token"]: r["weight"] for r in kept.select("token", "weight").collect()}
    discard(kept)
    return lexicon, *law


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, most_tokens: int = LEXICON_TOKENS) -> Segments:
    """Learn from rows of labels (doc_id, label 0/1). The token counts cover all of them, the
    curve is fitted on at most ``max_rows``. Without both classes every score is 0.5 or less."""
    rows = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    # Labels are small beside the texts: unless they measure large, the texts stay where they are.
    near = F.broadcast(rows) if fits_broadcast(rows) else rows
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(near, "doc_id")
    sizes = {r["label"]: r["count"] for r in docs.select("doc_id").join(near, "doc_id").groupBy("label").count().collect()}
    lexicon, rate, size = lexicon_of(token_counts(known), sizes.get(1, 0), sizes.get(0, 0), most_tokens)
    model = Segments({}, rate, size, table=lexicon) if isinstance(lexicon, str) else Segments(lexicon, rate, size)
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id")
    got = _evidence(sample, model, "label").toPandas()
    if got["label"].nunique() < 2:
        return replace(model, slope=0.0, shift=-1.0)
    x, y = np.log1p(np.maximum(got["evidence"].to_numpy(), 0)), got["label"].to_numpy(float)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps with a small ridge: classes that part cleanly stay finite
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 0.1 * slope, (y - p).sum() - 0.1 * shift])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, shift = slope + step[0], shift + step[1]
    return replace(model, slope=float(max(slope, 0.0)), shift=float(shift))


def _with_entries(docs: DataFrame, table: str, name: str) -> DataFrame:
    """docs with a column of the (token, weight) entries of a stored lexicon that their texts hold.

    Texts meet the lexicon by their distinct tokens, under two hashes of the text, so copies share
    their entries; what comes back is one row per different text.
    """
    left, right = fresh(docs.columns, "_left", "_right")
    named = docs.withColumn(left, F.xxhash64("text")).withColumn(right, F.xxhash64(F.lit(1), "text"))
    schema = pa.schema([("l", pa.int64()), ("r", pa.int64()), ("token", pa.string())])

    def tokens(batches):
        for batch in batches:
            for l, r, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = sorted({x for w in set(words_of(t)) for x in tokens_of(w)})
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(found)), pa.array([r] * len(found)), pa.array(found, pa.string())], schema=schema)

    held = named.select(left, right, "text").mapInArrow(tokens, "l long, r long, token string")
    lexicon = docs.sparkSession.read.parquet(table).select("token", "weight")
    entries = held.join(lexicon, "token").groupBy(F.col("l").alias(left), F.col("r").alias(right)).agg(F.collect_set(F.struct("token", "weight")).alias(name))
    return named.join(entries, [left, right], "left").select(*docs.columns, name)


def _readable(docs: DataFrame, model: Segments):
    """docs, with each text's own entries in a further last column if the lexicon is a table; and a
    function that gives (model, words, cache) of every row of a batch of such rows."""
    held = model.table is None
    (name,) = fresh(docs.columns, "_entries")
    rows = docs if held else _with_entries(docs, model.table, name)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON_TOKENS tokens at most

    def read(batch, seen):
        texts = batch.column(at).to_pylist()
        if held:
            return ((shared.value, words_of(t), seen) for t in texts)
        own = batch.column(batch.num_columns - 1).to_pylist()
        return ((replace(shared.value, lexicon={e["token"]: e["weight"] for e in es or []}), words_of(t), {}) for t, es in zip(texts, own))

    return rows, read


def _evidence(docs: DataFrame, model: Segments, other: str) -> DataFrame:
    kind = dict(docs.dtypes)[other]
    rows, read = _readable(docs.select(other, "text"), model)

    def run(batches):
        seen: dict[str, float] = {}
        for batch in batches:
            if batch.num_rows:
                x = [m.evidence(words, cache) for m, words, cache in read(batch, seen)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], [other, "evidence"])

    return rows.mapInArrow(run, f"{other} {kind}, evidence double")


def score_toxicity(docs: DataFrame, model: Segments, name: str = "score") -> DataFrame:
    """docs with a column of scores added: the probability of label 1.

    Null and empty texts hold no passage and get the score of a clean text. Only the text counts.
    """
    assert name not in docs.columns, name
    docs = docs.withColumn("text", F.col("text").cast("string"))
    width = len(docs.columns)
    rows, read = _readable(docs, model)
    curve = replace(model, lexicon={}).probability  # without the lexicon, which is sent once

    def run(batches):
        seen: dict[str, float] = {}
        for batch in batches:
            if batch.num_rows:
                x = np.array([m.evidence(words, cache) for m, words, cache in read(batch, seen)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(curve(x))], [*batch.schema.names[:width], name])

    return rows.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxic_passages(docs: DataFrame, model: Segments) -> DataFrame:
    """One row per significant passage: doc_id, first and last word (from 0), score, text of its words."""
    rows, read = _readable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("words", pa.string())])

    def run(batches):
        seen: dict[str, float] = {}
        for batch in batches:
            for i, (m, w, cache) in zip(batch.column(0).to_pylist(), read(batch, seen)):
                out = [(i, a, b - 1, s, " ".join(w[a:b])) for a, b, s in m.passages(w, cache)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, first_word long, last_word long, score double, words string")
