"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the bytes and word hashes of the whole text. Labels are learnt from a
bounded sample of labelled rows (``MAX_ROWS``, in the order of a hash of the id). The trees are
flattened into arrays and walked for all rows of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netweir.llm.common import IS_BLANK, mix, word_hashes

MAX_ROWS = 40_000  # labelled rows that are learnt from; all documents are scored
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.15, 5.0
LETTERS_UP, LETTERS_LOW, DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)
MARKS = np.array([b in b"#$%&*+<=>@[\\]^_`{|}~" for b in range(256)])
STOPS = np.array([b in b".,;:?'\"()-" for b in range(256)])
STATS = [
    "words", "bytes_per_word", "upper", "digits", "marks", "stops", "bangs", "bars", "wide", "blanks",
    "distinct", "top_word", "same_as_before", "distinct_pairs", "top_pair", "distinct_fives", "lines", "repeated_lines",
    "words_per_line", "longest_word", "digit_words", "marked_words",
]


def statistics(text: str | None) -> np.ndarray:
    """One value per name in STATS; all zero for a text without words."""
    out = np.zeros(len(STATS))
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    h = word_hashes(data)
    if not len(h):
        return out
    count = np.bincount(data, minlength=256)
    solid = ~IS_BLANK[data]
    size, n = int(solid.sum()), len(h)
    upper, lower = count[LETTERS_UP].sum(), count[LETTERS_LOW].sum()
    _, times = np.unique(h, return_counts=True)
    out[0] = np.log1p(n)
    out[1] = size / n
    out[2] = upper / max(1, upper + lower)
    out[3] = count[DIGITS].sum() / size
    out[4] = count[MARKS].sum() / size
    out[5] = count[STOPS].sum() / size
    out[6] = count[33] / n
    out[7] = count[124] / n
    out[8] = count[128:].sum() / size
    out[9] = (len(data) - size) / n
    out[10] = np.log(len(times)) / np.log(n) if n > 1 else 1.0
    out[11] = times.max() / n if n > 1 else 0.0
    if n > 1:
        out[12] = (h[1:] == h[:-1]).mean()
        _, twos = np.unique(mix(h[:-1] * np.uint64(3) + h[1:]), return_counts=True)
        out[13], out[14] = len(twos) / (n - 1), twos.max() / (n - 1)
    else:
        out[13], out[14] = 1.0, 0.0
    if n > 4:
        fives = mix(mix(h[:-4] * np.uint64(3) + h[1:-3]) * np.uint64(5) + mix(h[2:-2] * np.uint64(7) + h[3:-1]) + h[4:])
        out[15] = len(np.unique(fives)) / (n - 4)
    else:
        out[15] = 1.0
    lines = [x for x in (text or "").split("\n") if x.strip()]
    out[16] = np.log1p(len(lines))
    out[17] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    out[18] = n / max(1, len(lines))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out[19] = np.log1p((ends - starts).max())
    kinds = np.concatenate(([0], np.cumsum(MARKS[data] | (data == 33))))
    out[21] = (kinds[ends] > kinds[starts]).mean()
    kinds = np.concatenate(([0], np.cumsum((data >= 48) & (data < 58))))
    out[20] = (kinds[ends] > kinds[starts]).mean()
    return out


@dataclass(frozen=True)
class Forest:
    """All trees in flat arrays: node i goes to left[i] if x[feature[i]] <= limit[i], else right[i];
    a leaf points to itself. ``roots`` holds the first node of each tree."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost logistic loss with second-order splits on histograms of at most BINS bins.

    Without rows of both classes every score is the (smoothed) share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    feature, limit, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        total = np.full(len(y), start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            roots.append(len(feature))
            open_nodes = [(np.arange(len(y)), 0)]
            while open_nodes:
                rows, depth = open_nodes.pop(0)
                me = len(feature)
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-3, None, None)
                if depth < DEPTH and len(rows) >= 20:
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        hist_g = np.cumsum(np.bincount(codes[j, rows], g[rows], len(c) + 1))[:-1]
                        hist_h = np.cumsum(np.bincount(codes[j, rows], h[rows], len(c) + 1))[:-1]
                        gain = hist_g**2 / (hist_h + L2) + (gs - hist_g) ** 2 / (hs - hist_h + L2) - gs**2 / (hs + L2)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                step = RATE * gs / (hs + L2)
                feature.append(0), limit.append(np.inf), left.append(me), right.append(me), value.append(step)
                if best[1] is None:
                    total[rows] += step
                    continue
                j, k = best[1], best[2]
                low = codes[j, rows] <= k
                feature[me], limit[me] = j, cuts[j][k]
                for part in (rows[low], rows[~low]):
                    open_nodes.append((part, depth + 1))
                # Nodes are numbered in the order they are taken: behind all that wait.
                waiting = len(open_nodes)
                left[me], right[me] = me + waiting - 1, me + waiting
    if not roots:
        roots, feature, limit, left, right, value = [0], [0], [np.inf], [0], [0], [0.0]
    return Forest(*(np.array(a) for a in (feature, limit, left, right, value, roots)), start)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """Learn from rows of labels (doc_id, label 0/1); at most ``max_rows`` of them."""
    rows = labels.filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    some = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x))], ["label", "x"])

    got = known.select("doc_id", "label", "text").mapInArrow(run, "label int, x array<double>").toPandas()
    order = sorted(range(len(got)), key=lambda i: (got["label"][i], list(got["x"][i])))
    x = np.array([got["x"][i] for i in order]).reshape(-1, len(STATS))
    return fit_forest(x, np.array([got["label"][i] for i in order], float))


def score_quality(docs: DataFrame, model: Forest, name: str = "score") -> DataFrame:
    """docs with a column of scores added: the probability of label 1.

    Null and empty texts get the score of all-zero statistics. No column but the text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TREES * 2**(DEPTH + 1) nodes
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t) for t in batch.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], [*batch.schema.names, name])

    assert name not in docs.columns, name
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
