"""The lexicon of op10: words of toxic texts only, chance words, and held-out texts by language."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netweir.llm import toxic_segments as ts
from netweir.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_rare_words_of_toxic_texts_only(spark):
    """12 of 3,000 texts, all toxic: below any cut by the share of all texts."""
    counts = spark.createDataFrame([("rare", 12, 0), ("once", 1, 0), ("even", 30, 270), ("clean", 0, 300)], "token string, toxic long, clean long")
    lexicon, _, _ = ts.lexicon_of(counts, 300, 2700)
    assert lexicon["rare"] > 0 > lexicon["clean"] and not {"once", "even"} & set(lexicon)


def test_chance_words_stay_out(spark):
    rnd = random.Random(5)
    rows = [(f"w{k}", sum(rnd.random() < 0.1 for _ in range(n)), n) for k in range(20_000) for n in [rnd.randint(1, 60)]]
    counts = spark.createDataFrame([(t, x, n - x) for t, x, n in rows], "token string, toxic long, clean long")
    assert len(ts.lexicon_of(counts, 30_000, 270_000)[0]) <= 2


def test_evidence_bounds_the_exact_tail(spark):
    """exp(-evidence) is at least twice the hypergeometric tail, so the false-discovery bound holds."""
    nt, nc = 30, 170
    for n in (1, 3, 8, 20):
        for k in range(n + 1):
            if k / n > nt / (nt + nc):
                tail = sum(math.comb(nt, x) * math.comb(nc, n - x) for x in range(k, min(n, nt) + 1)) / math.comb(nt + nc, n)
                llr = k * math.log(k / n * (nt + nc) / nt) + ((n - k) * math.log((n - k) / n * (nt + nc) / nc) if k < n else 0)
                assert tail <= math.exp(-llr) * (1 + 1e-9)


def test_repeated_words_count_again():
    """A word that returns every 30 words counts at 0, 60 and 120."""
    model = ts.Segments({"vile": 6.0}, 1.0, 1.0)
    scores = model.scores(["vile" if k % 30 == 0 else "road" for k in range(150)], {})
    assert [k for k, s in enumerate(scores) if s > 0] == [0, 60, 120]


def test_lexicon_as_a_table(spark, edge_docs):
    """A lexicon beyond the limit stays a table: same scores and passages, copies, nulls, clashing names and repeated rows included."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(30)) + (" vile brute" * 3 if k % 3 == 0 else "")) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, label int")
    held, table = ts.fit_toxicity(docs, labels), ts.fit_toxicity(docs, labels, most_tokens=1)
    assert held.table is None and table.table and not table.lexicon
    assert (table.rate, table.size, table.slope, table.shift) == pytest.approx((held.rate, held.size, held.slope, held.shift))
    more = docs.unionByName(docs.filter("doc_id < 20")).unionByName(spark.createDataFrame([(None, None), (500, ""), (501, "vile " * 5000)], "doc_id long, text string"))
    for given in (more.withColumn("_left", F.lit(1)).withColumn("_entries", F.lit("x")), edge_docs):
        a, b = ts.score_toxicity(given, held, "p"), ts.score_toxicity(given, table, "p")
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert sorted(map(tuple, ts.toxic_passages(docs, held).collect())) == sorted(map(tuple, ts.toxic_passages(docs, table).collect()))


@pytest.mark.parametrize("lang,least", [("de", 0.5), ("en", 0.5), ("es", 0.25), ("fr", 0.5)])
def test_held_out_by_language(spark, held_out, lang, least):
    """Floors well below what was measured (see the README), far above what a cut by share found."""
    toxic, found, clean, flagged = held_out[lang]
    print(lang, "recall", found, "of", toxic, "false positives", flagged, "of", clean)
    assert found >= least * toxic and flagged <= 0.02 * clean


@pytest.fixture(scope="module")
def held_out(spark):
    scored = QUERIES["op10_toxic_segments"](spark, SF).filter("held_out").select("doc_id", "predicted")
    known = scored.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    clean = 1 - F.col("toxic")
    rows = known.groupBy("lang").agg(F.sum("toxic"), F.sum(F.col("toxic") * F.col("predicted")), F.sum(clean), F.sum(clean * F.col("predicted"))).collect()
    return {r[0]: tuple(r)[1:] for r in rows}
