"""run() against a plain version of the stages on the same table."""

import corpus_pipeline as cp
import pytest
from test_minhash_forest import brute
from test_packing import check

from netweir.llm.quality_trees import fit_quality, statistics
from netweir.llm.toxic_segments import fit_toxicity, words_of

SF = "/root/testdata/sf0.01"


def test_run_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = fit_quality(docs, labels.selectExpr("doc_id", "quality AS label"))
    rows = [(i, t) for i, t in rows if good.score(statistics(t)[None])[0] >= 0.3]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    toxic = fit_toxicity(left, labels.selectExpr("doc_id", "toxic AS label"))
    rows = [(i, t) for i, t in rows if toxic.probability(toxic.evidence(words_of(t), {})) < 0.7]
    classes = brute(rows, 5)
    rows = {i: t for i, t in rows if classes[i][1] == i}
    check(cp.run(spark, SF).collect(), rows, 1024, lambda r: r.ids_crc32)


def test_stages_keep_columns_and_cope(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in cp.STAGES[:-1]:
            out = cp.stored(stage(spark, docs, SF), name)
            assert out.columns == docs.columns, name
    kept = cp.STAGES[2][1](spark, edge_docs, SF).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13]
    assert sum(r.doc_id is None for r in kept) == 2


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_names(name):
    assert callable(dict(cp.STAGES)[name])


def test_no_text_is_lost(spark):
    """Texts under one doc_id go only if a near duplicate of them stays."""
    a, b, c = "p q r s t u v", "k l m n o p q r", "d e f g h i j"
    rows = [(1, a), (1, b), (2, b), (3, c), (5, a), (5, "x y z w v u"), (6, b + " s t"), (7, None), (7, ""), (None, a), (8, c.upper()), (3, c)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, text_hash string")
    kept = sorted(((r.doc_id, r.text) for r in cp.STAGES[2][1](spark, docs, SF).collect()), key=str)
    assert kept in [sorted([(1, a), (1, b), (3, c), (5, "x y z w v u"), (7, x), (None, a), *far], key=str) for x in (None, "") for far in ([(6, b + " s t")],)]
