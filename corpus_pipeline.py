"""A corpus from raw documents to packed sequences: quality, toxicity, near duplicates, packing.

Every stage reads what the one before it wrote. A document stays unless a stage has evidence
against it; all stages but the last return the columns of documents as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweir.llm.common import fresh, reachable, small_batches, stored, table
from netweir.llm.minhash_forest import groups, text_hash
from netweir.llm.packing import place, token_pieces
from netweir.llm.quality_trees import fit_quality, score_quality
from netweir.llm.toxic_segments import fit_toxicity, score_toxicity
from netweir.operators.joins import fits_broadcast
from netweir.session import configure

#: A document goes below this chance of being good, or from this chance of being toxic.
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.7


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are judged like any."""
    (score,) = fresh(docs.columns, "score")
    model = fit_quality(docs, _labels(spark, sf_dir, "quality"))
    return score_quality(docs, model, score).filter(F.col(score) >= LEAST_QUALITY).drop(score)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without significant toxic passages."""
    (score,) = fresh(docs.columns, "score")
    model = fit_toxicity(docs, _labels(spark, sf_dir, "toxic"))
    return score_toxicity(docs, model, score).filter(F.col(score) < MOST_TOXIC).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (of texts
    under one doc_id that are near duplicates: the one with the smallest hash).

    Texts that are no near duplicates stay, also under a common doc_id. Rows that repeat doc_id
    and text stay once: the first by their other columns. A null doc_id is no document's and
    stays, as do texts without words.
    """
    (mark,) = fresh(docs.columns, "text_hash")
    rows = stored(groups(docs, words=5, percent=80).select("doc_id", "text_hash", "group_id"), "groups")
    grouped = rows.filter("group_id is not null")
    first = grouped.groupBy("group_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    dropped = grouped.join(first, "group_id").filter(F.struct("doc_id", "text_hash") != F.col("first")).select("doc_id", F.col("text_hash").alias(mark)).distinct()
    marked = docs.withColumn(mark, text_hash("text"))
    dropped = stored(dropped, "dropped")
    # Texts move only if the list of what goes is too large to be sent to them.
    kept = marked.join(F.broadcast(dropped) if fits_broadcast(dropped) else dropped, ["doc_id", mark], "left_anti")
    again = rows.filter("doc_id is not null").groupBy("doc_id", F.col("text_hash").alias(mark)).count().filter("count > 1").select("doc_id", mark)
    again = stored(again, "repeated")
    if again.isEmpty():
        return kept.select(*docs.columns)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    turn = F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(*(others or ["doc_id"])))
    once = kept.join(again, ["doc_id", mark], "left_semi").withColumn(mark + "_turn", turn).filter(F.col(mark + "_turn") == 1)
    return kept.join(again, ["doc_id", mark], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place in it."""
    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stored(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return place(pieces, ["doc_id", "start", "ids_crc32"])


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(small_batches(reachable(configure(spark))), docs, sf_dir)

    return run


STAGES = [("quality", _stage(quality)), ("toxicity", _stage(toxicity)), ("near_dedup", _stage(near_dedup)), ("packing", _stage(packing))]

#: Trained scores and MinHash candidates have no SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
