"""The dealt operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweir.llm.block_maxscore import build_index, search
from netweir.llm.common import reachable, stored, table
from netweir.llm.epsilon_grid import near_vectors
from netweir.llm.license_scan import licenses, scan
from netweir.llm.minhash_forest import near_duplicates
from netweir.llm.packing import place, token_pieces
from netweir.llm.pair_index_bpe import digests
from netweir.llm.parsed_fingerprints import edited_and_next
from netweir.llm.personal_data import personal_data
from netweir.llm.quality_trees import fit_quality, score_quality
from netweir.llm.stripes import divergences
from netweir.llm.text_density import extract
from netweir.llm.toxic_segments import fit_toxicity, score_toxicity
from netweir.llm.warc_index import write_and_read
from netweir.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(reachable(configure(spark)), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op9_minhash_forest")
def minhash_forest(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def fold(folds: int, held: int) -> Column:
    """Whether crc32 of the id as text (a null id: empty text) leaves ``held`` modulo ``folds``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == held


def training_labels(spark, sf_dir, column, held_out=None):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))
    return labels if held_out is None else labels.filter(~held_out)


@query("op8_quality_trees")
def quality_trees(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, training_labels(spark, sf_dir, "quality", fold(5, 0)))
    scored = score_quality(docs, model)
    return scored.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_toxic_segments")
def toxic_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, training_labels(spark, sf_dir, "toxic", fold(3, 1)))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_packing")
def packing(spark, sf_dir):
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    pieces = stored(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "pieces")
    return place(pieces, ["doc_id", "start", "ids_crc32"])


@query("op7_pair_index_bpe")
def pair_index_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_parsed_fingerprints")
def parsed_fingerprints(spark, sf_dir):
    return edited_and_next(table(spark, sf_dir, "documents"))


@query("op6_text_density")
def text_density(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query(
    "op1_epsilon_grid",
    """WITH RECURSIVE v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
    reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, p.b FROM reach JOIN p ON p.a = reach.r),
    c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
    n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
    FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
)
def epsilon_grid(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


@query(
    "op2_warc_index",
    """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id > min(page_id) OVER (PARTITION BY payload_digest)
      THEN min(page_id) OVER (PARTITION BY payload_digest) END AS refers_to FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM f""",
)
def warc_index(spark, sf_dir):
    return write_and_read(table(spark, sf_dir, "pages")).drop("url")


@query("op5_license_scan")
def license_scan(spark, sf_dir):
    """Documents as files of a tree: source, language, thousands of ids."""
    docs = table(spark, sf_dir, "documents")
    part = [F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")]
    return licenses(stored(scan(docs.select("doc_id", F.concat_ws("/", *part).alias("path"), "text")), "scanned"))


@query(
    "op11_block_maxscore",
    r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    o AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM o, s WHERE term IN (SELECT term FROM q) GROUP BY term),
    x AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN o USING (term), s GROUP BY item_id, r, doc_id),
    k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
    SELECT * FROM k WHERE rank <= 50""",
)
def block_maxscore(spark, sf_dir):
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@query(
    "op12_stripes",
    r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    o AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
    k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
    a AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    p AS (SELECT lang, source, term, n, 1 + (1000000000 * CAST(n + 2 AS HUGEINT)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM a JOIN v USING (lang)),
    t AS (SELECT lang, term, sum(n) AS n FROM a GROUP BY ALL),
    q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM t JOIN v USING (lang)),
    f AS (SELECT x.lang, x.source, y.source AS item, CAST(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS BIGINT) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
    o2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
    SELECT * FROM o2 WHERE part = 'pair' OR rank <= 10""",
)
def stripes(spark, sf_dir):
    return divergences(table(spark, sf_dir, "documents"))


@query("op13_personal_data")
def weak_supervision(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))
