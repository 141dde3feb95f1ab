"""Vector queries (PIPE-3): FN-9/10, UDF-5, SRC-7, JOIN-4/5, WIN-1, TOPK-3,
AGG-7/8, UDF-7, FN-16."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .oracle import py_strip, with_ctes
from .registry import query, split_labelled
from ..operators import vectors as V

DIM = 64
K = 5


def _norm_sql(src: str, idcol: str) -> str:
    return f"""(SELECT {idcol}, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS v{', label' if idcol == 'vec_id' else ''}
  FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS v,
          sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS nrm FROM {src}))"""


@query("l2_normalize", """SELECT vec_id, pos, round(x, 6) AS value FROM (
  SELECT vec_id, unnest(range(len(v))) AS pos, unnest(CASE WHEN nrm > 0 THEN list_transform(v, lambda y: y / nrm) ELSE v END) AS x
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
          sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS nrm FROM embeddings))""")
def q_l2_normalize(spark, sf_dir):
    """FN-9: every vector normalised, one row per component."""
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("pos", "value")) \
            .select("vec_id", F.col("pos").cast("long").alias("pos"), "value")


TOPK_SQL = f"""s AS (SELECT q.query_id, c.vec_id, c.label, list_dot_product(q.v, c.v) AS score
  FROM {_norm_sql('fx_query', 'query_id')} q CROSS JOIN {_norm_sql('fx_corpus', 'vec_id')} c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s),
hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score, label FROM r WHERE rank <= {K})"""


def hits(spark, sf_dir):
    return V.topk_similar(fx.fx_query(spark, sf_dir), fx.fx_corpus(spark, sf_dir), k=K, carry=("label",))


@query("topk_similar", with_ctes(f"""WITH {TOPK_SQL}
SELECT query_id, rank, vec_id, round(score, 6) AS score, label FROM hits""", "fx_query", "fx_corpus"))
def q_topk_similar(spark, sf_dir):
    """JOIN-4 / WIN-1 / FN-10: exact top-5 of every query vector against the
    labelled corpus, written as blocks that the query tasks read in place."""
    return hits(spark, sf_dir)


@query("topk_blocks", with_ctes(f"""WITH {TOPK_SQL}
SELECT query_id, rank, vec_id, round(score, 6) AS score, label FROM hits""", "fx_query", "fx_corpus"))
def q_topk_blocks(spark, sf_dir):
    """JOIN-4 over an index of many small blocks: each block has a pivot and a
    radius, and those that the triangle inequality rules out are not read."""
    return V.topk_similar(fx.fx_query(spark, sf_dir), fx.fx_corpus(spark, sf_dir), k=K, carry=("label",),
                          corpus_block_rows=256)


@query("retrieved_label_distribution", with_ctes(f"""WITH {TOPK_SQL}
SELECT query_id, coalesce(label, 'unknown') AS label, count(*) AS n FROM hits GROUP BY 1, 2""", "fx_query", "fx_corpus"))
def q_retrieved_label_distribution(spark, sf_dir):
    """AGG-7: label counts among each query's hits."""
    return V.retrieved_label_distribution(hits(spark, sf_dir))


_ORDER = "list_position(['valid', 'advertisement', 'irrelevant', 'rants without visit'], label)"


@query("knn_vote", with_ctes(f"""WITH {TOPK_SQL},
d AS (SELECT query_id, coalesce(label, 'unknown') AS label, count(*) AS n FROM hits GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, coalesce({_ORDER}, 5), label) AS r FROM d)
SELECT query_id, label AS knn_label, n AS votes FROM w WHERE r = 1""", "fx_query", "fx_corpus"))
def q_knn_vote(spark, sf_dir):
    """UDF-7: majority label of the 5 nearest labelled vectors."""
    return V.knn_vote(hits(spark, sf_dir))


@query("index_stats", with_ctes("""SELECT 'total_vectors' AS metric, NULL AS key, count(*) AS value FROM fx_corpus
UNION ALL SELECT 'embedding_dimension', NULL, max(len(embedding)) FROM fx_corpus
UNION ALL SELECT 'data_columns', NULL, 3
UNION ALL SELECT 'label_count', label, count(*) FROM fx_corpus WHERE label IS NOT NULL GROUP BY label""", "fx_corpus"))
def q_index_stats(spark, sf_dir):
    """AGG-8: index statistics and label distribution."""
    return V.index_stats(fx.fx_corpus(spark, sf_dir))


# ---- text retrieval over composed reviews (RAG) ----

def hash_emb_sql(src: str, idcol: str, textcol: str) -> str:
    """Sparse form (id, bucket, value) of the hashed embedding, in SQL."""
    txt = f"coalesce(nullif({py_strip(textcol)}, ''), 'No content')"
    return f"""(SELECT {idcol} AS id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {idcol})) AS value FROM (
  SELECT {idcol}, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {DIM} AS bucket, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT {idcol}, unnest(regexp_split_to_array(lower({txt}), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {src})
  WHERE t <> '' GROUP BY 1, 2))"""


@query("hash_embeddings", with_ctes(f"""SELECT id AS review_id, CAST(bucket AS BIGINT) AS bucket, round(value, 6) AS value
FROM {hash_emb_sql('fx_composed', 'review_id', 'text_info')}""", "fx_composed"))
def q_hash_embeddings(spark, sf_dir):
    """UDF-5 / FN-13: shipped hashed bag-of-words embedder over whole texts
    (non-zero components, one row each)."""
    from .registry import composed
    c = composed(spark, sf_dir)
    e = c.select("review_id", F.posexplode(V.hash_embedding("text_info", DIM)).alias("bucket", "value"))
    return e.filter(F.col("value") != 0).select("review_id", F.col("bucket").cast("long").alias("bucket"), "value")


def rag_sides(spark, sf_dir):
    """Index = labelled train rows (PRED-1 on text/label), queries = test rows.

    The labelled, embedded table is written once to the shared checkpoint
    folder and read back by both sides (stage boundary, as between the
    reference's steps), so the join/compose/embed work runs once instead
    of once per branch and survives lost executors."""
    from ..session import materialize
    s = split_labelled(spark, sf_dir)
    needed = (F.col("split") == "test") | (F.col("text_info").isNotNull() & F.col("ai_classification").isNotNull())
    s = s.filter(needed).select("review_id", "store_info", "text_info", "ai_classification", "split",
                                V.hash_embedding("text_info", DIM).alias("embedding"))
    s = materialize(s, "rag-embedded")
    idx = (s.filter(F.col("split") == "train").dropna(subset=["text_info", "ai_classification"])
           .select(F.col("review_id").alias("vec_id"), "store_info", "text_info", "ai_classification", "embedding"))
    qs = s.filter(F.col("split") == "test").select(
        F.col("review_id").alias("query_id"), "store_info", "text_info", "embedding")
    return qs, idx


RAG_SQL = f"""idx AS (SELECT review_id, store_info, text_info, ai_classification FROM fx_split
  WHERE split = 'train' AND text_info IS NOT NULL AND ai_classification IS NOT NULL),
qs AS (SELECT review_id, store_info, text_info FROM fx_split WHERE split = 'test'),
qe AS {hash_emb_sql('qs', 'review_id', 'text_info')},
ie AS {hash_emb_sql('idx', 'review_id', 'text_info')},
sc AS (SELECT qe.id AS query_id, ie.id AS vec_id, sum(qe.value * ie.value) AS score
  FROM qe JOIN ie ON qe.bucket = ie.bucket GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM sc),
rhits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM rk WHERE rank <= {K}),
ex AS (SELECT h.query_id, string_agg('Business: "' || coalesce(i.store_info, '') || '"' || chr(10) || 'User comment: "'
    || coalesce(i.text_info, '') || '"' || chr(10) || 'Classification: ' || coalesce(i.ai_classification, ''),
    chr(10) || chr(10) ORDER BY h.rank) AS examples
  FROM rhits h JOIN idx i ON h.vec_id = i.review_id GROUP BY h.query_id),
rex AS (SELECT q.review_id AS query_id, coalesce(ex.examples, 'No similar examples found.') AS examples
  FROM qs q LEFT JOIN ex ON q.review_id = ex.query_id)"""


def rag_hits(spark, sf_dir):
    qs, idx = rag_sides(spark, sf_dir)
    return qs, idx, V.topk_similar(qs, idx, k=K, carry=("ai_classification",))


@query("rag_topk", with_ctes(f"""WITH {RAG_SQL} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM rhits""",
                             "fx_split"))
def q_rag_topk(spark, sf_dir):
    """JOIN-4 over hashed text embeddings: 5 nearest labelled train reviews
    for every test review (query = comment text, as in retrieval)."""
    _, _, h = rag_hits(spark, sf_dir)
    return h.select("query_id", "rank", "vec_id", "score")


@query("rag_examples_text", with_ctes(f"WITH {RAG_SQL} SELECT query_id, examples FROM rex", "fx_split"))
def q_rag_examples_text(spark, sf_dir):
    """FN-16 / TOPK-3 / JOIN-5: retrieved examples formatted for the prompt."""
    qs, idx, h = rag_hits(spark, sf_dir)
    return V.examples_text(qs, h, idx, max_examples=K)


@query("build_index", with_ctes(f"""WITH idx AS (SELECT review_id, ai_classification, text_info FROM fx_split
  WHERE split = 'train' AND text_info IS NOT NULL AND ai_classification IS NOT NULL),
e AS {hash_emb_sql('idx', 'review_id', 'text_info')}
SELECT i.review_id AS vec_id, i.ai_classification AS label, count(e.bucket) AS nonzero,
  round(sqrt(sum(e.value * e.value)), 6) AS norm
FROM idx i LEFT JOIN e ON i.review_id = e.id GROUP BY 1, 2""", "fx_split"))
def q_build_index(spark, sf_dir):
    """PIPE-3: PRED-1 -> FN-13 -> UDF-5 -> FN-9 -> index rows (vec_id,
    label, non-zero components, norm)."""
    _, idx = rag_sides(spark, sf_dir)
    return idx.select("vec_id", F.col("ai_classification").alias("label"),
                      F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nonzero"),
                      V.l2_norm("embedding").alias("norm"))
