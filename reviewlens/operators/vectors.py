"""Vectors: normalise, embed, exact top-k similarity join, retrieval.

FN-9, FN-10, FN-13, UDF-5, JOIN-4/5, WIN-1, TOPK-3, AGG-7/8, UDF-7, FN-16.

Exact top-k at scale (JOIN-4): the corpus is written once as blocks, which
the tasks that hold the queries read in place, skipping those that a bound
shows to hold no hit (``block_index``). Only queries are shuffled; no corpus
row is copied, and no pair is ever materialised as a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASSES, NO_CONTENT, NO_EXAMPLES, PY_WS
from ..functions.text import let
from .block_index import save_blocks, topk_blocks
from .join import skew_safe_join


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """FN-9: unit length; a zero vector stays zero."""
    return let(_c(v).cast("array<double>"), lambda a: let(l2_norm(a), lambda n: F.when(
        n > 0, F.transform(a, lambda x: x / n)).otherwise(a)))


def dot(a, b) -> Column:
    """FN-10: inner product accumulated in DOUBLE."""
    return F.aggregate(F.zip_with(_c(a).cast("array<double>"), _c(b).cast("array<double>"), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def hash_bucket(token: Column, dim: int) -> Column:
    """First 32 bits of md5(token), modulo ``dim``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def hash_embedding(text, dim: int = 64) -> Column:
    """UDF-5 shipped embedder (no model, no network): lower-cased word
    tokens hashed (md5, first 32 bits) into ``dim`` buckets, counts L2
    normalised. Whole texts, pure column expressions, no shuffle: tokens
    are hashed once per row, then the buckets and one of each number below
    ``dim`` are sorted, so that each bucket's count is the length of its run
    less one. Work grows with tokens + dim, not with their product."""
    # FN-13 without rewriting the text: stripping cannot change the tokens
    # (white space separates them), only a blank text becomes 'No content'
    t = _c(text).cast("string")
    t = F.when(t.isNull() | t.rlike(rf"(?U)^{PY_WS}*$"), F.lit(NO_CONTENT)).otherwise(t)
    toks = F.array_remove(F.split(F.lower(t), TOKEN_SPLIT), "")
    buckets = F.transform(toks, lambda t: hash_bucket(t, dim))
    runs = F.sort_array(F.concat(buckets, F.sequence(F.lit(0), F.lit(dim - 1))))

    def counted(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                          lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda st: F.transform(
            st, lambda at, j: (F.coalesce(F.get(st, j + 1), F.size(s)) - at - 1).cast("double")))

    return l2_normalize(let(runs, counted))


def _embed_bisect(embed_fn, texts: list[str], dim: int) -> tuple[list, list]:
    """Split a failing chunk in halves until the failing texts are found;
    they get a zero vector, their neighbours their real embedding."""
    if len(texts) == 1:
        try:
            return list(embed_fn(texts)), [False]
        except Exception:  # noqa: BLE001
            return [[0.0] * dim], [True]
    vecs, failed = [], []
    mid = len(texts) // 2
    for half in (texts[:mid], texts[mid:]):
        try:
            vecs.extend(embed_fn(half))
            failed.extend([False] * len(half))
        except Exception:  # noqa: BLE001
            v, f = _embed_bisect(embed_fn, half, dim)
            vecs.extend(v)
            failed.extend(f)
    return vecs, failed


def embed_batches(df: DataFrame, text_col: str, embed_fn, out_col: str = "embedding",
                  batch_size: int = 100, dim: int | None = None, max_retries: int = 3,
                  base_wait: float = 1.0, on_failure: str = "zero") -> DataFrame:
    """UDF-5 for user models: ``embed_fn(list[str]) -> list[list[float]]``
    called per Arrow batch of ``batch_size`` texts inside ``mapInPandas``
    (the client is built once per partition by ``embed_fn`` itself).
    Retries with waits of base_wait*2**attempt s; after the last failure the
    chunk is bisected and only the failing texts get a zero vector and
    ``embed_failed = true`` (UDF-4, index side; ``dim`` must be given), or the
    task fails with ``on_failure="raise"`` (query side)."""
    import time

    from pyspark.sql.types import ArrayType, BooleanType, FloatType, StructType
    if on_failure != "raise" and not dim:
        raise ValueError("a zero vector needs dim, the length of the embedder's vectors")
    schema = StructType(list(df.schema.fields)).add(out_col, ArrayType(FloatType())).add("embed_failed", BooleanType())

    def run(it):
        for pdf in it:
            texts = pdf[text_col].fillna("").astype(str).str.strip().replace("", "No content").tolist()
            vecs, failed = [], []
            for i in range(0, len(texts), batch_size):
                chunk = texts[i:i + batch_size]
                for attempt in range(max_retries):
                    try:
                        out = embed_fn(chunk)
                        vecs.extend(out)
                        failed.extend([False] * len(chunk))
                        break
                    except Exception:  # noqa: BLE001
                        if attempt == max_retries - 1:
                            if on_failure == "raise":  # query side: no silent zero vector
                                raise
                            v, f = _embed_bisect(embed_fn, chunk, dim)  # only failing texts get zeros
                            vecs.extend(v)
                            failed.extend(f)
                        elif base_wait > 0:
                            time.sleep(base_wait * 2 ** attempt)
            pdf[out_col] = vecs
            pdf["embed_failed"] = failed
            yield pdf

    return df.mapInPandas(run, schema)


BLOCK_FLOATS = 1 << 25          # numbers of a corpus block (~256 MB as float64)


def is_usable(embedding, dim: int | None) -> Column:
    """A vector of ``dim`` finite numbers (None: of any length)."""
    v = _c(embedding).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    right = F.size(v) == dim if dim is not None else F.lit(True)
    return F.coalesce(v.isNotNull() & right & ~bad, F.lit(False))


def usable_vectors(df: DataFrame, embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    return df.filter(is_usable(embedding, dim))


def unusable_vectors(df: DataFrame, embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """The rows that ``topk_similar`` sets apart: NULL, short, long or
    non-finite vectors. They are no hits, get none, and disturb no other."""
    return df.filter(~is_usable(embedding, dim))


def vector_sizes(queries: DataFrame, corpus: DataFrame, embedding: str = "embedding") -> tuple[dict, dict]:
    """How many usable vectors of each length the queries and the corpus
    have: one aggregate over both."""
    sides = (usable_vectors(queries, embedding).select(F.lit(0).alias("side"), F.size(embedding).alias("d"))
             .unionByName(usable_vectors(corpus, embedding).select(F.lit(1).alias("side"), F.size(embedding).alias("d"))))
    rows = sides.groupBy("side", "d").count().filter("d > 0").collect()
    return tuple({r["d"]: r["count"] for r in rows if r["side"] == side} for side in (0, 1))


def common_dim(asked: dict, held: dict) -> int | None:
    """The most frequent length of the corpus's vectors (None: there is none).
    Raises where two lengths are as frequent, or where the queries' most
    frequent length is another."""
    if not held:
        return None
    most = sorted(held, key=lambda d: (-held[d], d))
    if len(most) > 1 and held[most[0]] == held[most[1]]:
        raise ValueError(f"corpus vectors of length {most[0]} come as often as those of {most[1]}: give dim")
    if asked and asked.get(most[0], 0) < max(asked.values()):
        raise ValueError(f"corpus vectors have length {most[0]}, queries {max(asked, key=lambda d: (asked[d], -d))}")
    return most[0]


def topk_similar(queries: DataFrame, corpus: DataFrame, k: int = 5, query_id: str = "query_id",
                 vec_id: str = "vec_id", embedding: str = "embedding", carry=("label",),
                 normalize: bool = True, corpus_block_rows: int = 50_000, query_block_rows: int = 4096,
                 exclude_self: bool = False, tie_decimals: int = 9, skip_failed: bool = True,
                 dim: int | None = None, index_path: str | None = None, report: bool = False) -> DataFrame:
    """JOIN-4 + WIN-1: exact inner-product top k of every query against the
    corpus (flat-index semantics; cosine after FN-9). Rows:
    (query_id, rank 1..k, vec_id, score, carry...). Fewer than k rows when
    the corpus is smaller than k (JOIN-5). Ranking uses the score rounded
    to ``tie_decimals`` so that float summation order cannot reorder
    equal vectors; exact ties go to the lower vec_id. The rounding departs
    from raw score order for scores closer than that. The corpus is written
    once as blocks that the query tasks read in place (``block_index``), to
    ``index_path`` or a stage folder; ``report`` adds, for each query, the
    blocks read and their number. Vectors that are NULL, of another length
    than ``dim`` (None: the corpus's most frequent, see ``common_dim``) or not
    finite are set apart on both sides (``unusable_vectors`` lists them)."""
    from ..session import run_folder, stable  # inputs are read more than once: never re-run a model
    queries, corpus = stable(queries, "topk-queries"), stable(corpus, "topk-corpus")
    if skip_failed and "embed_failed" in corpus.columns:  # UDF-4: zero vectors of failed embeddings
        corpus = corpus.filter(~F.coalesce(F.col("embed_failed"), F.lit(False)))
    carry = [c for c in carry if c in corpus.columns]
    asked, held = vector_sizes(queries, corpus, embedding)
    dim_ = dim if dim is not None else common_dim(asked, held)
    queries, corpus = (usable_vectors(x, embedding, dim_) for x in (queries, corpus))
    if not asked.get(dim_) or not held.get(dim_):  # same columns as a non-empty result, no rows
        kind = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
        return queries.sparkSession.createDataFrame(
            [], f"{query_id} {queries.schema[query_id].dataType.simpleString()}, rank int, {vec_id} {kind[vec_id]}, "
                "score double" + "".join(f", {x} {kind[x]}" for x in carry)
                + (", blocks_read int, blocks int" if report else ""))
    rows = max(1, min(corpus_block_rows, BLOCK_FLOATS // dim_))
    path = index_path or f"{run_folder(queries.sparkSession)}/blocks-{uuid.uuid4().hex}"
    corpus = corpus.select(vec_id, embedding, *carry)
    save_blocks(corpus, path, held[dim_], vec_id, embedding, rows, normalize)
    hits = topk_blocks(queries, path, k, query_id, vec_id, embedding, carry, normalize, query_block_rows,
                       exclude_self, tie_decimals, block_schema=corpus.schema, single=held[dim_] <= rows)
    return hits if report else hits.drop("blocks_read", "blocks")


def retrieved_label_distribution(hits: DataFrame, label: str = "label") -> DataFrame:
    """AGG-7: label counts per query among its hits; missing label -> 'unknown'."""
    return hits.groupBy("query_id", F.coalesce(F.col(label), F.lit("unknown")).alias(label)) \
               .agg(F.count(F.lit(1)).alias("n"))


def knn_vote(hits: DataFrame, label: str = "label") -> DataFrame:
    """UDF-7: majority label of the retrieved examples; ties go to the
    earlier class in the fixed class order (then by label text)."""
    d = retrieved_label_distribution(hits, label)
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in CLASSES]), F.col(label)), F.lit(len(CLASSES) + 1))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), order, label)
    return (d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select("query_id", F.col(label).alias("knn_label"), F.col("n").alias("votes")))


def examples_text(queries: DataFrame, hits: DataFrame, meta: DataFrame, query_id: str = "query_id",
                  vec_id: str = "vec_id", max_examples: int = 5, store: str = "store_info",
                  text: str = "text_info", label: str = "ai_classification", with_labels: bool = False) -> DataFrame:
    """FN-16 + TOPK-3 + JOIN-5: per query, the first ``max_examples`` hits
    formatted as 'Business: "…"' / 'User comment: "…"' / 'Classification: …'
    blocks joined by a blank line; no hit -> 'No similar examples found.'.
    ``with_labels`` adds ``example_labels`` (rank order) from the same
    aggregation, so the hits are computed once. Groups hold <= max_examples rows."""
    h = hits.filter(F.col("rank") <= max_examples).select(query_id, "rank", vec_id)
    m = meta.select(F.col(vec_id), F.col(store).alias("_s"), F.col(text).alias("_t"), F.col(label).alias("_l"))
    block = F.concat(F.lit('Business: "'), F.coalesce(F.col("_s"), F.lit("")), F.lit('"\nUser comment: "'),
                     F.coalesce(F.col("_t"), F.lit("")), F.lit('"\nClassification: '),
                     F.coalesce(F.col("_l"), F.lit("")))
    items = F.sort_array(F.collect_list(F.struct("rank", block.alias("b"), F.col("_l").alias("l"))))
    # a popular corpus vector can be a neighbour of a large share of all
    # queries (hubness): the hits side may hold a hot vec_id, so join skew-safe
    hm = skew_safe_join(h, m, [vec_id], "inner", salt_from=[query_id, "rank"], materialize_big=True)
    per_q = (hm.groupBy(query_id).agg(items.alias("_items"))
             .select(query_id, F.array_join(F.transform("_items", lambda s: s["b"]), "\n\n").alias("examples"),
                     F.transform("_items", lambda s: s["l"]).alias("example_labels")))
    out = queries.select(query_id).join(per_q, query_id, "left")
    cols = [F.col(query_id), F.coalesce("examples", F.lit(NO_EXAMPLES)).alias("examples")]
    if with_labels:
        cols.append(F.coalesce("example_labels", F.array().cast("array<string>")).alias("example_labels"))
    return out.select(*cols)


def index_stats(index: DataFrame, embedding: str = "embedding", label: str = "label",
                manifest: DataFrame | None = None) -> DataFrame:
    """AGG-8: vectors, dimension, columns and the label distribution, as
    (metric, key, value) rows; with the index's ``manifest`` also the name of
    the model it was built with (as key)."""
    a = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(embedding)).alias("d"))
    scal = a.select(F.explode(F.array(
        F.struct(F.lit("total_vectors").alias("metric"), F.lit(None).cast("string").alias("key"),
                 F.col("n").cast("long").alias("value")),
        F.struct(F.lit("embedding_dimension").alias("metric"), F.lit(None).cast("string").alias("key"),
                 F.col("d").cast("long").alias("value")),
        F.struct(F.lit("data_columns").alias("metric"), F.lit(None).cast("string").alias("key"),
                 F.lit(len(index.columns)).cast("long").alias("value")),
    )).alias("s")).select("s.*")
    dist = index.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("value")) \
        .select(F.lit("label_count").alias("metric"), F.col(label).cast("string").alias("key"), "value")
    out = scal.unionByName(dist)
    if manifest is None:
        return out
    model = manifest.select(F.lit("model_name").alias("metric"), F.col("model_name").alias("key"),
                            F.lit(None).cast("long").alias("value"))
    return out.unionByName(model)
