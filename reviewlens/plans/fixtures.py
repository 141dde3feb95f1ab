"""Fixture views: the reference's input schemas filled from the driver tables.

The reference ships no data; these views give its relations (store meta,
reviews, truth, predictions, raw answers, labelled vectors) from the
given tables, so every query's work grows with the tables. All are plain
projections/joins of whole tables (value rules inject NULLs, empty
strings and odd shapes; nothing is filtered out to make checks cheap).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CLASSES
from ..operators.split import hash_bucket32


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a lazy DataFrame. The (read-only) tables are
    listed and their footers read once per session and path, not once per
    query build; no data is cached."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    df = _TABLES.get(key)
    if df is None:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


def class_of(c) -> F.Column:
    """Integer label -> class, by label mod 4."""
    return F.element_at(F.array(*[F.lit(x) for x in CLASSES]), F.pmod(c, F.lit(4)) + 1)


def fx_meta(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("src"), k.cast("string")).alias("gmap_id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("address"),
        F.when(k % 7 == 3, F.lit(None).cast("string")).when(k % 7 == 5, F.lit(" None "))
         .otherwise(F.concat(F.lit("Trades in "), F.col("n_name"))).alias("description"),
        F.when(k % 3 == 0, F.lit('["Pizza", "Bar"]')).when(k % 3 == 1, F.lit("Hair salon"))
         .otherwise(F.lit('["Cafe"]')).alias("category"),
        ((F.lit(10) + k % 41).cast("double") / 10).alias("avg_rating"),
        (k % 90).cast("long").alias("num_of_reviews"),
        F.when(k % 4 == 0, F.lit("Open")).alias("state"),
    )


def fx_review(spark, sf_dir) -> DataFrame:
    return review_view(table(spark, sf_dir, "documents"))


def review_view(d: DataFrame) -> DataFrame:
    """Reviews from ``documents`` rows (batch or streaming)."""
    i = F.col("doc_id")
    return d.select(
        i.alias("review_id"),
        F.when(i % 29 == 3, F.lit(None).cast("string")).when(i % 31 == 5, F.lit(""))
         .when(i % 17 == 2, F.lit("closed")).otherwise(F.col("source")).alias("gmap_id"),
        F.when(i % 11 == 4, F.lit(None).cast("string")).when(i % 13 == 6, F.lit("null"))
         .otherwise(F.col("text")).alias("text"),
        F.concat(F.lit("user"), (i % 50).cast("string")).alias("name"),
        F.when(i % 9 != 2, 1 + F.col("n_chars") % 5).alias("rating"),
        (i * 1000).alias("time"),
        F.when(i % 6 == 0, F.lit('{"time": 5, "text": "Thanks"}')).when(i % 6 == 1, F.lit("plain reply"))
         .when(i % 6 == 2, F.lit('{"time": 5, "text": null}')).alias("resp"),
    )


def fx_gt(spark, sf_dir) -> DataFrame:
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("review_id"),
        F.when((q == 1) & (t == 0), "valid").when((q == 0) & (t == 0), "advertisement")
         .when(q == 1, "irrelevant").otherwise("rants without visit").alias("label"))


def _pred_label(threshold: int) -> F.Column:
    i, n = F.col("review_id"), F.col("n_chars")
    return (F.when(i % 37 == 0, F.lit("ERROR: timeout")).when(i % 41 == 0, F.lit("no idea"))
            .when(n % 10 < threshold, F.col("label")).when(n % 3 == 0, F.lit("valid"))
            .when(n % 3 == 1, F.lit("advertisement")).otherwise(F.lit("irrelevant")))


def _gt_docs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("review_id"), "n_chars")
    return fx_gt(spark, sf_dir).join(d, "review_id")


def fx_pred(spark, sf_dir) -> DataFrame:
    return _gt_docs(spark, sf_dir).select("review_id", _pred_label(7).alias("label"))


TEMPLATE_THRESHOLDS = [("zero_shot", 5), ("few_shot", 6), ("few_shot_cot", 7), ("cot_rag", 8)]


def fx_pred_by_template(spark, sf_dir) -> DataFrame:
    """Predictions of the four templates for the same truth set (EVAL-11)."""
    g = _gt_docs(spark, sf_dir)
    tpl = F.explode(F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t).alias("thr"))
                              for n, t in TEMPLATE_THRESHOLDS])).alias("tp")
    x = g.select("*", tpl).select("review_id", "label", "n_chars", "tp.template", "tp.thr")
    i, n = F.col("review_id"), F.col("n_chars")
    pred = (F.when(i % 37 == 0, F.lit("ERROR: timeout")).when(i % 41 == 0, F.lit("no idea"))
            .when(n % 10 < F.col("thr"), F.col("label")).when(n % 3 == 0, F.lit("valid"))
            .when(n % 3 == 1, F.lit("advertisement")).otherwise(F.lit("irrelevant")))
    return x.select("template", "review_id", F.col("label").alias("y_true"), pred.alias("y_pred"))


def fx_response(spark, sf_dir) -> DataFrame:
    g = fx_gt(spark, sf_dir)
    i, lab = F.col("review_id"), F.col("label")
    nl = F.lit("\n")
    m = i % 8
    resp = (F.when(m == 0, F.concat(F.lit("Reasoning: ok."), nl, F.lit("Classification: "), lab))
            .when(m == 1, F.concat(F.lit("CLASSIFICATION:  "), F.upper(lab), F.lit(" ")))
            .when(m == 2, F.concat(F.lit("Classification: "), lab, nl, F.lit("Reasoning: because")))
            .when(m == 3, F.lit("this is invalid"))
            .when(m == 4, F.concat(lab, F.lit(".")))
            .when(m == 5, F.concat(F.lit("I say "), lab, nl, F.lit("done")))
            .when(m == 6, F.concat(F.lit("  "), lab, nl))
            .otherwise(F.lit("no idea")))
    return g.select("review_id", resp.alias("response"))


VEC_SPLIT_RATIO = 0.1
VEC_SPLIT_SEED = 42


def _vec_is_query() -> F.Column:
    return hash_bucket32(F.col("vec_id"), VEC_SPLIT_SEED) < int(VEC_SPLIT_RATIO * 2 ** 32)


def fx_corpus(spark, sf_dir) -> DataFrame:
    """Labelled index vectors: the train side of a hash split of embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter(~_vec_is_query()).select("vec_id", "embedding", class_of(F.col("label")).alias("label"))


def fx_query(spark, sf_dir) -> DataFrame:
    """Query vectors: the test side of the same split (together: the whole table)."""
    e = table(spark, sf_dir, "embeddings")
    return e.filter(_vec_is_query()).select(F.col("vec_id").alias("query_id"), "embedding")


def fx_logits(spark, sf_dir) -> DataFrame:
    """Model outputs for the truth set: four logits from the whole vector,
    component i adding to logit i mod 4."""
    def logit(j):
        part = F.filter(F.col("embedding").cast("array<double>"), lambda x, i: i % 4 == j)
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)

    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(*[logit(j) for j in range(len(CLASSES))]).alias("logits"), "label")
