"""End-to-end stages over files (PIPE-1..5), for users coming from the
reference's scripts: each stage reads its input files, runs one Spark plan
built from the operators, and writes Parquet (CSV / JSON exports optional).

    prepare   meta NDJSON + review NDJSON -> composed, train, test (Parquet)
    profile   train + test -> profile tables
    index     labelled table -> vector index (Parquet + manifest)
    classify  reviews (+ index for cot_rag) -> predictions (Parquet, CSV)
    evaluate  truth + predictions -> metrics tables and the JSON documents
    train_classifier, classify_trained  the trained text classifier, saved and applied

Outputs are written once and read back, so later stages and repeated
actions never recompute (or re-score) earlier ones, and a lost executor
costs a re-read, not a re-run.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .constants import CLASSES, DEFAULT_CLEAN_PATTERN, UNKNOWN_BUSINESS
from .functions.text import model_input_text
from .operators import evaluate as ev
from .operators import profile as pf
from .operators import score as S
from .operators import vectors as V
from .operators.prepare import (clean_error_rows, compose_reviews, compose_summary, dropna_required,
                                join_meta_review, join_stats, require_columns, store_column_fallback)
from .operators.split import split_exact, split_hash
from .session import materialize
from .sources import readers as R
from .sources.sinks import csv_output_path, metrics_json, write_csv, write_metrics_json

def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


# nested values (category list, hours, reply object) and numbers are read as their JSON text, so that a
# value of an unexpected type keeps its row and its wording
META_SCHEMA = _schema(("gmap_id", StringType()), ("name", StringType()), ("address", StringType()),
                      ("description", StringType()), ("category", StringType()), ("avg_rating", StringType()),
                      ("num_of_reviews", StringType()), ("price", StringType()), ("hours", StringType()),
                      ("state", StringType()))
REVIEW_SCHEMA = _schema(("gmap_id", StringType()), ("text", StringType()), ("name", StringType()),
                        ("rating", StringType()), ("time", StringType()), ("resp", StringType()))
HASH_MODEL = "hash-{dim}"


def _write(df: DataFrame, path: str, mode: str) -> DataFrame:
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare(spark: SparkSession, meta_path: str, review_path: str, out_dir: str, test_ratio: float = 0.1,
            seed: int = 42, exact: bool = True, clean_pattern: str | None = DEFAULT_CLEAN_PATTERN,
            mode: str = "errorifexists", meta_schema: StructType = META_SCHEMA,
            review_schema: StructType = REVIEW_SCHEMA) -> dict[str, DataFrame]:
    """PIPE-1: tolerant scans (SRC-1) -> join (JOIN-1) -> PRED-3 + compose
    (FN-7/8) -> train/test split (SAMP-1) -> cleaning (PRED-4).

    Every key of the input reaches the joined table (``joined``), declared in
    the schemas or not, as ``meta_<key>`` and ``review_<key>``. Nested JSON values (category lists, hours, reply objects) arrive as
    their JSON text. Unless the input has a ``review_id``, each review is
    identified by its position in the input, ``<file>:<line>:<item>``
    (numbered without collecting any file), so a re-run on the same files
    gives the same ids whatever the cluster's split settings."""
    meta, bad_meta = R.scan_jsonl(spark, meta_path, meta_schema, "_extra")
    reviews, bad_reviews = R.scan_jsonl(spark, review_path, review_schema, "_extra")
    if "review_id" not in review_schema.fieldNames():  # identity = position in the input (file, line, item)
        numbered = R.scan_jsonl_numbered(spark, review_path, review_schema, "_extra")
        reviews = numbered.select(
            F.concat_ws(":", "file", F.col("line_number").cast("string"), F.col("item").cast("string"))
             .alias("review_id"), *review_schema.fieldNames(), "_extra")
    meta, reviews = materialize(meta, "meta"), materialize(reviews, "reviews")  # parsed once, read more often
    meta, reviews = R.spread_keys(meta, "_extra"), R.spread_keys(reviews, "_extra")
    joined = _write(join_meta_review(meta, reviews), os.path.join(out_dir, "joined"), mode)
    composed = _write(compose_reviews(joined), os.path.join(out_dir, "composed"), mode)
    split = (split_exact if exact else split_hash)(composed, "review_id", test_ratio, seed)
    if clean_pattern:
        split = clean_error_rows(split, clean_pattern)
    split = _write(split, os.path.join(out_dir, "split"), mode)
    stats = (join_stats(meta, reviews).unionByName(
        spark.createDataFrame([("bad_meta_lines", bad_meta.count()), ("bad_review_lines", bad_reviews.count())],
                              "metric string, value long")))
    return {"joined": joined, "composed": composed, "train": split.filter(F.col("split") == "train").drop("split"),
            "test": split.filter(F.col("split") == "test").drop("split"), "join_stats": stats,
            "compose_summary": compose_summary(joined)}


def profile(train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """PIPE-2: AGG-1..6 for both sides, missing values, error patterns, the
    ten most frequent categories and the comparisons (JOIN-6, AGG-13, SET-1)."""
    return pf.full_profile(train, test)


def build_index(labelled: DataFrame, index_path: str, text: str = "text_info", label: str = "ai_classification",
                id_col: str = "review_id", dim: int = 64, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """PIPE-3: PRED-1 -> PRED-7 (error answers are no examples) -> FN-13 -> UDF-5 (hashed embedder) -> FN-9 -> SRC-7.
    Skipped when an index is present, unless ``force``."""
    rows = ev.filter_error_predictions(dropna_required(require_columns(labelled, [text, label]), [text, label]), label)
    rows = rows.select(
        F.col(id_col).alias("vec_id"), "store_info", text, label, V.hash_embedding(text, dim).alias("embedding"))
    R.save_vector_index(rows, index_path, HASH_MODEL.format(dim=dim), force=force)
    return R.load_vector_index(labelled.sparkSession, index_path)


def classify(reviews: DataFrame, output_path: str, template: str = "few_shot", factory=S.RuleScorer,
             index_path: str | None = None, k: int = 5, partitions: int | None = None,
             csv: bool = False, mode: str = "errorifexists", **score_opts) -> DataFrame:
    """PIPE-4: PROJ-3, SRC-6, PRED-1, then UDF-1 (or UDF-6 for ``cot_rag``:
    hashed query embedding -> exact top-k over the index -> example block ->
    prompt) and one scoring pass; written once (scores are never recomputed)."""
    x = require_columns(store_column_fallback(reviews), ["text_info"])
    x = dropna_required(x, ["text_info"])
    keep = tuple(c for c in x.columns if c not in ("prompt",))
    if template == "cot_rag":
        if index_path is None:
            raise ValueError("the cot_rag template needs index_path, where its examples come from")
        idx, man = R.load_vector_index(reviews.sparkSession, index_path)
        dim = int(man.first()["dimension"])
        q = x.select(F.col("review_id").alias("query_id"), V.hash_embedding("text_info", dim).alias("embedding"))
        hits = V.topk_similar(q, idx, k=k, carry=())
        ex = V.examples_text(q, hits, idx, max_examples=k, with_labels=True) \
              .withColumnRenamed("query_id", "review_id")
        x = x.join(ex, "review_id", "left")
        out = S.classify(x, factory, template=template, examples="examples", keep=keep,
                         context=("example_labels",), partitions=partitions, **score_opts)
    else:
        out = S.classify(x, factory, template=template, keep=keep, partitions=partitions, **score_opts)
    out = _write(S.with_error_text(out).drop("template"), output_path, mode)
    if csv:
        write_csv(out, csv_output_path(output_path), mode=mode)
    return out


def evaluate(truth: DataFrame, predictions: DataFrame, key: str = "review_id", truth_col: str = "label",
             pred_col: str = "ai_classification", title: str = "Review classification",
             json_path: str | None = None, binary_json_path: str | None = None) -> dict[str, DataFrame]:
    """PIPE-5: SRC-6 -> EVAL-1 (keyed alignment, error predictions dropped) ->
    EVAL-2..8 multi-class and binary, each with its report and JSON document."""
    require_columns(truth, [key, truth_col])
    require_columns(predictions, [key, pred_col])
    a = ev.filter_error_predictions(ev.align(truth, predictions, key, truth_col, pred_col))
    multi = ev.evaluate(a)
    binary = ev.evaluate_binary(a)
    out = {"per_class": multi["per_class"], "overall": multi["overall"], "confusion": multi["confusion"],
           "report": ev.metrics_report(multi["per_class"], multi["overall"]),
           "binary_per_class": binary["per_class"], "binary_overall": binary["overall"],
           "binary_confusion": binary["confusion"],
           "binary_report": ev.metrics_report(binary["per_class"], binary["overall"])}
    for name, side, path in (("json", multi, json_path), ("binary_json", binary, binary_json_path)):
        out[name] = metrics_json(side["per_class"], title)
        if path:
            write_metrics_json(out[name], path)
    return out


def _model_input(df: DataFrame, text: str, business: str, rating: str | None):
    """FN-12 over the columns that are there: the business may be missing
    (its placeholder is used) and so may the rating."""
    require_columns(df, [text])
    shop = F.col(business) if business in df.columns else F.lit(UNKNOWN_BUSINESS)
    return model_input_text(shop, F.col(text), F.col(rating) if rating in df.columns else None)


def train_classifier(labelled: DataFrame, model_path: str, label: str = "ai_classification", text: str = "text",
                     business: str = "business_name", rating: str | None = "rating", **fit_opts):
    """UDF-9: fits the text classifier on FN-12 inputs and saves it."""
    rows = labelled.select(_model_input(labelled, text, business, rating).alias("text"), F.col(label).alias("label"))
    model = S.train_text_classifier(rows.dropna(), **fit_opts)
    S.save_text_classifier(model, model_path)
    return model


def classify_trained(reviews: DataFrame, model_path: str, output_path: str, text: str = "text",
                     business: str = "business_name", rating: str | None = "rating", csv: bool = False,
                     mode: str = "errorifexists") -> dict[str, DataFrame]:
    """UDF-8 from table to file with a saved model: every row keeps its
    columns and gets ``classification_result``, ``classification_category``
    and ``classification_confidence``. Also returns the summary counts."""
    model = S.load_text_classifier(model_path)
    shown = _model_input(reviews, text, business, rating)
    if business not in reviews.columns:
        reviews = reviews.withColumn(business, F.lit(UNKNOWN_BUSINESS))
    keep = [c for c in reviews.columns if not c.startswith("classification_")]
    scored = S.score_reviews(model, reviews.withColumn("_input", shown), "_input", keep).drop("predicted_label_id")
    out = _write(scored, output_path, mode)
    if csv:
        write_csv(out, csv_output_path(output_path), mode=mode)
    return {"rows": out, "results": out.groupBy("classification_result").count(),
            "categories": out.groupBy("classification_category").count()}


__all__ = ["prepare", "profile", "build_index", "classify", "train_classifier", "classify_trained", "evaluate",
           "META_SCHEMA", "REVIEW_SCHEMA", "CLASSES"]
