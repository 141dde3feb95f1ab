"""Evaluation (EVAL-1..11, PROJ-5, PROJ-7, PRED-7, JOIN-3, FN-11).

Everything derives from ONE shuffle over the predictions:
``groupBy(by..., y_true, y_pred, correct).count()``. Labels outside the
fixed label list are folded to ``__other__`` first, so the size of that
table is bounded by (|labels|+1)^2 * 2 per group no matter how many
distinct garbage answers exist. Every metric after it works on at most a
few dozen rows, with no joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BINARY_CLASSES, CLASSES, ERROR_PREFIX, OTHER_LABEL
from ..functions.text import preview


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def binary_label(c) -> Column:
    """PROJ-7: 'valid' stays, everything else (NULL too) becomes 'invalid'."""
    return F.when(_col(c) == "valid", F.lit("valid")).otherwise(F.lit("invalid"))


def label_name(label_id, labels=CLASSES) -> Column:
    """PROJ-5: label id (0-based) -> class name."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), _col(label_id).cast("int") + 1)


def is_error_prediction(c) -> Column:
    bare = F.trim(_col(c)) == ERROR_PREFIX.rstrip(":")
    return F.coalesce(_col(c).startswith(ERROR_PREFIX) | bare, F.lit(False))


def filter_error_predictions(df: DataFrame, pred: str = "y_pred") -> DataFrame:
    """PRED-7: drop predictions that start with 'ERROR:' or are a bare 'ERROR';
    NULL is kept (wrong)."""
    return df.filter(~is_error_prediction(F.col(pred)))


def align(truth: DataFrame, pred: DataFrame, key: str = "review_id",
          truth_col: str = "label", pred_col: str = "label") -> DataFrame:
    """JOIN-3: align truth and predictions by key (not by file position).

    One grouped pass: a key must come exactly once on each side. The check is
    the result's filter, so nothing read from it, a count included, goes
    without it.
    """
    t = truth.select(F.col(key).alias(key), F.lit(1).alias("_t"), F.lit(0).alias("_p"),
                     F.col(truth_col).alias("y_true"), F.lit(None).cast("string").alias("y_pred"))
    p = pred.select(F.col(key).alias(key), F.lit(0).alias("_t"), F.lit(1).alias("_p"),
                    F.lit(None).cast("string").alias("y_true"), F.col(pred_col).alias("y_pred"))
    g = t.unionByName(p).groupBy(key).agg(F.sum("_t").alias("_t"), F.sum("_p").alias("_p"),
                                          F.max("y_true").alias("y_true"), F.max("y_pred").alias("y_pred"))
    once = (F.col("_t") == 1) & (F.col("_p") == 1)
    wrong = F.raise_error(F.concat(
        F.lit("each key needs one truth row and one prediction; key "),
        F.coalesce(F.col(key).cast("string"), F.lit("NULL")), F.lit(" has "), F.col("_t").cast("string"), F.lit(" and "),
        F.col("_p").cast("string")))
    return g.filter(F.when(once, F.lit(True)).otherwise(wrong.cast("boolean"))).select(key, "y_true", "y_pred")


def align_mismatch(truth: DataFrame, pred: DataFrame, key: str = "review_id") -> DataFrame:
    """Keys present on one side only (what ``align`` refuses), tagged by side."""
    t = truth.select(key).join(pred.select(key), key, "left_anti").withColumn("missing_in", F.lit("predictions"))
    p = pred.select(key).join(truth.select(key), key, "left_anti").withColumn("missing_in", F.lit("truth"))
    return t.unionByName(p)


def prediction_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                      labels=CLASSES, by=(), groups: DataFrame | None = None) -> DataFrame:
    """The one shuffle: counts per (by..., folded truth, folded prediction,
    correct). ``groups`` holds the groups that must appear, e.g. those of the
    input before error rows were dropped: one left without rows counts 0, so
    its overall metrics fail instead of being left out."""
    t, p = F.col(y_true), F.col(y_pred)
    fold = lambda c: F.when(c.isin(*labels), c).otherwise(F.lit(OTHER_LABEL))
    counts = (df.groupBy(*by, fold(t).alias("y_true"), fold(p).alias("y_pred"),
                         F.coalesce(t == p, F.lit(False)).alias("correct"))
              .agg(F.count(F.lit(1)).alias("n")))
    return counts if groups is None else counts.unionByName(_zero(groups.select(*by).distinct()))


def _zero(groups: DataFrame) -> DataFrame:
    """A count of 0 for each row of ``groups``."""
    none = F.lit(OTHER_LABEL)
    return groups.select("*", none.alias("y_true"), none.alias("y_pred"), F.lit(False).alias("correct"),
                         F.lit(0).cast("long").alias("n"))


def _with_labels(counts: DataFrame, labels, by=()) -> DataFrame:
    if not by:  # every label appears, whatever the input holds
        one = counts.sparkSession.range(1).select()
        counts = counts.select("y_true", "y_pred", "correct", "n").unionByName(_zero(one))
    lab = F.explode(F.array(*[F.struct(F.lit(i).alias("label_id"), F.lit(x).alias("label"))
                              for i, x in enumerate(labels)])).alias("_lab")
    return counts.select("*", lab).select("*", "_lab.label_id", "_lab.label").drop("_lab")


def per_class_metrics(counts: DataFrame, labels=CLASSES, by=()) -> DataFrame:
    """EVAL-3: precision, recall, F1, support per listed label (0/0 -> 0).

    Also carries the group totals (rows, correct rows) used by EVAL-2/4/5.
    """
    x = _with_labels(counts, labels, by)
    yt, yp, lab, n = F.col("y_true"), F.col("y_pred"), F.col("label"), F.col("n")
    agg = x.groupBy(*by, "label_id", "label").agg(
        F.sum(F.when((yt == lab) & (yp == lab), n).otherwise(0)).alias("tp"),
        F.sum(F.when(yp == lab, n).otherwise(0)).alias("predicted"),
        F.sum(F.when(yt == lab, n).otherwise(0)).alias("support"),
        F.sum(n).alias("total"),
        F.sum(F.when(F.col("correct"), n).otherwise(0)).alias("correct_total"),
    )
    z = F.lit(0.0)
    return agg.select(
        *by, "label_id", "label",
        F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), z).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("support")), z).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")), z).alias("f1"),
        F.col("support").cast("long").alias("support"),
        F.col("tp").cast("long").alias("tp"),
        F.col("predicted").cast("long").alias("predicted"),
        F.col("total").cast("long").alias("total"),
        F.col("correct_total").cast("long").alias("correct_total"),
    )


def overall_metrics(per_class: DataFrame, by=(), extra=()) -> DataFrame:
    """EVAL-2, 4, 5: accuracy over all rows; macro = plain mean over labels;
    weighted by support (0 when no support). Raises when no row is left.
    ``extra``: (name, aggregate) pairs computed in the same aggregate."""
    sup = F.col("support")
    wsum = lambda m: F.coalesce(F.try_divide(F.sum(F.col(m) * sup), F.sum(sup)), F.lit(0.0))
    g = per_class.groupBy(*by).agg(
        F.max("total").alias("total"), F.max("correct_total").alias("correct"),
        F.sum(sup).cast("long").alias("support_total"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        wsum("precision").alias("precision_weighted"), wsum("recall").alias("recall_weighted"),
        wsum("f1").alias("f1_weighted"),
        *[c.alias(name) for name, c in extra],
    )
    total = F.coalesce(F.col("total"), F.lit(0))
    acc = F.when(total > 0, F.col("correct") / total).otherwise(
        F.raise_error(F.lit("no prediction is left to evaluate")))
    return g.select(*by, total.cast("long").alias("n_rows"), acc.alias("accuracy"), "support_total",
                    "precision_weighted", "recall_weighted", "f1_weighted",
                    "precision_macro", "recall_macro", "f1_macro",
                    *[name for name, _ in extra])


def confusion_matrix(counts: DataFrame, labels=CLASSES, by=()) -> DataFrame:
    """EVAL-6: zero-filled matrix in label order; rows = actual label.
    Truth or prediction outside the labels is dropped here only."""
    x = _with_labels(counts, labels, by)
    cols = [F.sum(F.when((F.col("y_true") == F.col("label")) & (F.col("y_pred") == p), F.col("n"))
                  .otherwise(0)).cast("long").alias("pred_" + p.replace(" ", "_"))
            for p in labels]
    return (x.groupBy(*by, "label_id", "label").agg(*cols)
            .withColumnRenamed("label_id", "actual_id").withColumnRenamed("label", "actual"))


def metrics_report(per_class: DataFrame, overall: DataFrame, by=()) -> DataFrame:
    """EVAL-8: one long table: each label, macro_avg, weighted_avg, accuracy.
    Averages carry the support total; the accuracy row fills one column."""
    pc = per_class.select(*by, F.col("label_id").alias("row_id"), F.col("label").alias("category"),
                          "precision", "recall", F.col("f1").alias("f1_score"), "support")
    n = 100
    o = overall
    rows = [
        o.select(*by, F.lit(n).alias("row_id"), F.lit("macro_avg").alias("category"),
                 F.col("precision_macro").alias("precision"), F.col("recall_macro").alias("recall"),
                 F.col("f1_macro").alias("f1_score"), F.col("support_total").alias("support")),
        o.select(*by, F.lit(n + 1).alias("row_id"), F.lit("weighted_avg").alias("category"),
                 F.col("precision_weighted").alias("precision"), F.col("recall_weighted").alias("recall"),
                 F.col("f1_weighted").alias("f1_score"), F.col("support_total").alias("support")),
        o.select(*by, F.lit(n + 2).alias("row_id"), F.lit("accuracy").alias("category"),
                 F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                 F.col("accuracy").alias("f1_score"), F.col("n_rows").alias("support")),
    ]
    out = pc
    for r in rows:
        out = out.unionByName(r)
    return out


def evaluate(df: DataFrame, y_true="y_true", y_pred="y_pred", labels=CLASSES, by=(), groups: DataFrame | None = None):
    """Counts, per-class, overall and confusion for one prediction table.
    ``groups``: as in ``prediction_counts``."""
    from ..session import stable
    # feeds four result tables: written once (it is tiny) when a model upstream would rerun
    counts = stable(prediction_counts(df, y_true, y_pred, labels, by, groups), "eval-counts")
    pc = per_class_metrics(counts, labels, by)
    return {"counts": counts, "per_class": pc, "overall": overall_metrics(pc, by),
            "confusion": confusion_matrix(counts, labels, by)}


def binary_view(df: DataFrame, y_true="y_true", y_pred="y_pred") -> DataFrame:
    """EVAL-7 input: both columns mapped to valid/invalid."""
    return df.withColumn(y_true, binary_label(y_true)).withColumn(y_pred, binary_label(y_pred))


def evaluate_binary(df: DataFrame, y_true="y_true", y_pred="y_pred", by=(), groups: DataFrame | None = None):
    return evaluate(binary_view(df, y_true, y_pred), y_true, y_pred, BINARY_CLASSES, by, groups)


# ---- model outputs (FN-11, EVAL-9, EVAL-10) ----

def softmax(logits) -> Column:
    """Numerically stable softmax of an ARRAY<DOUBLE> (max subtracted)."""
    l = _col(logits)
    m = F.array_max(l)
    ex = F.transform(l, lambda x: F.exp(x - m))
    s = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / s)


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def classify_logits(df: DataFrame, logits: str = "logits", labels=CLASSES) -> DataFrame:
    """FN-11: probabilities, predicted id, confidence, category, valid/invalid."""
    probs = softmax(logits)
    return (df.withColumn("probabilities", probs)
            .withColumn("predicted_label_id", argmax(logits))
            .withColumn("confidence", F.array_max("probabilities"))
            .withColumn("classification_category", label_name("predicted_label_id", labels))
            .withColumn("classification_result", binary_label("classification_category")))


def eval_samples(df: DataFrame, id_col: str, text_col: str, true_id_col: str,
                 logits: str = "logits", labels=CLASSES) -> DataFrame:
    """EVAL-9: per-sample table (ids, labels, correct, confidence, preview)."""
    x = classify_logits(df, logits, labels)
    return x.select(
        F.col(id_col).alias("sample_id"),
        preview(F.col(text_col), 100).alias("text_preview"),
        label_name(true_id_col, labels).alias("true_label"),
        F.col("classification_category").alias("predicted_label"),
        (F.col(true_id_col).cast("int") == F.col("predicted_label_id")).alias("correct"),
        F.col("confidence"),
        F.col(true_id_col).cast("int").alias("true_label_id"),
        F.col("predicted_label_id"),
        F.col("probabilities")[0].alias("valid_probability"),
    )


def evaluation_summary(samples: DataFrame, training_rows: DataFrame | None = None,
                       labels=CLASSES) -> DataFrame:
    """EVAL-10: total, correct, accuracy, training rows, <class>_accuracy for
    classes that have truth rows. Long (metric, value) table."""
    agg = samples.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.sum(F.col("correct").cast("long")).alias("correct_predictions"),
        *[F.sum((F.col("true_label_id") == i).cast("long")).alias(f"_n{i}") for i in range(len(labels))],
        *[F.sum(((F.col("true_label_id") == i) & F.col("correct")).cast("long")).alias(f"_c{i}")
          for i in range(len(labels))],
    )
    entries = [
        F.struct(F.lit(0).alias("ord"), F.lit("total_samples").alias("metric"),
                 F.col("total_samples").cast("double").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("correct_predictions").alias("metric"),
                 F.col("correct_predictions").cast("double").alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit("accuracy").alias("metric"),
                 F.try_divide(F.col("correct_predictions"), F.col("total_samples")).alias("value")),
    ]
    for i, lab in enumerate(labels):
        entries.append(F.when(F.col(f"_n{i}") > 0, F.struct(
            F.lit(4 + i).alias("ord"), F.lit(f"{lab}_accuracy").alias("metric"),
            (F.col(f"_c{i}") / F.col(f"_n{i}")).alias("value"))))
    out = agg.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")) \
             .select("e.ord", "e.metric", "e.value")
    if training_rows is not None:
        tr = training_rows.agg(F.count(F.lit(1)).cast("double").alias("value")) \
                          .select(F.lit(3).alias("ord"), F.lit("training_samples").alias("metric"), "value")
        out = out.unionByName(tr)
    return out
