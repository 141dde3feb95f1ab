"""Evaluation queries (EVAL-1..11, PRED-7, JOIN-3, PROJ-5..7, FN-11, SRC-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .oracle import with_ctes
from .registry import query
from ..operators import evaluate as ev

LABS = "(VALUES (0, 'valid'), (1, 'advertisement'), (2, 'irrelevant'), (3, 'rants without visit')) AS l(label_id, label)"
BLABS = "(VALUES (0, 'valid'), (1, 'invalid')) AS l(label_id, label)"

BASE = """base AS (SELECT g.review_id, g.label AS y_true, p.label AS y_pred
  FROM fx_gt g JOIN fx_pred p ON g.review_id = p.review_id
  WHERE NOT coalesce(starts_with(p.label, 'ERROR:'), false))"""
BBASE = BASE + """, bbase AS (SELECT review_id,
  CASE WHEN y_true = 'valid' THEN 'valid' ELSE 'invalid' END AS y_true,
  CASE WHEN y_pred = 'valid' THEN 'valid' ELSE 'invalid' END AS y_pred FROM base)"""


def _per_class_sql(src: str, labs: str, by: str = "") -> str:
    b = f"b.{by}, " if by else ""
    return f"""pc AS (SELECT {b}l.label_id, l.label,
  count(*) FILTER (WHERE b.y_true = l.label AND b.y_pred = l.label) AS tp,
  count(*) FILTER (WHERE b.y_pred = l.label) AS predicted,
  count(*) FILTER (WHERE b.y_true = l.label) AS support
  FROM {src} b CROSS JOIN {labs} GROUP BY {b}l.label_id, l.label),
pcm AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
  CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
  CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2.0 * tp / (predicted + support) END AS f1 FROM pc)"""


def _overall_sql(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    j = f"USING ({by})" if by else "ON true"
    gb = f"GROUP BY {by}" if by else ""
    return f"""acc AS (SELECT {g}count(*) AS n_rows,
  avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM {src} {gb}),
avgs AS (SELECT {g}CAST(sum(support) AS BIGINT) AS support_total,
  avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
  CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(precision * support) / sum(support) END AS precision_weighted,
  CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(recall * support) / sum(support) END AS recall_weighted,
  CASE WHEN sum(support) = 0 THEN 0.0 ELSE sum(f1 * support) / sum(support) END AS f1_weighted
  FROM pcm {gb}),
ov AS (SELECT * FROM acc JOIN avgs {j})"""


def _r(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


OVERALL_COLS = "accuracy precision_weighted recall_weighted f1_weighted precision_macro recall_macro f1_macro"


def aligned(spark, sf_dir):
    return ev.filter_error_predictions(ev.align(fx.fx_gt(spark, sf_dir), fx.fx_pred(spark, sf_dir),
                                                "review_id", "label", "label"))


@query("filter_error_predictions", with_ctes(f"WITH {BASE} SELECT review_id, y_true, y_pred FROM base", "fx_pred"))
def q_filter_error_predictions(spark, sf_dir):
    """EVAL-1 / PRED-7 / JOIN-3: keyed alignment, error predictions dropped."""
    return aligned(spark, sf_dir)


@query("align_gt_pred", with_ctes("""SELECT g.review_id, g.label AS y_true, p.label AS y_pred
FROM fx_gt g JOIN fx_pred p ON g.review_id = p.review_id""", "fx_pred"))
def q_align_gt_pred(spark, sf_dir):
    """JOIN-3: truth and prediction aligned by key (mismatch raises)."""
    return ev.align(fx.fx_gt(spark, sf_dir), fx.fx_pred(spark, sf_dir), "review_id", "label", "label")


@query("align_mismatch", with_ctes("""SELECT g.review_id, 'predictions' AS missing_in FROM fx_gt g
WHERE g.review_id NOT IN (SELECT review_id FROM fx_composed)
UNION ALL SELECT c.review_id, 'truth' FROM fx_composed c WHERE c.review_id NOT IN (SELECT review_id FROM fx_gt)""",
                                   "fx_gt", "fx_composed"))
def q_align_mismatch(spark, sf_dir):
    """JOIN-3 check: truth rows vs. composed (to-be-classified) rows; the keys
    on one side only, which ``align`` refuses."""
    from .registry import composed
    return ev.align_mismatch(fx.fx_gt(spark, sf_dir), composed(spark, sf_dir).select("review_id"), "review_id")


@query("multiclass_per_class", with_ctes(f"""WITH {BASE}, {_per_class_sql('base', LABS)}
SELECT label_id, label, {_r('precision recall f1')}, support FROM pcm""", "fx_pred"))
def q_multiclass_per_class(spark, sf_dir):
    """EVAL-3: per-class precision / recall / F1 / support, 4 fixed labels."""
    pc = ev.per_class_metrics(ev.prediction_counts(aligned(spark, sf_dir)))
    return pc.select("label_id", "label", "precision", "recall", "f1", "support")


@query("multiclass_overall", with_ctes(f"""WITH {BASE}, {_per_class_sql('base', LABS)}, {_overall_sql('base')}
SELECT n_rows, support_total, {_r(OVERALL_COLS)} FROM ov""", "fx_pred"))
def q_multiclass_overall(spark, sf_dir):
    """EVAL-2/4/5: accuracy, weighted and macro averages."""
    return ev.overall_metrics(ev.per_class_metrics(ev.prediction_counts(aligned(spark, sf_dir))))


def _confusion_sql(src: str, labs: str, labels) -> str:
    cols = ", ".join(
        f"CAST(count(b.y_pred) FILTER (WHERE b.y_pred = '{p}') AS BIGINT) AS pred_{p.replace(' ', '_')}" for p in labels)
    return f"""SELECT l.label_id AS actual_id, l.label AS actual, {cols}
FROM {labs} LEFT JOIN {src} b ON b.y_true = l.label GROUP BY l.label_id, l.label"""


@query("confusion_matrix", with_ctes(f"WITH {BASE} " + _confusion_sql("base", LABS, ev.CLASSES), "fx_pred"))
def q_confusion_matrix(spark, sf_dir):
    """EVAL-6: zero-filled 4x4 matrix in label order."""
    return ev.confusion_matrix(ev.prediction_counts(aligned(spark, sf_dir)))


@query("binary_confusion", with_ctes(f"WITH {BBASE} " + _confusion_sql("bbase", BLABS, ev.BINARY_CLASSES), "fx_pred"))
def q_binary_confusion(spark, sf_dir):
    """EVAL-7: valid/invalid confusion matrix."""
    return ev.evaluate_binary(aligned(spark, sf_dir))["confusion"]


def _report_sql(src: str, labs: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""{_per_class_sql(src, labs, by)}, {_overall_sql(src, by)}
SELECT {g}label_id AS row_id, label AS category, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1_score, support FROM pcm
UNION ALL SELECT {g}100, 'macro_avg', round(precision_macro, 6), round(recall_macro, 6), round(f1_macro, 6), support_total FROM ov
UNION ALL SELECT {g}101, 'weighted_avg', round(precision_weighted, 6), round(recall_weighted, 6), round(f1_weighted, 6), support_total FROM ov
UNION ALL SELECT {g}102, 'accuracy', NULL, NULL, round(accuracy, 6), n_rows FROM ov"""


@query("metrics_report", with_ctes(f"WITH {BASE}, " + _report_sql("base", LABS), "fx_pred"))
def q_metrics_report(spark, sf_dir):
    """EVAL-8: long metrics table (4 classes, macro, weighted, accuracy)."""
    r = ev.evaluate(aligned(spark, sf_dir))
    return ev.metrics_report(r["per_class"], r["overall"])


@query("binary_metrics", with_ctes(f"WITH {BBASE}, " + _report_sql("bbase", BLABS), "fx_pred"))
def q_binary_metrics(spark, sf_dir):
    """EVAL-7 / PROJ-7: valid vs invalid metrics report."""
    r = ev.evaluate_binary(aligned(spark, sf_dir))
    return ev.metrics_report(r["per_class"], r["overall"])


TPL_BASE = """tbase AS (SELECT template, review_id, y_true, y_pred FROM fx_pred_tpl
  WHERE NOT coalesce(starts_with(y_pred, 'ERROR:'), false))"""


@query("metrics_by_template", with_ctes(f"""WITH {TPL_BASE}, {_per_class_sql('tbase', LABS, 'template')},
{_overall_sql('tbase', 'template')}
SELECT template, n_rows, support_total, {_r(OVERALL_COLS)} FROM ov""", "fx_pred_tpl"))
def q_metrics_by_template(spark, sf_dir):
    """EVAL-11: the template sweep, all four templates in one job (template
    is part of every group key: one shuffle for the whole sweep)."""
    rows = fx.fx_pred_by_template(spark, sf_dir)
    p = ev.filter_error_predictions(rows)
    by = ["template"]
    counts = ev.prediction_counts(p, by=by, groups=rows)
    return ev.overall_metrics(ev.per_class_metrics(counts, by=by), by=by)


@query("metrics_report_by_template", with_ctes(f"WITH {TPL_BASE}, " + _report_sql("tbase", LABS, "template"),
                                               "fx_pred_tpl"))
def q_metrics_report_by_template(spark, sf_dir):
    """EVAL-11 + EVAL-8: full report per template in one job."""
    rows = fx.fx_pred_by_template(spark, sf_dir)
    r = ev.evaluate(ev.filter_error_predictions(rows), by=["template"], groups=rows)
    return ev.metrics_report(r["per_class"], r["overall"], by=["template"])


@query("metrics_json", with_ctes(f"""WITH {BASE}, {_per_class_sql('base', LABS)}, {_overall_sql('base')}
SELECT 'Multi-class Classification Metrics' AS title, round(o.accuracy, 6) AS accuracy,
  round(o.precision_weighted, 6) AS precision_weighted, round(o.recall_weighted, 6) AS recall_weighted,
  round(o.f1_weighted, 6) AS f1_weighted, round(o.precision_macro, 6) AS precision_macro,
  round(o.recall_macro, 6) AS recall_macro, round(o.f1_macro, 6) AS f1_macro, p.label,
  round(p.precision, 6) AS precision, round(p.recall, 6) AS recall, round(p.f1, 6) AS f1, p.support
FROM ov o CROSS JOIN pcm p""", "fx_pred"))
def q_metrics_json(spark, sf_dir):
    """SRC-5: the JSON metrics document (title, overall numbers, nested
    per_class_metrics), rendered with to_json and parsed back."""
    from ..sources.sinks import metrics_json, METRICS_JSON_SCHEMA
    r = ev.evaluate(aligned(spark, sf_dir))
    doc = metrics_json(r["per_class"], "Multi-class Classification Metrics")
    parsed = doc.select(F.from_json("json", METRICS_JSON_SCHEMA).alias("d"))
    overall = ["title", "accuracy", "precision_weighted", "recall_weighted", "f1_weighted",
               "precision_macro", "recall_macro", "f1_macro"]
    return parsed.select("d.*").select(*overall, F.explode("per_class_metrics").alias("label", "m")) \
                 .select(*overall, "label", "m.precision", "m.recall", "m.f1", "m.support")


LOGITS = """lg AS (SELECT e.vec_id, list_transform([0, 1, 2, 3], lambda j: list_sum(list_filter(CAST(e.embedding AS DOUBLE[]), lambda x, i: (i - 1) % 4 = j))) AS logits, e.label % 4 AS true_id, d.text
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
sm AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS ex FROM lg),
pr AS (SELECT *, list_transform(ex, lambda x: x / list_sum(ex)) AS probs,
  CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pid FROM sm)"""
CL = "(['valid', 'advertisement', 'irrelevant', 'rants without visit'])"


def _logit_frame(spark, sf_dir):
    e = fx.fx_logits(spark, sf_dir)
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return e.join(d, e.vec_id == d.doc_id, "left").withColumn("true_id", F.pmod("label", F.lit(4)))


@query("softmax_classify", with_ctes(f"""WITH {LOGITS}
SELECT vec_id, pid AS predicted_label_id, round(list_max(probs), 6) AS confidence,
  {CL}[pid + 1] AS classification_category,
  CASE WHEN pid = 0 THEN 'valid' ELSE 'invalid' END AS classification_result,
  round(probs[1], 6) AS p0, round(probs[2], 6) AS p1, round(probs[3], 6) AS p2, round(probs[4], 6) AS p3
FROM pr"""))
def q_softmax_classify(spark, sf_dir):
    """FN-11: logits -> softmax, argmax, confidence, category, valid/invalid."""
    x = ev.classify_logits(fx.fx_logits(spark, sf_dir), "logits")
    return x.select("vec_id", "predicted_label_id", "confidence", "classification_category",
                    "classification_result", *[F.col("probabilities")[i].alias(f"p{i}") for i in range(4)])


@query("eval_samples", with_ctes(f"""WITH {LOGITS}
SELECT vec_id AS sample_id,
  CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS text_preview,
  {CL}[true_id + 1] AS true_label, {CL}[pid + 1] AS predicted_label, true_id = pid AS correct,
  round(list_max(probs), 6) AS confidence, CAST(true_id AS INTEGER) AS true_label_id, pid AS predicted_label_id,
  round(probs[1], 6) AS valid_probability
FROM pr"""))
def q_eval_samples(spark, sf_dir):
    """EVAL-9 / PROJ-5 / PROJ-6: per-sample evaluation table."""
    return ev.eval_samples(_logit_frame(spark, sf_dir), "vec_id", "text", "true_id")


@query("evaluation_summary", with_ctes(f"""WITH {LOGITS}, s AS (SELECT true_id, true_id = pid AS ok FROM pr)
SELECT 0 AS ord, 'total_samples' AS metric, CAST(count(*) AS DOUBLE) AS value FROM s
UNION ALL SELECT 1, 'correct_predictions', CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS DOUBLE) FROM s
UNION ALL SELECT 2, 'accuracy', round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) FROM s
UNION ALL SELECT 3, 'training_samples', CAST(count(*) AS DOUBLE) FROM fx_corpus
UNION ALL SELECT 4 + true_id, {CL}[true_id + 1] || '_accuracy', round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6)
  FROM s GROUP BY true_id""", "fx_corpus"))
def q_evaluation_summary(spark, sf_dir):
    """EVAL-10: totals, accuracy, training rows, per-class accuracy."""
    s = ev.eval_samples(_logit_frame(spark, sf_dir), "vec_id", "text", "true_id")
    return ev.evaluation_summary(s, fx.fx_corpus(spark, sf_dir))
