"""Classification queries (PIPE-4): UDF-1..3, UDF-6, UDF-8, UDF-9, SRC-8."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .oracle import class_list_sql, with_ctes
from .q_evaluate import LABS, _report_sql
from .q_parse import _sql_lit
from .q_vectors import K, RAG_SQL, rag_hits
from .registry import composed, query, split_labelled
from ..constants import CLASSES
from ..functions.prompts import COMMENT_PH, EXAMPLES_PH, STORE_PH, TEMPLATES, render_prompt
from ..operators import bayes as B
from ..operators import evaluate as ev
from ..operators import score as S
from ..operators.vectors import examples_text
from ..session import materialize

SWEEP = ["zero_shot", "few_shot", "few_shot_cot"]
_COT = "('few_shot_cot', 'cot_rag')"


def _rule_sql(text: str) -> tuple[str, str]:
    """(class, reason) CASE expressions of the keyword scorer, from its rule list."""
    low = f"lower(coalesce({text}, ''))"
    cls = " ".join(f"WHEN contains({low}, '{w}') THEN '{c}'" for c, ws in S.RULE_KEYWORDS for w in ws)
    why = " ".join(f"WHEN contains({low}, '{w}') THEN 'mentions ''{w}'''" for c, ws in S.RULE_KEYWORDS for w in ws)
    return f"CASE {cls} ELSE 'valid' END", f"CASE {why} ELSE 'no warning signs' END"


def _answer_sql(cls: str, why: str, template: str) -> str:
    return (f"CASE WHEN {template} IN {_COT} THEN 'Reasoning: ' || {why} || '.' || chr(10) || 'Classification: ' "
            f"|| {cls} ELSE 'Classification: ' || {cls} END")


RCLS, RWHY = _rule_sql("text_info")
_TPL_VALUES = ", ".join(f"('{t}')" for t in SWEEP)


@query("classify_reviews", with_ctes(f"""SELECT review_id, t.template, {RCLS} AS ai_classification,
  {_answer_sql(RCLS, RWHY, 't.template')} AS ai_raw_response
FROM fx_composed CROSS JOIN (VALUES {_TPL_VALUES}) AS t(template)""", "fx_composed"))
def q_classify_reviews(spark, sf_dir):
    """UDF-1 / UDF-2a / PIPE-4: every composed review under three templates
    in one job (templates exploded, one mapInPandas scoring pass with the
    shipped keyword scorer, native render and parse)."""
    c = composed(spark, sf_dir)
    x = c.select("*", F.explode(F.array(*[F.lit(t) for t in SWEEP])).alias("tpl"))
    out = S.classify(x, S.RuleScorer, template=F.col("tpl"), base_wait=0.0)
    return S.with_error_text(out).select("review_id", "template", "ai_classification", "ai_raw_response")


class RefusingScorer(S.RuleScorer):
    """Keyword scorer that raises for comments containing ``word``: stands
    for a remote model rejecting some inputs (UDF-3 check)."""

    word = "license"

    def score(self, batch):
        bad = batch[self.comment_col].fillna("").str.lower().str.contains(self.word, regex=False)
        if bad.any():
            raise ValueError("scorer refused the text")
        return super().score(batch)


_ERR = "'ERROR: ValueError: scorer refused the text'"


@query("classify_errors", with_ctes(f"""SELECT review_id,
  CASE WHEN contains(lower(text_info), 'license') THEN {_ERR} ELSE {RCLS} END AS ai_classification,
  CASE WHEN contains(lower(text_info), 'license') THEN {_ERR} ELSE 'Classification: ' || {RCLS} END AS ai_raw_response
FROM fx_composed""", "fx_composed"))
def q_classify_errors(spark, sf_dir):
    """UDF-3 / UDF-4: a scorer failing on some rows; the batch is retried,
    then bisected down to the failing rows, which become 'ERROR: …' rows and
    the job goes on."""
    out = S.classify(composed(spark, sf_dir), RefusingScorer, template="zero_shot", base_wait=0.0, max_retries=2)
    return S.with_error_text(out).select("review_id", "ai_classification", "ai_raw_response")


_ORDER = "coalesce(list_position(['valid', 'advertisement', 'irrelevant', 'rants without visit'], label), 5)"
QCLS, QWHY = _rule_sql("q.text_info")


@query("rag_classify", with_ctes(f"""WITH {RAG_SQL},
v AS (SELECT h.query_id, i.ai_classification AS label, count(*) AS n FROM rhits h JOIN idx i ON h.vec_id = i.review_id
      GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, {_ORDER}, label) AS r,
        sum(n) OVER (PARTITION BY query_id) AS tot FROM v)
SELECT q.review_id, 'cot_rag' AS template, coalesce(b.label, {QCLS}) AS ai_classification,
  CASE WHEN b.label IS NOT NULL THEN 'Reasoning: ' || CAST(b.n AS VARCHAR) || ' of ' || CAST(CAST(b.tot AS BIGINT) AS VARCHAR)
    || ' similar reviews say ' || b.label || '.' || chr(10) || 'Classification: ' || b.label
  ELSE 'Reasoning: ' || {QWHY} || '.' || chr(10) || 'Classification: ' || {QCLS} END AS ai_raw_response
FROM qs q LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON q.review_id = b.query_id""", "fx_split"))
def q_rag_classify(spark, sf_dir):
    """UDF-6 / UDF-2b: retrieval-augmented classification of the test
    reviews: hashed embedding -> exact top-5 over the labelled train index
    -> example block (FN-16) -> cot_rag prompt -> k-NN vote scorer -> CoT
    parser. Joins first (set-based), one scoring pass last."""
    qs, idx, h = rag_hits(spark, sf_dir)
    ex = examples_text(qs, h, idx, max_examples=K, with_labels=True)
    x = qs.join(ex, "query_id").withColumnRenamed("query_id", "review_id")
    out = S.classify(x, S.KnnVoteScorer, template="cot_rag", examples="examples",
                     context=("example_labels",), base_wait=0.0)
    return S.with_error_text(out).select("review_id", "template", "ai_classification", "ai_raw_response")


@query("rag_prompts", with_ctes(f"""WITH {RAG_SQL}
SELECT q.review_id, replace(replace(replace({_sql_lit(TEMPLATES['cot_rag'])}, {_sql_lit(STORE_PH)}, q.store_info),
  {_sql_lit(COMMENT_PH)}, q.text_info), {_sql_lit(EXAMPLES_PH)}, e.examples) AS prompt
FROM qs q JOIN rex e ON q.review_id = e.query_id""", "fx_split"))
def q_rag_prompts(spark, sf_dir):
    """FN-14 / UDF-6: the whole prompt of every test review under the template
    that shows retrieved examples."""
    qs, idx, h = rag_hits(spark, sf_dir)
    x = qs.join(examples_text(qs, h, idx, max_examples=K), "query_id")
    return x.select(F.col("query_id").alias("review_id"),
                    render_prompt("store_info", "text_info", "cot_rag", "examples").alias("prompt"))


def _train_test(spark, sf_dir):
    s = split_labelled(spark, sf_dir).filter(F.col("text_info").isNotNull())
    train = s.filter((F.col("split") == "train") & F.col("ai_classification").isNotNull())
    test = s.filter(F.col("split") == "test")
    return train, test


@query("train_text_classifier")
def q_train_text_classifier(spark, sf_dir):
    """UDF-9 (re-aimed): fit the TF-IDF + multinomial logistic regression
    classifier on the labelled train split; per-class metrics of the fitted
    model on its training rows (4 rows). Rows-only check: fitting is
    iterative, not SQL."""
    train, _ = _train_test(spark, sf_dir)
    model = S.train_text_classifier(train, text="text_info", label="ai_classification", max_iter=20)
    pred = S.score_reviews(model, train, text="text_info", keep=("review_id", "ai_classification"))
    counts = ev.prediction_counts(pred.select(F.col("ai_classification").alias("y_true"),
                                              F.col("classification_category").alias("y_pred")))
    return ev.per_class_metrics(counts, CLASSES)


@query("score_reviews")
def q_score_reviews(spark, sf_dir):
    """UDF-8: batch inference of the trained classifier on the test split:
    class, valid/invalid result, confidence, label id per review."""
    train, test = _train_test(spark, sf_dir)
    model = S.train_text_classifier(train, text="text_info", label="ai_classification", max_iter=20)
    return S.score_reviews(model, test, text="text_info")


def _bayes_sql() -> str:
    """CTEs of the closed-form classifier: training rows, word counts, model."""
    n = range(len(CLASSES))
    per_class = ", ".join(f"count(*) FILTER (lab = '{c}') AS n{i}" for i, c in enumerate(CLASSES))
    text = f"translate(text_info, '{B.UPPER}', '{B.LOWER}')"
    unit = lambda share, i: f"CAST(round({B.UNIT} * ln({share})) AS BIGINT) AS l{i}"
    seen = ", ".join(unit(f"(n{i} + 1)::DOUBLE / (t{i} + size)::DOUBLE", i) for i in n)
    prior = ", ".join(unit(f"(n{i} + 1)::DOUBLE / (size + {len(CLASSES)})::DOUBLE", i) for i in n)
    return f"""tr AS (SELECT text_info, ai_classification AS lab FROM fx_split WHERE split = 'train' AND text_info IS NOT NULL
  AND ai_classification IN {class_list_sql()}),
cnt AS (SELECT word, {per_class} FROM (
  SELECT lab, unnest(regexp_extract_all({text}, '{B.WORD_RE}')) AS word FROM tr) GROUP BY word),
tot AS (SELECT {", ".join(f"coalesce(sum(n{i}), 0) AS t{i}" for i in n)}, count(*) AS size FROM cnt),
doc AS (SELECT {per_class}, count(*) AS size FROM tr),
model AS (SELECT word, {seen} FROM cnt, tot UNION ALL SELECT '' AS word, {prior} FROM doc),
"""


@query("train_bayes_classifier", with_ctes(
    "WITH " + _bayes_sql().rstrip().rstrip(",") + " SELECT word, l0, l1, l2, l3 FROM model", "fx_split"))
def q_train_bayes_classifier(spark, sf_dir):
    """UDF-9 in closed form: naive Bayes log likelihoods (millionths) of
    every word of the labelled train split, by class; priors at the empty word."""
    train, _ = _train_test(spark, sf_dir)
    return B.fit_bayes(train, "text_info", "ai_classification")


@query("score_bayes", with_ctes("WITH " + _bayes_sql() + f"""w AS (SELECT review_id,
  unnest(list_concat([''], regexp_extract_all(translate(text_info, '{B.UPPER}', '{B.LOWER}'), '{B.WORD_RE}'))) AS word
  FROM fx_split WHERE split = 'test' AND text_info IS NOT NULL),
s AS (SELECT review_id, {", ".join(f"sum(l{i})::BIGINT AS s{i}" for i in range(len(CLASSES)))}
  FROM w JOIN model USING (word) GROUP BY review_id),
b AS (SELECT *, greatest(s0, s1, s2, s3) AS mx FROM s),
r AS (SELECT review_id, CASE WHEN s0 = mx THEN 0 WHEN s1 = mx THEN 1 WHEN s2 = mx THEN 2 ELSE 3 END AS pid,
  1 / ({" + ".join(f"exp((s{i} - mx)::DOUBLE / {B.UNIT})" for i in range(len(CLASSES)))}) AS conf FROM b)
SELECT review_id, CAST(pid AS INTEGER) AS predicted_label_id,
  ([{", ".join(f"'{c}'" for c in CLASSES)}])[pid + 1] AS classification_category,
  CASE WHEN pid = 0 THEN 'valid' ELSE 'invalid' END AS classification_result,
  round(conf, 6) AS classification_confidence FROM r""", "fx_split"))
def q_score_bayes(spark, sf_dir):
    """UDF-8 with the closed-form model: fitted on the train split, written
    and read back, then every review of the test split is classified."""
    train, test = _train_test(spark, sf_dir)
    model = materialize(B.fit_bayes(train, "text_info", "ai_classification"), "bayes-model")
    return B.score_bayes(model, test, "text_info")


@query("stream_classify", with_ctes(f"""SELECT review_id, 'zero_shot' AS template, {RCLS} AS ai_classification,
  'Classification: ' || {RCLS} AS ai_raw_response FROM fx_composed""", "fx_composed"))
def q_stream_classify(spark, sf_dir):
    """SRC-8: the documents file read as a stream (availableNow trigger),
    stream-static join with store metadata, composition and scoring, then
    appended to a Parquet sink; returns the sink's rows (= batch result)."""
    from ..streaming.classify_stream import classify_stream, read_review_stream
    path = f"{sf_dir.rstrip('/')}/documents*.parquet"  # file source needs a folder or a glob
    schema = fx.table(spark, sf_dir, "documents").schema
    reviews = fx.review_view(read_review_stream(spark, path, schema))
    q, sink = classify_stream(reviews, fx.fx_meta(spark, sf_dir), S.RuleScorer, template="zero_shot")
    q.awaitTermination()
    return spark.read.parquet(sink).select("review_id", "template", "ai_classification", "ai_raw_response")


def _tpl_values_sql() -> str:
    return ", ".join(f"('{t}')" for t in SWEEP)


@query("classify_metrics", with_ctes(f"""WITH cls AS (SELECT review_id, t.template, {RCLS} AS y_pred
  FROM fx_composed CROSS JOIN (VALUES {_tpl_values_sql()}) AS t(template)),
tbase AS (SELECT c.template, c.review_id, g.label AS y_true, c.y_pred FROM cls c JOIN fx_gt g ON c.review_id = g.review_id
  WHERE NOT coalesce(starts_with(c.y_pred, 'ERROR:'), false)),
""" + _report_sql("tbase", LABS, "template"), "fx_composed", "fx_gt"))
def q_classify_metrics(spark, sf_dir):
    """PIPE-4 -> PIPE-5: the keyword scorer's answers for three templates
    (one scoring pass) evaluated against the truth labels of the reviews
    that have one, one metrics report per template (one shuffle)."""
    c = composed(spark, sf_dir)
    x = c.select("*", F.explode(F.array(*[F.lit(t) for t in SWEEP])).alias("tpl"))
    pred = S.with_error_text(S.classify(x, S.RuleScorer, template=F.col("tpl"), base_wait=0.0))
    truth = fx.fx_gt(spark, sf_dir).withColumnRenamed("label", "y_true")
    a = ev.filter_error_predictions(
        pred.select("review_id", "template", F.col("ai_classification").alias("y_pred")).join(truth, "review_id"))
    asked = x.join(truth, "review_id").select(F.col("tpl").alias("template"))  # unfiltered, and no second scoring
    r = ev.evaluate(a, by=["template"], groups=asked)
    return ev.metrics_report(r["per_class"], r["overall"], by=["template"])


def make_keyword_logit_model():
    """A deterministic stand-in for a user model (UDF-8): logit of each
    class = occurrences of its scorer keywords in the lower-cased text,
    'valid' gets 0.5. Runs per Arrow batch inside ``predict_batch_udf``."""
    import numpy as np

    kws = [[]] + [ws for _, ws in S.RULE_KEYWORDS]  # class order: valid, advertisement, irrelevant, rants

    def predict(texts):
        out = np.zeros((len(texts), len(CLASSES)))
        for i, t in enumerate(texts):
            low = (t or "").lower()
            out[i] = [sum(low.count(w) for w in ws) for ws in kws]
        out[:, 0] += 0.5
        return out
    return predict


def _logit_sql(text: str) -> list[str]:
    low = f"lower(coalesce({text}, ''))"
    per = [["0.5"]] + [[f"((length({low}) - length(replace({low}, '{w}', ''))) // {len(w)})" for w in ws]
                       for _, ws in S.RULE_KEYWORDS]
    return [" + ".join(p) if c else "0.5" for c, p in enumerate(per)]


_LG = _logit_sql("text_info")
_MX = f"greatest({', '.join(f'l{i}' for i in range(4))})"


@query("model_scores", with_ctes(f"""WITH lg AS (SELECT review_id, {', '.join(f'CAST({e} AS DOUBLE) AS l{i}' for i, e in enumerate(_LG))}
  FROM fx_composed),
ex AS (SELECT *, {', '.join(f'exp(l{i} - {_MX}) AS e{i}' for i in range(4))}, {_MX} AS mx FROM lg),
pr AS (SELECT review_id, CASE WHEN l0 = mx THEN 0 WHEN l1 = mx THEN 1 WHEN l2 = mx THEN 2 ELSE 3 END AS pid,
  greatest(e0, e1, e2, e3) / (e0 + e1 + e2 + e3) AS conf FROM ex)
SELECT review_id, CAST(pid AS INTEGER) AS predicted_label_id,
  (['valid', 'advertisement', 'irrelevant', 'rants without visit'])[pid + 1] AS classification_category,
  CASE WHEN pid = 0 THEN 'valid' ELSE 'invalid' END AS classification_result,
  round(conf, 6) AS classification_confidence FROM pr""", "fx_composed"))
def q_model_scores(spark, sf_dir):
    """UDF-8 user-model path: every composed review scored by a model
    function through predict_batch_udf (batches of 32), then FN-11
    (softmax, first argmax, confidence, class, valid/invalid) natively."""
    c = composed(spark, sf_dir)
    return S.score_with_model(c, make_keyword_logit_model, text="text_info", keep=("review_id",))
