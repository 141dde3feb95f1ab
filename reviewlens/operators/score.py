"""Classification jobs (PIPE-4): UDF-1..4, UDF-6, UDF-8, UDF-9.

The model call is the only Python stage. A *scorer* is any object with
``score(batch: pandas.DataFrame) -> list[str]``: it receives an Arrow batch
holding the rendered ``prompt`` plus the context columns and returns one
raw answer per row. Rendering before it and parsing after it are native
column expressions, so the Python worker sees each row exactly once.

``classify`` runs one ``mapInPandas`` pass. The scorer object is built once
per partition (``factory()`` inside the task), never per row, and called
with ``batch_size`` rows at a time. Texts come as UTF-8 and only those of one
call are decoded, so a worker's memory does not follow the Arrow batch's texts
(as Python text, one emoji takes a text to four bytes a character). A failing call is retried with waits
of 2**attempt s; after the last attempt the batch is bisected down to the
failing rows, so one bad row does not fail its neighbours (UDF-3/4): its
error text goes to ``ai_error`` and the job goes on.

Scorers may be remote and non-deterministic; Spark may run a task twice.
Call ``materialize`` (``reviewlens.session``) on the result before more
than one action so scores are computed once and survive lost executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..constants import CLASSES, ERROR_PREFIX, MAX_TOKENS, MAX_TOKENS_RAG, TEMPERATURE
from ..functions.parse import parse_for_template
from ..functions.prompts import render_prompt

# Fixed values of the shipped keyword scorer (our own rules, checked in
# this order; no keyword -> valid):
#   advertisement: "http", "www.", "@", "free", "discount", "promo"
#   irrelevant: "license", "copyright", "lorem ipsum"
#   rants without visit: "never been", "never visited", "heard that"
RULE_KEYWORDS = [
    ("advertisement", ["http", "www.", "@", "free", "discount", "promo"]),
    ("irrelevant", ["license", "copyright", "lorem ipsum"]),
    ("rants without visit", ["never been", "never visited", "heard that"]),
]
COT_TEMPLATES = ("few_shot_cot", "cot_rag")
CALL_BYTES = 4 << 20  # texts shown at a time to a scorer that names no batch size
NULL_PROMPT_ERROR = "ValueError: prompt could not be rendered (NULL store or comment)"


def rule_answer(cls: str, reason: str, cot: bool) -> str:
    """Answer text in the shape the templates ask for."""
    if cot:
        return f"Reasoning: {reason}.\nClassification: {cls}"
    return f"Classification: {cls}"


class RuleScorer:
    """UDF-2 (a): keyword rules over the comment; needs no model or network.
    Takes as many rows as ``CALL_BYTES`` of text allow (``batch_size = None``)."""

    batch_size = None

    def __init__(self, comment_col: str = "comment", template_col: str = "template"):
        self.comment_col = comment_col
        self.template_col = template_col

    def classes(self, batch: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
        cls, why = [], []
        for text in batch[self.comment_col].fillna(""):
            low = text.lower()  # one at a time: a Series with its .str would stay until the next collection
            label, word = next(((c, w) for c, words in RULE_KEYWORDS for w in words if w in low), ("valid", None))
            cls.append(label)
            why.append(f"mentions '{word}'" if word else "no warning signs")
        return pd.Series(cls, batch.index, object), pd.Series(why, batch.index, object)

    def score(self, batch: pd.DataFrame) -> list[str]:
        cls, why = self.classes(batch)
        cot = batch[self.template_col].isin(COT_TEMPLATES) if self.template_col in batch else False
        return [rule_answer(c, r, bool(t)) for c, r, t in
                zip(cls, why, cot if isinstance(cot, pd.Series) else [cot] * len(batch))]


class KnnVoteScorer:
    """UDF-2 (b) / UDF-7: majority label of the retrieved examples
    (``example_labels``, rank order); ties go to the earlier class; no
    examples -> the keyword rules."""

    def __init__(self, labels_col: str = "example_labels", fallback: RuleScorer | None = None):
        self.labels_col = labels_col
        self.fallback = fallback or RuleScorer()

    def score(self, batch: pd.DataFrame) -> list[str]:
        out = self.fallback.score(batch)
        order = {c: i for i, c in enumerate(CLASSES)}
        for i, labels in enumerate(batch[self.labels_col]):
            if labels is None or len(labels) == 0:
                continue
            counts: dict[str, int] = {}
            for x in labels:
                counts[x] = counts.get(x, 0) + 1
            best = min(counts, key=lambda x: (-counts[x], order.get(x, len(CLASSES)), x))
            out[i] = rule_answer(best, f"{counts[best]} of {len(labels)} similar reviews say {best}", True)
        return out


def generation_params(template: str) -> dict:
    """Model call settings per template (more room for retrieval answers)."""
    return {"max_tokens": MAX_TOKENS_RAG if template == "cot_rag" else MAX_TOKENS, "temperature": TEMPERATURE}


class FunctionScorer:
    """UDF-2 remote back end: wraps a user function ``fn(prompts: list[str])
    -> list[str]`` (an HTTP client, a local model...). Called with
    ``batch_size`` prompts at a time; build the client inside ``fn`` lazily
    or pass ``lambda: FunctionScorer(make_client())`` as the factory so it
    is created once per task. With ``with_params`` the call also gets
    ``max_tokens`` and ``temperature`` for the rows' template."""

    def __init__(self, fn, batch_size: int | None = 32, with_params: bool = False):
        self.fn = fn
        self.batch_size = batch_size
        self.with_params = with_params

    def score(self, batch: pd.DataFrame) -> list[str]:
        if not self.with_params:
            out = list(self.fn(batch["prompt"].tolist()))
        else:
            out = [None] * len(batch)
            tpl = batch["template"].to_numpy()
            for t in pd.unique(tpl):
                pos = [i for i in range(len(batch)) if tpl[i] == t]
                res = list(self.fn(batch["prompt"].iloc[pos].tolist(), **generation_params(t)))
                if len(res) != len(pos):
                    raise ValueError(f"scorer returned {len(res)} answers for {len(pos)} prompts")
                for i, r in zip(pos, res):
                    out[i] = r
        if len(out) != len(batch):
            raise ValueError(f"scorer returned {len(out)} answers for {len(batch)} prompts")
        return out


def _call(scorer, sub: pd.DataFrame) -> list:
    out = list(scorer.score(sub))
    if len(out) != len(sub):  # a short or long answer list is a failed call, not a misaligned one
        raise ValueError(f"scorer returned {len(out)} answers for {len(sub)} rows")
    return out


def _score_batch(scorer, sub: pd.DataFrame, max_retries: int, base_wait: float):
    """Score one sub-batch: retried with waits of base_wait*2**attempt;
    after the last failure the batch is bisected, so only the halves that
    hold a failing row are scored again (O(bad rows * log n) calls, not one
    call per row) and one bad row never fails its neighbours. Returns
    (answers, errors)."""
    for attempt in range(max_retries):
        try:
            return _call(scorer, sub), [None] * len(sub)
        except Exception:  # noqa: BLE001
            if attempt < max_retries - 1 and base_wait > 0:
                time.sleep(base_wait * 2 ** attempt)
    return _isolate(scorer, sub)


def _isolate(scorer, sub: pd.DataFrame):
    if len(sub) == 1:
        try:
            return _call(scorer, sub), [None]
        except Exception as e:  # noqa: BLE001
            return [None], [f"{type(e).__name__}: {e}"]
    answers: list[str | None] = []
    errors: list[str | None] = []
    mid = len(sub) // 2
    for half in (sub.iloc[:mid], sub.iloc[mid:]):
        try:
            a, e = _call(scorer, half), [None] * len(half)
        except Exception:  # noqa: BLE001
            a, e = _isolate(scorer, half)
        answers += a
        errors += e
    return answers, errors


def _calls(pdf: pd.DataFrame, ok, size: int | None, texts: list[str]):
    """The positions ``ok`` in stretches of ``size`` rows, or (None) of about
    ``CALL_BYTES`` of the encoded columns ``texts`` (at least a row each)."""
    if size:
        return [ok[a:a + size] for a in range(0, len(ok), size)]
    sizes = sum(pdf[c].map(len, na_action="ignore").fillna(0).to_numpy(dtype=np.int64) for c in texts)[ok]
    part = np.cumsum(sizes) // CALL_BYTES
    return [x for x in np.split(ok, np.flatnonzero(np.diff(part)) + 1) if len(x)]


def _decoded(sub: pd.DataFrame, texts: list[str]) -> pd.DataFrame:
    return sub.assign(**{c: pd.Series([None if x is None else bytes(x).decode() for x in sub[c]], sub.index, object)
                         for c in texts})


def _score_partition(factory: Callable[[], object], batch_size: int | None, max_retries: int, base_wait: float,
                     comment: str, back: list[str], texts: list[str]):
    """``comment``: the input column shown to the scorer as ``comment``;
    ``back``: the input columns that leave Python again; ``texts``: those
    that come as UTF-8."""
    def run(it):
        scorer = factory()  # one client per task, not per row
        size = batch_size or getattr(scorer, "batch_size", None)
        for pdf in it:
            answers: list[str | None] = []
            errors: list[str | None] = []
            ok = pdf["prompt"].notna().to_numpy()
            for at in _calls(pdf, ok.nonzero()[0], size, texts):
                todo = _decoded(pdf.iloc[at], texts)
                a, e = _score_batch(scorer, todo.assign(comment=todo[comment]), max_retries, base_wait)
                answers += a
                errors += e
            if not ok.all():  # FN-14: a NULL store or comment cannot be rendered -> error row
                full_a: list[str | None] = [None] * len(pdf)
                full_e: list[str | None] = [NULL_PROMPT_ERROR] * len(pdf)
                for i, a, e in zip(ok.nonzero()[0], answers, errors):
                    full_a[i], full_e[i] = a, e
                answers, errors = full_a, full_e
            out = pdf[back].assign(ai_raw_response=answers, ai_error=errors)
            pdf.loc[:, texts] = todo = None  # Spark's reader holds the frame until it has made the next
            yield out
    return run


def classify(df: DataFrame, factory: Callable[[], object], template="few_shot",
             store: str = "store_info", comment: str = "text_info", examples: str | None = None,
             keep: tuple[str, ...] = ("review_id",), context: tuple[str, ...] = (),
             batch_size: int | None = None, max_retries: int = 3, base_wait: float = 1.0,
             partitions: int | None = None) -> DataFrame:
    """UDF-1: render (FN-14) -> score (one mapInPandas pass) -> parse
    (FN-17/18 by template). ``template`` is a name or a column of names
    (several templates in one job). Output: ``keep`` columns, template,
    ai_raw_response, ai_error, ai_classification (NULL on error).
    The scorer gets ``batch_size`` rows per call (default: the scorer's own
    ``batch_size`` attribute, e.g. 32 for a remote model, else the rows of
    about ``CALL_BYTES`` of texts); ``partitions``
    bounds the number of concurrent scorer clients."""
    tpl = F.lit(template) if isinstance(template, str) else template
    kept = [c for c in keep if c != "template"]
    cols = [F.col(c) for c in kept] + [tpl.alias("template")]
    texts = ["prompt"]  # columns that do not leave Python again travel as UTF-8
    shown = comment  # a kept comment column is not sent a second time
    if comment not in kept:
        shown = "comment" if "comment" not in kept else "_comment"
        cols.append(F.col(comment).alias(shown))
        texts.append(shown)
    cols += [F.col(c) for c in dict.fromkeys((*context, *([examples] if examples else []))) if c not in kept]
    cols.append(render_prompt(store, comment, template, examples).alias("prompt"))
    x = df.select(*cols)
    if examples and examples not in kept:
        texts.append(examples)
    texts = [c for c in dict.fromkeys(texts) if x.schema[c].dataType == StringType()]
    x = x.withColumns({c: F.col(c).cast("binary") for c in texts})
    if partitions:
        x = x.repartition(partitions)
    back = [*kept, "template"]
    schema = x.select(*back).schema.add("ai_raw_response", "string").add("ai_error", "string")
    scored = x.mapInPandas(_score_partition(factory, batch_size, max_retries, base_wait, shown, back, texts), schema)
    parsed = F.when(F.col("ai_error").isNull(), parse_for_template(F.col("ai_raw_response"), F.col("template")))
    return scored.select(*back, "ai_raw_response", "ai_error", parsed.alias("ai_classification"))


def with_error_text(df: DataFrame) -> DataFrame:
    """UDF-3 at export: an error becomes 'ERROR: <message>' in both the
    class and the raw-answer column (the CSV form the evaluator filters)."""
    err = F.concat(F.lit(ERROR_PREFIX + " "), F.col("ai_error"))
    return (df.withColumn("ai_classification", F.when(F.col("ai_error").isNull(), F.col("ai_classification"))
                          .otherwise(err))
              .withColumn("ai_raw_response", F.when(F.col("ai_error").isNull(), F.col("ai_raw_response"))
                          .otherwise(err))
              .drop("ai_error"))


# ---- UDF-9 / UDF-8: trainable text classifier on pyspark.ml ----

def train_text_classifier(train: DataFrame, text: str = "text", label: str = "label",
                          num_features: int = 1 << 18, max_iter: int = 50, reg: float = 0.01):
    """UDF-9 (re-aimed): RegexTokenizer -> HashingTF -> IDF ->
    multinomial LogisticRegression over whole texts; labels are indexed in
    the fixed class order (label id = class position). Distributed fit
    (tree aggregation), nothing collected but the coefficients."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    lab = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col(label)) - 1
    data = train.filter(lab >= 0).select(F.col(text).alias("_text"), lab.cast("double").alias("_label"))
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_feat"),
        LogisticRegression(featuresCol="_feat", labelCol="_label", family="multinomial",
                           maxIter=max_iter, regParam=reg, rawPredictionCol="_raw",
                           probabilityCol="_prob", predictionCol="_pred"),
    ])
    return pipe.fit(data)


def save_text_classifier(model, path: str, overwrite: bool = False) -> None:
    """The fitted model in ``path`` (shared storage)."""
    (model.write().overwrite() if overwrite else model.write()).save(path)


def load_text_classifier(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def score_reviews(model, df: DataFrame, text: str = "text", keep=("review_id",)) -> DataFrame:
    """UDF-8: batch inference; adds classification_category (class),
    classification_result (valid/invalid), classification_confidence
    (largest probability) and predicted_label_id (first maximum)."""
    from pyspark.ml.functions import vector_to_array

    from .evaluate import argmax, binary_label

    x = model.transform(df.select(*keep, F.col(text).alias("_text")))
    probs = vector_to_array("_prob").alias("probabilities")
    y = x.select(*keep, probs)
    pid = argmax("probabilities")
    cat = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), pid + 1)
    return y.select(*keep, pid.alias("predicted_label_id"), cat.alias("classification_category"),
                    binary_label(cat).alias("classification_result"),
                    F.array_max("probabilities").alias("classification_confidence"))



def score_with_model(df: DataFrame, make_predict_fn, text: str = "text", keep=("review_id",),
                     batch_size: int = 32) -> DataFrame:
    """UDF-8 for user models: ``make_predict_fn()`` is called once per
    Python worker and returns ``predict(texts: np.ndarray) -> logits``
    (batch x 4, class order); ``predict_batch_udf`` feeds it ``batch_size``
    rows at a time over Arrow. FN-11 (softmax, argmax, confidence, class,
    valid/invalid) then runs natively."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    from .evaluate import classify_logits

    predict = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    x = df.select(*keep, predict(F.col(text)).alias("logits"))
    return classify_logits(x, "logits").select(
        *keep, "predicted_label_id", F.col("classification_category"), F.col("classification_result"),
        F.col("confidence").alias("classification_confidence"))
