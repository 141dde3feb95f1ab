"""The closed-form classifier (UDF-8, UDF-9) against plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from reviewlens.constants import CLASSES
from reviewlens.operators import bayes

TRAIN = [("great food and Great staff", "valid"), ("buy now buy cheap", "advertisement"),
         ("my cat is sick", "irrelevant"), ("never went there but hate it", "rants without visit"),
         ("food was fine, ça va 100", "valid"), (None, "valid"), ("", "irrelevant"), ("buy food", None), ("x", "no class")]
TEXTS = ["Great FOOD", "buy buy buy", "my cat", "never went", "", None, "unseen words only", "food " * 3000 + "buy"]


def plain_scores(text):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    rows = [(t, c) for t, c in TRAIN if c in CLASSES]
    held = {c: Counter(w for t, k in rows if k == c for w in tokens(t)) for c in CLASSES}
    vocabulary = set().union(*held.values())
    unit = lambda share: round(math.log(share) * bayes.UNIT)
    return [unit((sum(k == c for _, k in rows) + 1) / (len(rows) + 4)) +
            sum(unit((held[c][w] + 1) / (sum(held[c].values()) + len(vocabulary))) for w in tokens(text) if w in vocabulary)
            for c in CLASSES]


def test_scores_equal_plain_python(spark, tmp_path):
    train = spark.createDataFrame(TRAIN, "text string, label string").repartition(3)
    bayes.fit_bayes(train).write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))  # saving and loading is the table itself
    df = spark.createDataFrame(list(enumerate(TEXTS)), "review_id int, text string").repartition(4)
    for opts in ({}, {"max_broadcast_rows": 0, "hot_rows": 50}):  # broadcast, then salted
        out = {r.review_id: r for r in bayes.score_bayes(model, df, **opts).collect()}
        assert len(out) == len(TEXTS)
        for i, text in enumerate(TEXTS):
            want = plain_scores(text)
            assert out[i].predicted_label_id == want.index(max(want))
            assert out[i].classification_category == CLASSES[out[i].predicted_label_id]
            posterior = 1 / sum(math.exp((x - max(want)) / bayes.UNIT) for x in want)
            assert math.isclose(out[i].classification_confidence, posterior, rel_tol=1e-9)


def test_no_training_rows(spark):
    none = spark.createDataFrame([], "text string, label string")
    model = bayes.fit_bayes(none)
    assert [r.word for r in model.collect()] == [""]
    df = spark.createDataFrame([(1, "any text")], "review_id int, text string")
    row = bayes.score_bayes(model, df).first()
    assert (row.predicted_label_id, row.classification_confidence) == (0, 0.25)
    assert bayes.score_bayes(model, df.filter(F.lit(False))).count() == 0
