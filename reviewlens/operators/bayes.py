"""UDF-8 / UDF-9 with a closed form: multinomial naive Bayes from word counts.

Training is one grouped count of words by class. A model is a table
(word, l0..l3): the log likelihood of the word in each class (add-one
smoothing), in whole millionths, so sums are exact and do not depend on the
order of rows. The row of the empty word holds the log priors. Saving a model
is writing this table, and loading it is reading it.

Words are runs of letters and digits (any character beyond ASCII counts as a
letter), A-Z lower-cased. A text without a known word gets the priors' class;
words that training never saw are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASSES
from ..session import materialize, stable
from .evaluate import binary_label
from .join import skew_safe_join

WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UNIT = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text) -> Column:
    """Words of a text, repeats included; none for a null text."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(WORD_RE), F.lit(0))


def _units(share) -> Column:
    return F.round(F.log(share) * UNIT).cast("long")


def fit_bayes(train: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """The model table from the rows whose label is one of the classes; rows
    without a text count towards the priors only."""
    rows = stable(train.filter(F.col(label).isin(*CLASSES)).select(F.col(label).alias("c"), F.col(text).alias("t")),
                  "bayes-train")
    per_class = [F.count(F.when(F.col("c") == c, 1)).alias(f"n{i}") for i, c in enumerate(CLASSES)]
    counts = materialize(rows.select("c", F.explode(words("t")).alias("word")).groupBy("word").agg(*per_class), "bayes")
    sums = [F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(CLASSES))]
    total = counts.agg(*sums, F.count(F.lit(1)).alias("size")).first()
    docs = rows.agg(*per_class, F.count(F.lit(1)).alias("size"))
    seen = [_units((F.col(f"n{i}") + 1) / F.lit(total[f"n{i}"] + total["size"])).alias(f"l{i}")
            for i in range(len(CLASSES))]
    prior = [_units((F.col(f"n{i}") + 1) / (F.col("size") + len(CLASSES))).alias(f"l{i}") for i in range(len(CLASSES))]
    return counts.select("word", *seen).unionByName(docs.select(F.lit("").alias("word"), *prior))


def score_bayes(model: DataFrame, df: DataFrame, text: str = "text", key: str = "review_id", **join_opts) -> DataFrame:
    """Class, valid/invalid result, label id (first maximum) and its posterior
    for each row of ``df``; ``key`` is unique and not null. A frequent word's
    rows are salted when the model is too large to broadcast."""
    x = df.select(key, F.explode(F.concat(F.array(F.lit("")), words(text))).alias("word"))
    sums = skew_safe_join(x, model, ["word"], **join_opts).groupBy(key).agg(
        F.array(*[F.sum(f"l{i}") for i in range(len(CLASSES))]).alias("l"))
    best = sums.withColumn("best", F.array_max("l"))
    odds = F.aggregate("l", F.lit(0.0), lambda s, v: s + F.exp((v - F.col("best")) / UNIT))
    pid = (F.array_position("l", F.col("best")) - 1).cast("int")
    category = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), pid + 1)
    return best.select(key, pid.alias("predicted_label_id"), category.alias("classification_category"),
                       binary_label(category).alias("classification_result"),
                       (F.lit(1.0) / odds).alias("classification_confidence"))
