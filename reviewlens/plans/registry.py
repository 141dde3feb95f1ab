"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
whole driver tables (through the fixture views). Doubles are rounded to
6 places at the output so both engines print the same value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from . import fixtures as fx
from ..operators import prepare as prep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir):
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return deco


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), places).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---- derived fixtures shared by many queries (Spark side) ----

def joined(spark, sf_dir) -> DataFrame:
    return prep.join_meta_review(fx.fx_meta(spark, sf_dir), fx.fx_review(spark, sf_dir))


def composed(spark, sf_dir) -> DataFrame:
    return prep.compose_reviews(joined(spark, sf_dir))


def labelled(spark, sf_dir) -> DataFrame:
    c = composed(spark, sf_dir)
    g = fx.fx_gt(spark, sf_dir).withColumnRenamed("label", "ai_classification")
    return c.join(g, "review_id", "left")


def split_labelled(spark, sf_dir) -> DataFrame:
    from ..operators.split import split_hash
    return split_hash(labelled(spark, sf_dir), "review_id", 0.1, 42)
