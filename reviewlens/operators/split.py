"""Reproducible train/test split (SAMP-1, SAMP-2, AGG-12, JOIN-7, SET-3).

Rows are placed by a keyed hash, ``h`` = first 32 bits of
md5(key || ':' || seed), so a row's side never depends on partitioning,
file order or cluster size.

* ``split_hash``: stateless, ``h < ratio * 2^32`` (no shuffle at all).
* ``split_exact``: exactly ceil(ratio * n) test rows, the rows with the
  smallest (h, key). No global sort: count rows per 16-bit prefix of h
  (<= 65,536 groups, a bounded table), find the boundary prefix with a
  running sum over that small table, and rank only the rows of the one
  boundary prefix (about n / 65,536 rows).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket32(key, seed: int = 42) -> Column:
    """First 32 bits of md5(key || ':' || seed) as a non-negative BIGINT."""
    k = F.col(key) if isinstance(key, str) else key
    hexs = F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.conv(hexs, 16, 10).cast("long")


def split_hash(df: DataFrame, key: str, test_ratio: float = 0.1, seed: int = 42,
               col: str = "split") -> DataFrame:
    """Tag each row 'test' or 'train' by its hash (approximately ratio)."""
    if not 0 < test_ratio < 1:
        raise ValueError("test_ratio must be between 0 and 1")
    thr = int(test_ratio * 2 ** 32)
    return df.withColumn(col, F.when(hash_bucket32(key, seed) < thr, "test").otherwise("train"))


def split_exact(df: DataFrame, key: str, test_ratio: float = 0.1, seed: int = 42,
                col: str = "split") -> DataFrame:
    """Tag exactly ceil(test_ratio * n) rows 'test' (smallest hash first).

    ``key`` must be unique per row (the review id): rows are ordered by
    (md5 prefix, key), and only the rows sharing the boundary 16-bit prefix
    (about n/65,536) are ranked in one window partition."""
    if not 0 < test_ratio < 1:
        raise ValueError("test_ratio must be between 0 and 1")
    from ..session import stable  # read twice (prefix counts, then tagging): never re-run a model
    df = stable(df, "split-input")
    # a NULL key hashes to 0: its rows are counted, ranked first (by their other columns) and kept
    h = df.withColumn("_h", F.coalesce(hash_bucket32(key, seed), F.lit(0).cast("long"))).withColumn("_b", F.shiftright("_h", 16))
    # bounded table: one row per 16-bit prefix present (<= 65,536 rows)
    buckets = h.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    w_all = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bt = (buckets
          .withColumn("_cum", F.sum("_cnt").over(w_all))
          .withColumn("_n", F.sum("_cnt").over(Window.partitionBy(F.lit(1))))
          .withColumn("_target", F.ceil(F.col("_n") * F.lit(test_ratio)).cast("long"))
          .withColumn("_before", F.col("_cum") - F.col("_cnt"))
          .select("_b", "_before", "_cnt", "_target"))
    # the boundary bucket table is small by construction (proven bound), so broadcast it
    x = h.join(F.broadcast(bt), "_b")
    is_edge = (F.col("_before") < F.col("_target")) & (F.col("_before") + F.col("_cnt") > F.col("_target"))
    # rows outside the boundary prefix: decided by the prefix alone (no shuffle)
    decided = x.filter(~is_edge).withColumn(
        col, F.when(F.col("_before") + F.col("_cnt") <= F.col("_target"), "test").otherwise("train"))
    # rows of the single boundary prefix (~n/65,536): ranked by (h, key)
    w = Window.partitionBy("_b").orderBy("_h", key, *[F.xxhash64(*df.columns)])
    edge = x.filter(is_edge).withColumn("_r", F.row_number().over(w)).withColumn(
        col, F.when(F.col("_before") + F.col("_r") <= F.col("_target"), "test").otherwise("train")).drop("_r")
    out = decided.unionByName(edge)
    return out.drop("_h", "_b", "_before", "_cnt", "_target")


def expected_test_rows(n: int, test_ratio: float) -> int:
    return math.ceil(n * test_ratio)


def split_verify(original: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """AGG-12 / JOIN-7 / SET-3: counts add up, ratios, real key overlap,
    rows lost or invented (exceptAll both ways on keys). Long table."""
    tagged = (original.select(F.col(key).alias("k"), F.lit("original").alias("s"))
              .unionByName(train.select(F.col(key).alias("k"), F.lit("train").alias("s")))
              .unionByName(test.select(F.col(key).alias("k"), F.lit("test").alias("s"))))
    per_key = tagged.groupBy("k").agg(
        F.sum((F.col("s") == "original").cast("long")).alias("o"),
        F.sum((F.col("s") == "train").cast("long")).alias("tr"),
        F.sum((F.col("s") == "test").cast("long")).alias("te"))
    a = per_key.agg(
        F.sum("o").alias("original_rows"), F.sum("tr").alias("train_rows"), F.sum("te").alias("test_rows"),
        F.sum(F.when((F.col("tr") > 0) & (F.col("te") > 0), 1).otherwise(0)).alias("overlap_keys"),
        F.sum(F.greatest(F.col("o") - F.col("tr") - F.col("te"), F.lit(0))).alias("missing_rows"),
        F.sum(F.greatest(F.col("tr") + F.col("te") - F.col("o"), F.lit(0))).alias("extra_rows"))
    return a.select(
        F.col("original_rows").cast("long"), F.col("train_rows").cast("long"), F.col("test_rows").cast("long"),
        ((F.col("train_rows") + F.col("test_rows")) == F.col("original_rows")).alias("counts_match"),
        F.round(F.try_divide(F.col("train_rows"), F.col("original_rows")), 6).alias("train_ratio"),
        F.round(F.try_divide(F.col("test_rows"), F.col("original_rows")), 6).alias("test_ratio"),
        F.col("overlap_keys").cast("long"), F.col("missing_rows").cast("long"), F.col("extra_rows").cast("long"))


def sample_rows(df: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """SAMP-2: n reproducible 'random' rows: smallest md5(key || seed)."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
