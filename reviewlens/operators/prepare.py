"""Data preparation (PIPE-1): join, compose, clean.

JOIN-1/2, PROJ-1..4, PRED-1..5, FN-5..8, AGG-9..11. One lazy plan:
scan -> key filter -> skew-safe join -> filter -> projection. Only the
join moves data (and not even that when the meta side is broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..constants import DEFAULT_CLEAN_PATTERN, UNKNOWN_BUSINESS
from ..functions.text import compose_store_info, compose_text_info, is_empty_or_null
from .join import skew_safe_join


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols) -> DataFrame:
    """SRC-6: fail at plan time, naming every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"columns not found: {', '.join(missing)}")
    return df


def nested_to_json(df: DataFrame) -> DataFrame:
    """PROJ-2: nested values (struct/array/map) become JSON text, nulls kept."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (StructType, ArrayType, MapType)):
            out.append(F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def prefix_columns(df: DataFrame, prefix: str, key: str = "gmap_id") -> DataFrame:
    """PROJ-1: every column but the key gets ``prefix``."""
    return df.select(*[F.col(c) if c == key else F.col(c).alias(prefix + c) for c in df.columns])


def valid_key(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c != "")


def join_meta_review(meta: DataFrame, review: DataFrame, key: str = "gmap_id",
                     review_id: str | None = "review_id", **join_opts) -> DataFrame:
    """JOIN-1: inner join meta x review on ``key`` (1:N; NULL/'' keys dropped
    on both sides; duplicate meta keys multiply rows). Output columns:
    meta_*, review_*, key (review_id kept unprefixed when given)."""
    m = prefix_columns(nested_to_json(meta.filter(valid_key(key))), "meta_", key)
    r = review.filter(valid_key(key))
    keep = {key} | ({review_id} if review_id and review_id in r.columns else set())
    r = nested_to_json(r).select(*[F.col(c) if c in keep else F.col(c).alias("review_" + c) for c in r.columns])
    salt_from = [review_id] if review_id and review_id in r.columns else None
    j = skew_safe_join(r, m, [key], "inner", salt_from=salt_from, **join_opts)
    cols = [c for c in j.columns if c.startswith("meta_")] + \
           [c for c in j.columns if c.startswith("review_") and c != review_id] + \
           ([review_id] if review_id in j.columns else []) + [key]
    return j.select(*cols)


def join_stats(meta: DataFrame, review: DataFrame, key: str = "gmap_id") -> DataFrame:
    """JOIN-2: meta rows read, meta rows matched, joined rows, distinct review stores.
    (metric, value) rows; each a single aggregate over a semi-join or scan."""
    r_keys = review.filter(valid_key(key)).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    mk = meta.select(key)
    matched = mk.filter(valid_key(key)).join(r_keys, key, "inner")
    a = mk.agg(F.count(F.lit(1)).alias("value")).select(F.lit("meta_rows_read").alias("metric"), "value")
    b = matched.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("_n"), F.lit(0)).alias("j"))
    c = r_keys.agg(F.count(F.lit(1)).alias("value")).select(F.lit("review_stores").alias("metric"), "value")
    return (a.unionByName(b.select(F.lit("meta_rows_matched").alias("metric"), F.col("m").alias("value")))
             .unionByName(b.select(F.lit("joined_rows").alias("metric"), F.col("j").cast("long").alias("value")))
             .unionByName(c))


def _get(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def has_description_and_text(df: DataFrame) -> Column:
    """PRED-3 predicate."""
    return ~is_empty_or_null(_get(df, "meta_description")) & ~is_empty_or_null(_get(df, "review_text"))


def compose_reviews(joined: DataFrame, key: str = "gmap_id", review_id: str | None = "review_id") -> DataFrame:
    """PRED-3 + FN-7/8: keep rows with description and text, compose
    ``store_info`` and ``text_info``; the key is carried (not left empty)."""
    g = lambda c: _get(joined, c)
    store = compose_store_info(g("meta_name"), g("meta_address"), g("meta_description"), g("meta_category"),
                               g("meta_avg_rating"), g("meta_num_of_reviews"), g("meta_state"))
    text = compose_text_info(g("review_text"), g("review_name"), g("review_rating"), g("review_resp"))
    cols = ([F.col(review_id)] if review_id and review_id in joined.columns else []) + \
        [F.col(key), store.alias("store_info"), text.alias("text_info")]
    return joined.filter(has_description_and_text(joined)).select(*cols)


def compose_summary(joined: DataFrame) -> DataFrame:
    """AGG-11: read, filtered, kept, with store text, with review text, with both."""
    keep = has_description_and_text(joined)
    g = lambda x: _get(joined, x)
    store = compose_store_info(g("meta_name"), g("meta_address"), g("meta_description"), g("meta_category"),
                               g("meta_avg_rating"), g("meta_num_of_reviews"), g("meta_state"))
    text = compose_text_info(g("review_text"), g("review_name"), g("review_rating"), g("review_resp"))
    s_ok, t_ok = store != "", text != ""
    k = lambda cond: F.sum(F.when(keep & cond, 1).otherwise(0)).cast("long")
    return joined.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.sum(F.when(keep, 0).otherwise(1)).cast("long").alias("rows_filtered"),
        k(F.lit(True)).alias("rows_kept"),
        k(s_ok).alias("with_store_info"), k(t_ok).alias("with_text_info"), k(s_ok & t_ok).alias("with_both"))


def contains_any_column(df: DataFrame, pattern: str, regex_ci: bool = False, cols=None) -> Column:
    """True when any column (as text) contains ``pattern``; NULL never matches."""
    cols = cols or df.columns
    if regex_ci:
        # literal pattern, case-insensitive, via Java's \Q..\E quoting
        tests = [F.coalesce(F.col(c).cast("string").rlike("(?iu)\\Q" + pattern + "\\E"), F.lit(False))
                 for c in cols]
    else:
        tests = [F.coalesce(F.col(c).cast("string").contains(pattern), F.lit(False)) for c in cols]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def clean_error_rows(df: DataFrame, pattern: str = DEFAULT_CLEAN_PATTERN) -> DataFrame:
    """PRED-4: drop rows where any column contains the literal pattern."""
    return df.filter(~contains_any_column(df, pattern))


def clean_summary(df: DataFrame, pattern: str = DEFAULT_CLEAN_PATTERN) -> DataFrame:
    """PRED-5 / AGG-10: before, errors, after, success rate % (dry run)."""
    hit = contains_any_column(df, pattern)
    a = df.agg(F.count(F.lit(1)).alias("rows_before"), F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("error_rows"))
    return a.select("rows_before", "error_rows", (F.col("rows_before") - F.col("error_rows")).alias("rows_after"),
                    F.round(F.coalesce(F.try_divide((F.col("rows_before") - F.col("error_rows")) * 100.0,
                                                    F.col("rows_before")), F.lit(0.0)), 6).alias("success_rate_pct"))


def dropna_required(df: DataFrame, cols) -> DataFrame:
    """PRED-1: drop rows with NULL in any of ``cols`` (after SRC-6)."""
    require_columns(df, cols)
    return df.dropna(subset=list(cols))


def store_column_fallback(df: DataFrame, store_column: str = "store_info") -> DataFrame:
    """PROJ-3: when ``store_column`` is absent: gmap_id as text, else
    business_name, else 'Unknown Business' (a plan-time choice)."""
    if store_column in df.columns:
        return df
    if "gmap_id" in df.columns:
        return df.withColumn(store_column, F.col("gmap_id").cast("string"))
    if "business_name" in df.columns:
        return df.withColumn(store_column, F.col("business_name"))
    return df.withColumn(store_column, F.lit(UNKNOWN_BUSINESS))


def reviews_per_store(joined: DataFrame, key: str = "gmap_id", review_id: str = "review_id",
                      rating: str = "review_rating") -> DataFrame:
    """AGG-9 (re-aimed): per-store review groups as a summary row.

    The reference builds an in-memory list per store only to drive its
    join; a list per key is unbounded (one store may hold a third of all
    reviews), so we keep the group's size, rating mean and id range, all
    partial-aggregated map-side."""
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count(rating).alias("n_rated"),
        F.round(F.avg(rating), 6).alias("avg_rating"),
        F.min(review_id).alias("first_review_id"),
        F.max(review_id).alias("last_review_id"))
