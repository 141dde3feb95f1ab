"""Profile / split / comparison queries (PIPE-2, SAMP-1/2, AGG-1..6, 12, 13,
FN-1..4, TOPK-1/2, JOIN-6/7, SET-1..3, PRED-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixtures as fx
from .oracle import _WS, h32, with_ctes
from .q_prepare import CLASSIFIED_SQL, classified
from .registry import composed, labelled, query, split_labelled
from ..constants import PROFILE_ERROR_PATTERNS
from ..operators import profile as pf
from ..operators import split as sp
from ..session import materialize

_IN = _WS[1:-1]
RATING_SQL = f"TRY_CAST(nullif(regexp_extract(text_info, 'Rating:{_WS}*(\\d+\\.?\\d*)', 1), '') AS DOUBLE)"
STORE_RATING_SQL = f"TRY_CAST(nullif(regexp_extract(store_info, 'Average Rating:{_WS}*(\\d+\\.?\\d*)', 1), '') AS DOUBLE)"
_STRIP = "regexp_replace({x}, '^{w}+|{w}+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x, w=_WS)


_CAT_EXT = f"regexp_extract(store_info, 'Category:{_WS}*([^|]+)', 1)"
CATEGORY_SQL = (f"CASE WHEN store_info IS NOT NULL AND regexp_matches(store_info, 'Category:{_WS}*([^|]+)') "
                f"THEN {_strip(f'split_part({_strip(_CAT_EXT)}, chr(44), 1)')} ELSE 'Unknown' END")
PROF = f"""prof AS (SELECT *, {RATING_SQL} AS extracted_rating, {CATEGORY_SQL} AS store_category,
  {STORE_RATING_SQL} AS store_avg_rating, length(text_info) AS text_length FROM fx_split)"""


def prof(spark, sf_dir):
    return pf.with_extracted(split_labelled(spark, sf_dir))


@query("extract_rating", with_ctes(f"WITH {PROF} SELECT review_id, extracted_rating FROM prof", "fx_split"))
def q_extract_rating(spark, sf_dir):
    """FN-1: first 'Rating: x' of text_info as DOUBLE."""
    return prof(spark, sf_dir).select("review_id", "extracted_rating")


@query("extract_category", with_ctes(f"WITH {PROF} SELECT review_id, store_category FROM prof", "fx_split"))
def q_extract_category(spark, sf_dir):
    """FN-2: first category of store_info, 'Unknown' when absent."""
    return prof(spark, sf_dir).select("review_id", "store_category")


@query("extract_store_rating", with_ctes(f"WITH {PROF} SELECT review_id, store_avg_rating FROM prof", "fx_split"))
def q_extract_store_rating(spark, sf_dir):
    """FN-3: store average rating from store_info."""
    return prof(spark, sf_dir).select("review_id", "store_avg_rating")


@query("class_distribution", with_ctes(f"""WITH {PROF} SELECT ai_classification, n, round(n * 100.0 / total, 6) AS pct
FROM (SELECT ai_classification, count(*) AS n, sum(count(*)) OVER () AS total FROM prof GROUP BY ai_classification)
WHERE ai_classification IS NOT NULL""", "fx_split"))
def q_class_distribution(spark, sf_dir):
    """AGG-1/2: class value counts, share of all rows."""
    return pf.class_distribution(prof(spark, sf_dir))


@query("rating_histogram", with_ctes(f"""WITH {PROF} SELECT extracted_rating, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct
FROM prof WHERE extracted_rating IS NOT NULL GROUP BY extracted_rating""", "fx_split"))
def q_rating_histogram(spark, sf_dir):
    """AGG-5 / AGG-2 (non-null share) / SORT-1."""
    return pf.rating_histogram(prof(spark, sf_dir))


_MISS_COLS = ["review_id", "gmap_id", "store_info", "text_info", "ai_classification"]


@query("missing_values", with_ctes(" UNION ALL ".join(
    f"SELECT {i} AS ord, '{c}' AS column, count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct_missing FROM fx_labelled"
    for i, c in enumerate(_MISS_COLS)), "fx_labelled"))
def q_missing_values(spark, sf_dir):
    """AGG-3: NULL count and share per column."""
    return pf.missing_values(labelled(spark, sf_dir), _MISS_COLS)


@query("numeric_summary", with_ctes(f"WITH {PROF} " + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, "
    f"round(min({m}), 6) AS min, round(max({m}), 6) AS max, round(median(CAST({m} AS DOUBLE)), 6) AS median FROM prof"
    for m in ["extracted_rating", "store_avg_rating", "text_length"]), "fx_split"))
def q_numeric_summary(spark, sf_dir):
    """AGG-4 / FN-4: mean, sample std, min, max, exact median."""
    return pf.numeric_summary(prof(spark, sf_dir))


_MONEY = {"o_totalprice": "orders", "l_extendedprice": "lineitem"}


@query("numeric_summary_radix", " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, "
    f"round(min({m}), 6) AS min, round(max({m}), 6) AS max, round(median(CAST({m} AS DOUBLE)), 6) AS median FROM {t}"
    for m, t in _MONEY.items()))
def q_numeric_summary_radix(spark, sf_dir):
    """AGG-4 on measures of which nearly every value is its own: the median
    by radix selection, no task ranking more than 1,024 values."""
    sides = [fx.table(spark, sf_dir, t).select(F.col(m).cast("double").alias(m)) for m, t in _MONEY.items()]
    return pf.numeric_summary(sides[0].unionByName(sides[1], allowMissingColumns=True), tuple(_MONEY), window_rows=1024)


@query("top_categories", with_ctes(f"""WITH {PROF} SELECT store_category, n, round(n * 100.0 / total, 6) AS pct,
  CAST(row_number() OVER (ORDER BY n DESC, store_category) AS INTEGER) AS rank
FROM (SELECT store_category, count(*) AS n, sum(count(*)) OVER () AS total FROM prof GROUP BY store_category)
ORDER BY n DESC, store_category LIMIT 10""", "fx_split"))
def q_top_categories(spark, sf_dir):
    """TOPK-1: ten most frequent categories, numbered."""
    return pf.top_categories(prof(spark, sf_dir))


_PATS = list(PROFILE_ERROR_PATTERNS)
_CCOLS = ["CAST(review_id AS VARCHAR)", "gmap_id", "store_info", "text_info", "ai_classification", "ai_raw_response"]


def _ci_any(p: str) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), lower('{p}')), false)" for c in _CCOLS) + ")"


@query("error_pattern_counts", with_ctes(f"""WITH x AS ({CLASSIFIED_SQL}),
c AS (SELECT {', '.join(f'CAST(sum(CASE WHEN {_ci_any(p)} THEN 1 ELSE 0 END) AS BIGINT) AS p{i}' for i, p in enumerate(_PATS))} FROM x)
""" + " UNION ALL ".join(f"SELECT {i} AS ord, '{p}' AS pattern, p{i} AS n_rows FROM c" for i, p in enumerate(_PATS))
    + f" UNION ALL SELECT 4, 'total', p0 + p1 + p2 + p3 FROM c", "fx_composed", "fx_pred"))
def q_error_pattern_counts(spark, sf_dir):
    """PRED-6: rows containing each error pattern (any column, any case)."""
    return pf.error_pattern_counts(classified(spark, sf_dir))


@query("profile_dataset", with_ctes(f"""WITH {PROF} SELECT split, count(*) AS rows, count(ai_classification) AS labelled_rows,
  count(DISTINCT ai_classification) AS classes, count(extracted_rating) AS rated_rows,
  round(avg(extracted_rating), 6) AS rating_mean, round(stddev_samp(extracted_rating), 6) AS rating_std,
  count(store_avg_rating) AS store_rated_rows, round(avg(store_avg_rating), 6) AS store_rating_mean,
  round(stddev_samp(store_avg_rating), 6) AS store_rating_std, round(avg(text_length), 6) AS text_length_mean,
  round(median(CAST(text_length AS DOUBLE)), 6) AS text_length_median, min(text_length) AS text_length_min,
  max(text_length) AS text_length_max, count(DISTINCT store_category) AS categories,
  round(min(extracted_rating), 6) AS rating_min, round(max(extracted_rating), 6) AS rating_max,
  round(median(extracted_rating), 6) AS rating_median
FROM prof GROUP BY split""", "fx_split"))
def q_profile_dataset(spark, sf_dir):
    """AGG-6: scalar profile of train and test from one histogram."""
    return pf.profile_scalars(prof(spark, sf_dir), by=["split"])


@query("profile_distributions", with_ctes(f"""WITH {PROF}
SELECT split, 'class' AS section, ai_classification AS value, count(*) AS n FROM prof
  WHERE ai_classification IS NOT NULL GROUP BY split, ai_classification
UNION ALL SELECT split, 'rating', CAST(extracted_rating AS VARCHAR), count(*) FROM prof
  WHERE extracted_rating IS NOT NULL GROUP BY split, extracted_rating
UNION ALL SELECT split, 'category', store_category, count(*) FROM prof GROUP BY split, store_category""", "fx_split"))
def q_profile_distributions(spark, sf_dir):
    """AGG-6: class / rating / category distributions per split, one histogram."""
    return pf.profile_distributions(prof(spark, sf_dir), "split")


def _by_split(spark, sf_dir, col):
    """Both sides' histogram of ``col`` from one pass."""
    return pf.histogram(prof(spark, sf_dir), [col], ["split"])


@query("compare_class_distribution", with_ctes(f"""WITH {PROF},
tr AS (SELECT ai_classification, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM prof
  WHERE split = 'train' AND ai_classification IS NOT NULL GROUP BY ai_classification),
te AS (SELECT ai_classification, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM prof
  WHERE split = 'test' AND ai_classification IS NOT NULL GROUP BY ai_classification)
SELECT coalesce(tr.ai_classification, te.ai_classification) AS ai_classification,
  round(coalesce(tr.pct, 0), 6) AS train_pct, round(coalesce(te.pct, 0), 6) AS test_pct,
  round(coalesce(tr.pct, 0) - coalesce(te.pct, 0), 6) AS difference
FROM tr FULL OUTER JOIN te ON tr.ai_classification = te.ai_classification""", "fx_split"))
def q_compare_class_distribution(spark, sf_dir):
    """JOIN-6 / SET-2: train vs test class shares, absent = 0."""
    return pf.class_comparison(_by_split(spark, sf_dir, "ai_classification"))


@query("compare_sizes_ratings", with_ctes(f"""WITH {PROF} SELECT
  CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
  CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_rows,
  round(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) / sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END), 6) AS train_test_ratio,
  round(avg(CASE WHEN split = 'train' THEN extracted_rating END), 6) AS train_rating_mean,
  round(avg(CASE WHEN split = 'test' THEN extracted_rating END), 6) AS test_rating_mean,
  round(avg(CASE WHEN split = 'train' THEN extracted_rating END) - avg(CASE WHEN split = 'test' THEN extracted_rating END), 6)
    AS rating_difference
FROM prof""", "fx_split"))
def q_compare_sizes_ratings(spark, sf_dir):
    """AGG-13: sizes, ratio, mean ratings and their difference."""
    return pf.sizes_ratings(_by_split(spark, sf_dir, "extracted_rating"))


@query("category_overlap", with_ctes(f"""WITH {PROF},
a AS (SELECT DISTINCT store_category FROM prof WHERE split = 'train'),
b AS (SELECT DISTINCT store_category FROM prof WHERE split = 'test'),
s AS (SELECT coalesce(a.store_category, b.store_category) AS c,
  CASE WHEN a.store_category IS NOT NULL AND b.store_category IS NOT NULL THEN 'common'
       WHEN a.store_category IS NOT NULL THEN 'train_only' ELSE 'test_only' END AS side
  FROM a FULL OUTER JOIN b ON a.store_category = b.store_category),
r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY c) AS rk FROM s)
SELECT side, count(*) AS n_categories,
  coalesce(string_agg(CASE WHEN rk <= 5 THEN c END, ', ' ORDER BY c), '') AS first_five
FROM r GROUP BY side""", "fx_split"))
def q_category_overlap(spark, sf_dir):
    """SET-1: common / train-only / test-only categories."""
    return pf.overlap(_by_split(spark, sf_dir, "store_category"))


@query("split_hash", with_ctes(f"""SELECT review_id,
  CASE WHEN {h32('review_id')} < {int(0.1 * 2 ** 32)} THEN 'test' ELSE 'train' END AS split FROM fx_labelled""",
                               "fx_labelled"))
def q_split_hash(spark, sf_dir):
    """SAMP-1 (stateless): md5-keyed split, about 10 % test."""
    return sp.split_hash(labelled(spark, sf_dir), "review_id", 0.1, 42).select("review_id", "split")


EXACT_SQL = f"""SELECT review_id, CASE WHEN rk <= CAST(ceil(n * 0.1) AS BIGINT) THEN 'test' ELSE 'train' END AS split
FROM (SELECT review_id, row_number() OVER (ORDER BY {h32('review_id')}, review_id) AS rk, count(*) OVER () AS n
      FROM fx_labelled)"""


@query("split_exact", with_ctes(EXACT_SQL, "fx_labelled"))
def q_split_exact(spark, sf_dir):
    """SAMP-1 (exact): ceil(0.1 n) test rows, no global sort."""
    return sp.split_exact(labelled(spark, sf_dir), "review_id", 0.1, 42).select("review_id", "split")


@query("split_verify", with_ctes(f"""WITH s AS ({EXACT_SQL}) SELECT
  (SELECT count(*) FROM fx_labelled) AS original_rows,
  CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
  CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_rows,
  count(*) = (SELECT count(*) FROM fx_labelled) AS counts_match,
  round(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) / count(*), 6) AS train_ratio,
  round(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) / count(*), 6) AS test_ratio,
  CAST(0 AS BIGINT) AS overlap_keys, CAST(0 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows
FROM s""", "fx_labelled"))
def q_split_verify(spark, sf_dir):
    """AGG-12 / JOIN-7 / SET-3: counts add up, ratios, key overlap, lost rows."""
    lab = materialize(labelled(spark, sf_dir), "labelled")
    s = materialize(sp.split_exact(lab, "review_id", 0.1, 42), "split")
    return sp.split_verify(lab, s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test"), "review_id")


@query("sample_rows", with_ctes("""SELECT * FROM fx_labelled
ORDER BY md5(CAST(review_id AS VARCHAR) || '42'), review_id LIMIT 5""", "fx_labelled"))
def q_sample_rows(spark, sf_dir):
    """SAMP-2: five reproducible random rows."""
    return sp.sample_rows(labelled(spark, sf_dir), "review_id", 5, 42)


@query("head_samples", with_ctes("SELECT * FROM fx_composed ORDER BY review_id LIMIT 3", "fx_composed"))
def q_head_samples(spark, sf_dir):
    """TOPK-2: first three composed rows."""
    return pf.head_samples(composed(spark, sf_dir), "review_id", 3)
