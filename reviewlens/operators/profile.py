"""Dataset profiling and train/test comparison (PIPE-2).

AGG-1..6, AGG-13, FN-1..4, TOPK-1/2, SORT-1, JOIN-6, SET-1/2, PRED-6.

Counts, shares, moments, exact medians and comparisons all come from one
``histogram`` per call: a table of (measure, value, count), whose size is
the number of distinct values of the profiled columns (classes, ratings,
lengths, categories), never the input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PROFILE_ERROR_PATTERNS
from ..functions.text import extract_category, extract_rating, extract_store_rating
from ..session import materialize
from .prepare import contains_any_column


def with_extracted(df: DataFrame, text_col: str = "text_info", store_col: str = "store_info") -> DataFrame:
    """FN-1..4 derived columns used by the profile."""
    return (df.withColumn("extracted_rating", extract_rating(text_col))
              .withColumn("store_category", extract_category(store_col))
              .withColumn("store_avg_rating", extract_store_rating(store_col))
              .withColumn("text_length", F.length(text_col)))


MEASURE, VALUE, COUNT = "_measure", "_value", "_n"


def histogram(df: DataFrame, cols, by=()) -> DataFrame:
    """(by..., _measure, _value, _n): how often each value (as text, NULL
    too) of each of ``cols`` occurs. The one pass over the input that all
    counts, shares, moments, medians and comparisons are taken from. It is
    pre-aggregated, so a hot value costs nothing extra, and written once,
    because several results read it."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias(MEASURE), F.col(c).cast("string").alias(VALUE))
                               for c in cols])).alias("_each")
    counts = df.select(*by, each).groupBy(*by, f"_each.{MEASURE}", f"_each.{VALUE}").agg(
        F.count(F.lit(1)).alias(COUNT))
    return materialize(counts, "histogram")


def tagged_sides(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sides under one schema, told apart by ``split``."""
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True))


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def shares(h: DataFrame, col: str, dtype: str, by=(), share_of: str = "all") -> DataFrame:
    """AGG-1/2 from a histogram. The denominator is a scalar subquery (or a
    per-group total joined on the ``by`` keys) on the written table, never a
    key-less window over its values."""
    g = h.filter(F.col(MEASURE) == col)
    tot = F.sum(COUNT) if share_of == "all" else F.sum(F.when(F.col(VALUE).isNotNull(), F.col(COUNT)))
    if by:
        g = g.join(g.groupBy(*by).agg(tot.alias("_total")), list(by))
        total = F.col("_total")
    else:
        total = g.select(tot).scalar()
    out = g.withColumn("pct", F.col(COUNT) * 100.0 / total).filter(F.col(VALUE).isNotNull())
    return out.select(*by, F.col(VALUE).cast(dtype).alias(col), F.col(COUNT).alias("n"), "pct") \
              .orderBy(*by, F.desc("n"), col)


def value_counts(df: DataFrame, col: str, by=(), share_of: str = "all") -> DataFrame:
    """AGG-1/2: counts per non-null value, descending (ties by value), with
    the share of all rows (``share_of='all'``) or of non-null rows."""
    return shares(histogram(df, [col], by), col, _type(df, col), by, share_of)


def class_distribution(df: DataFrame, col: str = "ai_classification", by=()) -> DataFrame:
    return value_counts(df, col, by, share_of="all")


def rating_histogram(df: DataFrame, col: str = "extracted_rating", by=()) -> DataFrame:
    """AGG-5: counts per rating in rating order; share of rated rows."""
    return value_counts(df, col, by, share_of="nonnull").orderBy(*by, col)


def _ranked(counts: DataFrame, col: str, n: int) -> DataFrame:
    return counts.limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), col)))


def top_categories(df: DataFrame, col: str = "store_category", n: int = 10) -> DataFrame:
    """TOPK-1: n most frequent categories, numbered 1..n (share of all rows)."""
    return _ranked(value_counts(df, col, share_of="all"), col, n)


def missing_values(df: DataFrame, cols=None, by=()) -> DataFrame:
    """AGG-3: NULL count and share per column, one aggregate, unpivoted."""
    cols = cols or [c for c in df.columns if c not in by]
    a = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[(F.count(F.lit(1)) - F.count(c)).alias(f"_m{i}")
                                                             for i, c in enumerate(cols)])
    st = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"),
                                      F.col(f"_m{i}").alias("n_missing")) for i, c in enumerate(cols)])).alias("s")
    return a.select(*by, "_n", st).select(*by, "s.ord", "s.column", "s.n_missing",
                                          F.coalesce(F.try_divide(F.col("s.n_missing") * 100.0, F.col("_n")),
                                                     F.lit(0.0)).alias("pct_missing"))


#: histograms of up to so many rows are ranked in one window a measure, larger ones by radix selection
WINDOW_ROWS = 1 << 16


def with_moments(h: DataFrame, types: dict[str, str], by=(), window_rows: int | None = None) -> DataFrame:
    """The histogram rows of numeric measures with ``v`` (the value as a
    double) and, over each (by, measure), the number of values, their mean and
    the number of values up to the row. With more than ``WINDOW_ROWS`` rows
    that last number is only told where the middle of the values lies
    (``_near_middle``), and is NULL elsewhere."""
    v = F.coalesce(*[F.when(F.col(MEASURE) == c, F.col(VALUE).cast(t).cast("double")) for c, t in types.items()])
    x = h.filter(F.col(MEASURE).isin(*types)).withColumn("v", v)
    n = F.when(F.col("v").isNotNull(), F.col(COUNT)).otherwise(F.lit(0))
    limit = WINDOW_ROWS if window_rows is None else window_rows
    if h.count() > limit:
        sums = x.groupBy(*by, MEASURE).agg(F.sum(n).alias("_total"),
                                           F.try_divide(F.sum(F.col("v") * n), F.sum(n)).alias("_mean"))
        sums = materialize(sums, "histogram-sums")  # a row for each measure and group
        return _near_middle(x.join(F.broadcast(sums), [*by, MEASURE]), by, limit)
    group = Window.partitionBy(*by, MEASURE)
    up_to = group.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.select("*", F.sum(n).over(group).alias("_total"), F.sum(n).over(up_to).alias("_upto"),
                    F.try_divide(F.sum(F.col("v") * n).over(group), F.sum(n).over(group)).alias("_mean"))


def ordered_bits(v) -> Column:
    """A double as a bigint that sorts like it (NaN last; -0 and 0 alike)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)


def _near_middle(x: DataFrame, by, limit: int) -> DataFrame:
    """``x`` (v, _total, COUNT, ...) with ``_upto`` for the rows around the
    middle of each (by, measure), by radix selection: rows are counted by the
    highest 16 of their ordered bits (at most 65,536 counts a measure), the
    prefixes that hold the middle values are kept, and only their rows are
    looked at again, by the next 16 bits, until few enough are left to be
    ranked. No task sorts the values of a measure."""
    keys = [*by, MEASURE]
    rows = x.withColumn("_bits", F.when(F.col("v").isNotNull(), ordered_bits(F.col("v"))))
    places = [F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)]
    held, below, shift = rows.filter("_bits IS NOT NULL"), None, 64
    while True:
        shift -= 16
        prefix = F.shiftright("_bits", shift)
        counts = held.withColumn("_prefix", prefix).groupBy(*keys, "_prefix", "_total").agg(
            F.sum(COUNT).alias("_count"), F.count(F.lit(1)).alias("_rows"))
        if below is not None:  # counted from the last kept prefix on, beside what lies below that one
            counts = counts.withColumn("_last", F.shiftright("_prefix", 16)).join(
                F.broadcast(below.select(*keys, F.col("_prefix").alias("_last"), F.col("_below").alias("_base"))),
                [*keys, "_last"])
            start, base = Window.partitionBy(*keys, "_last"), F.col("_base")
        else:
            start, base = Window.partitionBy(*keys), F.lit(0)
        before = start.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_below", base + F.coalesce(F.sum("_count").over(before), F.lit(0)))
        inside = [(F.col("_below") <= p) & (p < F.col("_below") + F.col("_count")) for p in places]
        below = materialize(counts.filter(inside[0] | inside[1]).select(*keys, "_prefix", "_below", "_rows"),
                            "radix-prefixes")  # one or two for each measure and group
        largest = below.agg(F.max("_rows")).collect()[0][0]
        known = F.broadcast(below.select(*keys, "_prefix", "_below"))
        held = rows.filter("_bits IS NOT NULL").withColumn("_prefix", prefix).join(known, [*keys, "_prefix"])
        if shift == 0 or largest is None or largest <= limit:
            break
        held = held.drop("_prefix", "_below")
    up_to = Window.partitionBy(*keys, "_prefix").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = held.withColumn("_upto", F.col("_below") + F.sum(COUNT).over(up_to))
    rest = rows.withColumn("_prefix", F.shiftright("_bits", shift)).join(known.drop("_below"), [*keys, "_prefix"], "left_anti")
    cols = x.columns
    return middle.select(*cols, "_upto").unionByName(rest.select(*cols, F.lit(None).cast("long").alias("_upto")))


def _stat(measure: str) -> dict[str, Column]:
    """Aggregates over ``with_moments`` for one measure."""
    mine = (F.col(MEASURE) == measure) & F.col("v").isNotNull()
    n, total = F.sum(F.when(mine, F.col(COUNT))), F.col("_total")
    off = F.col("v") - F.col("_mean")

    def at(place):  # the smallest value that more than ``place`` values do not exceed
        return F.min(F.when(mine & (F.col("_upto") > place), F.col("v")))

    return {"n": F.coalesce(n, F.lit(0)).cast("long"), "mean": F.max(F.when(mine, F.col("_mean"))),
            "std": F.when(n > 1, F.sqrt(F.sum(F.when(mine, F.col(COUNT) * off * off)) / (n - 1))),
            "min": F.min(F.when(mine, F.col("v"))), "max": F.max(F.when(mine, F.col("v"))),
            "median": (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / 2}


def numeric_summary(df: DataFrame, cols=("extracted_rating", "store_avg_rating", "text_length"),
                    window_rows: int | None = None) -> DataFrame:
    """AGG-4: count, mean, sample std, min, max, exact median per measure,
    from one histogram. ``window_rows`` (None: ``WINDOW_ROWS``) bounds the
    values of a measure that one task ranks."""
    x = with_moments(histogram(df, cols), {c: _type(df, c) for c in cols}, window_rows=window_rows)
    a = x.agg(*[expr.alias(f"{name}{i}") for i, c in enumerate(cols) for name, expr in _stat(c).items()])
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), *[F.col(f"{name}{i}").alias(name) for name in _stat(c)])
                             for i, c in enumerate(cols)])).alias("s")
    return a.select(st).select("s.*")


def error_pattern_counts(df: DataFrame, patterns=PROFILE_ERROR_PATTERNS, cols=None, by=()) -> DataFrame:
    """PRED-6: rows where any column contains each pattern (case-insensitive),
    plus the total over patterns (a row may count more than once)."""
    cols = cols or [c for c in df.columns if c not in by]
    hits = [F.sum(contains_any_column(df, p, regex_ci=True, cols=cols).cast("long")).alias(f"p{i}")
            for i, p in enumerate(patterns)]
    a = df.groupBy(*by).agg(*hits)
    entries = [F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern"), F.col(f"p{i}").alias("n_rows"))
               for i, p in enumerate(patterns)]
    entries.append(F.struct(F.lit(len(patterns)).alias("ord"), F.lit("total").alias("pattern"),
                            sum((F.col(f"p{i}") for i in range(len(patterns))), F.lit(0)).alias("n_rows")))
    return a.select(*by, F.explode(F.array(*entries)).alias("s")).select(*by, "s.*")


#: what a full profile counts
PROFILE_COLS = ("ai_classification", "extracted_rating", "store_avg_rating", "text_length", "store_category")
NUMERIC = ("extracted_rating", "store_avg_rating", "text_length")


def scalars(h: DataFrame, types: dict[str, str], by=()) -> DataFrame:
    """AGG-6 scalar part from a histogram of ``PROFILE_COLS``. Distinct
    values of the text columns enter no window."""
    numbers = with_moments(h, {c: types[c] for c in NUMERIC}, by)
    x = numbers.unionByName(h.filter(~F.col(MEASURE).isin(*NUMERIC)), allowMissingColumns=True)
    r, s, t = map(_stat, NUMERIC)

    def known(col, what):  # over the non-null values of a text column
        return F.coalesce(F.sum(F.when((F.col(MEASURE) == col) & F.col(VALUE).isNotNull(), what)),
                          F.lit(0)).cast("long")

    rows = F.coalesce(F.sum(F.when(F.col(MEASURE) == "text_length", F.col(COUNT))), F.lit(0)).cast("long")
    return x.groupBy(*by).agg(
        rows.alias("rows"), known("ai_classification", F.col(COUNT)).alias("labelled_rows"),
        known("ai_classification", F.lit(1)).alias("classes"),
        r["n"].alias("rated_rows"), r["mean"].alias("rating_mean"), r["std"].alias("rating_std"),
        s["n"].alias("store_rated_rows"), s["mean"].alias("store_rating_mean"), s["std"].alias("store_rating_std"),
        t["mean"].alias("text_length_mean"), t["median"].alias("text_length_median"),
        t["min"].cast(types["text_length"]).alias("text_length_min"),
        t["max"].cast(types["text_length"]).alias("text_length_max"),
        known("store_category", F.lit(1)).alias("categories"),
        r["min"].alias("rating_min"), r["max"].alias("rating_max"), r["median"].alias("rating_median"))


def profile_scalars(df: DataFrame, by=()) -> DataFrame:
    """AGG-6 scalar part, per dataset (or per ``by`` group)."""
    return scalars(histogram(df, PROFILE_COLS, by), {c: _type(df, c) for c in PROFILE_COLS}, by)


def distributions(h: DataFrame, by: str = "split") -> DataFrame:
    """AGG-6 distribution part from a histogram."""
    section = F.element_at(F.create_map(*map(F.lit, (
        "ai_classification", "class", "extracted_rating", "rating", "store_category", "category"))), F.col(MEASURE))
    return h.select(by, section.alias("section"), F.col(VALUE).alias("value"), F.col(COUNT).alias("n")) \
            .filter("section IS NOT NULL AND value IS NOT NULL")


def profile_distributions(df: DataFrame, by: str = "split") -> DataFrame:
    """AGG-6 distribution part: class, rating and category counts per dataset
    from one histogram (a single shuffle)."""
    return distributions(histogram(df, ("ai_classification", "extracted_rating", "store_category"), [by]), by)


def class_comparison(h: DataFrame, col: str = "ai_classification", dtype: str = "string") -> DataFrame:
    """JOIN-6 from a histogram by ``split``: one group per value, both sides."""
    g = h.filter((F.col(MEASURE) == col) & F.col(VALUE).isNotNull())
    n = {side: F.sum(F.when(F.col("split") == side, F.col(COUNT)).otherwise(0)) for side in ("train", "test")}
    pct = [F.coalesce(F.try_divide(x * 100.0, g.select(x).scalar()), F.lit(0.0)).alias(f"{side}_pct")
           for side, x in n.items()]
    j = g.groupBy(F.col(VALUE).cast(dtype).alias(col)).agg(*pct)
    return j.withColumn("difference", F.col("train_pct") - F.col("test_pct")).orderBy(col)


def compare_class_distribution(train: DataFrame, test: DataFrame, col: str = "ai_classification") -> DataFrame:
    """JOIN-6 / SET-2 / SORT-1: class shares (of non-null rows) side by side,
    absent = 0, sorted by class, difference train - test."""
    return class_comparison(histogram(tagged_sides(train.select(col), test.select(col)), [col], ["split"]), col,
                            _type(train, col))


def sizes_ratings(h: DataFrame, rating: str = "extracted_rating") -> DataFrame:
    """AGG-13 from a histogram by ``split``."""
    v, x = F.col(VALUE).cast("double"), h.filter(F.col(MEASURE) == rating)
    of = {side: F.when(F.col("split") == side, F.col(COUNT)).otherwise(0) for side in ("train", "test")}
    a = x.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"{side}_rows") for side, n in of.items()],
              *[F.try_divide(F.sum(v * n), F.sum(F.when(v.isNotNull(), n))).alias(f"{side}_rating_mean")
                for side, n in of.items()])
    return a.select("train_rows", "test_rows",
                    F.try_divide(F.col("train_rows"), F.col("test_rows")).alias("train_test_ratio"),
                    "train_rating_mean", "test_rating_mean",
                    (F.col("train_rating_mean") - F.col("test_rating_mean")).alias("rating_difference"))


def compare_sizes_ratings(train: DataFrame, test: DataFrame, rating: str = "extracted_rating") -> DataFrame:
    """AGG-13: sizes, train:test ratio, mean rating each side and difference."""
    return sizes_ratings(histogram(tagged_sides(train.select(rating), test.select(rating)), [rating], ["split"]), rating)


def overlap(h: DataFrame, col: str = "store_category", dtype: str = "string") -> DataFrame:
    """SET-1 from a histogram by ``split``: each value is grouped once, then
    counted by the sides that hold it."""
    on = {side: F.max(F.col("split") == side).alias(f"_{side}") for side in ("train", "test")}
    r = h.filter(F.col(MEASURE) == col).groupBy(F.col(VALUE).cast(dtype).alias(col)).agg(*on.values())
    side = F.when(F.col("_train") & F.col("_test"), "common").when(F.col("_train"), "train_only").otherwise("test_only")
    r = r.select(col, side.alias("side"))
    counts = r.groupBy("side").agg(F.count(F.lit(1)).alias("n_categories"))
    # first five names per side: row_number() <= 5 is planned with a partial
    # WindowGroupLimit, so at most five names per side and task are shuffled
    top = (r.withColumn("_r", F.row_number().over(Window.partitionBy("side").orderBy(col)))
           .filter(F.col("_r") <= 5)
           .groupBy("side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", col))),
                                                         lambda s: s[col]), ", ").alias("first_five")))
    return counts.join(top, "side").select("side", "n_categories", "first_five")


def category_overlap(train: DataFrame, test: DataFrame, col: str = "store_category") -> DataFrame:
    """SET-1: common / train-only / test-only category counts and the first
    five names (sorted) of each side-only set."""
    return overlap(histogram(tagged_sides(train.select(col), test.select(col)), [col], ["split"]), col, _type(train, col))


def full_profile(train: DataFrame, test: DataFrame) -> dict[str, DataFrame]:
    """Every profile table of both sides: one pass for the histogram, one
    each for missing values and error patterns."""
    both = with_extracted(tagged_sides(train, test))
    types, h = {c: _type(both, c) for c in PROFILE_COLS}, histogram(both, PROFILE_COLS, ["split"])
    raw = [c for c in both.columns if c in train.columns or c in test.columns]
    raw = [c for c in raw if c != "split"]
    cat = "store_category"
    tops = {side: _ranked(shares(h.filter(F.col("split") == side), cat, types[cat]), cat, 10)
            .withColumn("split", F.lit(side)) for side in ("train", "test")}
    return {"scalars": scalars(h, types, ["split"]), "distributions": distributions(h),
            "class_comparison": class_comparison(h), "sizes_ratings": sizes_ratings(h), "category_overlap": overlap(h),
            "top_categories": tops["train"].unionByName(tops["test"]),
            "missing": missing_values(both, raw, ["split"]),
            "error_patterns": error_pattern_counts(both, cols=raw, by=["split"])}


def head_samples(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """TOPK-2: first n rows by key (TakeOrdered)."""
    return df.orderBy(key).limit(n)
