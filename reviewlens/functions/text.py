"""Scalar text functions (FN-0..8, FN-12, FN-13, PRED-2, PROJ-6).

Every function returns a Column built from built-in expressions, so it
runs inside whole-stage codegen; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EMPTY_MARKERS, NO_CONTENT, PY_WS, UNKNOWN_CATEGORY


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (Column -> Column).

    Spark re-evaluates an expression at every place it is referenced (and
    inside lambdas once per element); binding it as the single element of
    an array and transforming that keeps it to one evaluation per row."""
    return F.element_at(F.transform(F.array(_c(value)), body), 1)


def py_strip(c) -> Column:
    """FN-0: Python ``str.strip()`` (all Unicode white space, both ends)."""
    return F.regexp_replace(_c(c), rf"(?U)^{PY_WS}+|{PY_WS}+$", "")


_EMPTY_RE = rf"(?U)^{PY_WS}*(?i:{'|'.join(m for m in EMPTY_MARKERS if m)})?{PY_WS}*$"


def is_empty_or_null(c) -> Column:
    """PRED-2: NULL, or stripped text in '', null, none, nan (any case).

    One anchored match instead of strip-then-compare: a real text fails at
    its first visible character, so long reviews are not rewritten just
    to learn they are not empty (4x cheaper on the sf0.1 documents). The
    markers are ASCII and no other character case-folds onto their
    letters, so this equals Python's ``strip().lower() in markers``."""
    c = _c(c)
    return c.isNull() | c.cast("string").rlike(_EMPTY_RE)


def _first_number(c, label: str) -> Column:
    pat = rf"(?U){label}:\s*(\d+\.?\d*)"
    raw = F.regexp_extract(_c(c), pat, 1)
    return F.when(raw != "", raw.try_cast("double"))


def extract_rating(c) -> Column:
    """FN-1: first ``Rating:\\s*(\\d+\\.?\\d*)`` as DOUBLE, else NULL."""
    return _first_number(c, "Rating")


def extract_store_rating(c) -> Column:
    """FN-3: first ``Average Rating:\\s*(\\d+\\.?\\d*)`` as DOUBLE, else NULL."""
    return _first_number(c, "Average Rating")


def extract_category(c) -> Column:
    """FN-2: first ``Category:\\s*([^|]+)``, stripped, first comma part,
    stripped; 'Unknown' for NULL or no match. ``Category: | x`` gives ''."""
    c = _c(c)
    pat = r"(?U)Category:\s*([^|]+)"
    grp = F.regexp_extract(c, pat, 1)
    first = py_strip(F.substring_index(py_strip(grp), ",", 1))
    return F.when(c.isNotNull() & c.rlike(pat), first).otherwise(F.lit(UNKNOWN_CATEGORY))


def category_list_text(c) -> Column:
    """FN-5: a JSON list of strings becomes 'a, b'; anything else stays raw."""
    c = _c(c)
    v = F.try_parse_json(c)
    joined = F.array_join(v.cast("array<string>"), ", ")
    is_str_list = F.schema_of_variant(v) == F.lit("ARRAY<STRING>")
    return F.when(c.startswith("[") & v.isNotNull() & is_str_list, joined).otherwise(c)


def response_text(c) -> Column:
    """FN-6: store reply text from a JSON/plain value; NULL when there is none.

    Object -> its ``text``; other JSON value -> its text form; not JSON ->
    the raw text; NULL, 'null' or an empty result -> NULL. The reply is
    parsed once per row (``let``)."""
    c = _c(c)

    def from_parsed(v: Column) -> Column:
        out = (F.when(v.isNull(), c)
               .when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.text", "string"))
               .otherwise(v.cast("string")))
        return let(out, lambda o: F.when(o == "", None).otherwise(o))

    return F.when(c.isNull() | (c == "null") | (c == ""), None).otherwise(let(F.try_parse_json(c), from_parsed))


def _part(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label}: "), value.cast("string")))


def compose_store_info(name, address, description, category, avg_rating,
                       num_of_reviews, state) -> Column:
    """FN-7: 'Store Name: … | Address: … | …', absent (NULL) parts omitted."""
    return F.concat_ws(
        " | ",
        _part("Store Name", _c(name)),
        _part("Address", _c(address)),
        _part("Description", _c(description)),
        _part("Category", category_list_text(_c(category))),
        _part("Average Rating", _c(avg_rating)),
        _part("Number of Reviews", _c(num_of_reviews)),
        _part("Status", _c(state)),
    )


def compose_text_info(text, reviewer, rating, resp) -> Column:
    """FN-8: 'Review: … | Reviewer: … | Rating: … | Store Response: …'."""
    text = _c(text)
    return F.concat_ws(
        " | ",
        _part("Review", F.when(text != "", text)),
        _part("Reviewer", _c(reviewer)),
        _part("Rating", _c(rating)),
        _part("Store Response", response_text(_c(resp))),
    )


def preview(c, n: int = 100) -> Column:
    """PROJ-6: first n characters, '...' appended only when longer."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def model_input_text(business, text, rating=None) -> Column:
    """FN-12: 'Business: b | Rating: r/5 | Review: t'; rating part dropped
    per row when NULL or when no rating column is given."""
    business, text = _c(business), _c(text)
    parts = [F.concat(F.lit("Business: "), F.coalesce(business.cast("string"), F.lit("")))]
    if rating is not None:
        r = _c(rating)
        parts.append(F.when(r.isNotNull(), F.concat(F.lit("Rating: "), r.cast("string"), F.lit("/5"))))
    parts.append(F.concat(F.lit("Review: "), F.coalesce(text.cast("string"), F.lit(""))))
    return F.concat_ws(" | ", *parts)


def embedding_text(c) -> Column:
    """FN-13: stripped text, empty -> 'No content'."""
    return F.coalesce(F.nullif(py_strip(_c(c).cast("string")), F.lit("")), F.lit(NO_CONTENT))
