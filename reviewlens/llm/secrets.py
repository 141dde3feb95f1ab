"""Secret scans with corpus-wide ownership frequency.

Base spans are the matches of three fixed patterns. Beside them, every
credential-like token (``CANDIDATE``) is hashed and its hash counted over the
whole corpus by distinct owners and by distinct repositories of an owner. A
hash that more than ``max_owners`` owners hold is a widely copied example; any
other is specific to its owner, in however many repositories, and adds a span
of kind ``live`` at each of its places. Where no column names the repository
it is the content, so copies of a text are one; ``max_repos`` can bound them.

Only hashes and offsets leave the text pass, never a secret. Counts are summed
hash by hash in three grouped steps (repository, owner, hash), each combined
before its shuffle, so a token found in a third of all files is one row of
each task. Its occurrences meet the counts through ``lookup``.

Everything is DataFrame expressions. Offsets are code points, end exclusive.
Defined results: a null or empty text has no spans; a null owner or repository
is one owner or repository of its own; repeated rows are scanned each, and
count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import lookup, running, text_or_empty, written

#: kind, pattern, group that holds the value, its least length (fixed values)
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # finds the runs of [0-9a-f]+ that are long enough
)
KINDS = (*(b[0] for b in BASE), "live")
#: 16 or more token characters with a digit and a letter among them
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}"
SPANS = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping
    matches: the pieces between them give the offsets."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v")] if group else []

    def spans(found):
        ends = running(F.transform(found, lambda m: F.char_length(m["p"]) + F.char_length(m["w"])))
        return let(ends, lambda end: F.transform(found, lambda m, i: F.struct(
            (end[i] - F.char_length(m["w"])).alias("start"), end[i].alias("end"), m["v" if group else "w"].alias("value"))))

    zipped = let(whole, lambda w: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(w)).alias("p"), w.alias("w"), *value))
    return F.when(text.rlike(pattern), let(zipped, spans)).otherwise(F.array().cast(FOUND))


def base_spans(text: Column, kind: int) -> Column:
    """The matches of one base kind that are long enough, as spans."""
    _, pattern, group, least = BASE[kind]
    found = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"),
                                                 m["end"].alias("end")))


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def scan(df: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None) -> DataFrame:
    """One pass over the texts: (row, id, owner, repo, base, candidates)."""
    text = text_or_empty(text_col)
    repo = F.xxhash64(text) if repo_col is None else F.col(repo_col)
    base = [base_spans(text, kind) for kind in range(len(BASE))]
    tokens = F.transform(matches(text, CANDIDATE), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.substring(F.sha2(m["value"], 256), 1, 32).alias("hash")))
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                     F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repo"),
                     F.array_sort(F.concat(*base)).alias("base"), tokens.alias("candidates"))


def ownership(tokens: DataFrame) -> DataFrame:
    """``tokens`` (hash, owner, repo): (hash, owners, repos, n)."""
    by_repo = tokens.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"),
                                        F.sum("n").alias("n"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repo_col: str | None = None, max_owners: int = 1, max_repos: int | None = None) -> DataFrame:
    """(id, base, spans) of every row: arrays of struct(start, kind, end),
    sorted; ``kind`` indexes ``KINDS``."""
    rows = written(scan(df, id_col, text_col, owner_col, repo_col), "secrets")
    tokens = written(rows.select("row", "owner", "repo", F.explode("candidates").alias("c"))
                     .select("row", "owner", "repo", "c.*"), "tokens")
    counts = written(ownership(tokens), "ownership")
    live = lookup(tokens, counts, "hash", "n", tokens.count()).filter(
        (F.col("owners") <= max_owners) & (F.lit(True) if max_repos is None else F.col("repos") <= max_repos))
    span = F.struct("start", F.lit(len(BASE)).alias("kind"), "end")
    more = live.groupBy("row").agg(F.collect_list(span).alias("live"))  # no more than a text's own tokens
    return rows.join(more, "row", "left").select(
        "id", "base", F.array_sort(F.concat("base", F.coalesce("live", F.array().cast(SPANS)))).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
