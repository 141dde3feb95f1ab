"""Source divergence audit with a frequent-pattern tree.

For every language, how far the word use of each of its sources lies from
that of each other source (part ``pair``), and which words set a source apart
from its language (part ``term``).

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A
language keeps the V terms found in at least ``min_docs`` of its documents.
``p = 1 + floor(SCALE * (count + 1) / (N + V))`` is a group's share of a term,
and ``f = floor((p - q)^2 / q)`` its distance from a share q. All numbers are
integers.

1. Each task counts the terms of its documents by (lang, source), and in how
   many documents each is; the counts are summed in one shuffle, so neither a
   hot source nor a frequent word is one task's work.
2. A kept term's *row* is its list of nonzero counts, ordered by source. Equal
   rows of a language are one row with a multiplicity.
3. The rows, range-partitioned and sorted, are inserted into a
   frequent-pattern tree (one node for each shared beginning of rows). Sorted
   rows need only the path from the root to the present node in memory: a node
   is complete once a row leaves it. On leaving, it corrects the sums of the
   pairs that it forms with each ancestor, once for the node and all the terms
   below it.
4. The value of a pair is V * f(no count, no count), plus what each nonzero
   count of either source changes alone, plus the tree's corrections where
   both are nonzero.

Work of step 3 is one correction for each node and ancestor. A task holds one
path (at most one entry for each source of the language) and a bounded list of
unsent corrections. The sums stay below 2^63 for up to 10^9 kept terms, and
are added up as DECIMAL(38) between tasks.

Null text, lang or source counts as ''. A group without any term has counts 0;
a language without kept terms has pair values 0 and no ``term`` rows. Two rows
of one id count as two documents. Texts of any length are counted whole. Equal
values rank by item in UTF-8 order. An empty table gives no rows; columns other
than text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.join import skew_safe_join
from .common import text_or_empty, written

SCALE = 1_000_000_000
HELD_TERMS = 1 << 19     # counts a task holds before it sends them on
HELD_PAIRS = 1 << 21     # corrections a task holds before it adds them up
PATH_ITEM = "struct<source:string,n:bigint,p:bigint,p0:bigint>"


def term_counts(docs: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter, defaultdict

        find = re.compile(rb"[A-Za-z\x80-\xff]+").findall  # the bytes of ASCII letters and of all other characters
        groups: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def out():
            for (lang, source), (times, within) in groups.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), len(times)), pa.repeat(pa.scalar(source), len(times)),
                     pa.array(times.keys(), pa.binary()).cast(pa.string()), pa.array(times.values(), pa.int64()),
                     pa.array(map(within.__getitem__, times), pa.int64())], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = find(text.lower())  # bytes.lower() changes A-Z only
                times, within = groups[lang, source]
                size -= len(times)
                times.update(found)
                within.update(set(found))
                size += len(times)
                if size > held:
                    yield from out()
                    size = 0
        yield from out()

    cols = [text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"),
            text_or_empty("text").cast("binary").alias("t")]
    part = docs.select(*cols).mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, v: Column) -> Column:
    """p of a count n; NULL where there is no kept term."""
    big = F.lit(SCALE).cast("decimal(38,0)") * (n + 1)
    return F.lit(1).cast("bigint") + F.call_function("div", big, F.nullif((total + v).cast("decimal(38,0)"), F.lit(0)))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def close_nodes(p, p0, mult, k: int):
    """The pairs that the nodes k, k+1, ... of a path form with their
    ancestors, as arrays (node, ancestor, value as node's group, value as
    ancestor's group): what both counts together change beside what each
    changes alone, times the node's terms."""
    import numpy as np

    def f(x, y):
        return (x - y) ** 2 // y

    size = len(p)
    step = max(1, (1 << 20) // max(size, 1))
    for lo in range(max(k, 1), size, step):
        hi = min(size, lo + step)
        node, up = np.nonzero(np.arange(hi - 1)[None, :] < np.arange(lo, hi)[:, None])
        node += lo
        a, a0, b, b0 = p[node], p0[node], p[up], p0[up]
        m = mult[node]
        yield (node, up, m * (f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)),
               m * (f(b, a) - f(b, a0) - f(b0, a) + f(b0, a0)))


def tree_corrections(paths: DataFrame, held: int = HELD_PAIRS) -> DataFrame:
    """``paths``: (lang, items, mult), distinct, sorted within partitions.
    Returns (lang, source, item, value): partial sums of the corrections."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names: dict = {}          # source -> number, of the present language
        lang = None
        src = n = p = p0 = mult = np.zeros(0, np.int64)
        store: list = []
        size = 0

        def leave(k):
            nonlocal size
            for node, up, own, other in close_nodes(p, p0, mult, k):
                a, b = src[node], src[up]
                store.append((np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([own, other])))
                size += 2 * len(node)

        def merge():
            nonlocal size
            a, b, v = (np.concatenate(x) for x in zip(*store))
            pair = a * len(names) + b
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            store[:] = [(pair[at] // len(names), pair[at] % len(names), np.add.reduceat(v[order], at))]
            size = len(at)

        def out():
            nonlocal size
            if size:
                merge()
                a, b, v = store.pop()
                told = pa.array(list(names), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(a), pa.string()), told.take(pa.array(a)), told.take(pa.array(b)),
                     pa.array(v)], ["lang", "source", "item", "value"])
            store.clear()
            size = 0

        for batch in batches:
            items = batch.column(1)
            ends = items.offsets.to_numpy()
            flat = items.values
            f_src, f_n, f_p, f_p0 = (flat.field(x) for x in ("source", "n", "p", "p0"))
            f_src, f_n = f_src.to_pylist(), f_n.to_numpy()
            f_p, f_p0 = f_p.to_numpy(), f_p0.to_numpy()
            for i, (row_lang, m) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if row_lang != lang:
                    leave(0)
                    yield from out()
                    lang, names = row_lang, {}
                    src = n = p = p0 = mult = np.zeros(0, np.int64)
                lo, hi = int(ends[i]), int(ends[i + 1])
                new = np.array([names.setdefault(s, len(names)) for s in f_src[lo:hi]], np.int64)
                both = min(len(src), len(new))
                differ = np.flatnonzero((src[:both] != new[:both]) | (n[:both] != f_n[lo:lo + both]))
                k = int(differ[0]) if len(differ) else both
                leave(k)
                mult = np.concatenate([mult[:k], np.zeros(len(new) - k, np.int64)]) + m
                src, n, p, p0 = new, f_n[lo:hi], f_p[lo:hi], f_p0[lo:hi]
                if size > held:
                    merge()
                    if size > held // 2:  # too many pairs of sources to hold
                        yield from out()
        leave(0)
        yield from out()

    return paths.mapInArrow(walk, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group."""
    groups = written(docs.groupBy(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"))
                     .agg(F.count(F.lit(1)).alias("rows")), "divergence-groups")
    counts = written(term_counts(docs), "divergence-counts")
    terms = counts.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"),
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("items")).filter(F.col("docs") >= min_docs)
    terms = written(terms.select("lang", "term", "total", "items"), "divergence-terms")  # a term's sources are its list

    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("v"))
    known = terms.select("lang", F.explode("items").alias("i")).select("lang", "i.source", "i.n") \
        .groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = (groups.join(known, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"),
                      F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.coalesce("v", F.lit(0)).alias("v")))
    groups = written(groups.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("group_n"), F.col("v"))),
                     "divergence-shares")

    cells = skew_safe_join(terms.select("lang", "term", "total", F.explode("items").alias("i"))
                           .select("lang", "term", "total", "i.source", "i.n"), groups, ["lang", "source"],
                           salt_from=["term"])
    cells = written(cells.withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))
                    .withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v")))
                    .select("lang", "term", "source", "n", "p", "p0", "q"), "divergence-cells")

    # pairs: no counts, one count, both counts
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("i0"))
    none = (groups.join(other, "lang").filter(F.col("source") != F.col("item"))
            .select("lang", "source", "item", (F.col("v").cast("decimal(38,0)") * F.coalesce(
                distance(F.col("p0"), F.col("i0")), F.lit(0).cast("bigint"))).alias("value")))
    often = cells.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    d = {k: F.col(k) for k in ("p", "p0", "i0")}
    single = (skew_safe_join(often, other, ["lang"], salt_from=["source", "p"])
              .filter(F.col("source") != F.col("item"))
              .select("lang", F.explode(F.array(
                  F.struct("source", "item", (F.col("m").cast("decimal(38,0)") * (
                      distance(d["p"], d["i0"]) - distance(d["p0"], d["i0"]))).alias("value")),
                  F.struct(F.col("item").alias("source"), F.col("source").alias("item"),
                           (F.col("m").cast("decimal(38,0)") * (
                               distance(d["i0"], d["p"]) - distance(d["i0"], d["p0"]))).alias("value")))).alias("s"))
              .select("lang", "s.*"))
    rows = (cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("items"))
            .groupBy("lang", "items").agg(F.count(F.lit(1)).alias("mult")))
    sorted_rows = rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")
    both = tree_corrections(sorted_rows)
    parts = [x.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
             for x in (none, single, both)]
    pairs = (parts[0].unionByName(parts[1]).unionByName(parts[2])
             .groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))
             .withColumn("part", F.lit("pair")))

    apart = (cells.filter(F.col("p") > F.col("q"))
             .select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
             .withColumn("part", F.lit("term")))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(w)) for x in (pairs, apart)]
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return ranked[0].select(cols).unionByName(ranked[1].filter(F.col("rank") <= top_terms).select(cols))

