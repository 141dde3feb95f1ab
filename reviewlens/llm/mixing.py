"""Mixing sources to target weights by subset-sum budget fitting.

1. Documents are counted by (source, exact length in words).
2. Source totals give targets: sources in code-point order (null last) weigh
   1, 2, 3, repeating, and share the sum of all sizes; no target exceeds
   ``most`` times its source, the excess is shared again by weight.
3. A source takes whole passes over its documents while they fit; what is
   left of the budget is fitted on the length counts: first the same share of
   every length, so that a few of the longest documents are open, then a
   bounded-knapsack dynamic programme (bit sets) finds the lengths that fill
   the rest. No length is left out. The fit is exact wherever the open words
   allow it; if they do not, four times as many are opened, up to the whole
   budget or ``WORK`` machine words of bit operations. Its memory is about 4
   bytes for each open word: ``SPAN`` + 1 longest documents at first.
4. How many documents of each length get one more copy is thereby fixed;
   which ones, the seeded hash of the id decides: lengths are cut into up to
   ``SPLITS`` hash ranges, whole ranges are taken, and only rows of the range
   on the border are ranked. No task holds all documents of a source or
   length, and reruns agree.

A source's plan sees its distinct lengths only (d lengths need d * d / 2 words
or more, so they grow with the square root at most); the driver sees three
sums a round. The table of sources, one short row each, is numbered in one
sort.

Null or empty texts have size 0 and are never taken in a rest; with whole
passes they count as copies of nothing. A very long text is a document as any
other. Null sources are one source. Rows that repeat an id are documents of
their own, told apart by their texts' hashes; rows without an id are spread by
those. Rows that agree in id, text and source are interchangeable. An empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WORD_RE = r"[^\x20\x09-\x0D]+"
SPLITS, SPAN, WORK = 4096, 4, 2**27


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          seed: int = 42, row_col: str | None = None) -> DataFrame:
    """(id, key, size, hash, text_hash, split), and row if ``row_col`` is
    given: the slim rows the mix works on. ``key`` is the source as a non-null
    string."""
    text_hash = F.xxhash64(F.lit(seed), text_or_empty(text_col))
    hash_ = F.when(F.col(id_col).isNull(), text_hash).otherwise(F.xxhash64(F.lit(seed), F.col(id_col)))
    row = [F.col(row_col).alias("row")] if row_col else []
    source = F.col(source_col).cast("string")
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
                     F.regexp_count(text_or_empty(text_col), F.lit(WORD_RE)).cast("long").alias("size"),
                     hash_.alias("hash"), text_hash.alias("text_hash"),
                     F.pmod(hash_, F.lit(SPLITS)).cast("int").alias("split"), *row)


def targets(totals: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """``totals`` (key, source_size). Adds target: shares by weight, none
    above ``most`` times its source."""
    order = Window.orderBy(F.col("key") == "n", "key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = written(totals.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", weight).drop("rank"),
                   "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total, capped, level = rows.agg(F.sum("source_size")).collect()[0][0] or 0, -1, 0.0
    while True:  # the level only rises, so each source is capped at most once
        full = F.lit(level) * F.col("w") >= cap if level else F.lit(False)
        r = rows.agg(F.sum(full.cast("int")).alias("n"), F.sum(F.when(full, cap)).alias("full"),
                     F.sum(F.when(~full, F.col("w"))).alias("w")).collect()[0]
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (total - (r["full"] or 0.0)) / r["w"]
    return rows.withColumn("target", F.least(F.lit(float(level)) * F.col("w"), cap)).drop("w")


def reach_rest(lengths: list[int], left: list[int], rest: int, order: list[int], work: int | None = None):
    """Bounded knapsack: how many of ``left[i]`` documents of ``lengths[i]``
    words come nearest to ``rest`` words, from below or above, each length at
    most ``left[i]`` times. None if that would take more than ``work`` bit
    operations (in machine words).

    ``reach`` has bit s set when s words can be made of the steps so far, and
    ``first`` remembers which step made it, so a sum is undone step by step.
    """
    import numpy as np

    unit = math.gcd(*(lengths[i] for i in order if left[i])) if any(left[i] for i in order) else 0
    if not unit:
        return [0] * len(lengths)
    below = rest // unit * unit
    goal = below if 2 * (rest - below) <= unit else below + unit  # no sum of these lengths is nearer
    top = goal + max(lengths[i] for i in order if left[i])
    steps = []
    for i in order:
        n, chunk = min(left[i], top // lengths[i]), 1
        while n > 0:
            steps.append((i, min(chunk, n)))
            n, chunk = n - min(chunk, n), chunk * 2
    if work is not None and len(steps) * (top // unit // 64 + 1) > work:
        return None
    bits = top // unit + 1
    mask, reach, first = (1 << bits) - 1, 1, np.zeros(bits, np.int32)
    for k, (i, c) in enumerate(steps):
        new = (reach << c * lengths[i] // unit) & mask
        new = (new | reach) ^ reach
        if new:
            raw = np.frombuffer(new.to_bytes(bits // 8 + 1, "little"), np.uint8)
            first[np.flatnonzero(np.unpackbits(raw, bitorder="little"))] = k
            reach |= new
        if reach >> goal // unit & 1:
            break
    under = (reach & ((1 << rest // unit + 1) - 1)).bit_length() - 1
    above = reach >> rest // unit + 1
    at = under
    if above:
        over = rest // unit + (above & -above).bit_length()
        at = over if over * unit - rest < rest - under * unit else under
    take = [0] * len(lengths)
    while at:
        i, c = steps[first[at]]
        take[i], at = take[i] + c, at - c * lengths[i] // unit
    return take


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of ``counts[i]`` documents of ``lengths[i]`` words to take so
    that the words come as near to ``budget`` as the method finds.

    The same share of every length is taken first. Documents are then given
    back, or taken from the largest down, until about ``SPAN`` times the
    longest document is open (all of a smaller budget), and the programme
    fills that. If it misses, it runs again with four times as much open,
    until it hits, the whole budget is open, or ``WORK`` is spent.
    """
    total = sum(a * n for a, n in zip(lengths, counts))
    if budget <= 0 or total <= 0:
        return [0] * len(lengths)
    down = sorted((i for i, a in enumerate(lengths) if a > 0 and counts[i] > 0), key=lambda i: -lengths[i])
    best, miss, span = None, None, SPAN * lengths[down[0]]
    while True:
        take = [n * budget // total if a > 0 else 0 for a, n in zip(lengths, counts)]
        rest = budget - sum(a * t for a, t in zip(lengths, take))
        if rest < span:  # give back the same share of every length, at least one document of each in turn
            part = span - rest
            for i in down:
                back = min(take[i], -(-take[i] * part // max(1, budget)) or 1)
                take[i], rest = take[i] - back, rest + back * lengths[i]
                if rest >= span:
                    break
        for i in down:
            if rest < span + lengths[i]:
                continue
            more = min(counts[i] - take[i], (rest - span) // lengths[i])
            take[i], rest = take[i] + more, rest - more * lengths[i]
        added = reach_rest(lengths, [n - t for n, t in zip(counts, take)], rest, down[::-1],
                           None if best is None else WORK)
        if added is None:
            return best
        found = [t + x for t, x in zip(take, added)]
        off = abs(budget - sum(a * t for a, t in zip(lengths, found)))
        if best is None or off < miss:
            best, miss = found, off
        if miss == 0 or rest >= budget:
            return best
        span *= 4


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=(1, 2, 3), most: float = 3.0, seed: int = 42, row_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row: the mix
    holds the document ``copies`` times, ``taken`` words in all. ``row_col``
    names a column that is returned as ``row``, to join the decisions by."""
    rows = written(sizes(df, id_col, text_col, source_col, seed, row_col), "sizes")
    ranges = written(rows.groupBy("key", "size", "split").agg(F.count(F.lit(1)).alias("n")), "ranges")
    lengths = written(ranges.groupBy("key", "size").agg(F.sum("n").alias("n")), "lengths")
    goal = targets(lengths.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    size = F.greatest(F.col("source_size"), F.lit(1))
    budget = F.round("target").cast("long")
    goal = written(goal.withColumn("base", F.least(F.floor(budget / size), F.lit(int(most))))
                   .withColumn("rest", budget - F.col("base") * F.col("source_size")), "targets")

    def plan(part):
        part = part.sort_values("size")
        part["take"] = fit_lengths(part["size"].tolist(), part["n"].tolist(), int(part["rest"].iloc[0]))
        return part[["key", "size", "take", "base", "source_size", "target"]]

    plans = written(lengths.join(goal, "key").groupBy("key").applyInPandas(
        plan, "key string, size bigint, take bigint, base bigint, source_size bigint, target double"), "plans")
    before = F.sum("n").over(Window.partitionBy("key", "size").orderBy("split")
                             .rowsBetween(Window.unboundedPreceding, -1))  # over at most SPLITS rows
    spans = ranges.withColumn("before", F.coalesce(before, F.lit(0))).join(plans, ["key", "size"])
    rank = F.row_number().over(Window.partitionBy("key", "size", "split").orderBy("hash", "id", "text_hash"))
    copies = F.col("base") + (F.col("before") + rank <= F.col("take")).cast("long")
    return (rows.join(spans, ["key", "size", "split"]).withColumn("copies", copies)
            .select("id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
                    *(["row"] if row_col else [])))
