"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut after every blank line into sections and these after every line
feed into paragraphs; nothing is dropped, so the tree covers every character.
A paragraph is cut into chunks of about ``MEAN`` words at places its words
decide, so words put in front leave later chunks alone. A chunk's node is its
SHA-256, any other node that of its children's nodes. Equal roots mean equal
texts.

``compare`` walks two trees. Equal sections are paired, and only those left
over are entered; so for paragraphs, then chunks. Nodes are paired first
together with the sibling before them, then by themselves. A pair counts its
characters, half of them where the siblings before and after it are both other
ones (an only child has no order). The likeness is the Dice coefficient of these
characters: 1 for equal roots and only for those, 0 where one text alone is
empty. ``edits`` are the paragraphs left over; ``differing`` tells the places
at which two trees differ, without pairing moved ones.

Everything is DataFrame expressions. ``with_next`` finds each document's
successor by id without a global sort: ids are cut into ranges of 2^8 and a
window looks inside a range; only range edges (one row in 256 or fewer) are
looked up in the next non-empty range, found by the same step on range
numbers, level by level (8 levels for any 64-bit ids).

Defined results: a null text counts as empty; an empty text has a root of its
own; rows with a null id are their own successor; rows that repeat an id
follow each other in the order of their texts' hashes; one row alone is its
own successor; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import text_or_empty, written

SECTION, PARAGRAPH = r"(?<=\n\n)(?!\n|\z)", r"(?<=\n)(?!\z)"
WORD = r"\s*+\S{1,64}+\s*+|\s++"  # every character is in one match
MEAN, LONGEST = 8, 32  # words of a chunk
BITS = 8


def spread(found: Column, total: Column, each) -> Column:
    """``each(start, length)`` for the pieces that begin at ``found``."""
    return let(found, lambda at: F.transform(at, lambda x, j: each(x, F.coalesce(F.get(at, j + 1), total) - x)))


def chunks(paragraph: Column) -> Column:
    """array<struct<node, size>>: pieces of whole words, cut where the hash of
    two neighbouring words says so, and every ``LONGEST`` words after a cut."""
    none = F.array().cast("array<struct<node:string,size:int>>")

    def starts(w):
        def opens(i):
            return (i == 0) | ((i > 1) & (F.pmod(F.xxhash64(F.get(w, i - 2), F.get(w, i - 1)), F.lit(MEAN)) == 0))

        cuts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), opens)
        return F.flatten(spread(cuts, F.size(w), lambda at, n: F.sequence(at, at + n - 1, F.lit(LONGEST))))

    def piece(w, at, n):
        return let(F.array_join(F.slice(w, at + 1, n), ""),
                   lambda c: F.struct(F.sha2(c, 256).alias("node"), F.char_length(c).alias("size")))

    return let(F.regexp_extract_all(paragraph, F.lit(WORD), F.lit(0)), lambda w: F.when(F.size(w) == 0, none).otherwise(
        spread(starts(w), F.size(w), lambda at, n: piece(w, at, n))))


def parent(below: Column, names: tuple, *more: Column) -> Column:
    """The node over ``below``, its size and children with their ``names``."""
    size = F.aggregate(below, F.lit(0), lambda n, x: n + x["size"])
    return F.struct(F.sha2(F.array_join(F.transform(below, lambda x: x["node"]), ","), 256).alias("node"),
                    size.alias("size"), *more, linked(below, names).alias("below"))


def linked(nodes: Column, names: tuple) -> Column:
    """Siblings with the keys they are matched by: ``before`` (with the one
    before), ``itself``, ``after``; ``alone`` marks an only child."""
    def keyed(a, x, i):
        edge = F.lit("")
        before = F.when(i > 0, F.get(a, i - 1)["node"]).otherwise(edge)
        after = F.coalesce(F.get(a, i + 1)["node"], edge)
        return F.struct(F.xxhash64(before, x["node"]).alias("before"), F.xxhash64(x["node"]).alias("itself"),
                        F.xxhash64(x["node"], after, edge).alias("after"), (F.size(a) == 1).alias("alone"),
                        *(x[n].alias(n) for n in names))

    return F.transform(nodes, lambda x, i: keyed(nodes, x, i))


def tree(text: Column) -> Column:
    """The root: struct<node, size, below: sections>, down to chunks."""
    def section(s, i):
        return let(F.transform(F.split(s, PARAGRAPH), lambda p, j: let(chunks(p), lambda c: parent(
            c, ("size",), F.concat_ws(".", i.cast("string"), j.cast("string")).alias("place")))),
            lambda ps: parent(ps, ("node", "size", "place", "below")))

    return let(F.transform(F.split(text, SECTION), section), lambda s: parent(s, ("node", "size", "below")))


def sections(text: Column) -> Column:
    """array<struct<node, paragraphs: array<node>>>: the two levels below the
    root."""
    return F.transform(tree(text)["below"], lambda s: F.struct(
        s["node"].alias("node"), F.transform(s["below"], lambda p: p["node"]).alias("paragraphs")))


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: places (from 0) where two trees
    differ; a branch with equal nodes is not entered. A missing section or
    paragraph differs from any."""
    none = F.array().cast("array<string>")

    def paragraphs(x, i):
        left, right = F.coalesce(x["a"]["paragraphs"], none), F.coalesce(x["b"]["paragraphs"], none)
        both = F.transform(F.arrays_zip(left.alias("a"), right.alias("b")),
                           lambda p, j: F.when(~p["a"].eqNullSafe(p["b"]),
                                               F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.when(x["a"]["node"].eqNullSafe(x["b"]["node"]),
                      F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.filter(both, lambda p: p.isNotNull()))

    return F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), paragraphs))


def match(a: Column, b: Column, key: str) -> Column:
    """struct<score, a, b>: siblings of both sides paired by one of their
    keys, as often as both hold it, and those left over. A pair scores its
    size twice; one found by itself with another neighbour on either side
    once, unless either is an only child. Sorted runs, no comparison of all
    pairs."""
    def tagged(nodes, side):
        return F.transform(nodes, lambda x, i: F.struct(x[key].alias("key"), F.lit(side).alias("side"), i.alias("i")))

    def pair(left, right):
        beside = left["alone"] | right["alone"] | (left["before"] == right["before"]) | (left["after"] == right["after"])
        return left["size"].cast("long") * F.when(beside, 2).otherwise(1)

    def places(group, side):
        return F.transform(F.filter(group, lambda e: e["side"] == side), lambda e: e["i"])

    def split(g):
        both = F.least(F.size(g["a"]), F.size(g["b"]))
        score = F.aggregate(F.sequence(F.lit(0), both - 1), F.lit(0).cast("long"),
                            lambda s, j: s + pair(F.get(a, F.get(g["a"], j)), F.get(b, F.get(g["b"], j))))
        rest = [F.slice(g[side], both + 1, F.size(g[side])).alias(side) for side in "ab"]
        return F.struct(F.when(both > 0, score).otherwise(F.lit(0).cast("long")).alias("score"), *rest)

    def runs(m):
        opens = F.filter(F.sequence(F.lit(0), F.size(m) - 1),
                         lambda i: (i == 0) | (F.get(m, i)["key"] != F.get(m, i - 1)["key"]))
        return spread(opens, F.size(m), lambda at, n: let(F.slice(m, at + 1, n), lambda g: let(
            F.struct(places(g, 0).alias("a"), places(g, 1).alias("b")), split)))

    def paired(m):
        def single(e, i):
            return (((i == 0) | (F.get(m, F.greatest(i - 1, F.lit(0)))["key"] != e["key"]))
                    & F.coalesce(F.get(m, i + 1)["key"] != e["key"], F.lit(True)))

        # a key that stands there once meets nothing
        return let(F.filter(m, single), lambda one: let(let(F.filter(m, lambda e, i: ~single(e, i)), runs), lambda r: F.struct(
            F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + x["score"]).alias("score"),
            left_over(one, 0, r, a).alias("a"), left_over(one, 1, r, b).alias("b"))))

    def left_over(one, side, r, nodes):
        at = F.concat(places(one, side), F.flatten(F.transform(r, lambda x: x["ab"[side]])))
        return F.transform(F.array_sort(at), lambda i: F.get(nodes, i))

    meet = F.arrays_overlap(F.transform(a, lambda x: x[key]), F.transform(b, lambda x: x[key]))
    return F.when(meet, let(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), paired)).otherwise(
        F.struct(F.lit(0).cast("long").alias("score"), a.alias("a"), b.alias("b")))


def compare(df: DataFrame, pairs: str = "pairs") -> DataFrame:
    """``df`` with its column ``pairs`` (array<struct<a, b>> of ``tree``s)
    replaced by array<struct<likeness, edits>>: the walk from the roots, into
    differing branches only. ``edits`` are the places ("section.paragraph",
    from 0) of a's paragraphs that b has not. Each step of the walk is a
    projection of its own, so none is worked out twice."""
    def step(each):
        return F.transform(pairs, lambda p: let(each(p), lambda q: F.struct(
            q["score"].alias("score"), p["total"].alias("total"), q["a"].alias("a"), q["b"].alias("b"),
            (q["edits"] if each is enter_paragraphs else p["edits"]).alias("edits"))))

    def begin(p):
        same = p["a"]["node"] == p["b"]["node"]
        total = (p["a"]["size"] + p["b"]["size"]).cast("long")
        a, b = (F.when(same, F.slice(t["below"], 1, 0)).otherwise(t["below"]) for t in (p["a"], p["b"]))
        return F.struct(F.lit(0).cast("long").alias("score"), F.when(~same, total).alias("total"), a.alias("a"),
                        b.alias("b"), F.array().cast("array<string>").alias("edits"))

    def pair_by(key):
        return lambda p: let(match(p["a"], p["b"], key), lambda q: F.struct(
            (p["score"] + q["score"]).alias("score"), q["a"].alias("a"), q["b"].alias("b")))

    def below(nodes):
        return F.flatten(F.transform(nodes, lambda n: n["below"])).alias

    def enter_sections(p):
        return F.struct(p["score"].alias("score"), below(p["a"])("a"), below(p["b"])("b"))

    def enter_paragraphs(p):
        return F.struct(p["score"].alias("score"), below(p["a"])("a"), below(p["b"])("b"),
                        F.transform(p["a"], lambda n: n["place"]).alias("edits"))

    df = df.withColumn(pairs, F.transform(pairs, begin))
    pairing = (pair_by("before"), pair_by("itself"))
    for each in (*pairing, enter_sections, *pairing, enter_paragraphs, *pairing):
        df = df.withColumn(pairs, step(each))
    return df.withColumn(pairs, F.transform(pairs, lambda p: F.struct(
        F.coalesce(F.least(p["score"], p["total"] - 1) / p["total"], F.lit(1.0)).alias("likeness"),  # no total: equal roots
        p["edits"].alias("edits"))))


def successors(values: DataFrame) -> DataFrame:
    """``values``: distinct non-null bigints v. Returns (v, next): the next
    larger value, null for the largest."""
    if values.limit(2**BITS + 1).count() <= 2**BITS:  # few enough for one window
        return values.select("v", F.lead("v").over(Window.orderBy("v")).alias("next"))
    inside = Window.partitionBy(F.shiftright("v", BITS)).orderBy("v")
    values = written(values.withColumn("next", F.lead("v").over(inside)).withColumn("g", F.shiftright("v", BITS)),
                     "successors")
    groups = values.groupBy("g").agg(F.min("v").alias("least"))
    after = successors(groups.select(F.col("g").alias("v"))).withColumnsRenamed({"v": "g", "next": "h"})
    heads = groups.withColumnsRenamed({"g": "h", "least": "head"})
    edge = values.filter("next IS NULL").join(after, "g").join(heads, "h", "left").select("v", F.col("head").alias("next"))
    return values.filter("next IS NOT NULL").select("v", "next").unionByName(edge)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): each row with the text of its successor by id, the
    first row's for the last."""
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    ranges = written(docs.filter("id IS NOT NULL").select(F.shiftright("id", BITS).alias("v")).distinct(), "ranges")
    first = F.lit(ranges.agg(F.min("v")).collect()[0][0]).cast("bigint")
    order = Window.partitionBy("g").orderBy("id", "h")
    rows = (docs.filter("id IS NOT NULL").withColumn("g", F.shiftright("id", BITS)).withColumn("h", F.xxhash64("text"))
            .select("id", "text", "g", F.lead("text").over(order).alias("next")))
    after = written(successors(ranges).select(F.col("v").alias("g"), F.coalesce("next", first).alias("to")), "edges")
    # a task sends on one text of each range it reads, not all of them
    heads = (docs.filter("id IS NOT NULL").groupBy(F.shiftright("id", BITS).alias("to"))
             .agg(F.min_by("text", F.struct("id", F.xxhash64("text"))).alias("head")))
    # the rows lie by range already: merged with one text a range, not shuffled again
    edge = after.join(heads, "to").select(F.col("g").alias("edge_g"), "head").hint("merge")
    rows = (rows.join(edge, (rows["g"] == edge["edge_g"]) & rows["next"].isNull(), "left")
            .select("id", "text", F.coalesce("next", "head").alias("next")))
    alone = docs.filter("id IS NULL").withColumn("next", F.col("text"))
    return rows.unionByName(alone)


def compare_edits(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, next). The edited text is the text with its last
    quarter (floor) replaced by as many first code points of ``next``. Returns
    (id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next, edits)."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter)))
    rows = rows.select("id", "n_chars", "edited", F.transform(F.array("text", "edited", "next"), tree).alias("t"))
    rows = rows.select("id", "n_chars", "edited", F.col("t")[0]["node"].alias("fingerprint"),
                       F.col("t")[1]["node"].alias("edited_fingerprint"),
                       F.transform(F.slice("t", 2, 2), lambda x: F.struct(F.col("t")[0].alias("a"), x.alias("b"))).alias("pairs"))
    near = compare(rows)
    return near.select("id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       F.col("pairs")[0]["likeness"].alias("near_edited"), F.col("pairs")[1]["likeness"].alias("near_next"),
                       F.col("pairs")[0]["edits"].alias("edits"))
