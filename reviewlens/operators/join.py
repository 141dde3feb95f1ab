"""Skew-safe equi-join helper.

A single store (join key) may hold a third of all reviews, so a plain
shuffle join would put a third of the data in one task. Strategy:

1. the dimension side is broadcast only after its size was measured
   (a column-pruned row count, then, only if that is under its bound, a
   byte count; both partial aggregations, no data moved to one task) and
   found under both bounds;
2. otherwise hot keys are found with a pre-aggregated key count of the
   big side (``groupBy(key).count()``: map-side combine, one row per key
   crosses the network). Keys with at least ``hot_rows`` rows get
   ``ceil(rows / hot_rows)`` salts: their big-side rows are spread over
   that many tasks by a hash of the row, and only *their* small-side rows
   are repeated once per salt. Cold keys join unsalted. The hot-key table
   has at most rows/hot_rows entries (a proven bound), so it is broadcast.
   AQE skew-join splitting stays on as a backstop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 * 1024 * 1024
DEFAULT_HOT_ROWS = 1_000_000


def size_estimate(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of ``df`` in one distributed aggregate:
    strings/binaries by their byte length, nested values by that of their
    JSON text, other columns at 8 bytes."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            parts.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("long"))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):  # nested values by their JSON text
            json = F.to_json(F.struct(F.col(f.name)))
            parts.append(F.coalesce(F.octet_length(json), F.lit(0)).cast("long"))
        else:
            parts.append(F.lit(8).cast("long"))
    width = parts[0] if len(parts) == 1 else sum(parts[1:], parts[0])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).collect()[0]
    return int(r["n"]), int(r["b"])


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes.
    Rows are counted first (column-pruned, cheap even for a big side); the
    byte pass only runs when the row count is already under its bound."""
    if df.count() > max_rows:
        return False
    n, b = size_estimate(df)
    return n <= max_rows and b <= max_bytes


def hot_keys(big: DataFrame, on: list[str], hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """Keys holding at least ``hot_rows`` rows, with their salt count."""
    return (big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") >= hot_rows)
            .select(*on, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts")))


def skew_safe_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                   salt_from: list[str] | None = None, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, hot_rows: int = DEFAULT_HOT_ROWS,
                   materialize_big: bool = False) -> DataFrame:
    """Join ``big`` (fact) with ``small`` (dimension) on equal ``on`` keys.
    Every row of ``big`` meets every matching row of ``small`` exactly once
    (salting changes where pairs are formed, never which).

    The salted path reads ``big`` twice (key count, then the join). When
    ``big`` is expensive to recompute (e.g. top-k hits), ``materialize_big``
    writes it once to the shared checkpoint folder first. A stream joins a
    small side that fits; with a larger one it is refused: join each micro
    batch instead (``foreachBatch``), which salts like any batch."""
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type for skew_safe_join: {how}")
    from ..session import materialize, stable  # both sides are read more than once below
    small = stable(small, "join-small")
    if fits_broadcast(small, max_broadcast_rows, max_broadcast_bytes):
        return big.join(F.broadcast(small), on, how)
    if big.isStreaming:  # keys of an unbounded input cannot be counted
        raise ValueError("the static side is too large to broadcast; join each micro batch in foreachBatch")
    big = materialize(big, "join-big") if materialize_big else stable(big, "join-big")
    hot = F.broadcast(hot_keys(big, on, hot_rows))
    cols = salt_from or big.columns
    row_hash = F.xxhash64(*[F.col(c) for c in cols])
    no_key = F.lit(False)
    for c in on:  # a NULL key never matches, so its rows may go anywhere
        no_key = no_key | F.col(c).isNull()
    b = big.join(hot, on, "left").withColumn(
        "_salt", F.when(no_key, F.pmod(row_hash, F.lit(1 << 20)).cast("int"))
                  .when(F.col("_salts").isNull(), F.lit(0))
                  .otherwise(F.pmod(row_hash, F.col("_salts")).cast("int")))
    s = small.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
    return b.drop("_salts").join(s.drop("_salts"), on + ["_salt"], how).drop("_salt")
