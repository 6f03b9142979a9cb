"""Pairs of rows that share a group key, with hot groups split into tiles.

Both similarity measures sum over pairs of rows inside a group: events inside
one consumption block, users sharing one item pair.  A plain equi self-join
sends a whole group to one task, so one hot group (a bot user, a blockbuster
item pair) would serialise the job.  Groups larger than ``tile_rows`` are cut
into ``t = ceil(size / tile_rows)`` tiles by a hash of the row identity; tile
``a`` of the left side meets tile ``b`` of the right side for every ``(a, b)``,
so the group's pairs spread over ``t * t`` join keys while each row is
replicated only ``t`` times.  Ordinary groups get ``t = 1`` (no replication).
One join key yields at most ``tile_rows ** 2`` pairs, about 17 million, whatever
the size of its group; join keys are spread by hash, and AQE may split further.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrec.session import cut

DEFAULT_TILE_ROWS = 4096


def pairs_within_groups(df: DataFrame, group_cols: Sequence[str], cols: Sequence[str],
                        identity: Sequence[str],
                        condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None,
                        tile_rows: int = DEFAULT_TILE_ROWS, materialize: bool = True,
                        size_col: str | None = None) -> DataFrame:
    """Ordered pairs ``(a, b)`` of rows of ``df`` with equal ``group_cols``.

    Returns ``group_cols`` plus ``a_<c>`` / ``b_<c>`` for every ``c`` in
    ``cols``.  ``identity`` columns make a row unique inside its group (used
    for tiling).  ``condition(a, b)`` receives accessors for the two sides and
    is applied as part of the join.
    """
    g = list(group_cols)
    if materialize:
        # both join sides (and the sizing pass) read the upstream once
        keep = [*g, *cols, *identity, *([size_col] if size_col else [])]
        df = cut(df.select(*dict.fromkeys(keep)), "pairs-input")
    if size_col is not None:
        # group sizes already known per row: tile inline, no extra pass
        tagged = df.withColumn("_t", F.greatest(F.lit(1), F.ceil(F.col(size_col) / F.lit(tile_rows))).cast("int"))
    else:
        sizes = df.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
        hot = (sizes.where(F.col("_n") > F.lit(tile_rows))
               .select(*g, F.ceil(F.col("_n") / F.lit(tile_rows)).cast("int").alias("_t")))
        tagged = df.join(hot, g, "left").withColumn("_t", F.coalesce(F.col("_t"), F.lit(1)))
    tagged = tagged.withColumn("_tile", F.pmod(F.xxhash64(*identity), F.col("_t")).cast("int"))
    spread = F.explode(F.sequence(F.lit(0), F.col("_t") - 1))
    left = tagged.select(*g, F.col("_tile").alias("_lt"), spread.alias("_rt"),
                         *[F.col(c).alias(f"a_{c}") for c in cols]).alias("_L")
    right = tagged.select(*g, spread.alias("_lt"), F.col("_tile").alias("_rt"),
                          *[F.col(c).alias(f"b_{c}") for c in cols]).alias("_R")
    keys = [*g, "_lt", "_rt"]
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"_L.{k}") == F.col(f"_R.{k}"))
    if condition is not None:
        cond = cond & condition(lambda c: F.col(f"_L.a_{c}"), lambda c: F.col(f"_R.b_{c}"))
    # Both sides are the whole input: a sort-merge join (spills, never broadcasts a
    # data-sized table, and AQE may split its partitions).
    joined = left.hint("merge").join(right, cond, "inner")
    return joined.select(*[F.col(f"_L.{k}").alias(k) for k in g],
                         *[F.col(f"_L.a_{c}").alias(f"a_{c}") for c in cols],
                         *[F.col(f"_R.b_{c}").alias(f"b_{c}") for c in cols])
