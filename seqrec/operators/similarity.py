"""Item-item and user-user similarities derived from consumption order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.operators.blocks import consumption_blocks
from seqrec.operators.knn import count_changes, products, top_k_users
from seqrec.operators.pairs import DEFAULT_TILE_ROWS, pairs_within_groups

SCORE_DIGITS = 6


def block_pair_scores(blocks: DataFrame, tile_rows: int = DEFAULT_TILE_ROWS,
                      digits: int | None = SCORE_DIGITS) -> DataFrame:
    """Directed item-item scores from closed blocks.

    For every two events of one block with different items at block places
    ``d`` apart, the earlier item gains ``2 * (1 + 1/d)`` towards the later
    one; equal timestamps give ``1 + 1/d`` in both directions.  Places are
    first places of equal ``(item, ts)`` elements.  Returns
    ``(src_item, dst_item, score)`` with the score rounded to 6 digits.
    """
    sized = "block_size" in blocks.columns
    elems = blocks.select("user_id", "block_id", "n", "idx", "item_id", "ts", *(["block_size"] if sized else []))
    pairs = pairs_within_groups(
        elems, ["user_id", "block_id"], ["idx", "item_id", "ts"], identity=["user_id", "block_id", "n"],
        condition=lambda a, b: (a("ts") <= b("ts")) & (a("item_id") != b("item_id")),
        tile_rows=tile_rows, size_col="block_size" if sized else None)
    d = F.abs(F.col("a_idx") - F.col("b_idx")).cast("double")
    weight = F.when(F.col("a_ts") < F.col("b_ts"), F.lit(2.0)).otherwise(F.lit(1.0)) * (F.lit(1.0) + F.lit(1.0) / d)
    total = F.sum(weight)
    return (pairs.groupBy(F.col("a_item_id").alias("src_item"), F.col("b_item_id").alias("dst_item"))
            .agg((F.round(total, digits) if digits is not None else total).alias("score")))


def block_item_similarity(train: DataFrame, gap, flush_open: bool = False,
                          tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Blocks (``gap`` in ``ts`` units) then directed pair scores."""
    blocks = consumption_blocks(train, gap, flush_open=flush_open)
    return block_pair_scores(blocks, tile_rows)


# ---------------------------------------------------------------- user-user


def first_occurrences(events: DataFrame) -> DataFrame:
    """``(user_id, item_id, first_pos[, first_ord])`` from events carrying ``pos``
    (and optionally the global replay ordinal ``ord``)."""
    aggs = [F.min("pos").alias("first_pos")]
    if "ord" in events.columns:
        aggs.append(F.min("ord").alias("first_ord"))
    return events.groupBy("user_id", "item_id").agg(*aggs)


def pairs_ahead(first: DataFrame, delta: int, cols: Sequence[str]) -> DataFrame:
    """``(user_id, a_<c>, b_<c>)`` for every two rows of a user with ``b`` 1 to ``delta - 1`` places (``first_pos``) after ``a``.

    Places are cut into tiles of ``delta - 1``; a row looks into its own tile and the next, so it is sent three times whatever
    ``delta`` is, and a join key ``(user_id, tile)`` holds a bounded stretch of one history.  A sort-merge join: the size that
    Spark expects of a side does not count the copies, and a side of a small table would be broadcast through the driver.
    """
    tile = F.floor(F.col("first_pos") / F.lit(delta - 1)).cast("bigint")
    a = first.select("user_id", F.col("first_pos").alias("_at"), F.explode(F.array(tile, tile + 1)).alias("_tile"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = first.select("user_id", F.col("first_pos").alias("_to"), tile.alias("_tile"), *[F.col(c).alias(f"b_{c}") for c in cols])
    met = a.hint("merge").join(b, ["user_id", "_tile"]).where((F.col("_to") > F.col("_at")) & (F.col("_to") - F.col("_at") < delta))
    return met.select("user_id", *[f"a_{c}" for c in cols], *[f"b_{c}" for c in cols])


def sequence_triples(first: DataFrame, delta: int, string_larger: bool = False) -> DataFrame:
    """Item pairs that sit less than ``delta`` places apart in a user's profile.

    Places are first occurrences.  Instead of a per-user self-join (quadratic
    in the profile length), every item looks ahead ``delta - 1`` places inside
    tiles of the profile (``pairs_ahead``): the work is linear in profile length
    times ``delta`` and no user key is ever hot in the join.  Returns
    ``(user_id, item_i, item_j[, born])`` with ``item_i < item_j``; ``born`` is the replay ordinal at which the later of
    the two items first arrived.
    """
    if delta < 2:
        cols = [F.lit(None).cast("bigint").alias(c) for c in ("user_id", "item_i", "item_j")]
        return first.sparkSession.range(0).select(*cols)
    has_ord = "first_ord" in first.columns
    j = pairs_ahead(first, delta, ["item_id", *(["first_ord"] if has_ord else [])])
    out = [F.col("user_id"), F.least("a_item_id", "b_item_id").alias("item_i"),
           F.greatest("a_item_id", "b_item_id").alias("item_j")]
    if has_ord:
        out.append(F.greatest("a_first_ord", "b_first_ord").alias("born"))
        if string_larger:
            # first arrival of the item that is larger as a string (compat refresh rule)
            larger_a = F.col("a_item_id").cast("string") > F.col("b_item_id").cast("string")
            out.append(F.when(larger_a, F.col("a_first_ord")).otherwise(F.col("b_first_ord")).alias("jarr"))
    return j.select(*out)


def pair_contributions(triples: DataFrame, tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """One row per (user pair, shared item pair): ``(user_a, user_b[, born])``, ``user_a < user_b``.

    Users sharing an item pair meet inside the ``(item_i, item_j)`` group;
    popular item pairs are tiled (see ``pairs_within_groups``).
    """
    has_born = "born" in triples.columns
    has_j = "jarr" in triples.columns
    cols = ["user_id"] + (["born"] if has_born else []) + (["jarr"] if has_j else [])
    pairs = pairs_within_groups(triples, ["item_i", "item_j"], cols, identity=["user_id"],
                                condition=lambda a, b: a("user_id") < b("user_id"), tile_rows=tile_rows)
    out = [F.col("a_user_id").alias("user_a"), F.col("b_user_id").alias("user_b")]
    if has_born:
        out.append(F.greatest("a_born", "b_born").alias("born"))
    if has_j:
        out.append(F.greatest("a_jarr", "b_jarr").alias("jarr"))
    return pairs.select(*out)


def pair_counts(triples: DataFrame, t0) -> DataFrame:
    """``(user_a, user_b, before, after)``, ``user_a < user_b``: the ``pair_contributions`` of two users born before ``t0``, and all of them.

    Counted as a blocked product (see ``knn``), so there is no row per contribution; ``triples`` carries ``born``."""
    late = F.when(F.col("born") < t0, 0).otherwise(1)
    counts = count_changes(triples.select("user_id", "item_i", "item_j", late.alias("born")), ("item_i", "item_j"))
    return counts.withColumnsRenamed({"user_id": "user_a", "neighbor_id": "user_b"})


def mirror(sim: DataFrame, a: str = "user_a", b: str = "user_b") -> DataFrame:
    """Symmetric closure of a ``a < b`` similarity table.

    One pass: every row is emitted in both orientations by an ``explode``, so
    the (expensive) input plan is not evaluated twice as a ``union`` would.
    """
    rest = [c for c in sim.columns if c not in (a, b)]
    both = F.explode(F.array(F.struct(F.col(a).alias("_x"), F.col(b).alias("_y")),
                             F.struct(F.col(b).alias("_x"), F.col(a).alias("_y"))))
    return (sim.select(both.alias("_o"), *rest)
            .select(F.col("_o._x").alias(a), F.col("_o._y").alias(b), *rest))


def seq_user_similarity(events: DataFrame, delta: int, block_users: int = 2048) -> DataFrame:
    """Number of item pairs common to two users that lie less than ``delta``
    places apart in *both* profiles.  ``events`` must carry ``pos``.
    Returns both directions ``(user_a, user_b, score BIGINT)``, positive only.

    A user is the set of its item pairs; the scores are a blocked product of these sets (see ``knn``), so
    what is written is the result and no row per common pair.
    """
    scores = products(pair_sets(events, delta), ("item_i", "item_j"), block_users=block_users)
    return scores.select(F.col("user_id").alias("user_a"), F.col("neighbor_id").alias("user_b"), F.col("score").cast("bigint").alias("score"))


def pair_sets(events: DataFrame, delta: int) -> DataFrame:
    """``(user_id, item_i, item_j)``: the item pairs of ``sequence_triples``."""
    return sequence_triples(first_occurrences(events.drop("ord") if "ord" in events.columns else events), delta)


def seq_user_neighbors(events: DataFrame, delta: int, k: int, block_users: int = 2048) -> DataFrame:
    """The ``k`` best neighbours ``(user_id, neighbor_id, score BIGINT, rank)`` by ``seq_user_similarity``, without its table of pairs."""
    best = top_k_users(pair_sets(events, delta), k, "count", block_users, ("item_i", "item_j"))
    return best.select("user_id", "neighbor_id", F.col("score").cast("bigint").alias("score"), "rank")


def merge_similarity(old: DataFrame, delta: DataFrame, keys=("user_a", "user_b"), score: str = "score") -> DataFrame:
    """Stored sums plus new contributions: bag union, then sum per key."""
    return (old.select(*keys, score).unionByName(delta.select(*keys, score))
            .groupBy(*keys).agg(F.sum(score).cast(old.schema[score].dataType).alias(score)))
