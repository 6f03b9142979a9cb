"""Exact largest inner products of users with items, in the order of the items' norms.

Items lie in blocks by falling norm.  By Cauchy and Schwarz no item of a block scores above the user's norm times the
block's largest, so the blocks a user must see are the first few.  Round 0 visits as many as hold the items the user needs
and gives a last needed score; round 1 visits the further blocks whose bound can reach it, the rest are never read for
this user.  What a user has seen is masked where it is scored, so it asks for no more than it can use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.functions.exprs import dot
from seqrec.operators.ordering import global_ordinal
from seqrec.session import cut, ship

SCORE_DIGITS = 6
#: Users and items that meet in one task at once, and users scored at once.
USER_BLOCK, ITEM_BLOCK, _CHUNK = 2048, 4096, 512


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _block_best(key, users: pa.Table, items: pa.Table) -> pa.Table:
    """Each user's best unseen items of one block: as many as it needs, none below its floor."""
    schema = pa.schema([("user_id", pa.int64()), ("item_id", pa.int64()), ("raw", pa.float64())])
    if not users.num_rows or not items.num_rows:
        return schema.empty_table()
    items = items.sort_by("item_id")
    ids, bias, q = items["item_id"].to_numpy(), items["bias"].to_numpy(), _matrix(items["vec"])
    p, who, need, floor = _matrix(users["vec"]), users["user_id"].to_numpy(), users["need"].to_numpy(), users["floor"].to_numpy()
    seen = users["seen"].combine_chunks()
    held = pc.fill_null(pc.list_value_length(seen), 0).to_numpy(zero_copy_only=False)
    owner, gone = np.repeat(np.arange(len(who)), held), seen.flatten().to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, gone), len(ids) - 1)
    here = ids[at] == gone
    owner, at = owner[here], at[here]
    out = []
    for low in range(0, len(who), _CHUNK):
        part = slice(low, low + _CHUNK)
        scores = np.round(p[part] @ q.T + bias, SCORE_DIGITS)
        mine = (owner >= low) & (owner < low + len(scores))
        scores[owner[mine] - low, at[mine]] = -np.inf
        most = int(min(need[part].max(), len(ids)))
        least = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most] if most < len(ids) else np.full(len(scores), -np.inf)
        i, j = np.nonzero((scores >= np.maximum(least, floor[part])[:, None]) & (scores > -np.inf))
        found = scores[i, j]
        order = np.lexsort((j, -found, i))
        i, j, found = i[order], j[order], found[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < need[part][i]
        out.append(pa.table([who[low + i[kept]], ids[j[kept]], found[kept]], schema=schema))
    return pa.concat_tables(out)


def _visited(users: DataFrame, items: DataFrame) -> DataFrame:
    """Best items of ``users`` ``(user_id, vec, need, seen, floor, first, last)`` in the blocks ``first`` to ``last``."""
    visits = cut(users.where("first <= last").withColumn("block", F.explode(F.sequence("first", "last"))).drop("first", "last"), "product-visits")
    slices = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(USER_BLOCK)).cast("int").alias("_s"))
    slices = cut(slices, "product-slices")
    guests = visits.join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("user_id"), F.col("_s")).cast("int")).drop("_s")
    hosts = (items.join(slices.withColumnRenamed("block", "of"), F.col("block") == F.col("of"))
             .select("of", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)).alias("part"), "item_id", "bias", F.col("vec")))
    return (guests.groupBy("block", "slice").cogroup(hosts.groupBy("of", "part"))
            .applyInArrow(_block_best, "user_id bigint, item_id bigint, raw double"))


def _cut_to_need(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("raw"), "item_id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("need"))


def top_products(users: DataFrame, items: DataFrame, info: dict | None = None) -> DataFrame:
    """``(user_id, item_id, raw)``: for each user its ``need`` unseen items of largest ``vec . vec + bias``, rounded to 6 digits, ties to the smaller item.

    ``users``: ``(user_id, vec, need, seen ARRAY<BIGINT>)``; ``items``: ``(item_id, vec, bias)``.  ``info`` receives the number of (user, block) visits made and possible.
    """
    spark = users.sparkSession
    ship(spark)
    norm = F.sqrt(dot("vec", "vec") + F.col("bias") * F.col("bias"))
    ranked = global_ordinal(items.select("item_id", (-norm).alias("_n")), ["_n", "item_id"], out="_o")
    placed = cut(items.join(ranked, "item_id").withColumn("block", F.floor(F.col("_o") / F.lit(ITEM_BLOCK)).cast("int")), "product-items")
    tops = [-r["t"] for r in placed.groupBy("block").agg(F.min("_n").alias("t")).orderBy("block").collect()]  # one number for each block
    if not tops:
        return users.select("user_id", F.col("user_id").alias("item_id"), F.lit(0.0).alias("raw")).where("false")
    own = F.sqrt(dot("vec", "vec") + F.lit(1.0))
    first = F.least(F.ceil(F.col("need") / F.lit(ITEM_BLOCK)), F.lit(len(tops))).cast("int")
    asked = cut(users.select("user_id", "vec", F.col("need").cast("bigint").alias("need"), "seen", own.alias("norm"), first.alias("until")), "product-users")
    start = asked.select("user_id", "vec", "need", "seen", F.lit(float("-inf")).alias("floor"), F.lit(0).alias("first"), (F.col("until") - 1).alias("last"))
    needs = asked.select("user_id", "need")
    seed = cut(_cut_to_need(_visited(start, placed).join(needs, "user_id")), "product-seed")
    last = seed.where(F.col("_r") == F.col("need")).select("user_id", F.col("raw").alias("floor"))
    # blocks whose largest norm can still reach the last needed score; rounding may add half a digit
    bounds = F.array(*[F.lit(float(t)) for t in tops])
    reach = F.size(F.filter(bounds, lambda t: t * F.col("norm") * F.lit(1 + 1e-12) + F.lit(0.6 * 10 ** -SCORE_DIGITS) >= F.col("floor")))
    rest = (asked.join(last, "user_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
            .select("user_id", "vec", "need", "seen", "floor", F.col("until").alias("first"), (reach - 1).alias("last")))
    rest = cut(rest.where("first <= last"), "product-rest")
    found = seed.drop("_r")
    if not rest.isEmpty():
        found = found.unionByName(_visited(rest, placed).join(needs, "user_id"))
    if info is not None:
        made = asked.agg(F.sum("until")).first()[0] + (rest.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] or 0)
        info.update(visits=made, possible=asked.count() * len(tops))
    return _cut_to_need(found).select("user_id", "item_id", "raw")
