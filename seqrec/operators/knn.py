"""Users' nearest neighbours as a blocked product, without a table of pairs.

A user is a sparse vector over items (or over any key, such as item pairs).  Users are laid out so that holders of the same
rare item lie together, and cut into blocks.  The inverted list of an item is kept per block with the largest
weight in it, so that

    bound(u, B) = sum over u's items i of w(u, i) * largest weight of i in B

is no less than u's product with any member of block B.  Scores rise with the product, and a block is visited only
if its bound can reach the user's running k-th score.  Round 0 lets every user visit the block with its best bound,
which gives a first k-th score; the visits that can reach it follow.  A visit multiplies whole blocks in a task,
common items as a matrix and the others item by item through the lists of both sides.  A task takes its visitors through all blocks, one after
another: their k best so far are kept, k-th scores rise on the way, blocks whose bound falls short of them are left out, and what leaves the
task is final.  So results are k rows for each user and version, and entries are sent once for each slice of visitors.

Entries may be born at versions.  Scores never fall then, so a pair whose last score does not reach a version's k-th score is out of
that version too, and only the others are counted at each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.operators.embeddings import cell_keys
from seqrec.operators.ordering import global_ordinal
from seqrec.session import cut, ship

SCORE_DIGITS = 6
#: Scores are rounded before they are compared, so a bound may fall short by half a digit.
_HALF = 0.6 * 10.0 ** -SCORE_DIGITS
#: Visitors that meet a block at a time, and are scored at once; their products with the members at all versions.
VISITORS, _CHUNK, _CELLS = 2048, 2048, 24_000_000
#: Entries of the visitors of a task, and places in their lists, about.
STRIPE, _LISTED = 8_000_000, 4_000_000
#: Pairs are counted one by one if they are no more than this share of all; pairs at once.
_FEW, _PAIRS = 0.3, 2048
#: Rows that leave a task at once; the lower half of a key.
_SENT, _TOP = 200_000, (1 << 32) - 1
#: An item goes through a matrix product if more than one in ``_DENSE`` pairs of a visit share it; items multiplied at once.
_DENSE, _COLUMNS = 100, 2048
#: Entries of a user in one row.
PACK = 4096
#: Products of an entry and a block's largest weight that are added up at once.
_SUMS = 4_000_000


def _layout(weights: DataFrame, measure: str, block_users: int, item_cols: Sequence[str]) -> tuple[DataFrame, int]:
    """``(user_id, size, block, items, weights, born)`` and the number of blocks.

    A row packs up to about ``PACK`` entries of a user as arrays, so entries move in bulk; ``weights`` is null where all are 1 and ``born``
    where there are no versions.  Items that one user alone holds make no pair; they count in the sizes (norm or item count) only."""
    weight = F.col("weight").cast("double") if "weight" in weights.columns else F.lit(1.0)
    born = [F.col("born").cast("int").alias("born")] if "born" in weights.columns else []
    w = cut(weights.select("user_id", *item_cols, weight.alias("weight"), *born), "knn-weights")
    lists = w.groupBy(*item_cols).agg(F.count(F.lit(1)).alias("_len")).where(F.col("_len") > 1)
    lists = global_ordinal(lists, ["_len", *item_cols], out="item")
    lists = cut(lists if lists.count() >= 1 << 31 else lists.withColumn("item", F.col("item").cast("int")), "knn-lists")
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight"))) if measure == "cosine" else F.count(F.lit(1)).cast("double")
    sizes = w.groupBy("user_id").agg(size.alias("size"), F.ceil(F.count(F.lit(1)) / F.lit(PACK)).alias("_packs"))
    packed = (w.hint("merge").join(lists, list(item_cols)).hint("merge").join(sizes, "user_id").withColumn("_pack", F.pmod(F.xxhash64("item"), F.col("_packs")))
              .groupBy("user_id", "_pack").agg(
                  F.first("size").alias("size"), F.min(F.struct("_len", "item")).alias("_a"), F.collect_list("item").alias("items"),
                  (F.lit(None).cast("array<double>") if measure == "count" else F.collect_list("weight")).alias("weights"),
                  (F.collect_list("born") if born else F.lit(None).cast("array<int>")).alias("born")))
    packed = cut(packed, "knn-packed")
    users = packed.groupBy("user_id").agg(F.min("_a").alias("_a"))
    placed = global_ordinal(users.select("user_id", F.col("_a._len").alias("_len"), F.col("_a.item").alias("_rare")), ["_len", "_rare", "user_id"], out="_o")
    blocks = placed.select("user_id", F.floor(F.col("_o") / F.lit(block_users)).cast("bigint").alias("block"))
    entries = cut(packed.select("user_id", "size", "items", "weights", "born").hint("merge").join(blocks, "user_id"), "knn-entries")
    last = entries.agg(F.max("block")).first()[0]
    return entries, 0 if last is None else last + 1


def _rows(entries: DataFrame) -> DataFrame:
    """``(user_id, block, size, item, weight)``: the packed entries one by one."""
    one = F.arrays_zip(F.col("items").alias("item"), F.coalesce("weights", F.transform("items", lambda i: F.lit(1.0))).alias("weight"))
    return entries.select("user_id", "block", "size", F.inline(one)).toDF("user_id", "block", "size", "item", "weight")


def _bound_sums(measure: str, blocks: int):
    """Each user's sum of weight times the block's largest, for every block that holds one of its items; a few users at a time."""
    schema = pa.schema([("user_id", pa.int64()), ("of", pa.int64()), ("sum", pa.float64()), ("size", pa.float64())])

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        at, item, weight, _ = _unpacked(left, "items", "weights", "born")
        who, of_row = np.unique(left["user_id"].to_numpy(), return_inverse=True)
        size = np.zeros(len(who))
        size[of_row] = left["size"].to_numpy()
        owner = of_row[at]
        unit = weight / size[owner] if measure == "cosine" else np.ones(len(owner))
        order = np.argsort(owner, kind="stable")
        owner, item, unit = owner[order], item[order], unit[order]
        lists = right["ofs"].combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        of, top = lists.flatten().to_numpy(zero_copy_only=False), right["tops"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        begin = np.cumsum(lengths) - lengths
        by = np.argsort(right["item"].to_numpy(), kind="stable")
        place = by[np.searchsorted(right["item"].to_numpy()[by], item)]
        done = np.concatenate([[0], np.cumsum(lengths[place])])  # products before each entry
        out = []
        some = max(1, _SUMS // blocks)
        for low in range(0, len(who), some):
            rows = min(some, len(who) - low)
            sums = np.zeros(rows * blocks)
            first, last = np.searchsorted(owner, (low, low + rows))
            while first < last:
                until = min(last, max(first + 1, int(np.searchsorted(done, done[first] + _SUMS, side="right")) - 1))
                now = place[first:until]
                each = lengths[now]
                value = np.repeat(begin[now] - (done[first:until] - done[first]), each) + np.arange(done[until] - done[first])
                cell = np.repeat((owner[first:until] - low) * blocks, each) + of[value]
                sums += np.bincount(cell, weights=np.repeat(unit[first:until], each) * top[value], minlength=len(sums))
                first = until
            found = np.flatnonzero(sums)
            mine = low + found // blocks
            out.append(pa.table([who[mine], found % blocks, sums[found], size[mine]], schema=schema))
        return pa.concat_tables(out)

    return run


def _bounds(entries: DataFrame, measure: str, blocks: int) -> DataFrame:
    """``(user_id, block, bound)``: what no score of the user with a member of the block exceeds.  A single block is visited anyway.

    The users of a part of a block meet the lists of the items that they hold, once each; there is no row for a user's item in a block."""
    if blocks <= 1:
        return entries.select("user_id", "block", F.lit(float("inf")).alias("bound")).distinct()
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("user_id"), F.lit(-(-tasks // blocks))).cast("int").alias("part")
    rows = _rows(entries)
    unit = F.col("weight") / F.col("size") if measure == "cosine" else F.lit(1.0)
    lists = rows.groupBy("item", F.col("block").alias("of")).agg(F.max(unit).alias("top"))
    lists = (lists.groupBy("item").agg(F.collect_list(F.struct("of", "top")).alias("_l"))
             .select("item", F.col("_l.of").alias("ofs"), F.col("_l.top").alias("tops")))
    needed = rows.select("block", part, "item").distinct()
    hosts = needed.hint("merge").join(lists, "item")
    guests = entries.select("block", part, "user_id", "size", "items", "weights", "born")
    spread = lambda df: df.repartition(tasks, "block", "part").groupBy("block", "part")
    sums = (spread(guests).cogroup(spread(hosts))
            .applyInArrow(_bound_sums(measure, blocks), "user_id bigint, of bigint, sum double, size double"))
    if measure == "jaccard":  # common items are at most `sum`, and the other user has at least as many
        smallest = entries.groupBy(F.col("block").alias("of")).agg(F.min("size").alias("least"))
        sums = sums.join(smallest, "of")
        bound = F.col("sum") / (F.col("size") + F.greatest("sum", "least") - F.col("sum"))
    else:
        bound = F.col("sum")
    return sums.select("user_id", F.col("of").alias("block"), (bound + F.lit(_HALF)).alias("bound"))


def _scores(measure: str, product: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Scores of positive products."""
    if measure == "count":
        return product
    score = product / (mine * theirs if measure == "cosine" else mine + theirs - product)
    return np.floor(score * 10 ** SCORE_DIGITS + 0.5) / 10 ** SCORE_DIGITS


def _best(measure: str, product: np.ndarray, mine: np.ndarray, theirs: np.ndarray, floor: np.ndarray, k: int | None, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's ``k`` best positive scores that reach its floor, ties to the smaller member.

    Products that cannot reach the floor, with some room for rounding, are never scored."""
    if measure == "count":
        reach = product >= np.maximum(floor, 0.5)[:, None]
    else:
        low = np.maximum(floor - 2 * _HALF, _HALF / 6) * (1 - 1e-9)  # what is less than that is rounded to 0
        if measure == "cosine":
            least = (low * mine)[:, None] * theirs
        else:
            least = (low / (1 + low))[:, None] * (mine[:, None] + theirs) * (1 - 1e-9)
        reach = product >= least
    i, j = np.divmod(np.flatnonzero(reach), product.shape[1])
    value = product[i, j]
    i, j, value = (x[value > 0] for x in (i, j, value))
    found = _scores(measure, value, mine[i], theirs[j])
    kept = (found > 0) & (found >= floor[i])
    i, j, found = i[kept], j[kept], found[kept]
    if k is None:
        return i, j, found
    full = np.flatnonzero(np.bincount(i, minlength=len(floor)) > k)
    if len(full):  # what is below the k-th score goes before the rest is sorted
        at = np.full(len(floor), -1)
        at[full] = np.arange(len(full))
        inside = at[i] >= 0
        rows = np.zeros((len(full), product.shape[1]))
        rows[at[i[inside]], j[inside]] = found[inside]
        least = np.zeros(len(floor))
        least[full] = np.partition(rows, rows.shape[1] - k, axis=1)[:, rows.shape[1] - k]
        kept = found >= least[i]
        i, j, found = i[kept], j[kept], found[kept]
    order = np.lexsort((member[j], -found, i))
    i, j, found = i[order], j[order], found[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], found[kept]


def _unpacked(table: pa.Table, items: str, weights: str, born: str):
    """(row, item, weight, version) of every packed entry."""
    lists = table[items].combine_chunks()
    row = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    rest = []
    for name, missing in ((weights, 1.0), (born, 0)):
        column = table[name].combine_chunks()
        rest.append(np.full(len(row), missing) if column.null_count == len(column) else column.flatten().to_numpy(zero_copy_only=False))
    return row, lists.flatten().to_numpy(zero_copy_only=False), rest[0], rest[1].astype(np.int64)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _ranges(begin: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from ``begin`` to ``until`` one range after another, and the number of the range of each."""
    each = until - begin
    of = np.repeat(np.arange(len(each)), each)
    return np.arange(len(of)) + (begin - (np.cumsum(each) - each))[of], of


class _Hosts:
    """The members of a block: their entries by item, in the order of birth, and the items held by many of them and of the visitors."""

    def __init__(self, table: pa.Table, versions: int, measure: str, asked: np.ndarray, asked_w: np.ndarray, visitors: int):
        """``asked``: what the visitors hold; ``place`` becomes its place among the items, and ``shared`` whether it is one of them."""
        at, hosted, weight, born = _unpacked(table, "items", "weights", "born")
        self.member, of_row = np.unique(table["user_id"].to_numpy(), return_inverse=True)
        self.size = np.zeros(len(self.member))
        self.size[of_row] = table["size"].to_numpy()
        self.items, of = _distinct(hosted)
        stamp = of * versions + born  # item by item, in the order of birth
        order = _in_order_of(stamp, len(self.items) * versions)
        self.by, self.w, stamp = of_row[at][order], weight[order], stamp[order]
        # where an item's members born up to each version end
        self.ends = np.searchsorted(stamp, np.arange(len(self.items) * versions), side="right").reshape(len(self.items), versions)
        self.starts = np.searchsorted(stamp, np.arange(len(self.items)) * versions)
        self.place, self.shared = place, shared = self.places(asked)
        # items held by many on both sides go through matrix products, the others are added one by one
        common = np.bincount(place[shared], minlength=len(self.items)) * (self.ends[:, -1] - self.starts) * _DENSE > visitors * len(self.member)
        common[stamp[~np.isfinite(self.w)] // versions] = False  # what is not finite stays with the pairs that share it
        common[place[shared & ~np.isfinite(asked_w)]] = False
        self.common, self.column = common, np.cumsum(common) - 1
        width = int(common.sum())
        item, birth = np.divmod(stamp.astype(np.int32) if len(self.items) * versions < 1 << 31 else stamp, versions)
        self.kind = np.float64 if measure == "cosine" or width >= 1 << 24 else np.float32  # items are counted exactly in either
        dense = slice(None) if common.all() else common[item]
        self.d_column, self.d_by, self.d_w, self.d_born = self.column[item[dense]], self.by[dense], self.w[dense], birth[dense]
        self.slices = [(at, min(at + _COLUMNS, width), slice(*np.searchsorted(self.d_column, (at, at + _COLUMNS)))) for at in range(0, width, _COLUMNS)]

    def places(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least, most = int(self.items[0]), int(self.items[-1])
        if most - least < 4 * (len(item) + len(self.by)):  # a table instead of a search
            table = np.full(most - least + 2, -1)
            table[self.items - least] = np.arange(len(self.items))
            place = table[np.where((item >= least) & (item <= most), item - least, -1)]
            return np.maximum(place, 0), place >= 0
        place = np.minimum(np.searchsorted(self.items, item), len(self.items) - 1)
        return place, self.items[place] == item


class _Best:
    """The ``k`` best of each visitor among the members met so far, and the scores that the next ones must reach.

    A score is a number that falls as it rises, below its row in a key, so that the best of a row sort first: counts as they are, other
    scores as the bits of a float, which tells them apart at 6 digits."""

    def __init__(self, k: int, floor: np.ndarray, count: bool):
        self.k, self.floor, self.count, self.key, self.member, self.new, self.waiting = k, floor, count, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, row: np.ndarray, member: np.ndarray, score: np.ndarray) -> None:
        if len(row):
            low = score.astype(np.int64) if self.count else score.astype(np.float32).view(np.int32).astype(np.int64)
            self.new.append(((row << 32) | (_TOP - low), member))
            self.waiting += len(row)
        if self.waiting > max(self.k * len(self.floor) // 2, 1):
            self.settle()

    def _scores(self, key: np.ndarray) -> np.ndarray:
        low = _TOP - (key & _TOP)
        return low.astype(np.float64) if self.count else np.floor(low.astype(np.int32).view(np.float32).astype(np.float64) * 10 ** SCORE_DIGITS + 0.5) / 10 ** SCORE_DIGITS

    def settle(self) -> np.ndarray:
        """The rank of what is kept, the best first."""
        if self.new:
            self.key, self.member = _sorted(*(np.concatenate(x) for x in zip((self.key, self.member), *self.new)))
        row = self.key >> 32
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        last = rank == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], self._scores(self.key[last]))
        kept = rank < self.k
        self.key, self.member, self.new, self.waiting = self.key[kept], self.member[kept], [], 0
        return rank[kept]

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place in the floors, member, score, rank) of what is kept."""
        rank = self.settle()
        return self.key >> 32, self.member, self._scores(self.key), rank + 1


def _sorted(key: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, equal ones by member; as one number if the digits suffice."""
    low, least = key & _TOP, member.min()
    top = low.min()
    widths = [int(x).bit_length() for x in (key[-1] >> 32 if len(key) < 2 else (key >> 32).max(), low.max() - top, int(member.max()) - int(least))]
    if sum(widths) < 63:
        one = ((key >> 32) << (widths[1] + widths[2])) | ((low - top) << widths[2]) | (member - least)
        one.sort()
        place = (one >> widths[2]) & ((1 << widths[1]) - 1)
        return ((one >> (widths[1] + widths[2])) << 32) | (place + top), (one & ((1 << widths[2]) - 1)) + least
    order = np.lexsort((member, key))
    return key[order], member[order]


def _in_order_of(value: np.ndarray, end: int) -> np.ndarray:
    """Places of the values, from the least; equal ones as they come."""
    return np.argsort(value.astype(np.uint16) if end <= 1 << 16 else value, kind="stable")  # few digits are sorted without comparing


def _distinct(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the place of each value among them."""
    if not len(value):
        return value, np.zeros(0, np.int64)
    least = int(value.min())
    width = int(value.max()) - least + 1
    if width > 4 * len(value):
        return np.unique(value, return_inverse=True)
    seen = np.zeros(width, bool)
    seen[value - least] = True
    return (np.flatnonzero(seen) + least).astype(value.dtype), (np.cumsum(seen) - 1)[value - least]


#: What a task returns: the best of each visitor, the k-th score only, all scores, scores as intervals of versions, scores at the first and the last version.
_SCHEMAS = {"lists": "version int, user_id bigint, neighbor_id bigint, score double, rank bigint", "kth": "user_id bigint, kth double",
            "products": "user_id bigint, neighbor_id bigint, score double", "intervals": "version int, until int, user_id bigint, neighbor_id bigint, score double",
            "changes": "user_id bigint, neighbor_id bigint, before bigint, after bigint"}
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}


def _bits(matrix: np.ndarray) -> np.ndarray:
    """What is not zero, 64 columns to a word."""
    packed = np.packbits(matrix != 0, axis=1)
    out = np.zeros((len(matrix), -(-packed.shape[1] // 8) * 8), np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view(np.uint64)


def _common_bits(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common bits of rows ``i`` of ``a`` and ``j`` of ``b``."""
    out = np.empty(len(i), np.float32)
    mine, theirs, ones = np.empty((_PAIRS, a.shape[1]), np.uint64), np.empty((_PAIRS, a.shape[1]), np.uint64), np.ones(a.shape[1], np.float32)
    for low in range(0, len(i), _PAIRS):
        n = min(_PAIRS, len(i) - low)
        np.take(a, i[low:low + n], axis=0, out=mine[:n], mode="clip")
        np.take(b, j[low:low + n], axis=0, out=theirs[:n], mode="clip")
        np.bitwise_and(mine[:n], theirs[:n], out=mine[:n])
        out[low:low + n] = np.bitwise_count(mine[:n]).astype(np.float32) @ ones
    return out


def _grown(kind, rows: int, members: int, slices, wanted: Sequence[int], guests, hosts, last: int):
    """(version, visitors' matrix, members' matrix) of the common items, a slice of columns after another, as of each wanted version in turn."""
    g_column, g_row, g_w, g_born = guests
    h_column, h_row, h_w, h_born = hosts
    for at, end, of in slices:
        mine = slice(*np.searchsorted(g_column, (at, end))) if len(slices) > 1 else slice(None)
        matrices = np.zeros((rows, end - at), kind), np.zeros((members, end - at), kind)
        known = -1
        for version in wanted:
            for out, column, row, w, born in ((matrices[0], g_column[mine], g_row[mine], g_w[mine], g_born[mine]), (matrices[1], h_column[of], h_row[of], h_w[of], h_born[of])):
                new = slice(None) if wanted == [last] and known < 0 else np.flatnonzero((born > known) & (born <= version))
                out[row[new], column[new] - at] = w[new]
            known = version
            yield version, *matrices


def _counted_singly(hosts: _Hosts, rows: int, versions: int, wanted: Sequence[int], cv, cp, cw, cs) -> dict[int, np.ndarray]:
    """Products over the items that are not common, item by item: its visitors times its members, as far as one side is new at a version."""
    order = np.lexsort((cs, cp))
    cv, cp, cw, cs = cv[order], cp[order], cw[order], cs[order]
    found = np.unique(cp)
    added, out = np.zeros((rows, len(hosts.member)), hosts.kind), {}
    begin = np.searchsorted(cp, found)
    upto = np.searchsorted(cp * versions + cs, (found[:, None] * versions + np.arange(versions)).reshape(-1), side="right").reshape(-1, versions)
    for version in range(max(wanted) + 1):
        for n, p in enumerate(found):
            a, s = begin[n], hosts.starts[p]
            old_v = a if version == 0 else upto[n, version - 1]
            old_m = s if version == 0 else hosts.ends[p, version - 1]
            new_v, new_m = upto[n, version], hosts.ends[p, version]
            if new_v > old_v and new_m > s:
                added[np.ix_(cv[old_v:new_v], hosts.by[s:new_m])] += cw[old_v:new_v, None] * hosts.w[s:new_m]
            if old_v > a and new_m > old_m:
                added[np.ix_(cv[a:old_v], hosts.by[old_m:new_m])] += cw[a:old_v, None] * hosts.w[old_m:new_m]
        if version in wanted:
            out[version] = added.copy() if version < max(wanted) else added
    return out


class _Visitors:
    """The visitors of a slice, what they hold, which blocks they visit and what they have found."""

    def __init__(self, table: pa.Table, measure: str, k: int | None, versions: int, kind: str):
        self.measure, self.k, self.versions, self.kind = measure, k, versions, kind
        self.wanted = [0] if kind == "kth" else sorted({0, versions - 1}) if kind == "changes" else list(range(versions))
        at, item, w, since = _unpacked(table, "items", "weights", "born")
        self.who, first_row, row = np.unique(table["user_id"].to_numpy(), return_index=True, return_inverse=True)
        self.own, kth, self.home = (table[name].to_numpy()[first_row] for name in ("size", "kth", "home"))
        order = np.argsort(row[at], kind="stable")
        self.item, self.w, self.since = item[order], w[order], since[order]
        self.begin = np.searchsorted(row[at][order], np.arange(len(self.who) + 1))
        asked = table.select(["blocks", "bounds"]).take(pa.array(first_row))
        guest = np.repeat(np.arange(len(self.who)), pc.list_value_length(asked["blocks"].combine_chunks()).to_numpy(zero_copy_only=False))
        block, bound = _flat(asked, "blocks"), _flat(asked, "bounds")
        order = np.argsort(block, kind="stable")
        self.guest, self.block, self.bound = guest[order], block[order], bound[order]
        self.of = np.repeat(np.arange(len(self.who)), np.diff(self.begin))
        self.best = [_Best(k or 1, kth.copy(), measure == "count") for _ in self.wanted]

    def meet(self, number: int, table: pa.Table):
        """The visitors of a block meet its members; what is found leaves the task, or is kept if only the best shall."""
        low, high = np.searchsorted(self.block, (number, number + 1))
        here, bound = self.guest[low:high], self.bound[low:high]
        here = np.sort(here[~(bound < self.best[0].floor[here])])
        if not len(here):
            return
        entry, of = _ranges(self.begin[here], self.begin[here + 1]) if len(here) < len(self.who) else (slice(None), self.of)
        hosts = _Hosts(table, self.versions, self.measure, self.item[entry], self.w[entry], len(here))
        ends = np.searchsorted(of, np.arange(0, len(here) + VISITORS, VISITORS))
        for low in range(0, len(here), VISITORS):
            some, mine = here[low:low + VISITORS], slice(*ends[low // VISITORS:low // VISITORS + 2])
            few = entry[mine] if len(here) < len(self.who) else mine
            shared = hosts.shared[mine]
            shared = slice(None) if shared.all() else shared
            v, place, w, since = (of[mine] - low)[shared], hosts.place[mine][shared], self.w[few][shared], self.since[few][shared]
            step = min(_CHUNK, max(64, _CELLS // (len(self.wanted) * len(hosts.member))))
            cuts = np.searchsorted(v, np.arange(0, len(some) + step, step))
            for at in range(0, len(some), step):
                inside = slice(*cuts[at // step:at // step + 2])
                yield from self._chunk(hosts, number, some[at:at + step], v[inside] - at, place[inside], w[inside], since[inside])

    def _chunk(self, hosts: _Hosts, number: int, some: np.ndarray, cv, cp, cw, cs):
        rows, members, wanted, member = len(some), len(hosts.member), self.wanted, hosts.member
        among = hosts.common[cp]
        guests = hosts.column[cp[among]], cv[among], cw[among], cs[among]
        if len(hosts.slices) > 1:
            order = np.argsort(guests[0], kind="stable")
            guests = tuple(x[order] for x in guests)
        theirs = hosts.d_column, hosts.d_by, hosts.d_w, hosts.d_born
        single = {} if among.all() else _counted_singly(hosts, rows, self.versions, wanted, cv[~among], cp[~among], cw[~among], cs[~among])

        def product(versions: Sequence[int]) -> dict[int, np.ndarray]:
            out = {v: single[v] if v in single else np.zeros((rows, members), hosts.kind) for v in versions}
            for v, mine, others in _grown(hosts.kind, rows, members, hosts.slices, versions, guests, theirs, self.versions - 1):
                out[v] += mine @ others.T
            return out

        who = self.who[some]
        if self.k is None:
            found = product(wanted)
            # a pair is found from the block that comes first, inside a block from the smaller id
            once = (self.home[some] != number)[:, None] | (who[:, None] < member)
            yield from self._all(found, once, who, some, hosts)
            return
        last = wanted[-1]
        itself = np.minimum(np.searchsorted(member, who), members - 1)
        mine = np.flatnonzero(member[itself] == who)
        final = product([last])[last]
        final[mine, itself[mine]] = 0

        def keep(version: int, product: np.ndarray) -> None:
            i, j, value = _best(self.measure, product, self.own[some], hosts.size, self.best[version].floor[some], self.k, member)
            self.best[version].add(some[i], member[j], value)

        keep(len(wanted) - 1, final)
        if len(wanted) == 1:
            return
        # counts never fall: what does not reach a version's k-th score at last did not reach it then; a few are counted one by one
        least = np.stack([best.floor[some] for best in self.best[:-1]])
        at = np.flatnonzero(final >= np.maximum(least.min(axis=0), 0.5)[:, None])
        i, j = np.divmod(at, members)
        value, pairs, whole = final.reshape(-1)[at], {}, []
        for version in wanted[:-1]:
            reach = np.flatnonzero(value >= least[version][i])
            if len(reach) > _FEW * final.size:
                whole.append(version)
            elif len(reach):
                pairs[version] = i[reach], j[reach], (single[version].reshape(-1)[at[reach]] if version in single else np.zeros(len(reach), np.float32))
        if pairs:
            for version, ours, others in _grown(hosts.kind, rows, members, hosts.slices, sorted(pairs), guests, theirs, self.versions - 1):
                pairs[version][2][:] += _common_bits(_bits(ours), _bits(others), pairs[version][0], pairs[version][1])
        for version, (i, j, score) in pairs.items():
            reach = (score > 0) & (score >= least[version][i])
            self.best[version].add(some[i[reach]], member[j[reach]], score[reach])
        for version, found in (product(whole) if whole else {}).items():
            found[mine, itself[mine]] = 0
            keep(version, found)

    def _all(self, found: dict[int, np.ndarray], once: np.ndarray, who: np.ndarray, some: np.ndarray, hosts: _Hosts):
        member, wanted = hosts.member, self.wanted
        if self.kind == "products":
            i, j, score = _best(self.measure, np.where(once, found[0], 0), self.own[some], hosts.size, np.zeros(len(who)), None, member)
            yield who[i], member[j], score
            yield member[j], who[i], score
        elif self.kind == "changes":
            i, j = np.nonzero(once & (found[wanted[-1]] > 0))
            yield *_in_order(who[i], member[j]), found[0][i, j].astype(np.int64), found[wanted[-1]][i, j].astype(np.int64)
        else:  # scores that end after they have held from their version to the one before
            start, before = np.zeros(once.shape, np.int32), np.zeros(once.shape, hosts.kind)
            for version in wanted:
                changed = (found[version] != before) & once
                i, j = np.nonzero(changed & (before > 0))
                yield start[i, j], np.full(len(i), version - 1, np.int32), *_in_order(who[i], member[j]), before[i, j].astype(np.float64)
                start[changed], before = version, found.pop(version)
            i, j = np.nonzero((before > 0) & once)
            yield start[i, j], np.full(len(i), self.versions - 1, np.int32), *_in_order(who[i], member[j]), before[i, j].astype(np.float64)

    def done(self):
        """What has been kept."""
        if self.k is None:
            return
        for version, best in enumerate(self.best):
            row, member, score, rank = best.lists()
            if self.kind == "kth":
                yield self.who[row[rank == self.k]], score[rank == self.k]
            else:
                yield np.full(len(row), version, np.int32), self.who[row], member, score, rank


def _in_order(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(a, b), np.maximum(a, b)


def _runs(batches):
    """(slice, block, rows) of rows that come one after another; the visitors of a slice are block -1."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        of, at = batch["slice"].to_numpy(), batch["at"].to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(at) != 0)) + 1), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            key = of[low], at[low]
            if held and key != now:
                yield *now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(low, high - low))
    if held:
        yield *now, pa.Table.from_batches(held)


def _visit(measure: str, k: int | None, versions: int, kind: str):
    """The visitors of a slice meet one block after another."""
    names = [field.split() for field in _SCHEMAS[kind].split(", ")]
    schema = pa.schema([(name, _TYPES[t]) for name, t in names])

    def rows_of(found):
        for columns in found:
            for low in range(0, len(columns[0]), _SENT):
                yield pa.RecordBatch.from_arrays([pa.array(c[low:low + _SENT], type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        visitors = None
        for _, block, rows in _runs(batches):
            if block >= 0:
                yield from rows_of(visitors.meet(block, rows))
                continue
            if visitors is not None:
                yield from rows_of(visitors.done())
            visitors = _Visitors(rows, measure, k, versions, kind)
        if visitors is not None:
            yield from rows_of(visitors.done())

    return run


def _visits(entries: DataFrame, visits: DataFrame, measure: str, k: int | None, versions: int, kind: str) -> DataFrame:
    """What the users find in their ``visits`` ``(user_id, block, bound, kth)``: scores that reach ``kth``.

    Users go into slices by their own block, so that like users share a task: a slice has about ``STRIPE`` entries and ``_LISTED`` places in lists
    at most, or fewer for two slices a core.  It meets the blocks that its users visit, one after another as they come out of
    the sort, so a task holds its visitors, a block, and the ``k`` best found.  Without ``k`` a pair of blocks meets once, from the first of both."""
    spark = entries.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(parts, 2 * spark.sparkContext.defaultParallelism)
    held = entries.groupBy("user_id").agg(F.first("block").alias("home"), F.sum(F.size("items")).alias("_e"))
    mine = visits.hint("merge").join(held, "user_id")
    if k is None:
        mine = mine.where(F.col("block") >= F.col("home"))
    asked = cut(mine.groupBy("user_id").agg(F.first("home").alias("home"), F.first("_e").alias("_e"), F.collect_list("block").alias("blocks"),
                                            F.collect_list("bound").alias("bounds"), F.first("kth").alias("kth")), "knn-asked")
    homes = cut(asked.groupBy("home").agg(F.count(F.lit(1)).alias("_v"), F.sum("_e").alias("_e"), F.sum(F.size("blocks")).alias("_w")), "knn-homes")  # a row for each block
    total = homes.select(F.coalesce(F.sum("_w"), F.lit(1))).scalar()
    lists = F.col("_v") * F.lit((k or 0) * (versions if kind == "lists" else 1) / _LISTED)
    share = F.greatest(F.col("_e") / F.lit(STRIPE), lists, F.col("_w") * F.lit(tasks) / total)
    before = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    homes = cut(homes.select("home", share.alias("_share")).withColumn("_from", F.coalesce(F.sum("_share").over(before), F.lit(0.0))), "knn-homes")
    slices = int(homes.select(F.coalesce(F.max(F.col("_from") + F.col("_share")), F.lit(0.0))).first()[0]) + 1
    grain = F.when(F.col("_share") == F.floor("_share"), F.col("_share")).otherwise(F.lit(float(1 << 20))).cast("bigint")
    inside = F.pmod(F.xxhash64("user_id"), grain) / grain
    asked = asked.join(F.broadcast(homes), "home").withColumn("slice", F.floor(F.col("_from") + inside * F.col("_share") + F.lit(1e-9)).cast("int")).drop("_from", "_share", "_e")
    met = asked.select("slice", F.explode("blocks").alias("block")).distinct().groupBy("block").agg(F.collect_list("slice").alias("slices"))  # a row for each block
    null = lambda kind: F.lit(None).cast(kind)
    held = ["user_id", "size", "items", "weights", "born"]
    guests = entries.select(*held).hint("merge").join(asked, "user_id").select("slice", F.lit(-1).cast("bigint").alias("at"), *held, "home", "kth", "blocks", "bounds")
    hosts = entries.join(F.broadcast(met), "block").select(F.explode("slices").alias("slice"), F.col("block").alias("at"), *held, null("bigint").alias("home"),
                                                           null("double").alias("kth"), null("array<bigint>").alias("blocks"), null("array<double>").alias("bounds"))
    # partitions of their own: few bytes are much work here, and Spark would put them together
    keys = F.array(*[F.lit(key).cast("bigint") for key in cell_keys(spark, slices)])
    rows = guests.unionByName(hosts).withColumn("_key", keys[F.col("slice")]).repartition(parts, "_key").sortWithinPartitions("slice", "at").drop("_key")
    return rows.mapInArrow(_visit(measure, k, versions, kind), _SCHEMAS[kind])


def _all_visits(weights: DataFrame, item_cols: Sequence[str], measure: str, block_users: int, versions: int, kind: str) -> DataFrame:
    """Every user visits the blocks with a member that shares an item."""
    ship(weights.sparkSession)
    entries, blocks = _layout(weights, measure, block_users, item_cols)
    visits = cut(_bounds(entries, measure, blocks).select("user_id", "block", "bound", F.lit(0.0).alias("kth")), "knn-visits")
    return _visits(entries, visits, measure, None, versions, kind)


def products(weights: DataFrame, item_cols: Sequence[str] = ("item_id",), measure: str = "count", block_users: int = 2048) -> DataFrame:
    """``(user_id, neighbor_id, score)``: all positive scores, both directions, block by block."""
    return _all_visits(weights, item_cols, measure, block_users, 1, "products")


def count_intervals(weights: DataFrame, item_cols: Sequence[str], versions: int, block_users: int = 2048) -> DataFrame:
    """``(version, until, user_id, neighbor_id, score)``: the common items of every pair of users, smaller id first, as intervals of versions.

    ``weights``: ``(user_id, *item_cols, born)`` with the number of the version from which an entry counts.  A pair has one row for each
    value its score takes, so rows grow with changes and not with versions."""
    return _all_visits(weights, item_cols, "count", block_users, versions, "intervals")


def count_changes(weights: DataFrame, item_cols: Sequence[str], block_users: int = 2048) -> DataFrame:
    """``(user_id, neighbor_id, before, after)``: the common items of every pair of users, smaller id first, at version 0 and at version 1.

    ``weights``: as for ``count_intervals``, with two versions."""
    return _all_visits(weights, item_cols, "count", block_users, 2, "changes")


def top_k_users(weights: DataFrame, k: int, measure: str = "cosine", block_users: int = 2048, item_cols: Sequence[str] = ("item_id",),
                versions: int | None = None, info: dict | None = None) -> DataFrame:
    """``([version,] user_id, neighbor_id, score, rank)``: the ``k`` users of largest positive score, exactly.

    ``weights``: ``(user_id, *item_cols[, weight][, born])``, each user and item once and weights above 0.  Measures: ``cosine`` and ``jaccard``
    (rounded to 6 digits) and ``count``, the number of common items; ties go to the smaller id.  With ``versions`` the entries carry the
    number of the version they are ``born`` at, from 0, and every version has its own lists; only ``count``, which never falls, takes versions.  A task holds
    the entries of one block and of its visitors in one slice.  The visits run when the result is read, so a result that is
    read twice wants to be ``cut``.  ``info`` receives the numbers of users, blocks, visits of both rounds and emitted pairs.
    """
    spark = weights.sparkSession
    if versions is not None and measure != "count":
        raise ValueError("versions need a measure that never falls")
    ship(spark)
    entries, blocks = _layout(weights, measure, block_users, item_cols)
    bounds = cut(_bounds(entries, measure, blocks), "knn-bounds")
    # round 0: the k-th score in the block with the best bound, the smaller on ties
    first = bounds.groupBy("user_id").agg(F.min(F.struct((-F.col("bound")).alias("b"), "block")).alias("_f"))
    first = first.select("user_id", F.col("_f.block").alias("block"), (-F.col("_f.b")).alias("bound"), F.lit(0.0).alias("kth"))
    # a bound holds for the last version and the k-th score of the first is the lowest, so no version loses a neighbour
    visits = bounds.withColumn("kth", F.lit(0.0))
    if blocks > 1:
        kth = cut(_visits(entries, first, measure, k, versions or 1, "kth"), "knn-kth")
        visits = bounds.hint("merge").join(kth, "user_id", "left").withColumn("kth", F.coalesce("kth", F.lit(0.0))).where(F.col("bound") >= F.col("kth"))
    visits = cut(visits.select("user_id", "block", "bound", "kth"), "knn-rest")
    best = _visits(entries, visits, measure, k, versions or 1, "lists")
    if info is not None:
        best = cut(best, "knn-found")
        info.update(users=bounds.select("user_id").distinct().count(), blocks=blocks, first=first.count(), rest=visits.count(), possible=bounds.count(), emitted=best.count())
    return best if versions is not None else best.drop("version")
