"""Sequential scans over users' histories in two passes over one sort.

Per-user windows send a user's whole history to one task, so one user with a
third of all events serialises the job.  Here the events are range-partitioned
and sorted once by ``(user, time, event)`` and written with ``checkpoint()``, so
a heavy user spans many partitions.  Nothing is shuffled after that:

1. every partition is summarised in one row: its first and last keys and what
   its rows do to the state they are entered with (two cases suffice);
2. the summaries, one row per partition like the offsets of an ordinal, are
   folded forwards and backwards into what precedes and follows each partition;
3. every partition is read again with its carry, and all columns are
   computed from whole columns at once.

Neither pass is expressible as a window: Spark knows no window over the rows of
a partition as they lie.  A task holds the columns of one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seqrec.session import scratch_root, ship

_PID = "_pid"
#: Rows of a partition, about; a task holds one partition's columns.
PARTITION_ROWS = 500_000


def sorted_partitions(df: DataFrame, order: Sequence[str], together: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, materialised with its partition number ``_pid``.

    Rows equal in the first ``together`` columns (default: all) lie in one partition.  Partitions grow in number with the
    rows, to about ``PARTITION_ROWS`` each; left to itself Spark would merge them by bytes, to millions of short rows.
    """
    spark = df.sparkSession
    scratch_root(spark)
    ship(spark)
    near = list(order)[:together]
    wanted = -(-df.count() // PARTITION_ROWS)
    spread = [max(wanted, spark.sparkContext.defaultParallelism)] if wanted > 1 else []
    return (df.repartitionByRange(*spread, *near).sortWithinPartitions(*order)
            .withColumn(_PID, F.spark_partition_id()).checkpoint(eager=True))


# ---------------------------------------------------------------- one partition


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def _gaps(times: pa.ChunkedArray) -> np.ndarray:
    t = times.to_numpy()
    return t[1:] - t[:-1]


class _Rule:
    """When a segment starts: at a user's first row; after more than ``gap``; with ``absorb`` not right after another start."""

    def __init__(self, user: str, time: str, gap, absorb: bool):
        self.user, self.time, self.gap, self.absorb = user, time, gap, absorb

    def flags(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """First row of its user, and after a gap, for all rows but the partition's first."""
        user = _codes(table[self.user])
        first = np.zeros(len(user), bool)
        first[1:] = user[1:] != user[:-1]
        wide = first.copy()
        if self.gap is not None:
            wide[1:] |= _gaps(table[self.time]) > self.gap
        return first, wide

    def starts(self, first: np.ndarray, wide: np.ndarray, enters: bool) -> np.ndarray:
        """Which rows start a segment, if the partition's first row does or does not."""
        if not self.absorb:
            out = wide.copy()
            out[0] = enters
            return out
        # inside a run of gaps every other row starts; a user's first row always does, a row without a gap never
        place = np.arange(len(first))
        known = first | ~wide
        known[0] = True
        value = first.copy()
        value[0] = enters
        last = np.maximum.accumulate(np.where(known, place, 0))
        return value[last] ^ ((place - last) & 1).astype(bool)

    def enters(self, carry: dict | None, user, time) -> bool:
        """Whether a partition's first row starts a segment."""
        if carry is None or carry["user"] != user:
            return True
        wide = self.gap is not None and time - carry["time"] > self.gap
        return bool(wide and not (self.absorb and carry["start"]))


def _summary(table: pa.Table, rule: _Rule) -> dict:
    """What the fold must know of a partition."""
    n = table.num_rows
    first, wide = rule.flags(table)
    out = {"rows": n, "user": table[rule.user][n - 1].as_py(), "time": table[rule.time][n - 1].as_py(),
           "first_user": table[rule.user][0].as_py(), "first_time": table[rule.time][0].as_py(), "cases": []}
    users = np.flatnonzero(first)
    own = int(users[-1]) if len(users) else 0  # first row of the last user here
    until = int(users[0]) if len(users) else n  # end of the first user here
    for enters in (False, True):
        starts = rule.starts(first, wide, enters)
        places = np.flatnonzero(starts)
        after = places[places >= 1]
        cut_at = int(after[0]) if len(after) else n  # where the segment that is entered ends
        out["cases"].append({"start": bool(starts[-1]), "next": cut_at, "same": bool(cut_at < until), "more": bool(cut_at < n),
                             "segments": int(starts[own:].sum()), "last": int(places[-1]) if len(places) else -1})
    out["whole"] = not len(users)
    return out


def _fold(parts: list[dict], rule: _Rule) -> list[dict | None]:
    """For each partition in order: what comes before its first row and after its last."""
    carry, before, cases = None, [], []
    for p in parts:
        enters = rule.enters(carry, p["first_user"], p["first_time"])
        case = p["cases"][enters]
        goes_on = carry is not None and carry["user"] == p["first_user"]
        before.append({"enters": enters, "id": carry["id"] if goes_on else -1, "n": carry["n"] if goes_on else -1, "rows": carry["user_rows"] if goes_on else 0})
        cases.append(case)
        whole = p["whole"] and goes_on
        carry = {"user": p["user"], "time": p["time"], "start": case["start"],
                 "id": (carry["id"] if whole else -1) + case["segments"],
                 "n": p["rows"] - 1 - case["last"] if case["last"] >= 0 else carry["n"] + p["rows"],
                 "user_rows": (carry["user_rows"] if whole else 0) + p["rows"]}
    # backwards: rows that the segment open at a partition's end still gets, and whether its user starts another
    left, closed, following = 0, False, None
    for k in range(len(parts) - 1, -1, -1):
        if following is None:
            left, closed = 0, False
        else:
            p, case = parts[following], cases[following]
            if before[following]["enters"]:
                left, closed = 0, parts[k]["user"] == p["first_user"]
            elif case["more"]:
                left, closed = case["next"], case["same"]
            else:
                left, closed = left + p["rows"], closed
        before[k] |= {"left": left, "closed": closed}
        following = k
    return before


def _tie_firsts(table: pa.Table, rule: _Rule, item: str, n: np.ndarray) -> np.ndarray:
    """First place among rows of equal user, time and item."""
    idx = n.copy()
    user, time = _codes(table[rule.user]), table[rule.time].to_numpy()
    same = (user[1:] == user[:-1]) & (time[1:] == time[:-1])
    if not same.any():
        return idx
    group = np.concatenate([[0], np.cumsum(~same)])
    tied = np.zeros(len(n), bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    items = _codes(table[item].take(pa.array(at)))
    order = np.lexsort((at, items, group[at]))
    g, i, rows = group[at][order], items[order], at[order]
    fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])
    idx[rows] = n[rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]]
    return idx


def _segmented(table: pa.Table, rule: _Rule, carry: dict, item: str | None) -> dict[str, np.ndarray]:
    """segment, n, size, closed (and idx) of every row of a partition."""
    rows = table.num_rows
    first, wide = rule.flags(table)
    starts = rule.starts(first, wide, carry["enters"])
    place = np.arange(rows)
    count = np.cumsum(starts)
    users = np.maximum.accumulate(np.where(first, place, 0))  # each row's user's first row here
    segment = np.where(users > 0, count - count[users], count + carry["id"])
    last = np.maximum.accumulate(np.where(starts, place, -1))
    n = np.where(last >= 0, place - last, place + carry["n"] + 1)
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], rows) if len(at) else np.array([], np.int64)
    size = np.empty(rows, np.int64)
    closed = np.empty(rows, bool)
    lead = int(at[0]) if len(at) else rows  # rows of the segment that goes on from before
    if lead:
        ended = lead < rows
        size[:lead] = carry["n"] + 1 + lead + (0 if ended else carry["left"])
        closed[:lead] = bool(not first[lead]) if ended else carry["closed"]
    if len(at):
        lengths, shut = ends - at, np.zeros(len(at), bool)
        shut[:-1] = ~first[at[1:]]
        lengths[-1] += carry["left"]
        shut[-1] = carry["closed"]
        size[lead:] = np.repeat(lengths, ends - at)
        closed[lead:] = np.repeat(shut, ends - at)
    out = {"segment": segment, "n": n, "size": size, "closed": closed}
    if item is not None:
        out["idx"] = _tie_firsts(table, rule, item, n)
    return out


# ---------------------------------------------------------------- all partitions


def _summaries(ranged: DataFrame, columns: Sequence[str], make) -> list[tuple[int, dict]]:
    """``make(table)`` of every partition that has rows, in partition order; one small row each."""
    import pickle

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            yield pa.RecordBatch.from_arrays([pa.array([table[_PID][0].as_py()], pa.int32()), pa.array([pickle.dumps(make(table))], pa.binary())], names=["p", "s"])

    rows = ranged.select(_PID, *dict.fromkeys(columns)).mapInArrow(run, "p int, s binary").collect()
    return sorted((r["p"], pickle.loads(r["s"])) for r in rows)


def _segments(df: DataFrame, order: Sequence[str], rule: _Rule, out: dict[str, str], item: str | None = None,
              closed_only: bool = False, together: int | None = None) -> DataFrame:
    """``df`` with the columns ``out`` names: ``{"segment" | "n" | "size" | "idx": name}``."""
    cols = df.columns
    ranged = sorted_partitions(df, order, together)
    found = _summaries(ranged, [rule.user, rule.time], lambda table: _summary(table, rule))
    carries = dict(zip([p for p, _ in found], _fold([s for _, s in found], rule)))

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        made = _segmented(table, rule, carries[table[_PID][0].as_py()], item)
        table = table.select(cols)
        for kind, name in out.items():
            table = table.append_column(name, pa.array(made[kind].astype(np.int64)))
        if closed_only:
            table = table.filter(pa.array(made["closed"]))
        yield from table.to_batches(max_chunksize=10_000)

    schema = StructType([*df.schema.fields, *[StructField(name, LongType()) for name in out.values()]])
    return ranged.select(*cols, _PID).mapInArrow(run, schema)


def consumption_blocks(df: DataFrame, gap, flush_open: bool = False) -> DataFrame:
    """Blocks of users' histories (the rule is in ``blocks``): one range shuffle, no window, no join."""
    rule = _Rule("user_id", "ts", gap, absorb=True)
    return _segments(df, ["user_id", "ts", "event_id"], rule, {"segment": "block_id", "n": "n", "idx": "idx", "size": "block_size"},
                     item="item_id", closed_only=not flush_open, together=2)


def positions(df: DataFrame) -> DataFrame:
    """``pos`` (place in the user's history) without per-user windows."""
    return _segments(df, ["user_id", "ts", "event_id"], _Rule("user_id", "ts", None, absorb=False), {"n": "pos"})


def gap_segments(df: DataFrame, gap, order=("ts", "event_id"), ts_col: str = "ts") -> DataFrame:
    """Gap sessions without per-user windows: adds ``session_id`` and ``n``.

    A new segment starts at a user's first row and wherever
    ``ts_col - previous ts_col > gap`` in ``(user_id, *order)`` order.
    """
    return _segments(df, ["user_id", *order], _Rule("user_id", ts_col, gap, absorb=False), {"segment": "session_id", "n": "n"})


def recent_items(events: DataFrame, targets: DataFrame | Column, n: int = 3) -> DataFrame:
    """The last ``n`` items before each target, ``(event_id, user_id, back, item_id)``, from one scan.

    ``targets`` is a condition on the events, or a table of their ``event_id``.  A partition's
    carry is the last ``n`` items of the user it goes on with, so a history may span any number of partitions.
    """
    if isinstance(targets, DataFrame):
        wanted = targets.select(F.col("event_id").alias("_e")).distinct()
        events = events.join(wanted, F.col("event_id") == F.col("_e"), "left").withColumn("_target", F.col("_e").isNotNull())
    else:
        events = events.withColumn("_target", F.coalesce(targets, F.lit(False)))
    ranged = sorted_partitions(events.select("user_id", "item_id", "ts", "event_id", "_target"), ["user_id", "ts", "event_id"])

    def tail(table):
        rows = table.num_rows
        user = _codes(table["user_id"])
        own = int(np.flatnonzero(np.concatenate([[True], user[1:] != user[:-1]]))[-1])
        return {"first": table["user_id"][0].as_py(), "user": table["user_id"][rows - 1].as_py(), "whole": own == 0,
                "items": table["item_id"].slice(max(own, rows - n)).to_pylist()}

    carries, held, owner = {}, [], None
    for p, s in _summaries(ranged, ["user_id", "item_id"], tail):
        goes_on = owner is not None and owner[0] == s["first"]
        carries[p] = held if goes_on else []
        held = (carries[p] + s["items"])[-n:] if s["whole"] else s["items"]
        owner = (s["user"],)

    schema = StructType([events.schema["event_id"], events.schema["user_id"], StructField("back", LongType()), events.schema["item_id"]])

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        before = carries[table[_PID][0].as_py()]
        user = _codes(table["user_id"])
        first = np.concatenate([[True], user[1:] != user[:-1]])
        place = np.arange(len(user))
        start = np.maximum.accumulate(np.where(first, place, 0))
        items = pa.concat_arrays([pa.array(before, table["item_id"].type), table["item_id"].combine_chunks()])
        at = np.flatnonzero(table["_target"].to_numpy(zero_copy_only=False))
        for back in range(1, n + 1):
            # rows of the user that goes on from the partition before may look back into the carry
            low = np.where(start[at] == 0, -len(before), start[at])
            ok = at[at - back >= low]
            if len(ok):
                yield pa.RecordBatch.from_arrays([pc.take(table["event_id"].combine_chunks(), pa.array(ok)), pc.take(table["user_id"].combine_chunks(), pa.array(ok)),
                                                  pa.array(np.full(len(ok), back, np.int64)), pc.take(items, pa.array(ok - back + len(before)))], names=schema.names)

    return ranged.mapInArrow(run, schema)
