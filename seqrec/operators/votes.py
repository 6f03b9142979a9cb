"""Neighbour votes swept along time: each test event gets its ``n`` best items, and nothing but these leaves a task.

A request is one user's events under one list of neighbours in one refresh window, so it holds no more events than a window.  Requests
are dealt into groups; a group gets the profiles of the neighbours that its requests name, once each.  In the task a
request starts from the votes before its first event; later votes are a change log.  Of the items that the log does
not touch the best ``n`` plus as many as the user consumes in the test period are enough; these and the touched
items are the only ones whose votes are followed from event to event.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.session import cut, ship

#: Requests in one task, and events of a request whose votes are held at once.
REQUESTS, _EVENTS = 256, 512


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; null lists are empty."""
    column = table[name].combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def _gathered(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the values of some list rows, one after another."""
    lengths = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _best(votes: np.ndarray, item: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest votes above 0, ties to the smaller item; ``item`` rises with the place."""
    at = np.flatnonzero(votes > 0)
    if len(at) > n:
        least = np.partition(votes[at], len(at) - n)[len(at) - n]
        at = at[votes[at] >= least]
    return at[np.lexsort((item[at], -votes[at]))][:n]


def _swept(base, moved_at, moved_ord, seen, later, later_ord, event_ord, n):
    """(event, place, votes, rank) of each event's ``n`` best places; ``moved_*`` is the change log, ``seen`` is never recommended."""
    votes = base.copy()
    votes[seen] = 0
    log = ~np.isin(moved_at, seen)
    moved_at, moved_ord = moved_at[log], moved_ord[log]
    moving = np.unique(moved_at)
    rest = votes.copy()
    rest[moving] = 0
    place = np.sort(np.concatenate([_best(rest, np.arange(len(rest)), n + len(later)), moving])).astype(np.int64)
    if not len(place):
        return np.zeros((4, 0), np.int64)
    column = np.searchsorted(place, moved_at)
    first_event = np.searchsorted(event_ord, moved_ord, side="right")  # a vote counts for events after it
    gone = np.full(len(place), np.iinfo(np.int64).max)
    at = np.minimum(np.searchsorted(place, later), len(place) - 1)
    ok = place[at] == later
    gone[at[ok]] = later_ord[ok]
    running, out = votes[place].astype(np.int64), []
    for low in range(0, len(event_ord), _EVENTS):
        ords = event_ord[low:low + _EVENTS]
        change = np.zeros((len(ords), len(place)), np.int64)
        now = (first_event >= low) & (first_event < low + len(ords))
        np.add.at(change, (first_event[now] - low, column[now]), 1)
        score = running + np.cumsum(change, axis=0)
        running = score[-1].copy()
        score[gone[None, :] < ords[:, None]] = 0
        order = np.argsort(-score, axis=1, kind="stable")[:, :n]
        top = np.take_along_axis(score, order, 1)
        e, r = np.nonzero(top > 0)
        out.append(np.stack([low + e, place[order[e, r]], top[e, r], r + 1]))
    return np.concatenate(out, axis=1)


def _sweep(n: int):
    schema = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int64()), ("rank", pa.int64())])

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        by = np.argsort(right["neighbor_id"].to_numpy(), kind="stable")
        right = right.take(pa.array(by))
        known = right["neighbor_id"].to_numpy()
        t_item, t_at = _lists(right, "items")
        t_count, _ = _lists(right, "counts")
        x_item, x_at = _lists(right, "later_items")
        x_ord, _ = _lists(right, "later_ords")
        items, place = np.unique(np.concatenate([t_item, x_item]), return_inverse=True)
        t_place, x_place = place[:len(t_item)], place[len(t_item):]
        columns = {c: _lists(left, c) for c in ("neighbors", "event_ids", "event_ords", "own", "own_later", "own_ords")}
        users = left["user_id"].to_numpy()
        out = []

        def own(name, r):
            values, at = columns[name]
            return values[at[r]:at[r + 1]]

        for r in range(left.num_rows):
            named = own("neighbors", r)
            rows = np.minimum(np.searchsorted(known, named), len(known) - 1)
            rows = rows[known[rows] == named]
            ords, events = own("event_ords", r), own("event_ids", r)
            order = np.argsort(ords, kind="stable")
            ords, events = ords[order], events[order]
            train, test = _gathered(t_at, rows), _gathered(x_at, rows)
            base = np.bincount(t_place[train], weights=t_count[train], minlength=len(items)).astype(np.int64)
            when, what = x_ord[test], x_place[test]
            early = when < ords[0]
            base += np.bincount(what[early], minlength=len(items))
            late = ~early & (when < ords[-1])

            def places(values):
                at = np.minimum(np.searchsorted(items, values), len(items) - 1)
                return at, items[at] == values

            at, ok = places(own("own", r))
            seen = at[ok]
            at, ok = places(own("own_later", r))
            e, p, votes, rank = _swept(base, what[late], when[late], seen, at[ok], own("own_ords", r)[ok], ords, n)
            out.append(pa.table([events[e], np.full(len(e), users[r]), items[p], votes, rank], schema=schema))
        return pa.concat_tables(out)

    return run


def sweep_votes(ev: DataFrame, lists: DataFrame, scored: DataFrame, n: int) -> DataFrame:
    """``(event_id, user_id, item_id, score, rank)``: the ``n`` items with most votes for every scored event.

    Votes are all events of the user's neighbours strictly before the event, of items the user has not consumed before it; ties go to the smaller
    item.  ``ev``: ``(user_id, item_id, ord, is_test)``; ``lists``: ``(list, user_id, neighbor_id)``; ``scored``: ``(event_id, user_id, ord, list,
    window)``, the events of a window following each other.  A task holds the requests of a group and the profiles (item counts of the training part, test events) of the
    neighbours they name.
    """
    spark = ev.sparkSession
    ship(spark)
    asked = scored.groupBy("user_id", "list", "window").agg(F.sort_array(F.collect_list(F.struct("ord", "event_id"))).alias("_e"))
    asked = cut(asked.select("user_id", "list", "window", F.col("_e.event_id").alias("event_ids"), F.col("_e.ord").alias("event_ords")), "votes-asked")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // REQUESTS))
    named = lists.groupBy("user_id", "list").agg(F.collect_list("neighbor_id").alias("neighbors"))
    first = ev.groupBy("user_id", "item_id").agg(F.count_if(~F.col("is_test")).alias("m"), F.min("ord").alias("first_ord"))
    first = cut(first, "votes-first")
    train = (first.where("m > 0").groupBy("user_id").agg(F.collect_list(F.struct("item_id", "m")).alias("_t"))
             .select("user_id", F.col("_t.item_id").alias("items"), F.col("_t.m").alias("counts")))
    later = (first.where("m = 0").groupBy("user_id").agg(F.collect_list(F.struct("item_id", "first_ord")).alias("_l"))
             .select("user_id", F.col("_l.item_id").alias("own_later"), F.col("_l.first_ord").alias("own_ords")))
    test = (ev.where("is_test").groupBy("user_id").agg(F.collect_list(F.struct("item_id", "ord")).alias("_x"))
            .select("user_id", F.col("_x.item_id").alias("later_items"), F.col("_x.ord").alias("later_ords")))
    # sort-merge joins: lists are small on disk and large in a driver that broadcasts them
    requests = (asked.hint("merge").join(named, ["user_id", "list"]).hint("merge").join(train.select("user_id", F.col("items").alias("own")), "user_id", "left")
                .hint("merge").join(later, "user_id", "left")
                .withColumn("group", F.pmod(F.xxhash64("user_id", "list", "window"), F.lit(tasks)).cast("int")).drop("list", "window"))
    requests = cut(requests, "votes-requests")
    profiles = train.hint("merge").join(test, "user_id", "full").withColumnRenamed("user_id", "neighbor_id")
    needed = requests.select(F.col("group").alias("of"), F.explode("neighbors").alias("neighbor_id")).distinct()
    right = needed.hint("merge").join(profiles, "neighbor_id")
    return (requests.groupBy("group").cogroup(right.groupBy("of"))
            .applyInArrow(_sweep(n), "event_id bigint, user_id bigint, item_id bigint, score bigint, rank bigint"))
