"""Consumption blocks on a stream: per-user state holds the open block.

``applyInPandasWithState`` keeps, per user, the events of the open block and
the next block id, for as long as the user may return: the block that is open
then is closed by the next event, as in the batch rule.  Events of one user
must arrive in replay order across micro-batches; an event older than the
user's last one is put out as a row without ``block_id`` and ``n``.  Output:
elements of closed blocks ``(user_id, block_id, n, item_id, ts, event_id)`` and
those late events, in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BLOCK_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("block_id", T.LongType()),
    T.StructField("n", T.LongType()), T.StructField("item_id", T.LongType()),
    T.StructField("ts", T.LongType()), T.StructField("event_id", T.LongType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("next_block", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())), T.StructField("tss", T.ArrayType(T.LongType())),
    T.StructField("eids", T.ArrayType(T.LongType())),
])


def _block_step(gap: int):
    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user = int(key[0])
        nb, items, tss, eids = state.get if state.exists else (0, (), (), ())
        open_ = list(zip(items, tss, eids))
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for it, ts, eid in zip(batch["item_id"].tolist(), batch["ts"].tolist(), batch["event_id"].tolist()):
            if open_ and (ts, eid) <= open_[-1][1:]:
                out.append((user, None, None, it, ts, eid))
                continue
            if len(open_) > 1 and ts - open_[-1][1] > gap:
                out.extend((user, nb, n, *e) for n, e in enumerate(open_))
                nb += 1
                open_ = []
            open_.append((it, ts, eid))
        state.update((nb, *([list(c) for c in zip(*open_)] if open_ else ([], [], []))))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in BLOCK_SCHEMA.fields]).astype({"block_id": "Int64", "n": "Int64"})
    return step


def stream_blocks(events: DataFrame, gap: int) -> DataFrame:
    """Closed-block elements and late events of a streaming ``events`` frame (canonical schema)."""
    src = events.select("user_id", "item_id", "ts", "event_id")
    return src.groupBy("user_id").applyInPandasWithState(
        _block_step(int(gap)), BLOCK_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def closed(elements: DataFrame) -> DataFrame:
    """The elements of closed blocks."""
    return elements.where(F.col("block_id").isNotNull())


def late(elements: DataFrame) -> DataFrame:
    """The events that came after a later event of their user."""
    return elements.where(F.col("block_id").isNull()).drop("block_id", "n")


def with_idx(closed: DataFrame) -> DataFrame:
    """Adds ``idx`` (first place of an equal ``(item, ts)`` element) to block elements."""
    from pyspark.sql import Window
    return closed.withColumn("idx", F.min("n").over(Window.partitionBy("user_id", "block_id", "item_id", "ts")))
