"""Connected components of a link table by contraction, every round a written table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm.ship import ship
from seqrec.session import cut

#: Links that one task contracts at a time.
BLOCK = 1 << 20


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of some links, without the roots themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, fewer than nodes in every block of a partition."""
    ship(links.sparkSession)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            a, b = _forest(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
                size += batch.num_rows
            if size >= BLOCK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return links.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that a link joins to another; component is the smallest node reachable.

    Partitions contract their own links first.  Then, in each round, every node moves to one of its neighbours or stays, the
    links are rewritten to the new nodes, and those inside one node vanish.  Rounds take turns between the least neighbour, which
    ends stars at once, and the neighbour of least random rank, which takes a constant share off any chain.
    Nodes and links stay distributed.  Null ends link nothing; an empty table gives an empty result.
    """
    pairs = links.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a <> b")
    edges = cut(_contracted(pairs), "links")
    found = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if turn % 2 == 0:
            best = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        else:
            rank = lambda c, t=turn: F.struct(F.xxhash64(c, F.lit(t)).alias("h"), F.col(c).alias("n"))
            best = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("to"))
        moved = cut(best, "moved")
        if found is None:
            found = moved.withColumnRenamed("to", "root")
        else:
            found = cut(found.join(moved, found["root"] == moved["node"], "left").select(found["node"], F.coalesce("to", "root").alias("root")), "roots")
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = cut(_contracted(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
        turn += 1
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return cut(found.join(least, "root").select("node", "component"), "components")
