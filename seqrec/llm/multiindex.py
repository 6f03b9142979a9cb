"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut in two halves; a codebook of its own for either half turns the pairs of codewords into a grid of
cells, and every vector is filed under its cell.  A vector then visits cells in the order of a lower bound on
its distance to anything filed there (the multi-sequence traversal) until the bound passes the distance that the
wanted cosine allows, and compares itself with what it finds, in double precision.  Cells that lie together are a page, and a vector
is sent to a page once, with the cells that it visits there.

The bound: something filed under codeword i is nearer to i than to the query's own codeword, hence beyond the bisector
of the two; the squared distances to the bisectors of both halves add up.  With target_recall 1 the traversal goes as
far as any link can lie, which loses none; below 1 it stops at the bound that covers this share of partners at the least
cosine, drawn around the vectors of the codebook sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.llm.graph import components
from seqrec.llm.ship import ship
from seqrec.session import cut

#: Members and queries that meet in one task at once.
MEMBERS, QUERIES = 2048, 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(column: pa.Array) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = _matrix(column)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codebook(x: np.ndarray, size: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means over a bounded sample; equal starts are merged."""
    rng = np.random.default_rng(seed)
    centres = np.unique(x[rng.permutation(len(x))[:size]], axis=0)
    for _ in range(rounds):
        near = _nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def _along(centres: np.ndarray) -> np.ndarray:
    """Codewords along their main direction, so that a vector visits cells that lie together."""
    centred = centres - centres.mean(0)
    return centres[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squares(x, centres).argmin(1)


def _bisectors(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the squared distance to its bisector with each codeword (0 for itself)."""
    squares = _squares(x, centres)
    own = squares.argmin(1)
    gap = np.sqrt(np.maximum(_squares(centres, centres), 0))[own]
    beyond = np.maximum(squares - squares[np.arange(len(x)), own][:, None], 0)
    return own, np.divide(beyond, 2 * gap, out=np.zeros_like(beyond), where=gap > 0) ** 2


def _visits(first: np.ndarray, second: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Codeword pairs of one query in traversal order as far as the bound."""
    order1, order2 = first.argsort(kind="stable"), second.argsort(kind="stable")
    one, two = first[order1], second[order2]
    one = one[:np.searchsorted(one, bound, "right")]
    reach = np.searchsorted(two, bound - one, "right")
    i = np.repeat(np.arange(len(one)), reach)
    j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
    by = np.argsort(one[i] + two[j], kind="stable")
    return order1[i[by]], order2[j[by]]


def _bound(x: np.ndarray, books, cosine: float, target_recall: float, seed: int) -> float:
    """Where the traversal may stop: the bound that covers the wanted share of links.

    Partners at exactly the least cosine are drawn in random directions around sampled vectors, and the links
    inside the sample are taken too; the larger of both bounds counts.  Links nearer than the least cosine need less.
    """
    most = 2 * (1 - cosine) + 1e-9
    if target_recall >= 1:
        return most
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:4096]]
    half = x.shape[1] // 2

    def needed(a: np.ndarray, b: np.ndarray) -> float:
        beyond = sum(_bisectors(a[:, s], c)[1][np.arange(len(a)), _nearest(b[:, s], c)] for s, c in zip((slice(0, half), slice(half, None)), books))
        return float(np.quantile(beyond, target_recall)) + 1e-9

    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.sqrt((away * away).sum(1, keepdims=True)), 1e-300)
    found = needed(x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * away)
    a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    return min(most, max(found, needed(x[a], x[b])) if len(a) else found)


def _linked(cosine: float):
    """Links of one block of queries with one block of members, summed by vector, and a forest with the same components."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64())])

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, m = _unit(left["vec"]), _unit(right["vec"])
        q_id, m_id = left["rid"].to_numpy(), right["rid"].to_numpy()
        q_n, m_n = left["copies"].to_numpy(), right["copies"].to_numpy()
        own, cell = left["own"].to_numpy(), right["cell"].to_numpy()
        lists = left["cells"].combine_chunks()
        asker = np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        asked = lists.flatten().to_numpy(zero_copy_only=False)
        asker, asked = asker[by := np.argsort(asked, kind="stable")], asked[by]
        hit = np.zeros((len(q), len(m)), bool)
        for c in np.unique(cell):  # only cells that the traversal has come to
            i, j = asker[slice(*np.searchsorted(asked, (c, c + 1)))], np.flatnonzero(cell == c)
            if len(i):
                near = q[i] @ m[j].T >= cosine
                hit[np.ix_(i, j)] = near & ((own[i] < c)[:, None] | ((own[i] == c)[:, None] & (q_id[i][:, None] < m_id[j])))
        some_q, some_m = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(some_q):
            return schema.empty_table()
        hit, q_id, m_id, q_n, m_n = hit[np.ix_(some_q, some_m)], q_id[some_q], m_id[some_m], q_n[some_q], m_n[some_m]
        ids = np.concatenate([q_id, m_id])
        n = np.concatenate([hit @ m_n, q_n @ hit])
        # local components: repeatedly take the least label among a vector's partners
        label_q, label_m = q_id.copy(), m_id.copy()
        top = np.iinfo(np.int64).max
        while True:
            new_m = np.minimum(label_m, np.where(hit, label_q[:, None], top).min(0))
            new_q = np.minimum(label_q, np.where(hit, new_m, top).min(1))
            if (new_m == label_m).all() and (new_q == label_q).all():
                break
            label_q, label_m = new_q, new_m
        keep = n > 0
        return pa.table([ids[keep], np.concatenate([label_q, label_m])[keep], n[keep]], schema=schema)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                 sample: int = 20_000, per_cell: int = 128, target_recall: float = 0.9999, seed: int = 5) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    n_links counts the other rows whose cosine is at least `cosine`; component_id is the smallest vec_id reachable
    by links.  Codebooks are fitted on a hash sample of about `sample` vectors (all, if there are fewer); all vectors are filed and searched.  Vectors that are
    null, empty, zero, hold null or non-finite components, or differ in length from the commonest length (the
    shorter on ties) link with nothing.  Equal vectors are searched once and counted as often as they occur.  Rows with
    a null vec_id link with nothing and have a null component.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(kind).alias("vec"))
    sound = (F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)), F.lit(False))
             & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)))
    good = rows.where(sound)
    length = good.groupBy(F.size("vec").alias("k")).count().orderBy(F.desc("count"), "k").head()
    if length is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = good.where(F.size("vec") == length["k"])
    distinct = cut(good.groupBy("vec").agg(F.min("vec_id").alias("rid"), F.count("*").alias("copies")), "vectors")
    n = distinct.count()
    share = int(1_000_000_000 * min(1.0, sample / n))
    taken = distinct.select("vec").where(F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(1_000_000_000)) < share).toArrow()
    if not taken.num_rows:
        taken = distinct.select("vec").limit(1).toArrow()
    x = _unit(taken["vec"])
    half = x.shape[1] // 2
    size = int(min(1024, max(2, round((n / per_cell) ** 0.5))))
    books = [_codebook(x[:, :half], size, seed), _along(_codebook(x[:, half:], size, seed + 1))]
    bound = _bound(x, books, cosine, target_recall, seed)
    wide = len(books[1])

    def filed(batches):
        for batch in batches:
            if batch.num_rows:
                v = _unit(batch.column(1))
                cell = _nearest(v[:, :half], books[0]) * wide + _nearest(v[:, half:], books[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int64))],
                                                 names=["rid", "vec", "copies", "cell"])

    index = cut(distinct.select("rid", "vec", "copies").mapInArrow(filed, f"rid bigint, vec {kind}, copies bigint, cell bigint"), "index")
    # cells of one first codeword after another, as long as they hold about MEMBERS, make a page, named by its first cell
    before = Window.partitionBy("row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = index.groupBy("cell").agg(F.count("*").alias("n")).withColumn("row", F.floor(F.col("cell") / F.lit(wide)))
    cells = cells.withColumn("_p", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(MEMBERS)))
    cells = cut(cells.withColumn("page", F.min("cell").over(Window.partitionBy("row", "_p"))).select("cell", "page", "n"), "cells")
    known = cells.select("cell", "page").toArrow()  # a row for each cell, at most 1024 x 1024
    page_of = np.full(len(books[0]) * wide, -1)
    page_of[known["cell"].to_numpy()] = known["page"].to_numpy()

    def probes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(batch.column(1))
            own = batch.column(3).to_numpy()
            first, second = _bisectors(v[:, :half], books[0])[1], _bisectors(v[:, half:], books[1])[1]
            who, where = [], []
            for k in range(len(v)):
                i, j = _visits(first[k], second[k], bound)
                cells = i * wide + j
                cells = cells[(cells > own[k]) & (page_of[cells] >= 0)]  # a link between two cells is found from the lesser one
                who.append(np.full(len(cells) + 1, k))
                where.append(np.append(own[k], cells))
            who, where = np.concatenate(who), np.concatenate(where)
            page = page_of[where]
            order = np.lexsort((page, who))
            who, where, page = who[order], where[order], page[order]
            # a vector goes to a page once, with the cells it visits there
            starts = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (page[1:] != page[:-1])]))
            ends = np.append(starts[1:], len(who))
            for at in range(0, len(starts), 8192):
                some = slice(at, at + 8192)
                low, high = starts[at], ends[some][-1]
                part = batch.take(pa.array(who[starts[some]]))
                visited = pa.ListArray.from_arrays(pa.array(np.append(starts[some], high) - low, pa.int32()), pa.array(where[low:high].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(page[starts[some]].astype(np.int64)), visited],
                                                 names=["rid", "vec", "copies", "own", "page", "cells"])

    visits = cut(index.mapInArrow(probes, f"rid bigint, vec {kind}, copies bigint, own bigint, page bigint, cells array<bigint>"), "visits")
    blocks = cells.groupBy("page").agg(F.ceil(F.sum("n") / (2 * MEMBERS)).cast("int").alias("m_blocks"))
    blocks = cut(blocks.join(visits.groupBy("page").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks")), "page"), "blocks")

    def spread(df, own_blocks, other_blocks, own, other):
        """Each row in one block of its own kind, once for every block of the other kind."""
        return (df.join(blocks, "page")
                .withColumn(own, F.pmod(F.xxhash64("rid"), F.col(own_blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).drop("m_blocks", "q_blocks"))

    members = spread(index.join(cells.select("cell", "page"), "cell"), "m_blocks", "q_blocks", "m", "q")
    queries = spread(visits, "q_blocks", "m_blocks", "q", "m")
    key = ["page", "m", "q"]
    found = cut(queries.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(_linked(cosine), "node bigint, root bigint, n bigint"), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    groups = (distinct.select("vec", "rid", "copies").join(counts, F.col("rid") == F.col("node"), "left").drop("node")
              .join(parts, F.col("rid") == F.col("node"), "left")
              .select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rid").alias("component_id")))
    members_out = good.join(groups, "vec").select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.coalesce(sound, F.lit(False)) | (F.size("vec") != length["k"])).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members_out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
