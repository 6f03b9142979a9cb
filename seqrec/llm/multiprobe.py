"""Nearest neighbours by inner product through multiprobe p-stable hashing.

Vectors are put on the unit sphere (scaled by the longest; the missing length goes to one further component), where the largest inner
product is the smallest distance.  Each of several tables hashes them by functions floor((a.x + b) / w) with normal
directions a; a bucket is one value of all functions.  For a neighbour at a wanted nearness c of a query q, a.x is
normal around c * a.q, so the chance that it lies in a bucket is a product over the functions.  A query visits buckets in falling order of
their estimated success (this chance against the chance of any vector to lie there, that is, hits for each member read) until the buckets visited would
hold the neighbour with a wanted probability, the least at which queries of a bounded sample find the target share of theirs.  The order is kept as a
threshold, so empty buckets cost nothing; buckets that agree in the first functions make a page, and a query goes only to pages that
can hold a bucket above its threshold.  Candidates of all tables are merged and ranked by their exact inner products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqrec.llm.ship import ship
from seqrec.llm.vectors import doubles, finite, lists, matrix, of_commonest_length
from seqrec.session import cut

#: Members and queries that meet in one task at once.
MEMBERS, QUERIES = 8192, 2048
#: Draws behind a query's threshold, and rows of scores held at once.
DRAWS, CHUNK = 400, 256
#: A bit more than rounding can move an inner product of unit vectors.
_SLACK = 1e-12


def _below(z: np.ndarray) -> np.ndarray:
    """Normal distribution function, to 1e-7 (the series of Abramowitz and Stegun, 7.1.26)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x) / 2
    return np.where(z < 0, tail, 1 - tail)


class Tables:
    """The hash functions of all tables, and what a bounded sample says of their values."""

    def __init__(self, sample: np.ndarray, longest: float, n: int, nearest: int, tables: int, target_recall: float, width: float, page_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.longest, self.tables, self.width = longest, tables, width
        self.functions = k = max(1, round(0.7 * math.log2(max(2, n))))
        self.first = min(k, max(0, round(math.log2(max(1, n / page_rows)) / 1.5)))
        x = self.members(sample)
        dims = x.shape[1]
        # directions at right angles in blocks: each is still normal, and together they see more of a vector
        blocks = [np.linalg.qr(rng.normal(size=(dims, dims)))[0].T for _ in range(-(-tables * k // dims))]
        self.a = (np.concatenate(blocks)[:tables * k] * np.sqrt(rng.chisquare(dims, size=(tables * k, 1)))).reshape(tables, k, dims)
        self.b = rng.uniform(0, width, (tables, k))
        self.draws = rng.normal(size=(DRAWS, k))
        raw = np.floor((np.einsum("nd,tkd->tnk", x, self.a) + self.b[:, None]) / width).astype(np.int64)
        self.low, self.high = raw.min(1), raw.max(1)  # values outside belong to the outermost slots
        self.slots = int((self.high - self.low).max()) + 1
        share = np.zeros((tables, k, self.slots))
        for t in range(tables):
            for j in range(k):
                share[t, j] = np.bincount(raw[t, :, j] - self.low[t, j], minlength=self.slots)
        self.log_share = np.log((share + 0.5) / (len(x) + 0.5 * self.slots))
        self.near, self.success = 0.0, 1.0
        self._calibrate(sample, n, nearest, target_recall, rng)

    def _calibrate(self, sample: np.ndarray, n: int, nearest: int, target_recall: float, rng) -> None:
        """Nearness of wanted neighbours, and the least success at which sampled queries find the wanted share of theirs.

        The `nearest` of all vectors are about the first (nearest * share) of the sample; a sample too small for that gives
        its own nearest, which lies farther off and makes queries visit more than they need.  The nearness is the cosine on the sphere that nine tenths of the
        sampled queries' last wanted neighbours reach."""
        taken = rng.permutation(len(sample))[:256]
        q, rank = self.queries(sample[taken]), min(max(1, round(nearest * len(sample) / n)), len(sample) - 1)
        if not rank or target_recall >= 1:
            return
        members = self.members(sample)
        s = q @ members.T
        s[np.arange(len(q)), taken] = -np.inf
        wanted = np.argsort(-s, axis=1, kind="stable")[:, :rank]
        self.near = float(np.clip(np.quantile(np.take_along_axis(s, wanted[:, -1:], 1), 0.1), 0.0, 0.999))
        drawn, held = [], []
        for t in range(self.tables):
            scores = self.scores(q, t)
            slots = self.values(members[wanted.reshape(-1)], t).reshape(*wanted.shape, -1)
            drawn.append(self._drawn(q, t, scores))
            held.append(sum(np.take_along_axis(scores[:, j], slots[:, :, j], 1) for j in range(self.functions)))
        for success in (*np.arange(0.05, 0.9, 0.025), *np.arange(0.9, 0.998, 0.0075)):
            found = np.zeros(wanted.shape, bool)
            for totals, own in zip(drawn, held):
                found |= own >= self._least(totals, success)[:, None]
            if found.mean() >= target_recall:
                self.success = float(success)
                return

    def members(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))[:, None]], 1)

    def queries(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return np.concatenate([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))], 1)

    def values(self, members: np.ndarray, t: int) -> np.ndarray:
        """Slots of all functions of one table, from 0."""
        raw = np.floor((members @ self.a[t].T + self.b[t]) / self.width)
        return (np.clip(raw, self.low[t], self.high[t]) - self.low[t]).astype(np.int64)

    def pages(self, slots: np.ndarray) -> np.ndarray:
        page = np.zeros(len(slots), np.int64)
        for j in range(self.first):
            page = page * self.slots + slots[:, j]
        return page

    def scores(self, queries: np.ndarray, t: int) -> np.ndarray:
        """(query, function, slot): log of a neighbour's chance to lie there, less that of any vector."""
        mean = self.near * (queries @ self.a[t].T)
        deviation = math.sqrt(1 - self.near ** 2)
        edges = (np.arange(1, self.slots) + self.low[t][:, None]) * self.width - self.b[t][:, None]
        z = np.where(np.arange(1, self.slots) > (self.high - self.low)[t][:, None], np.inf, edges)[None]
        below = _below((z - mean[:, :, None]) / deviation)
        chance = np.diff(np.concatenate([np.zeros_like(mean)[..., None], below, np.ones_like(mean)[..., None]], 2), axis=2)
        return np.log(np.maximum(chance, 1e-12)) - self.log_share[t][None]

    def thresholds(self, queries: np.ndarray, t: int, scores: np.ndarray) -> np.ndarray:
        """Least score of the buckets to visit, so that they hold the wanted share of drawn neighbours."""
        return self._least(self._drawn(queries, t, scores), self.success)

    @staticmethod
    def _least(totals: np.ndarray, success: float) -> np.ndarray:
        if success >= 1:
            return np.full(len(totals), -np.inf)
        return np.quantile(totals, 1 - success, axis=1, method="lower") - 1e-9

    def _drawn(self, queries: np.ndarray, t: int, scores: np.ndarray) -> np.ndarray:
        """(query, draw): score of the bucket in which a drawn neighbour lies."""
        drawn = self.near * (queries @ self.a[t].T)[:, None] + math.sqrt(1 - self.near ** 2) * self.draws[None]
        slot = (np.clip(np.floor((drawn + self.b[t]) / self.width), self.low[t], self.high[t]) - self.low[t]).astype(np.int64)
        total = np.zeros(slot.shape[:2])
        for j in range(self.functions):
            total += np.take_along_axis(scores[:, j], slot[:, :, j], 1)
        return total

    def visited_pages(self, scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, page) of the pages that may hold a bucket at or above the query's threshold."""
        rest = scores[:, self.first:].max(2).sum(1)
        who, page, sum_ = np.arange(len(scores)), np.zeros(len(scores), np.int64), np.zeros(len(scores))
        best = scores.max(2)
        for j in range(self.first):
            open_ = rest + best[:, j + 1:self.first].sum(1)
            sum_ = (sum_[:, None] + scores[who, j]).ravel()
            page = (page[:, None] * self.slots + np.arange(self.slots)).ravel()
            who = np.repeat(who, self.slots)
            kept = sum_ + open_[who] >= least[who]
            who, page, sum_ = who[kept], page[kept], sum_[kept]
        if not self.first:
            kept = rest >= least
            who, page = who[kept], page[kept]
        return who, page


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed in the order of the components whatever the number of pairs."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * m[:, d]
    return total


def _search(tables: Tables | None, nearest: int):
    """The nearest visited members of one block of queries in one block of members of a page; without tables all are visited."""
    schema = pa.schema([("query", pa.int64()), ("members", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q, m = matrix(left["vec"]), matrix(right["vec"])
        ids, member = left["gid"].to_numpy(), right["gid"].to_numpy()
        by = np.argsort(member, kind="stable")
        m, member = m[by], member[by]
        out_q, out_m, out_s = [], [], []
        if tables is not None:
            t = int(key[0].as_py()) % tables.tables
            slots, bucket = np.unique(tables.values(tables.members(m), t), axis=0, return_inverse=True)
            bucket = bucket.reshape(-1)
            least = left["least"].to_numpy()
            unit = tables.queries(q)
        for at in range(0, len(q), CHUNK):
            part = slice(at, at + CHUNK)
            columns = np.arange(len(m))
            if tables is not None:
                table = tables.scores(unit[part], t)
                score = np.zeros((len(table), len(slots)))
                for j in range(tables.functions):
                    score += table[:, j][:, slots[:, j]]
                visit = score >= least[part][:, None]
                columns = np.flatnonzero(visit.any(0)[bucket])
                if not len(columns):
                    continue
            s = q[part] @ m[columns].T
            if tables is not None:
                s[~visit[:, bucket[columns]]] = -np.inf
            k = min(nearest, len(columns))
            bound = np.partition(s, len(columns) - k, axis=1)[:, len(columns) - k]
            length = np.sqrt((q[part] ** 2).sum(1)) * math.sqrt((m * m).sum(1).max())
            i, j = np.nonzero((s >= (bound - _SLACK * length)[:, None]) & (s > -np.inf))
            exact = _products(q[part][i], m[columns[j]])
            order = np.lexsort((columns[j], -exact, i))
            i, j, exact = i[order], columns[j][order], exact[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            kept = (rank < nearest) | (exact == exact[np.minimum(np.searchsorted(i, i) + nearest - 1, len(i) - 1)])  # ties are settled by vec_id later
            i, j, exact = i[kept], j[kept], exact[kept]
            who, start = np.unique(i, return_index=True)
            ends = np.append(start, len(i)).astype(np.int32)
            out_q.append(pa.array(ids[part][who]))
            out_m.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(member[j])))
            out_s.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(exact)))
        if not out_q:
            return schema.empty_table()
        return pa.table([pa.chunked_array(c) for c in (out_q, out_m, out_s)], schema=schema)

    return run


def _meet(queries: DataFrame, index: DataFrame, tables: Tables | None, nearest: int) -> DataFrame:
    """(query, member, score): the nearest members of every query that meets them in a page.

    Pages above MEMBERS rows, or with more than QUERIES queries, are cut into blocks by hash, and every block of queries meets every block of members."""
    m = index.groupBy("page").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m_blocks"))
    q = queries.groupBy("page").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q_blocks"))
    blocks = cut(m.join(q, "page"), "blocks")

    def spread(df, own_blocks, other_blocks, own, other):
        return (df.join(blocks, "page").withColumn(own, F.pmod(F.xxhash64("gid"), F.col(own_blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).drop("m_blocks", "q_blocks"))

    key = ["page", "m", "q"]
    found = (spread(queries, "q_blocks", "m_blocks", "q", "m").groupBy(*key)
             .cogroup(spread(index, "m_blocks", "q_blocks", "m", "q").groupBy(*key))
             .applyInArrow(_search(tables, nearest), "query bigint, members array<bigint>, scores array<double>"))
    return found.select("query", F.inline(F.arrays_zip("members", "scores"))).toDF("query", "member", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = 20,
                       query_where: str = "vec_id % 20 = 0", tables: int = 2, target_recall: float = 0.95, width: float = 2.5, sample: int = 20_000,
                       page_rows: int = 16_384, seed: int = 12, info: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its `nearest` rows of largest inner product among the visited, ties to smaller vec_id.

    Queries are the rows for which `query_where` holds of their vec_id; candidates are all other rows.  Every vector is in every table; what is
    fitted on a hash sample of about `sample` vectors (all, if there are fewer) are the nearness of wanted neighbours, how full slots are and how far queries must go for `target_recall`; at 1
    every bucket is visited.  A query that its visits leave with fewer than `nearest` candidates
    is searched again over all vectors in blocks, so it gets all there are.

    Vectors that are null, empty, zero, hold null or non-finite components, have a null vec_id, or differ in length from the commonest (the shorter on
    ties) take no part.  Equal vectors are stored once with their least nearest + 1 ids, which are all that a result can
    hold; rows of equal id are rows of their own.  Other columns are ignored.  An empty table gives an empty result.
    `info` receives the measured nearness and the shape of the tables.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), doubles(vector_col).alias("vec"))
    good = rows.where(F.col("vec_id").isNotNull() & finite() & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False)))
    good, dims = of_commonest_length(good)
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    if not dims:
        return empty
    good = good.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    ids = good.withColumn("place", place).where(F.col("place") <= nearest + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    groups = cut(ids.select(F.monotonically_increasing_id().alias("gid"), "vec", "ids"), "vectors")
    asked = cut(good.where(query_where).join(groups.select("gid", "vec"), "vec").select(F.col("vec_id").alias("query_id"), "gid"), "asked")
    if asked.isEmpty():
        return empty
    big = F.aggregate("vec", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    norm = big * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / big) * (x / big)))
    whole = groups.agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.sum(F.size("ids")).alias("rows")).head()
    share = int(1_000_000_000 * min(1.0, sample / whole["n"]))
    taken = groups.select("vec").where(F.pmod(F.xxhash64("gid", F.lit(seed)), F.lit(1_000_000_000)) < share).toArrow()
    if not taken.num_rows:
        taken = groups.select("vec").limit(1).toArrow()
    hashes = Tables(matrix(taken["vec"]), whole["longest"] * (1 + 1e-12), whole["n"], nearest, tables, target_recall, width, page_rows, seed)
    if info is not None:
        info.update(vectors=whole["n"], nearness=hashes.near, success=hashes.success, functions=hashes.functions, slots=hashes.slots, page_functions=hashes.first)

    def filed(batches):
        for batch in batches:
            if batch.num_rows:
                x = hashes.members(matrix(batch.column(1)))
                for t in range(hashes.tables):
                    page = hashes.pages(hashes.values(x, t)) * hashes.tables + t
                    yield pa.RecordBatch.from_arrays([pa.array(page), batch.column(0), batch.column(1)], names=["page", "gid", "vec"])

    def probes(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                unit = hashes.queries(matrix(part.column(1)))
                for t in range(hashes.tables):
                    scores = hashes.scores(unit, t)
                    least = hashes.thresholds(unit, t, scores)
                    who, page = hashes.visited_pages(scores, least)
                    rows_ = part.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([pa.array(page * hashes.tables + t), rows_.column(0), rows_.column(1), pa.array(least[who])],
                                                     names=["page", "gid", "vec", "least"])

    index = cut(groups.select("gid", "vec").mapInArrow(filed, "page bigint, gid bigint, vec array<double>"), "index")
    searched = cut(groups.join(asked.select("gid").distinct(), "gid", "left_semi").select("gid", "vec"), "searched")
    visits = cut(searched.mapInArrow(probes, "page bigint, gid bigint, vec array<double>, least double"), "visits")
    found = cut(_best(_meet(visits, index, hashes, nearest + 1), groups, nearest + 1), "found")
    wanted = min(nearest + 1, whole["rows"])
    full = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= wanted)
    short = cut(searched.join(full, F.col("gid") == F.col("query"), "left_anti"), "short")
    if not short.isEmpty():
        everywhere = _meet(short.withColumn("page", F.lit(0).cast("bigint")), groups.select(F.lit(0).cast("bigint").alias("page"), "gid", "vec"), None, nearest + 1)
        again = cut(_best(everywhere, groups, nearest + 1), "again")
        found = found.join(short.select(F.col("gid").alias("query")), "query", "left_anti").unionByName(again)
    # a query is not its own neighbour: of its row's id the first place in its own vector's list is dropped
    own = (F.col("member") == F.col("query")) & (F.col("vec_id") == F.col("query_id")) & F.col("first")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    numbered = asked.withColumn("row", F.monotonically_increasing_id())
    return (numbered.join(found, F.col("gid") == F.col("query")).where(~own).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score"))


def _best(met: DataFrame, groups: DataFrame, nearest: int) -> DataFrame:
    """(query, member, vec_id, first, score): each query's best rows over all tables; `first`: the first of equal ids of a member."""
    once = met.groupBy("query", "member").agg(F.max("score").alias("score"))
    # of vectors that tie, the smallest ids count, so a vector stands for its least id here
    by = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    least = groups.select(F.col("gid").alias("member"), "ids", F.col("ids")[0].alias("least"))
    kept = once.join(least, "member").withColumn("place", F.row_number().over(by)).where(F.col("place") <= nearest)
    spread = kept.select("query", "member", "score", "ids", F.posexplode("ids").alias("at", "vec_id"))
    spread = spread.withColumn("first", F.array_position("ids", F.col("vec_id")) == F.col("at") + 1)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", F.desc("first"))
    return (spread.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nearest)
            .select("query", "member", "vec_id", "first", "score"))
