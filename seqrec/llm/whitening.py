"""Whitening of vectors by spectral divide and conquer with QDWH polar decompositions.

Components become integers floor(scale * c).  Number, sums and covariance are of the distinct integer vectors and are summed where
these lie; only sums of one row per dimension reach the driver.  There the covariance V, a matrix as
wide as the vectors, is split: the polar factor U of V - sI, by dynamically weighted Halley iterations,
gives the projector (U + I) / 2 on the eigenvectors above s; an orthonormal basis of either side makes two smaller
problems, which are split in turn until single components are left.  Tasks then project every row on them.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqrec.llm.ship import ship
from seqrec.llm.vectors import doubles, finite, lists, matrix, of_commonest_length
from seqrec.session import cut

_EPS = np.finfo(np.float64).eps
#: Partial matrices that one group adds.
FAN = 256


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations (QDWH)."""
    size = np.linalg.norm(a)
    if not size:
        return np.zeros_like(a)
    x, low = a / size, _EPS  # a lower bound of the smallest singular value; smaller ones do not tell a side
    identity = np.eye(len(a))
    for _ in range(40):
        d = (4 * (1 - low * low) / low ** 4) ** (1 / 3) if low < 1 else 0.0
        root = math.sqrt(1 + d)
        h = root + math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q = np.linalg.qr(np.concatenate([math.sqrt(c) * x, identity]))[0]
            new = b / c * x + (h - b / c) / math.sqrt(c) * q[:len(a)] @ q[len(a):].T
        else:
            lower = np.linalg.cholesky(identity + c * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            new = b / c * x + (h - b / c) * np.linalg.solve(lower.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        moved, x = np.linalg.norm(new - x), new
        if moved <= _EPS ** (1 / 3) * 1e-3 and 1 - low <= 1e-8 or moved <= 4 * _EPS * len(a):
            break
    return x


def split(a: np.ndarray, size: float, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below a shift; None if the matrix is a multiple of the identity in double precision.

    The shift is the median of the diagonal, which lies between the least and the largest eigenvalue.  Where an eigenvalue meets it, the polar
    factor does not tell the sides apart, and other shifts near it are tried."""
    n = len(a)
    middle = float(np.median(np.diag(a)))
    spread = np.linalg.norm(a - middle * np.eye(n))
    if spread <= 4 * _EPS * n * size:
        return None
    best = None
    for step in (0.0, 0.0137, -0.0219, 0.0731, -0.0897, 0.151, -0.173, 0.29, -0.31):
        u = polar(a - (middle + step * spread / math.sqrt(n)) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = projector @ rng.normal(size=(n, k))
        for _ in range(2):
            basis = projector @ np.linalg.qr(basis)[0]
        whole = np.linalg.qr(basis, mode="complete")[0]
        above, below = whole[:, :k], whole[:, k:]
        rest = np.linalg.norm(below.T @ a @ above)
        if best is None or rest < best[0]:
            best = rest, above, below
        if rest <= 64 * _EPS * n * size:
            break
    return best and best[1:]


def leading(a: np.ndarray, k: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors as columns; only parts that hold them are split."""
    rng = np.random.default_rng(seed)
    size = max(float(np.linalg.norm(a)), 1e-300)
    found: list[np.ndarray] = []
    stack = [np.eye(len(a))]
    while stack and len(found) < k:
        basis = stack.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        halves = split(part, size, rng) if len(part) > 1 else None
        if halves is None:
            found.extend(basis.T)
        else:
            stack += [basis @ halves[1], basis @ halves[0]]  # the upper side is split first
    v = np.array(found).T
    v = v / np.sqrt((v * v).sum(0))
    e = np.einsum("dk,de,ek->k", v, a, v)
    order = np.argsort(-e, kind="stable")[:k]
    return e[order], v[:, order]


def _added(partials: DataFrame) -> dict[int, list[float]]:
    """Sums of partial rows (i, part, value array): by FAN of them, then by row; the last step has one row for each i and FAN partitions."""
    def run(key, table):
        table = table.sort_by("part")
        total = np.zeros(0)
        for row in table["value"].to_pylist():
            total = np.array(row) if not len(total) else total + np.array(row)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["i", "part", "value"])

    schema = "i int, part int, value array<double>"
    once = partials.withColumn("fan", F.floor(F.col("part") / FAN).cast("int")).groupBy("i", "fan").applyInArrow(run, schema)
    twice = once.withColumn("fan", F.lit(0)).groupBy("i", "fan").applyInArrow(run, schema)
    return {r["i"]: r["value"] for r in twice.collect()}


def _deviations(x: np.ndarray, n: int, sums: list[int], wide: bool) -> np.ndarray:
    """n * x - S, exactly."""
    if wide:
        return n * x.astype(object) - np.array(sums, dtype=object)
    return n * x - np.array(sums, np.int64)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 4, scale: int = 256) -> dict | None:
    """What whitening needs, from the distinct integer vectors: n, sums, components (columns), eigenvalues, trace, identity_error.

    Null if no row remains.  Components whose eigenvalue is not above rounding (1e-13 of the largest) are left out: they have no
    variance to scale.  identity_error is the largest absolute entry of the whitened vectors' covariance less the identity, measured over all of them.
    """
    ship(vectors.sparkSession)
    rows, dims = _scaled(vectors.select(doubles(vector_col).alias("vec")), scale)
    if not dims:
        return None
    distinct = cut(rows.select("x").distinct(), "distinct")
    lows = F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v.cast("double"))))
    whole = distinct.agg(F.count("*").alias("n"), F.max(lows).alias("most")).head()
    n, most = whole["n"], int(whole["most"])
    wide = 4 * n * max(1, most) >= 1 << 62

    def sums(batches):
        total = [0] * dims
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), object if wide else np.int64)
                total = [a + int(b) for a, b in zip(total, x.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], names=["i", "s"])

    by = {r["i"]: int(r["s"]) for r in distinct.mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    total = [by[i] for i in range(dims)]

    def centred(batch) -> np.ndarray:
        return (_deviations(matrix(batch.column(0), np.int64), n, total, wide) / n).astype(np.float64)

    def products(project):
        """Partial sums of the products of centred vectors, one row for each dimension and partition."""
        def run(batches):
            from pyspark import TaskContext
            made = None
            for batch in batches:
                if batch.num_rows:
                    c = project(centred(batch))
                    made = c.T @ c if made is None else made + c.T @ c
            if made is not None:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array([part] * len(made), pa.int32()), lists(made, pa.float64())], names=["i", "part", "value"])

        got = _added(distinct.mapInArrow(run, "i int, part int, value array<double>"))
        return np.array([got[i] for i in range(len(got))]) / n

    v = products(lambda c: c)
    v = (v + v.T) / 2
    e, found = leading(v, min(components, dims))
    sound = e > max(1e-13 * float(e[0]), 0.0)
    e, found = e[sound], found[:, sound]
    trace = float(np.trace(v))
    error = 0.0
    if len(e):
        error = float(np.abs(products(lambda c: c @ (found / np.sqrt(e))) - np.eye(len(e))).max())
    return {"n": n, "sums": total, "components": found, "eigenvalues": e, "trace": trace, "identity_error": error, "dims": dims, "scale": scale, "wide": wide}


def _scaled(rows: DataFrame, scale: int, dims: int | None = None) -> tuple[DataFrame, int]:
    good = rows.where(finite())
    if dims is None:
        good, dims = of_commonest_length(good)
    else:
        good = good.where(F.size("vec") == dims)
    return good.withColumn("x", F.transform("vec", lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))).drop("vec"), dims


def whiten(vectors: DataFrame, model: dict | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation, whitened: one row per remaining input row; whitened has one number for each component of the model.

    Rows whose vector is null, empty, holds null or non-finite components or has another length than the model are left out; null and
    repeated ids stay.  deviation is the exact sum over dimensions of (n * x - S)^2, null beyond 38 digits.  Scaled components beyond the range of a long are
    set to its ends.  Other columns are ignored; without a model there are no rows.
    """
    schema = "vec_id bigint, deviation decimal(38,0), whitened array<double>"
    spark = vectors.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    ship(spark)
    rows, _ = _scaled(vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), doubles(vector_col).alias("vec")), model["scale"], model["dims"])
    n, sums, wide, dims = model["n"], model["sums"], model["wide"], model["dims"]
    to = model["components"] / np.sqrt(model["eigenvalues"])
    top = 10 ** 38

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _deviations(matrix(batch.column(1), np.int64), n, sums, wide)
                c = (d / n).astype(np.float64)
                if not wide and dims * int(np.abs(d).max()) ** 2 < 1 << 63:
                    square = [int(v) for v in (d * d).sum(1)]
                else:
                    square = [sum(int(v) ** 2 for v in row) for row in d]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Decimal(v) if v < top else None for v in square], pa.decimal128(38, 0)), lists(c @ to, pa.float64())],
                                                 names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
