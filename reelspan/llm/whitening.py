"""Whitening of embeddings: principal components by a randomised range finder over all rows.

Vectors become whole numbers (256ths), of which each distinct one counts once: the fit list. A random basis,
wider than the components asked for, is sent through the covariance of the fit list several times: each pass
multiplies all centred rows, task by task, and adds the tasks' small matrices in rounds. Rayleigh-Ritz in that basis gives
eigenvalues, vectors and residuals. Where a residual says that some vector isn't right to double precision, the basis becomes the
full dimension, whose single pass gives the covariance itself.

Only matrices of (dimensions x basis) meet on the driver; rows never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspan.llm.common import Scratch, map_arrow

#: Components; further basis vectors; passes before the basis becomes the full dimension.
COMPONENTS, OVERSAMPLING, POWER_PASSES = 4, 8, 6
#: Levels of a whole number; the largest value that an entry may become.
LEVELS, MOST_LEVEL = 256, 1 << 62
#: A vector's error that the residuals may leave, and the eigenvalue, in parts of the largest, that counts as none.
MOST_ERROR, LEAST_VALUE = 1e-12, 1e-12
#: Matrices that one task adds up, rows that are multiplied at once, seed of the random basis.
FAN_IN, ROWS, SEED = 64, 4096, 20_240_501
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def levels(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors as whole numbers. Null vectors and such with null or non-finite entries go; entries
    beyond 2^62 in size become that. Vectors of another length than most have (of equally many, the greater
    length) have no place in a covariance and go too, as do empty ones."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    whole = lambda c: F.floor(F.greatest(F.least(c * LEVELS, F.lit(float(MOST_LEVEL))), F.lit(-float(MOST_LEVEL)))).cast("long")
    good = df.where(fine).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, whole).alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size("x") == (sizes["d"] if sizes else 0))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices of long numbers."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    grid = flat.reshape(len(lists), -1)
    for i in range(0, len(grid), ROWS):
        yield grid[i : i + ROWS]


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors the fit list has, and their sums in each dimension, both exact."""

    def run(batches):
        n, sums = 0, None
        for batch in batches:
            for grid in matrices(batch, 0) if batch.num_rows else ():
                small = int(np.abs(grid).max(initial=0)) < (1 << 62) // ROWS
                part = grid.sum(axis=0) if small else grid.astype(object).sum(axis=0)
                part = np.array([int(p) for p in part], object)
                n, sums = n + len(grid), part if sums is None else sums + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([str(s) for s in sums])], names=["i", "n", "s"])

    parts = map_arrow(fit.select("x"), run, "i int, n long, s string")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).collect()  # one row a dimension
    sums = {r["i"]: int(r["s"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [sums[i] for i in range(len(sums))]


def summed(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``work(x)`` over all vectors x of the fit list, whose tasks get some thousand of them at once as a
    matrix. Tasks add up their own; their sums are added FAN_IN at a time, in rounds, until one is left."""

    def one(total):
        return pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["m"])

    def multiply(batches):
        total = None
        for batch in batches:
            for grid in matrices(batch, 0) if batch.num_rows else ():
                part = work(grid)
                total = part if total is None else total + part
        if total is not None:
            yield one(total)

    def add(batches):
        total = None
        for batch in batches:
            for m in batch.column(0):
                part = np.frombuffer(m.as_buffer(), "<f8")
                total = part.copy() if total is None else total + part
        if total is not None:
            yield one(total)

    vectors = fit.select("x")
    tasks, parts = vectors.rdd.getNumPartitions(), map_arrow(vectors, multiply, "m binary")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = map_arrow(parts.repartition(tasks), add, "m binary")
    found = parts.collect()  # one matrix
    return np.frombuffer(found[0]["m"], "<f8").reshape(shape) if found else np.zeros(shape)


def ritz(basis: np.ndarray, image: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling) and vectors of the covariance within a basis and its image under the covariance, and the largest
    error of the first ``k`` vectors that their residuals allow."""
    small = basis.T @ image
    e, u = np.linalg.eigh((small + small.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    vectors = basis @ u
    residual = np.linalg.norm(image @ u - vectors * e, axis=0)
    worst = 0.0
    for j in range(min(k, len(e))):
        if e[j] > LEAST_VALUE * e[0]:
            gap = min((abs(e[j] - x) for i, x in enumerate(e) if i != j), default=e[j])
            worst = max(worst, residual[j] / max(gap, np.finfo(float).tiny))
    return e, vectors, worst


def components(fit: DataFrame, n: int, mean: np.ndarray, k: int = COMPONENTS, passes: int = POWER_PASSES) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues (falling) and unit vectors (columns) of the ``k`` first components of the fit list, fewer where
    the covariance has fewer. Vectors are right to MOST_ERROR, from a narrow basis if its residuals say so, or
    else from the full one."""
    d, width = len(mean), k + OVERSAMPLING

    def through(basis):
        return lambda grid: (c := grid - mean).T @ (c @ basis)

    errors: list[float] = []
    basis, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, min(width, d))))
    while width < d and len(errors) < passes:
        image = summed(fit, through(basis), basis.shape) / n
        e, vectors, worst = ritz(basis, image, k)
        errors.append(worst)
        if worst <= MOST_ERROR:
            break
        if len(errors) > 1 and worst * (worst / errors[-2]) ** (passes - len(errors)) > MOST_ERROR:
            break  # the passes that are left can't do it
        basis, _ = np.linalg.qr(image)
    if not errors or errors[-1] > MOST_ERROR:
        covariance = summed(fit, lambda grid: (c := grid - mean).T @ c, (d, d)) / n
        e, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        e, vectors = e[::-1], vectors[:, ::-1]
    keep = int(np.count_nonzero(e[:k] > LEAST_VALUE * max(e[0], 0.0)))
    return e[:keep], vectors[:, :keep]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, passes: int = POWER_PASSES) -> DataFrame:
    """For each row with a usable vector (see ``levels``) and each of the ``k`` first components of the distinct vectors: vec_id,
    component (from 1), n (distinct vectors), deviation (sum over dimensions of (n x - S)^2, exact; null where a long can't
    hold it), whitened (the centred vector's part along the component, over the square root of its eigenvalue), explained
    (eigenvalue over trace) and identity_error (largest difference between the covariance of whitened distinct vectors and the identity).

    Repeated rows each have their rows, a null key stays null, other columns are not read. A component without
    variance has no rows, so a table of one distinct vector gives none, as does an empty table.
    """
    spark = df.sparkSession
    good = levels(df, key, vector)
    fit = Scratch(spark, "whitening").keep(good.select("x").distinct(), "fit")
    n, sums = exact_sums(fit)
    none = spark.createDataFrame([], RESULT)
    if not n:
        return none
    mean = np.array([s / n for s in sums])
    e, vectors = components(fit, n, mean, k, passes)
    if not len(e):
        return none
    trace = float(summed(fit, lambda grid: np.array([np.square(grid - mean).sum()]), (1,))[0]) / n
    scaled = vectors / np.sqrt(e)

    def whitened_sums(grid):
        w = (grid - mean) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    moments = summed(fit, whitened_sums, (len(e) + 1, len(e))) / n
    error = float(np.abs(moments[:-1] - np.outer(moments[-1], moments[-1]) - np.eye(len(e))).max())
    explained = (e / trace).tolist()

    def run(batches):
        for batch in batches:
            done = 0
            for grid in matrices(batch, 1) if batch.num_rows else ():
                ids = batch.column(0).slice(done, len(grid))
                done += len(grid)
                far = deviations(grid, n, sums)
                w = (grid - mean) @ scaled
                for j in range(len(e)):
                    fixed = [pa.array(np.full(len(grid), x)) for x in (explained[j], error)]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(len(grid), j + 1, np.int32)), pa.array(np.full(len(grid), n, np.int64)), far, pa.array(np.ascontiguousarray(w[:, j])), *fixed],
                        names=[c.split()[0] for c in RESULT.split(", ")],
                    )

    return map_arrow(good, run, RESULT)


def deviations(grid: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum over dimensions of (n x - S)^2 of each row, exact; null where a long can't hold it."""
    most = n * int(np.abs(grid).max(initial=0)) + max(abs(s) for s in sums)
    if most * most * grid.shape[1] < 1 << 63:
        return pa.array(np.square(grid * n - np.array(sums, np.int64)).sum(axis=1))
    exact = np.square(grid.astype(object) * n - np.array(sums, object)).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
