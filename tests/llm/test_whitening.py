"""Whitening against exact arithmetic and a full decomposition by numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from reelspan.llm import whitening
from reelspan.llm.common import Scratch

CLASH = "x string, component string, n string, deviation string"


def brute(rows):
    """rows: (vec_id, vector); (fit list, eigenvalues, vectors, per row deviation and whitened values)."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    centred = np.array(fit, float) - mean
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        out.setdefault(i, []).append((deviation, (np.array(x, float) - mean) @ u[:, :4] / np.sqrt(np.maximum(e[:4], 1e-300))))
    return n, e, out


def check(rows, got, k=4):
    n, e, out = brute(rows)
    found = {}
    for r in got:
        found.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(found) == len(out) * k and len(got) == k * sum(map(len, out.values()))
    for c in range(k):
        want = np.array([w[c] for i in sorted(out) for _, w in sorted(out[i], key=lambda x: x[0])])
        have = np.array([r["whitened"] for i in sorted(out) for r in sorted(found[i, c + 1], key=lambda r: r["deviation"])])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8
        assert all(abs(r["explained"] / (e[c] / e.sum()) - 1) < 1e-9 for r in found[sorted(out)[0], c + 1])
    for (i, _), rs in found.items():
        assert sorted(r["deviation"] for r in rs) == sorted(d for d, _ in out[i])
        assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in rs)


def test_whole_table_equals_the_full_decomposition(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    check([(r["vec_id"], r["embedding"]) for r in df.collect()], whitening.whiten(df).collect())


def test_a_narrow_basis_suffices_where_values_fall_fast(spark, monkeypatch):
    """The residuals decide: with some strong components no pass of full dimension runs; without, one does."""
    rng, shapes, inner = np.random.default_rng(4), [], whitening.summed
    monkeypatch.setattr(whitening, "summed", lambda fit, work, shape: shapes.append(shape) or inner(fit, work, shape))
    strong = rng.standard_normal((500, 40)) * np.array([90.0, 70, 50, 30, *[0.05] * 36])
    for vectors, full in ((strong, False), (rng.standard_normal((500, 40)), True)):
        shapes.clear()
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
        check(rows, whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect())
        assert ((40, 40) in shapes) == full and (40, 12) in shapes


def test_odd_rows(spark):
    """Nulls, non-finite entries, repeated rows and vectors, other lengths, clashing columns, few dimensions."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(40)]
    rows += [(50, rows[0][1]), (51, rows[0][1]), (3, rows[3][1]), (None, rows[4][1]), (60, [0.001 + c for c in rows[5][1]])]
    bad = [(70, None), (71, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (72, [float("nan")] * 6), (73, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (74, []), (75, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, *"????") for i, v in rows + bad], f"vec_id long, embedding array<double>, {CLASH}")
    check([(-1 if i is None else i, v) for i, v in rows], [r.asDict() | {"vec_id": -1 if r["vec_id"] is None else r["vec_id"]} for r in whitening.whiten(df).collect()])
    assert whitening.whiten(df.where("vec_id >= 70 and vec_id < 75")).count() == 0 and whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id in (0, 50, 51)")).count() == 0  # one distinct vector: no variance
    assert {r["component"] for r in whitening.whiten(df.where("vec_id in (0, 1, 50)")).collect()} == {1}
    assert {r["component"] for r in whitening.whiten(df.where("vec_id = 75").union(df.where("vec_id = 75").withColumn("embedding", df["embedding"]))).collect()} == set()


def test_sums_and_deviations_are_exact(spark):
    big = [(i, [float(2**40 + i), -float(3**20) * i, 1e300]) for i in range(50)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    fit = Scratch(spark, "fit-test").keep(whitening.levels(df).select("x").distinct(), "fit")
    n, sums = whitening.exact_sums(fit)
    assert n == 50 and sums == [sum(256 * (2**40 + i) for i in range(50)), -sum(256 * 3**20 * i for i in range(50)), 50 * 2**62]
    grid = np.array([[3, -4], [10**9, 7]])
    assert whitening.deviations(grid, 10, [5, 6]).to_pylist() == [25**2 + 46**2, None if (10**10 - 5) ** 2 + 64**2 >= 2**63 else (10**10 - 5) ** 2 + 64**2]
    assert whitening.deviations(grid, 3, [5, 6]).to_pylist() == [16 + 18**2, (3 * 10**9 - 5) ** 2 + 15**2]


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_matrices_are_added_in_rounds(spark, parts):
    fit = spark.range(1000, numPartitions=parts).selectExpr("array(id, -id) AS x")
    got = whitening.summed(fit, lambda grid: grid.T @ grid * 1.0, (2, 2))
    total = sum(i * i for i in range(1000))
    assert got.tolist() == [[total, -total], [-total, total]]
