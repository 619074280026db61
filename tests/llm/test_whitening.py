"""Whitening against dense eigenvectors, and the Lanczos process on its own."""

import math

import numpy as np
import pytest

from lodestack.llm import whitening
from lodestack.llm.queries import QUERIES
from tests import oracle

SCHEMA = "vec_id long, embedding array<double>, label string, n int"


def plain(vectors):
    """(x, deviations, eigenvalues, eigenvectors) of sound vectors by dense arithmetic."""
    dim = max(len(v) for v in vectors)
    x = [[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (dim - len(v))]] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    z = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    values, turn = np.linalg.eigh(z.T @ z / n)
    return z, deviations, values[::-1], turn[:, ::-1]


def check(rows, vectors, ids, count=8):
    z, deviations, values, turn = plain(vectors)
    n = len(vectors)
    assert len(rows) == n * count and {r.component for r in rows} == set(range(1, count + 1))
    whole = sum(deviations)
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / (whole / n**3)) <= 1e-10 * r.explained
    for c in range(count):
        want = z @ turn[:, c] / math.sqrt(values[c])
        got = sorted((str(r.vec_id), r.whitened) for r in rows if r.component == c + 1)
        pairs = [sorted((str(i), s * w) for i, w in zip(ids, want, strict=True)) for s in (1, -1)]
        assert any(all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-7 for a, b in zip(got, p, strict=True)) for p in pairs)
    assert sorted(r.deviation for r in rows if r.component == 1) == sorted(deviations)


def test_whitened_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 20)) @ np.diag(np.linspace(3, 0.2, 20)) + 7
    rows = [(i if i != 5 else None, [float(c) for c in v], "a", 1) for i, v in enumerate(x)]
    rows += [rows[3], (7, rows[8][1], "b", 2), (600, rows[0][1][:12], "c", 3), (601, [], "d", 4)]
    sound = [(r[0], r[1]) for r in rows]
    rows += [(700, None, "e", 1), (701, [1.0, None] * 10, "e", 1), (702, [float("nan")] * 20, "e", 1), (703, [float("-inf")] + [0.0] * 19, "e", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whitened(frame.repartition(7)).collect()
    check(got, [v for _, v in sound], [i for i, _ in sound])
    assert [f.name for f in whitening.whitened(frame).schema][:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_few_dimensions_and_little_variance(spark):
    flat = spark.createDataFrame([(i, [1.0, 2.0, 3.0], "", 0) for i in range(9)], SCHEMA)
    assert whitening.whitened(flat).count() == 0 == whitening.whitened(flat.limit(0)).count() == whitening.whitened(flat.limit(1)).count()
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "", 0) for i in range(9)], SCHEMA)
    got = whitening.whitened(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and abs(got[0].explained - 1) < 1e-12
    two = spark.createDataFrame([(i, [float(i % 3), float(i % 5)], "", 0) for i in range(30)], SCHEMA)
    check(whitening.whitened(two).collect(), [[float(i % 3), float(i % 5)] for i in range(30)], list(range(30)), 2)


def test_large_entries_stay_exact(spark):
    vectors = [[1e12 * (i % 7), float(i), -1e11 * (i % 4)] for i in range(40)]
    got = whitening.whitened(spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(vectors)], SCHEMA), count=1).collect()
    assert sorted(r.deviation for r in got) == sorted(min(2**63 - 1, d) for d in plain(vectors)[1])
    assert whitening.quantised(np.array([1e300, -1e300, 1.5e308, -0.0001])).tolist() == [2**63 - 1, -(2**63), 2**63 - 1, 99_999]


@pytest.mark.parametrize("kind", ["decay", "flat", "equal", "rank"])
def test_lanczos_restarts_and_breakdown(kind):
    rng, dim = np.random.default_rng(2), 300
    values = {"decay": 1000 * 0.9 ** np.arange(dim), "flat": np.linspace(2, 1, dim), "equal": np.repeat([5.0, 4.0, 1.0], 100), "rank": np.append([9.0, 7.0, 3.0], np.zeros(dim - 3))}[kind]
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    a = turn * values @ turn.T
    found, vectors, passes = whitening.lanczos(lambda v: a @ v, dim, 8, most=40)
    assert np.abs(found - values[:8]).max() < 1e-10 * values[0]
    assert np.abs(a @ vectors - vectors * found).max() < 1e-10 * values[0] and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.lanczos(lambda v: a @ v, dim, 8, most=40, tolerance=0.0, passes=3)


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    frame = QUERIES["op12_whitening"](spark, oracle.SF)
    assert [(n, t) for n, t in frame.dtypes] == [tuple(c.split()) for c in "vec_id bigint,component int,n bigint,deviation bigint,whitened double,explained double,identity_error double".split(",")]
    check(frame.collect(), [r[1] for r in rows], [r[0] for r in rows])
