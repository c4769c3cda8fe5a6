import math
from fractions import Fraction

import numpy as np
import pytest

from fleetwear.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """From x vectors: n, S, exact covariance as fractions."""
    fit = sorted(set(vectors))
    n, d = len(fit), len(fit[0])
    s = [sum(v[i] for v in fit) for i in range(d)]
    cov = [[Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3) for j in range(d)] for i in range(d)]
    return fit, n, s, cov


def check(rows, vectors, most=16):
    """rows of the operator, vectors: [(key, x tuple)]."""
    fit, n, s, cov = plain([v for _, v in vectors])
    d = len(s)
    matrix = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(matrix)[::-1]
    k = min(most, int((values > d * np.finfo(float).eps * values[0]).sum()))
    assert len(rows) == k * len(vectors)
    by = {}
    for r in rows:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert math.isclose(r["explained"], values[r["component"] - 1] / np.trace(matrix), rel_tol=1e-9)
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    white = []
    for key, x in vectors:
        own = by[key]
        assert sorted(own) == list(range(1, k + 1))
        assert {r["deviation"] for c in own.values() for r in c} == {sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))} or len(own[1]) > 1
        white.append([own[c][0]["whitened"] for c in range(1, k + 1)])
    # Whitened values are the centred ones in the eigenvectors: solve for the axes and test them.
    centred = np.array([[a - b / n for a, b in zip(x, s, strict=True)] for _, x in vectors])
    white = np.array(white)
    axes = np.linalg.lstsq(centred, white, rcond=None)[0] * np.sqrt(values[:k])
    if len(vectors) > d:
        assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-8
        assert np.abs(matrix @ axes - axes * values[:k]).max() < 1e-8 * values[0]
    assert np.abs(centred @ axes / np.sqrt(values[:k]) - white).max() < 1e-8


def whole(vector):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector)


def test_query(spark):
    vectors = [(r["vec_id"], tuple(math.floor(64 * c) + 1_000_000 for c in r["embedding"])) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    check(queries.QUERIES["op12_whitening"](spark, FOLDER).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    good += [(i, good[3][1]) for i in range(60, 90)] + [(None, good[4][1]), (5, good[5][1])]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [3e38] * 5)]
    df = spark.createDataFrame([(k, v, 0, [1], 1) for k, v in good + bad], "vec_id long, embedding array<float>, label int, x array<int>, component int")
    check(whitening.whiten(df).collect(), [(k, whole(v)) for k, v in good])
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id between 60 and 80")).count() == 0  # one distinct vector has no variance


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(a), float(b), float(a), 0.5], 0) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["component"] for r in whitening.whiten(df).collect()} == {1, 2}


def test_sums_stay_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) * 2.0**28).clip(-(2.0**29), 2.0**29).astype(np.float32).tolist(), 0) for i in range(300)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    vectors = [whole(v) for _, v, _ in rows]
    _, n, s, _ = plain(vectors)
    exact = {i: sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in enumerate(vectors)}
    assert any(v >= 1 << 63 for v in exact.values())
    assert all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 1 << 63 else None) for r in found)
    assert all(r["identity_error"] < 1e-9 for r in found)


@pytest.mark.parametrize("size", [10, 1 << 36])
def test_polarisation_gives_the_covariance(size):
    rng = np.random.default_rng(size % 97)
    x = rng.integers(-size, size, (200, 6))
    _, n, s, cov = plain([tuple(map(int, v)) for v in x])
    fit = np.array(sorted({tuple(map(int, v)) for v in x}))
    mean = np.array([t // n for t in s])
    squares = whitening.square_sums(np.ascontiguousarray((fit - mean).T)).astype(object)
    found = whitening.covariance(squares, np.array([t % n for t in s], object), n)
    assert found.tolist() == [[float(c) for c in row] for row in cov]
