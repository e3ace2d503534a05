import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tesserae.llm import common
from tesserae.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n long, component string"


def exact(vectors):
    """n, sums, n²V in Python integers, and deviations, straight from the definition."""
    xs = [[math.floor(Fraction(c) * 1024) + 100000 for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    s = [sum(x[k] for x in xs) for k in range(d)]
    v = [[sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs) for j in range(d)] for i in range(d)]
    return xs, n, s, v, [sum((n * x[k] - s[k]) ** 2 for k in range(d)) for x in xs]


def held(spark, rows, frame=None):
    df = frame if frame is not None else spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA)
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs, n, s, v, dev = exact([v for _, v in good])
    got = W.whitened(df.repartition(3)).collect()
    d = len(s)
    assert len(got) == len(good) * min(8, d)
    cov = np.array([[Fraction(c, n**3) for c in r] for r in v]).astype(float)
    trace = float(sum(Fraction(v[k][k], n**3) for k in range(d)))
    by = {}
    for r in got:
        assert r["n"] == n
        by.setdefault((r["vec_id"], r["deviation_exact"]), {})[r["component"]] = r
    for (i, _), x, e in zip(good, xs, dev):
        r = by[i, str(e)][1]
        assert r["deviation"] == (e if e < 1 << 63 else None)
    # eigenpairs: the whitened columns give back V's axes
    first = [by[i, str(e)] for (i, _), e in zip(good, dev)]
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s)] for x in xs])
    for k in range(1, min(8, d) + 1):
        w = [r[k]["whitened"] for r in first]
        if w[0] is None:
            continue
        e = first[0][k]["explained"] * trace
        axis = centred.T @ np.array(w) / n / math.sqrt(e)
        assert abs(np.linalg.norm(axis) - 1) < 1e-6
        assert np.linalg.norm(cov @ axis - e * axis) < 1e-6 * trace
    assert got[0]["identity_error"] < 1e-6
    return got


def test_against_the_definition(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) * (k + 1) + k for k in range(10)]) for i in range(300)]
    rows += [(5, rows[0][1]), (None, rows[1][1]), (900, None), (901, [1.0, None] + [0.0] * 8), (902, [math.nan] * 10), (903, [math.inf] + [0.0] * 9), (904, [])]
    held(spark, rows)


@pytest.mark.parametrize("scale,away", [(1.0, 1e6), (3e4, 0.0), (1e9, 5e9)])
def test_large_values_stay_exact(spark, scale, away):
    rng = random.Random(5)
    held(spark, [(i, [rng.gauss(0, scale) + away for _ in range(4)]) for i in range(60)])


def test_variance_of_nothing(spark):
    got = W.whitened(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 3.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] is None) for r in got) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    assert {round(abs(r["whitened"]), 9) for r in got if r["component"] == 1} == {1.0}
    one = W.whitened(spark.createDataFrame([(1, [0.5, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["whitened"], r["deviation"], r["explained"], r["identity_error"]) for r in one] == [(None, 0, 0.0, None)] * 2


def test_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whitened(spark.createDataFrame([], schema)).collect() == []
    assert W.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    got = W.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [4.0, 1.0]), (4, [1.0, 2.0, 3.0])], schema)).collect()
    assert {(r["vec_id"], r["n"]) for r in got} == {(1, 2), (3, 2)}


def test_limbs():
    for v in (0, 1, -1, (1 << 40) - 1, 1 << 40, -(1 << 40) - 1, 3**90, -(7**70)):
        assert sum(p << (W.LIMB * k) for k, p in W.in_limbs(v)) == v
    x = np.random.default_rng(1).integers(-(1 << 61), 1 << 61, (50, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(3)] for i in range(3)]
    assert W.products(x).tolist() == want


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"])) for r in common.table(spark, sf, "embeddings").collect()]
    df = W.op13_whitening(spark, sf)
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(spark, rows, common.table(spark, sf, "embeddings"))
