import math
from fractions import Fraction

import numpy as np
import pytest

from tallyspark.llm.whitening import (Scatter, characteristic_modulo, coefficient_bits, eigenvectors, largest_roots, primes_below,
                                      roots_above, whitened)

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n double, component int"


def table(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, 0, "x", 1.0, 9) for i, v in vectors], SCHEMA.replace("float", kind))


def brute(vectors, kind=np.float32):
    fine = [(i, [math.floor(float(kind(c)) * 256) for c in v]) for i, v in vectors
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    v = np.cov(np.array(fit, float).T, bias=True).reshape(len(sums), len(sums)) if n > 1 else np.zeros((1, 1))
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = []
    for i, x in fine:
        white = (np.array(x) - np.array(sums) / n) @ u / np.sqrt(np.maximum(e, 1e-300))
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out.append((i, n, deviation, white, e / v.trace() if n > 1 else e))
    return out


def compare(found, want, components=4):
    rows = {}
    for r in found:
        rows.setdefault(r.vec_id, []).append(r)
        assert r.identity_error <= 1e-9
    assert set(rows) == {w[0] for w in want}
    sign = [0] * components
    for i, n, deviation, white, explained in want:
        for k in range(components):
            for r in [r for r in rows[i] if r.component == k + 1]:
                assert r.n == n and r.deviation == deviation and r.explained == pytest.approx(explained[k], rel=1e-9)
                sign[k] = sign[k] or (1 if r.whitened * white[k] > 0 else -1)
                assert r.whitened == pytest.approx(sign[k] * white[k], abs=1e-7)


def test_vectors_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, (draw.normal(size=12) * np.arange(1, 13) * 0.07).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(400)]  # one very common vector
    odd = [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, []), (2005, [1.0] * 3), (2006, [-0.0] * 12)]
    got = whitened(table(spark, vectors + odd)).collect()
    assert got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got, brute([v for v in vectors + odd if v[0] != 2005]))
    assert len(got) == 4 * 701


def test_repeated_rows_and_ids(spark):
    vectors = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.75]), (2, [0.0, 0.25])]
    got = whitened(table(spark, vectors)).collect()
    assert len(got) == 8 and sum(r.vec_id is None for r in got) == 2 and {r.n for r in got} == {3}


def test_few_dimensions_and_equal_roots(spark):
    square = [(0, [1.0, 0.0, 5.0]), (1, [-1.0, 0.0, 5.0]), (2, [0.0, 1.0, 5.0]), (3, [0.0, -1.0, 5.0])]
    got = whitened(table(spark, square)).collect()
    assert len(got) == 8 and all(r.explained == 0.5 and r.identity_error < 1e-12 for r in got)
    assert whitened(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])])).collect() == []
    assert whitened(table(spark, [])).collect() == []


def test_entries_up_to_the_ends_of_long(spark):
    vectors = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [3e12, 5.0]), (3, [0.5, 1e9])]
    got = whitened(table(spark, vectors, "double")).collect()
    assert len(got) == 8 and {r.vec_id: r.deviation for r in got}[0] is None and all(r.identity_error < 1e-9 for r in got)


def test_polynomial_modulo_primes_and_its_roots(spark):
    draw = np.random.default_rng(3)
    half = draw.integers(-40, 40, (6, 7))
    matrix = half @ half.T
    matrix[:, 2] = matrix[:, 0] = 0
    matrix[2], matrix[0] = 0, 0  # rows without anything below the diagonal
    matrix[2, 2] = matrix[0, 0] = 5_000

    def minor(a):  # the determinant of t - a by expansion, as coefficients
        if not len(a):
            return [1]
        out = [0] * (len(a) + 1)
        for j in range(len(a)):
            rest = minor([row[:j] + row[j + 1:] for row in a[1:]])
            for k, c in enumerate(rest):
                for e, f in enumerate(a[0][j]):
                    out[k + e] += (-1) ** j * c * f if k + e < len(out) else 0
        return out

    want = minor([[[-int(v), 1] if i == j else [-int(v), 0] for j, v in enumerate(row)] for i, row in enumerate(matrix)])[:7]
    for p in primes_below(1 << 31, 3):
        assert all(p % q for q in range(2, 2_000)) and p < 1 << 31
        assert characteristic_modulo(matrix.astype(np.int64), p).tolist() == [c % p for c in want]
    assert max(abs(c) for c in want).bit_length() <= coefficient_bits(int(matrix.trace()), 6)
    roots = sorted(np.linalg.eigvalsh(matrix.astype(float)), reverse=True)
    assert [roots_above(want, int(t), 0) for t in (-1, 4_999, 5_000)] == [sum(r > t + 1e-6 for r in roots) for t in (-1, 4_999, 5_000)]
    found = largest_roots(want, 4)
    assert [float(Fraction(m, 2**b)) for m, b in found] == pytest.approx(roots[:4], rel=1e-10)
    units = np.array([[float(c) for c in v] for v in eigenvectors(Scatter(1, [0] * 6, matrix.tolist()), found)])
    assert np.abs(units @ units.T - np.eye(4)).max() < 1e-14
    assert np.abs(matrix @ units.T - units.T * roots[:4]).max() < 1e-8
