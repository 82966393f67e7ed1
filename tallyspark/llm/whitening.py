"""Whitening of embeddings by principal components that come from an exact characteristic polynomial.

Vectors are rounded to whole numbers, so their scatter n * sum(x x') - S S' is a matrix of integers, summed by
tasks without error. Its characteristic polynomial is found modulo many primes, one task row per prime: the
matrix is brought to Hessenberg form, and the polynomial follows by a recurrence. Chinese remainders give the
integer coefficients. All roots of the polynomial are real, so the number of roots above a point is the number of
sign changes after shifting the polynomial there; bisection encloses the largest roots as narrowly as wanted.
Inverse iteration at such a root, in long decimals, gives its component.

What reaches the driver has the size of the scatter, d * d numbers, however many vectors there are.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import ship, stored

COMPONENTS = 4
SCALE = 256
#: Binary digits of a root beyond its leading one, and decimal digits of inverse iteration.
ROOT_BITS, DIGITS = 160, 110
LONG = 2**63


def whole_numbers(vector: Column) -> Column:
    """The entries as floor(256 * entry); what does not fit in a long is the nearest long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("bigint"))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector has finite entries only, and the most frequent length.

    Rows without a vector, with an empty one, or with a null, infinite or not-a-number entry go. Of lengths that
    are as frequent, the longer one counts; vectors of other lengths have no place in one matrix and go too.
    """
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    kept = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    sizes = kept.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("d")).limit(1).select("d").first()
    return kept.where(F.size("embedding") == (most[0] if most else 0)).select("vec_id", whole_numbers(F.col("embedding")).alias("x"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column, one a row."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x' x of whole numbers, as Python integers: in floats where no sum can reach 2 ** 53."""
    most = int(np.abs(x.astype(object)).max()) if x.size else 0
    if most * most * len(x) < 2**53:
        return (x.T.astype(float) @ x.astype(float)).astype(np.int64).astype(object)
    wide = x.astype(object)
    return wide.T.dot(wide)


@dataclass
class Scatter:
    """n vectors, their sums by dimension, and the integer matrix n * sum(x x') - S S'."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def d(self) -> int:
        return len(self.sums)

    @property
    def trace(self) -> int:
        return sum(self.matrix[i][i] for i in range(self.d))


def scatter(vectors: DataFrame) -> Scatter:
    """Of a table of different vectors x. Tasks add up their rows; parts are added by cell of the matrix."""
    def add(batches):
        total = None
        for batch in batches:
            x = matrix_of(batch.column("x"))
            for lo in range(0, len(x), 1_024):
                part = np.column_stack([np.ones(len(x[lo:lo + 1_024]), np.int64), x[lo:lo + 1_024]])
                total = _products(part) if total is None else total + _products(part)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(
                [str(v) for v in total[i, j]], pa.string())})

    ship(vectors.sparkSession)
    # Numbers travel as text in parts of 18 digits, for products of long entries pass every numeric type.
    cells = vectors.select("x").mapInArrow(add, "i int, j int, v string")
    low, high = F.expr("right(v, 18)"), F.expr("left(v, greatest(length(v) - 18, 0))")
    minus = F.when(F.col("v").startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    digits = cells.withColumn("sign", minus).withColumn("v", F.ltrim(F.col("v"), F.lit("-")))
    parts = digits.groupBy("i", "j").agg(
        F.sum(low.cast("decimal(20,0)") * F.col("sign")).alias("low"),
        F.sum(F.when(F.length("v") > 18, high.cast("decimal(27,0)")).otherwise(0) * F.col("sign")).alias("high"))
    found = {(r.i, r.j): int(r.high) * 10**18 + int(r.low) for r in parts.collect()}
    if not found:
        return Scatter(0, [], [])
    n, d = found[0, 0], max(j for _, j in found)
    sums = [found[0, j] for j in range(1, d + 1)]
    square = [[n * found[min(i, j), max(i, j)] - sums[i - 1] * sums[j - 1] for j in range(1, d + 1)] for i in range(1, d + 1)]
    return Scatter(n, sums, square)


def primes_below(limit: int, count: int) -> list[int]:
    """The largest `count` primes below `limit` (at most 2 ** 31)."""
    small = np.ones(int(limit**0.5) + 2, bool)
    small[:2] = False
    for i in range(2, int(len(small) ** 0.5) + 1):
        if small[i]:
            small[i * i::i] = False
    small, out, hi = np.flatnonzero(small), [], limit
    while len(out) < count:
        lo = max(hi - (1 << 16), int(small[-1]) + 1)
        mark = np.ones(hi - lo, bool)
        for p in small:
            mark[(-lo) % p::p] = False
        out += (lo + np.flatnonzero(mark)[::-1]).tolist()
        hi = lo
    return out[:count]


def characteristic_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t - matrix) modulo p, from the constant one up: Hessenberg form by similar row and
    column steps, then the polynomials of its leading minors one from another."""
    a, d = matrix.copy() % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1:, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            a[[i, k + 1]] = a[[k + 1, i]]
            a[:, [i, k + 1]] = a[:, [k + 1, i]]
        factor = a[k + 2:, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2:] = (a[k + 2:] - factor[:, None] * a[k + 1] % p) % p
        for j in np.flatnonzero(factor):
            a[:, k + 1] = (a[:, k + 1] + a[:, k + 2 + j] * factor[j] % p) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for m in range(1, d + 1):
        minors[m, 1:] = minors[m - 1, :-1]
        minors[m] = (minors[m] - a[m - 1, m - 1] * minors[m - 1] % p) % p
        chain = 1
        for i in range(1, m):
            chain = chain * int(a[m - i, m - i - 1]) % p
            if not chain:
                break
            minors[m] = (minors[m] - int(a[m - i - 1, m - 1]) * chain % p * minors[m - i - 1] % p) % p
    return minors[d]


def coefficient_bits(trace: int, d: int) -> int:
    """Bits that hold any coefficient: the k-th sum of products of d roots that are not negative is largest when
    they are equal."""
    return max([1, *(int(log2(comb(d, k)) + k * max(0.0, log2(max(trace, 1)) - log2(d))) + 3 for k in range(1, d + 1))])


def characteristic(spark, found: Scatter) -> list[int]:
    """The integer coefficients of det(t - matrix), from the constant one up, by remainders modulo as many primes
    as the coefficients need. Primes are dealt to tasks."""
    d = found.d
    primes = primes_below(1 << 31, (coefficient_bits(found.trace, d) + 1) // 30 + 1)
    rows = [[str(v) for v in row] for row in found.matrix]

    def remainders(batches):
        whole = [[int(v) for v in row] for row in rows]
        for batch in batches:
            for p in batch.column("p").to_pylist():
                found = characteristic_modulo(np.array([[v % p for v in row] for row in whole], np.int64), p)
                yield pa.RecordBatch.from_pydict({"p": pa.array([p]), "c": pa.array([found.tolist()], pa.list_(pa.int64()))})

    ship(spark)
    table = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(min(len(primes), 64))
    residues = {r.p: r.c for r in table.mapInArrow(remainders, "p bigint, c array<bigint>").collect()}
    product = 1
    for p in primes:
        product *= p
    weight = {p: product // p * pow(product // p % p, -1, p) for p in primes}
    out = []
    for k in range(d + 1):
        v = sum(weight[p] * residues[p][k] for p in primes) % product
        out.append(v - product if v > product // 2 else v)
    return out


def roots_above(poly: list[int], point: int, bits: int) -> int:
    """How many roots are above point / 2 ** bits, of a polynomial whose roots are all real: the sign changes of
    its coefficients after the shift to that point."""
    d = len(poly) - 1
    c = [v << bits * (d - k) for k, v in enumerate(poly)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += point * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int]]:
    """(m, b) for root m / 2 ** b of the largest positive roots, each as often as it occurs, rounded up in the
    last of ROOT_BITS binary digits."""
    d = len(poly) - 1
    zero = next(k for k, v in enumerate(poly) if v)
    bound = 1
    while roots_above(poly, bound, 0):
        bound *= 2
    out = []
    for k in range(min(count, d - zero)):
        lo, hi = 0, bound  # at most k roots are above hi, more than k above lo
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if roots_above(poly, mid, 0) > k else (lo, mid)
        bits = max(0, ROOT_BITS - hi.bit_length())
        lo, hi = lo << bits, hi << bits
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if roots_above(poly, mid, bits) > k else (lo, mid)
        out.append((hi, bits))
        bound = (hi >> bits) + 1
    return out


def eigenvectors(found: Scatter, roots: list[tuple[int, int]]) -> list[list[decimal.Decimal]]:
    """Unit eigenvectors of the matrix, one per root, each at right angles to those before it.

    Every step solves (matrix - root) y = x by elimination in decimals of DIGITS places; vectors of the same root
    stay apart because what earlier ones hold is taken out before and after each step.
    """
    d = found.d
    with decimal.localcontext() as context:
        context.prec = DIGITS
        # The exponent range of long products must not end a step.
        context.Emax, context.Emin = decimal.MAX_EMAX, decimal.MIN_EMIN
        tiny = decimal.Decimal(max(found.trace, 1)).scaleb(10 - DIGITS)
        out: list[list[decimal.Decimal]] = []

        def apart(v):
            for u in out:
                inner = sum(a * b for a, b in zip(u, v))
                v = [a - inner * b for a, b in zip(v, u)]
            size = sum(a * a for a in v).sqrt()
            return [a / size for a in v]

        for number, (m, bits) in enumerate(roots):
            shift = decimal.Decimal(m) / decimal.Decimal(2) ** bits
            a = [[decimal.Decimal(v) for v in row] for row in found.matrix]
            for i in range(d):
                a[i][i] -= shift
            order = []
            for k in range(d):
                at = max(range(k, d), key=lambda i: abs(a[i][k]))
                a[k], a[at] = a[at], a[k]
                order.append(at)
                if abs(a[k][k]) < tiny:
                    a[k][k] = tiny
                for i in range(k + 1, d):
                    if a[i][k]:
                        factor = a[i][k] = a[i][k] / a[k][k]
                        row, top = a[i], a[k]
                        for j in range(k + 1, d):
                            row[j] -= factor * top[j]
            draw = np.random.default_rng(number)
            v = apart([decimal.Decimal(float(x)) for x in draw.normal(size=d)])
            for _ in range(4):
                # Rows were exchanged as a whole, factors too, so all exchanges come before the factors.
                for k in range(d):
                    v[k], v[order[k]] = v[order[k]], v[k]
                for k in range(d):
                    for i in range(k + 1, d):
                        if a[i][k]:
                            v[i] -= a[i][k] * v[k]
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - sum(a[k][j] * v[j] for j in range(k + 1, d))) / a[k][k]
                v = apart(v)
            out.append(v)
        return out


@dataclass
class Whitening:
    """Of a fit list: n, sums S by dimension; per component its unit vector over sqrt(e), and e / trace."""

    n: int
    sums: list[int]
    scaled: np.ndarray  # d x components, to be used on n * x - S
    explained: list[float]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x).astype(float) / self.n) @ self.scaled

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in longs where they fit, else as Python integers."""
        most = int(np.abs(x.astype(object)).max()) if x.size else 0
        kind = np.int64 if self.n * most + max(map(abs, self.sums), default=0) < LONG else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S) ** 2; null where one does not fit in a long."""
        off = self.offsets(x)
        most = max((abs(int(off.max())), abs(int(off.min()))), default=0) if off.size else 0
        if most * most * max(1, off.shape[1]) < LONG:
            return (off.astype(np.int64) ** 2).sum(1).tolist()
        return [v if v < LONG else None for v in (sum(int(a) ** 2 for a in row) for row in off)]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """From a table of different vectors x. There are as many components as eigenvalues above 0, at most
    `components`; none without vectors, or with one."""
    found = scatter(vectors)
    if not found.trace:
        return Whitening(found.n, found.sums, np.zeros((found.d, 0)), [])
    roots = largest_roots(characteristic(vectors.sparkSession, found), components)
    units = eigenvectors(found, roots)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        values = [decimal.Decimal(m) / decimal.Decimal(2) ** bits for m, bits in roots]  # of n * n times the covariance
        scaled = [[float(a * found.n / v.sqrt()) for a in u] for u, v in zip(units, values)]
        explained = [float(v / found.trace) for v in values]
    return Whitening(found.n, found.sums, np.array(scaled).T, explained)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    k = len(model.explained)
    names = [f"w{i}" for i in range(k)]

    def project(batches):
        for batch in batches:
            white = model.project(matrix_of(batch.column("x")))
            yield pa.RecordBatch.from_pydict({c: pa.array(white[:, i]) for i, c in enumerate(names)})

    white = vectors.select("x").mapInArrow(project, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each usable row (`usable`) and component: vec_id, component (from 1), n, deviation, whitened, explained
    and identity_error.

    The fit list holds each vector of whole numbers once. Repeated rows each have their own results; ids may be
    null or repeated; other columns are not read. Fewer components exist where the vectors lie in a space of fewer
    dimensions; without any, as with no rows or equal rows only, there is no result.
    """
    kept = stored(usable(rows), "whitening-rows")
    distinct = stored(kept.select("x").distinct(), "whitening-vectors")
    model = fit(distinct, components)
    k = len(model.explained)
    error = identity_error(distinct, model) if k else 0.0
    kind = kept.schema["vec_id"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            x = matrix_of(batch.column("x"))
            if not len(x) or not k:
                continue
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(at)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(at), model.n)), "deviation": pa.array(model.deviations(x), pa.int64()).take(pa.array(at)),
                "whitened": pa.array(model.project(x).ravel()), "explained": pa.array(np.tile(model.explained, len(x))),
                "identity_error": pa.array(np.full(len(at), error))})

    ship(rows.sparkSession)
    return kept.mapInArrow(judge, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
