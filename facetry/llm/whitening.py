"""Embedding whitening (operator 12) by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers y = floor(1024 c); the contract's x is y + 100000, which changes no covariance. Tasks add up exact
scatter matrices of (y, 1); their sum gives n, S and A = n Y'Y - S S', an integer matrix with V = A / n**2. The polynomial
det(t - A) is found modulo primes below 2**31, each by a Hessenberg reduction in a Spark task, and put together by the Chinese
remainder theorem; the number of primes follows from Maclaurin's bound on the coefficients, and one more prime checks the
result. All roots are real, so the sign variations of p(t + a) count those above a exactly: bisection isolates each root
to ``BITS`` bits below its leading one, however close it lies to others. Inverse iteration with 120 digits, one task a root,
gives the eigenvectors; a root of multiplicity m, or roots that agree in half the bits, give m orthonormal vectors together.

All that leaves the executors is square in the dimension, never in the rows. The rows are read twice.

A vector that is null or holds null or non-finite entries is dropped; an empty table, or one without variance, gives no
rows. A shorter vector counts as padded with zeros (an empty one too). A null id is kept as null, repeated rows count each
time, and other columns are ignored. There are fewer than ``most`` components where fewer eigenvalues are above zero.
``deviation`` is null where it passes 64 bits; ``deviation_exact`` spells it at any size. Vectors are as long as their
dimension, so no row is long in another sense.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.shared import settled, table

#: Bits of a root below its leading one, digits of the inverse iteration, and components that are returned.
BITS, DIGITS, COMPONENTS = 256, 120, 8
#: Rows of a product in double precision: its sums stay exact for entries up to SMALL.
ROWS, SMALL = 4096, 1 << 20


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(fine).select(F.col(key).cast("long").alias("id"), x.alias("v"))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 c), padded with zeros: doubles where they are small, else Python integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(values) and np.abs(values).max() < SMALL / 1024:
        out[row, at] = np.floor(values * 1024)
        return out
    out = out.astype(object)
    out[:] = 0
    for i, j, c in zip(row.tolist(), at.tolist(), values.tolist()):
        p, q = c.as_integer_ratio()
        out[i, j] = 1024 * p // q
    return out


def scatter(rows: DataFrame, width: int) -> np.ndarray:
    """The exact sum of z z' over z = (y, 1). Each task sends its own; the sums are made row by row in two rounds."""

    def run(batches):
        total = np.zeros((width + 1, width + 1), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                column = batch.column("v").slice(at, ROWS)
                y = integers(column, width)
                z = np.concatenate([y, np.ones((len(column), 1), y.dtype)], 1)
                part = z.T @ z
                total += part.astype(np.int64).astype(object) if part.dtype != object else part
        yield pa.RecordBatch.from_pylist([{"i": i, "sums": [str(s) for s in total[i]]} for i in range(width + 1)], pa.schema([("i", pa.int32()), ("sums", pa.list_(pa.string()))]))

    def added(part: pd.DataFrame) -> pd.DataFrame:
        sums = [0] * (width + 1)
        for own in part["sums"]:
            sums = [a + int(b) for a, b in zip(sums, own)]
        return pd.DataFrame({"i": part["i"].iloc[:1], "sums": [[str(s) for s in sums]]})

    kind = "i int, sums array<string>"
    parts = rows.select("v").mapInArrow(run, kind).withColumn("lot", F.spark_partition_id() % 64)
    found = parts.groupBy("i", "lot").applyInPandas(added, kind).groupBy("i").applyInPandas(added, kind)
    out = np.zeros((width + 1, width + 1), object)
    for r in found.collect():
        out[r["i"]] = [int(s) for s in r["sums"]]
    return out


def prime(n: int) -> bool:
    """Miller-Rabin, exact below 2**31 with these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2**31 whose product has more than ``bits`` bits, and one more."""
    out, n, product = [], 2**31 - 1, 1
    while product.bit_length() <= bits:
        if prime(n):
            out.append(n)
            product *= n
        n -= 2
    while not prime(n):
        n -= 2
    return [*out, n]


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - a) modulo ``p``, lowest first, by reduction to Hessenberg form."""
    d = len(a)
    h = np.array([[int(x) % p for x in row] for row in a], np.int64).reshape(d, d)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), p - 2, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(1)) % p
    found = np.zeros((d + 1, d + 1), np.int64)
    found[0, 0] = 1
    for k in range(d):
        own = np.zeros(d + 1, np.int64)
        own[1:] = found[k, :-1]
        own = (own - h[k, k] * found[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            own = (own - int(h[i, k]) * product % p * found[i]) % p
        found[k + 1] = own
    return found[d].tolist()


def characteristic(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(t - a), lowest first, for a positive semidefinite ``a``."""
    d, trace = len(a), sum(int(a[i, i]) for i in range(len(a)))
    bound = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    held, spelled = primes(bound.bit_length() + 1), [[str(x) for x in row] for row in a]
    matrix = spark.sparkContext.broadcast(spelled)

    def run(parts):
        own = np.array([[int(x) for x in row] for row in matrix.value], object)
        for part in parts:
            yield pd.DataFrame({"p": part["p"], "residues": [polynomial_modulo(own, int(p)) for p in part["p"]]})

    given = spark.createDataFrame([(p,) for p in held], "p long").repartition(min(len(held), 4 * spark.sparkContext.defaultParallelism))
    residues = {r["p"]: r["residues"] for r in given.mapInPandas(run, "p long, residues array<long>").collect()}
    used, check = held[:-1], held[-1]
    product = math.prod(used)
    out = [0] * (d + 1)
    for p in used:
        rest = product // p
        weight = rest * pow(rest, -1, p)
        out = [c + r * weight for c, r in zip(out, residues[p])]
    out = [c - product if c > product // 2 else c for c in (c % product for c in out)]
    if [c % check for c in out] != residues[check]:
        raise ArithmeticError("the polynomial fails its check modulo a further prime")
    return out


class Roots:
    """Exact comparisons with the roots, all real, of an integer polynomial (lowest coefficient first)."""

    def __init__(self, coefficients: list[int]):
        self.c, self.d = coefficients, len(coefficients) - 1
        self.above = lru_cache(None)(self._above)

    def _above(self, a: int, s: int) -> int:
        """Roots greater than a / 2**s, by Descartes' rule, which is exact where all roots are real."""
        q = [c << s * (self.d - i) for i, c in enumerate(self.c)]
        for i in range(self.d):
            for j in range(self.d - 1, i - 1, -1):
                q[j] += a * q[j + 1]
        signs = [c > 0 for c in q if c]
        return sum(x != y for x, y in zip(signs, signs[1:]))

    def sign(self, a: int, s: int) -> int:
        value = 0
        for i in range(self.d, -1, -1):
            value = value * a + (self.c[i] << s * (self.d - i))
        return (value > 0) - (value < 0)

    def largest(self, most: int, bits: int = BITS) -> list[tuple[int, int]]:
        """(r, s) of the ``most`` largest roots above zero, falling: each lies in (r - 1, r] / 2**s."""
        # The sum of squares of the roots, by Newton's identity.
        top = 1 + math.isqrt(self.c[-2] ** 2 - 2 * (self.c[-3] if self.d > 1 else 0)) if self.d else 1
        out = []
        for k in range(1, min(most, self.above(0, 0)) + 1):
            lo, hi, s = 0, top, 0
            while True:
                alone = self.above(lo, s) - self.above(hi, s) == 1
                over = (-1) ** self.above(lo, s)
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    if alone:
                        at = self.sign(mid, s)
                        lo, hi = (mid, hi) if at == over else (lo, mid) if at else (mid - 1, mid)
                    elif self.above(mid, s) >= k:
                        lo = mid
                        alone, over = self.above(lo, s) - self.above(hi, s) == 1, (-1) ** self.above(lo, s)
                    else:
                        hi = mid
                        alone = self.above(lo, s) - self.above(hi, s) == 1
                if hi.bit_length() > bits:
                    break
                step = bits + 1 - hi.bit_length()
                lo, hi, s = lo << step, hi << step, s + step
            out.append((hi, s))
        return out


def null_vectors(a: np.ndarray, root: Decimal, m: int) -> list[list[float]]:
    """``m`` orthonormal vectors that a - root takes to nearly zero: inverse iteration on one elimination."""
    d = len(a)
    with localcontext() as context:
        context.prec = DIGITS
        u = np.array([[Decimal(int(x)) for x in row] for row in a], object)
        for i in range(d):
            u[i, i] -= root
        size = max(abs(x) for x in u.ravel()) or Decimal(1)
        tiny = size * Decimal(10) ** (10 - DIGITS)
        order = list(range(d))
        for k in range(d):
            i = max(range(k, d), key=lambda r: abs(u[r, k]))
            u[[k, i]] = u[[i, k]]
            order[k], order[i] = order[i], order[k]
            if abs(u[k, k]) < tiny:
                u[k, k] = tiny
            u[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
            u[k + 1 :, k + 1 :] = u[k + 1 :, k + 1 :] - np.multiply.outer(u[k + 1 :, k], u[k, k + 1 :])
        turn = np.random.default_rng(d)
        block = [np.array([Decimal(int(x)) for x in turn.integers(-1000, 1001, d)], object) for _ in range(m)]
        for _ in range(4):
            found: list[np.ndarray] = []
            for b in block:
                x = b[order]
                for k in range(d):
                    x[k + 1 :] = x[k + 1 :] - u[k + 1 :, k] * x[k]
                for k in range(d - 1, -1, -1):
                    x[k] = x[k] / u[k, k]
                    x[:k] = x[:k] - u[:k, k] * x[k]
                x = x / max(abs(v) for v in x)
                for _ in range(2):
                    for w in found:
                        x = x - w * (w * x).sum()
                found.append(x / (x * x).sum().sqrt())
            block = found
        return [[float(v) for v in x] for x in block]


def components(spark: SparkSession, a: np.ndarray, n: int, most: int = COMPONENTS) -> list[tuple[list[float], float, float]]:
    """(unit eigenvector, square root of the eigenvalue of V, share of V's trace) by falling eigenvalue above zero."""
    if not len(a) or not any(int(a[i, i]) for i in range(len(a))):
        return []
    roots = Roots(characteristic(spark, a)).largest(most)
    near = lambda x, y: abs((x[0] << y[1]) - (y[0] << x[1])) << BITS // 2 <= x[0] << y[1]
    groups: list[list[tuple[int, int]]] = []
    for r in roots:
        groups.append([*groups.pop(), r] if groups and near(groups[-1][-1], r) else [r])
    with localcontext() as context:
        context.prec = DIGITS
        values = [[Decimal(2 * r - 1) / (Decimal(2) ** (s + 1)) for r, s in g] for g in groups]
        trace = Decimal(sum(int(a[i, i]) for i in range(len(a))))
        scales = [[(float(v.sqrt() / n), float(v / trace)) for v in g] for g in values]
    matrix = spark.sparkContext.broadcast([[str(x) for x in row] for row in a])

    def run(parts):
        own = np.array([[int(x) for x in row] for row in matrix.value], object)
        for part in parts:
            yield pd.DataFrame({"g": part["g"], "vectors": [null_vectors(own, Decimal(r), m) for r, m in zip(part["root"], part["m"])]})

    asked = spark.createDataFrame([(i, str(g[0]), len(g)) for i, g in enumerate(values)], "g int, root string, m int").repartition(len(values))
    vectors = {r["g"]: r["vectors"] for r in asked.mapInPandas(run, "g int, vectors array<array<double>>").collect()}
    return [(list(v), *scale) for i, g in enumerate(scales) for v, scale in zip(vectors[i], g)]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row for each row and component: ``key``, component, n, deviation, whitened, explained, identity_error,
    deviation_exact."""
    spark = df.sparkSession
    rows = usable(df, key, vector)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    total = scatter(rows, width)
    n, sums = int(total[width, width]), total[width, :width]
    a = n * total[:width, :width] - np.multiply.outer(sums, sums)
    found = components(spark, a, n, most) if n else []
    turn = np.array([v for v, _, _ in found]).T.reshape(width, len(found))
    scale = np.array([s for _, s, _ in found])
    with localcontext() as context:
        context.prec = DIGITS
        mean = np.array([float(Decimal(int(s)) / n) for s in sums]) if n else np.zeros(width)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = integers(part.column("v"), width)
                off = n * y.astype(np.int64).astype(object) - sums if y.dtype != object else n * y - sums
                spelled = [str(x) for x in (off * off).sum(1)] if width else ["0"] * len(y)
                white = (y.astype(np.float64) - mean) @ turn / scale
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * len(found), pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spelled, pa.string()), lists], names=["id", "deviation_exact", "white"])

    out = settled(rows.mapInArrow(run, "id long, deviation_exact string, white array<double>")) if found else spark.createDataFrame([], "id long, deviation_exact string, white array<double>")
    error = 0.0
    if found:
        at = [F.col("white")[i] for i in range(len(found))]
        pairs = [F.covar_pop(at[i], at[j]) - (1.0 if i == j else 0.0) for i in range(len(at)) for j in range(i + 1)]
        error = out.agg(F.greatest(*map(F.abs, pairs), F.lit(0.0)).alias("error")).first()["error"]
    shares = F.array(*(F.lit(s) for _, _, s in found)) if found else F.array().cast("array<double>")
    long = out.select("id", "deviation_exact", F.posexplode("white").alias("at", "whitened"))
    return long.select(
        F.col("id").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation_exact").try_cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"), "deviation_exact",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
