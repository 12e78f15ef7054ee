"""Principal components of embeddings by exact arithmetic, and the embeddings whitened on them.

1. Entries become whole numbers, x = floor(64 c) + 1000000. Spark sums x and the products of x exactly; with n rows the
   scatter n * sum(x x') - S S' is an integer matrix, n squared times the covariance.
2. Its characteristic polynomial is found modulo many primes (Hessenberg form, then the recurrence of its leading
   minors), one task for some primes, and joined by Chinese remainders.
3. All roots are real, so the sign changes of the polynomial shifted to a count the roots above a: intervals with
   one root are found so and halved, in whole numbers, far beyond double precision.
4. Each root's null space is found by inverse iteration on a fixed-point elimination, one task for some roots.

The driver holds a matrix of the dimension and a polynomial, never rows. The dimension d bounds all of it: d * d sums,
and about d * log2(trace) / 31 primes of d ** 3 steps each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm.rows import tidy

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 2.0**62  # of a scaled entry; beyond, it is no long
_LIMB = 18  # bits of the parts whose products are summed in doubles without loss
_SUM = 40  # bits of the parts of a sum, which Spark adds as longs
_SUMS = 5
_ROWS = 4096
FRACTION = 64  # bits after the point of a root
_WORK = 160  # bits of a quotient in the elimination


# --- exact sums -------------------------------------------------------------------------------------------------

def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows whose vector is not null and whose entries are all finite numbers.

    An entry that is no long after scaling counts as not finite. Vectors of another length than the commonest one (of
    several, the longest) have no place in one covariance and are left out as well, and so are empty ones.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where("v IS NOT NULL AND size(v) > 0")
    sound = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST / SCALE), F.lit(False)))
    return rows.where(sound)


def _dimension(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    return found["d"] if found else 0


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """floor(64 c) of each entry; the shift by 1000000 falls out of all that is centred."""
    values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(values * SCALE).reshape(-1, d)


def gram(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, x whole numbers held in doubles or longs."""
    x = x.astype(np.int64)
    total = np.zeros((x.shape[1],) * 2, object)
    if not len(x):
        return total
    parts, rest = [], x
    while rest.any():  # a negative rest ends at 0 because the sign stays with the parts
        low = np.fmod(rest, 1 << _LIMB)
        parts.append(low.astype(np.float64))
        rest = (rest - low) >> _LIMB
    for a, left in enumerate(parts):
        for b, right in enumerate(parts):
            for k in range(0, len(x), _ROWS):  # 2 ** 18 squared, 4096 times, stays below 2 ** 53
                product = np.einsum("ki,kj->ij", left[k : k + _ROWS], right[k : k + _ROWS], optimize=True)
                total += product.astype(np.int64).astype(object) << (_LIMB * (a + b))
    return total


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, n * sum(x x') - sums sums') with x = floor(64 c), all exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch, d)
                total += gram(np.concatenate([x, np.ones((len(x), 1))], axis=1))
        i, j = np.triu_indices(d + 1)
        values = total[i, j].tolist()
        parts = [[(v >> (_SUM * k)) & ((1 << _SUM) - 1) for v in values] for k in range(_SUMS - 1)]
        parts.append([v >> (_SUM * (_SUMS - 1)) for v in values])
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, pa.int64()) for p in parts)],
            ["i", "j", *(f"s{k}" for k in range(_SUMS))])

    schema = "i int, j int, " + ", ".join(f"s{k} long" for k in range(_SUMS))
    summed = rows.select("v").mapInArrow(tidy(run), schema).groupBy("i", "j").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(_SUMS)))
    full = np.zeros((d + 1, d + 1), object)
    for r in summed.collect():  # (d + 1) (d + 2) / 2 rows
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = sum(r[f"s{k}"] << (_SUM * k) for k in range(_SUMS))
    n, sums = full[d, d], full[:d, d]
    return n, sums.tolist(), n * full[:d, :d] - np.outer(sums, sums)


# --- characteristic polynomial ----------------------------------------------------------------------------------

def _is_prime(n: int) -> bool:
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):  # enough below 3 215 031 751
        x = pow(a, odd, n)
        if a % n == 0 or x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product has more than so many bits."""
    out, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def _power(x: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, base = np.ones_like(x), x.copy()
    for k in range(31):
        out = np.where((e >> k) & 1 == 1, out * base % p, out)
        base = base * base % p
    return out


def polynomial_mod(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients, lowest first, of det(y - a[k]) modulo p[k] for a stack of matrices with entries in 0 .. p[k] - 1."""
    a, count, d = a.copy(), len(p), a.shape[1]
    every, q = np.arange(count), p[:, None]
    cube = p[:, None, None]
    for k in range(d - 2):
        lead = k + 1 + (a[:, k + 1 :, k] != 0).argmax(axis=1)  # a row to take its multiples off the others
        for m in np.flatnonzero(lead != k + 1):
            r = lead[m]
            a[m, [k + 1, r]] = a[m, [r, k + 1]]
            a[m][:, [k + 1, r]] = a[m][:, [r, k + 1]]
        f = a[:, k + 2 :, k] * _power(a[every, k + 1, k], p - 2, p)[:, None] % q  # 0 if the column is clear
        a[:, k + 2 :] = (a[:, k + 2 :] - f[:, :, None] * a[:, k + 1, None, :] % cube) % cube
        # the inverse step on columns keeps the matrix similar
        terms = a[:, :, k + 2 :] * f[:, None, :] % cube
        a[:, :, k + 1] = (a[:, :, k + 1] + terms.sum(axis=2)) % q
    minors = np.zeros((d + 1, count, d + 1), np.int64)
    minors[0, :, 0] = 1
    for k in range(1, d + 1):
        now = np.roll(minors[k - 1], 1, axis=1)  # times y; the last place is still 0
        now = (now - a[:, k - 1, k - 1, None] * minors[k - 1] % q) % q
        below = np.ones(count, np.int64)
        for i in range(k - 1, 0, -1):
            below = below * a[:, i, i - 1] % p
            now = (now - (a[:, i - 1, k - 1] * below % p)[:, None] * minors[i - 1] % q) % q
        minors[k] = now
    return minors[d]


def characteristic(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of det(y - m) for a symmetric integer matrix without negative eigenvalues."""
    d, trace = len(m), int(sum(m[k, k] for k in range(len(m))))
    # an elementary symmetric function is largest where all eigenvalues are equal
    bits = max(math.comb(d, k).bit_length() + k * (trace // d + 1).bit_length() for k in range(d + 1))
    moduli, entries = primes(bits + 2), m.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            step = max(1, (1 << 21) // (d * d))
            for k in range(0, len(p), step):
                some = p[k : k + step]
                a = np.array([[[x % q for x in row] for row in entries] for q in some.tolist()], np.int64)
                found = polynomial_mod(a, some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    tasks = min(len(moduli), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(tasks)
    found = rows.mapInArrow(tidy(run), "p long, c array<long>").collect()  # a polynomial for each prime
    product = math.prod(moduli)
    out = [0] * (d + 1)
    for r in found:
        rest = product // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        for k, c in enumerate(r["c"]):
            out[k] += c * unit
    out = [c % product for c in out]
    return [c - product if 2 * c > product else c for c in out]


# --- roots ------------------------------------------------------------------------------------------------------

def _above(c: list[int], a: int) -> int:
    """How many roots lie above a, if all are real: the sign changes after a shift by a."""
    c = list(c)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(c: list[int], z: int) -> int:
    value = 0
    for x in reversed(c):
        value = value * z + x
    return (value > 0) - (value < 0)


def largest_roots(c: list[int], most: int, fraction: int = FRACTION) -> list[tuple[int, int]]:
    """(root, multiplicity) of the largest positive roots, falling, until `most` are told; roots times 2 ** fraction.

    c must have real roots only, none below 0. Roots that lie within one unit of that size count as one.
    """
    zeros = next(k for k, x in enumerate(c) if x)
    c = c[zeros:]
    d = len(c) - 1
    if not d:
        return []
    c = [x << (fraction * (d - k)) for k, x in enumerate(c)]
    top = (-c[d - 1] // c[d]) + 2  # the sum of all roots
    out, told = [], 0
    open_parts = [(0, top, d, 0)]  # the roots in (low, high]: above low and above high
    while open_parts and told < most:
        low, high, over_low, over_high = open_parts.pop()
        count = over_low - over_high
        if not count:
            continue
        if count == 1:
            sign = _sign(c, high)
            while high - low > 1 and sign:
                mid = (low + high) // 2
                here = _sign(c, mid)
                if here == sign or not here:
                    high, sign = mid, here
                else:
                    low = mid
        elif high - low > 1:
            mid = (low + high) // 2
            over_mid = _above(c, mid)
            open_parts += [(low, mid, over_low, over_mid), (mid, high, over_mid, over_high)]
            continue
        out.append((high, count))
        told += count
    return out


# --- null spaces ------------------------------------------------------------------------------------------------

def _starts(d: int, count: int) -> list[np.ndarray]:
    rng = np.random.default_rng(d)
    return [np.array([int(x) for x in rng.integers(1 << 20, 1 << 21, d) * rng.choice([-1, 1], d)], object) for _ in range(count)]


def null_vectors(m: list[list[int]], root: int, count: int, fraction: int = FRACTION) -> list[list[float]]:
    """`count` unit vectors, at right angles, that m maps to root / 2 ** fraction times themselves, to double precision."""
    d = len(m)
    a = np.array([[x << fraction for x in row] for row in m], object).reshape(d, d)
    a[range(d), range(d)] -= root
    order = list(range(d))
    low = np.zeros((d, d), object)
    for k in range(d):
        r = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, r]], low[[k, r]] = a[[r, k]], low[[r, k]]
        order[k], order[r] = order[r], order[k]
        if not a[k, k]:
            a[k, k] = 1  # a smallest unit in place of none
        f = (a[k + 1 :, k] << _WORK) // a[k, k]
        low[k + 1 :, k] = f
        a[k + 1 :, k:] -= (f[:, None] * a[k, k:][None, :]) >> _WORK
    size = max(int(abs(x)) for row in m for x in row).bit_length() + fraction + 2 * _WORK

    def solved(b: np.ndarray) -> np.ndarray:
        y = (b << size)[order]
        for k in range(d):
            y[k + 1 :] -= (low[k + 1 :, k] * y[k]) >> _WORK
        for k in range(d - 1, -1, -1):
            y[k] = (y[k] << _WORK) // a[k, k]
            y[:k] -= (a[:k, k] * y[k]) >> _WORK
        top = max(int(abs(x)) for x in y).bit_length()
        return y >> max(0, top - 2 * _WORK)

    found: list[np.ndarray] = []
    for start in _starts(d, count):
        x = start
        for _ in range(3):
            x = solved(x)
            for e in found:
                x = (x << _WORK) - e * ((int((x * e).sum()) << _WORK) // int((e * e).sum()))
        found.append(x)
    out = []
    for x in found:
        squares = int((x * x).sum())
        unit = math.isqrt(squares << (2 * _WORK))
        v = [(int(e) << _WORK) / unit for e in x]
        if max(v, key=abs) < 0:
            v = [-e for e in v]
        out.append(v)
    return out


@dataclass
class Whitener:
    """n rows, their sums less n times the shift, components in columns (over the root of their n * n-fold variance), shares."""

    n: int
    sums: list[int]
    columns: np.ndarray
    explained: list[float]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """Components of positive variance, at most `components`, of all usable vectors; None if there are none.

    Equal eigenvalues get vectors at right angles in their common space.
    """
    rows = usable(vectors)
    d = _dimension(rows)
    if not d:
        return None
    spark = vectors.sparkSession
    n, sums, m = scatter(rows.where(F.size("v") == d), d)
    trace = int(sum(m[k, k] for k in range(d)))
    if not trace:
        return None
    found = largest_roots(characteristic(spark, m), components)
    entries = m.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, root, count in zip(*(batch.column(c).to_pylist() for c in ("k", "root", "count")), strict=True):
                vs = null_vectors(entries, int(root), count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * count, pa.int32()), pa.array(vs, pa.list_(pa.float64()))], ["k", "v"])

    parts = spark.createDataFrame([(k, str(r), c) for k, (r, c) in enumerate(found)], "k int, root string, count int")
    parts = parts.repartition(min(len(found), spark.sparkContext.defaultParallelism))
    spaces: dict[int, list] = {}
    for r in parts.mapInArrow(tidy(run), "k int, v array<double>").collect():  # a matrix of d rows
        spaces.setdefault(r["k"], []).append(r["v"])
    columns, explained = [], []
    for k, (root, _) in enumerate(found):
        deviation = math.isqrt(root << FRACTION) / (1 << FRACTION)
        for v in spaces[k]:
            columns.append(np.array(v) / deviation)
            explained.append(root / (trace << FRACTION))
    return Whitener(n, sums, np.array(columns[:components]).T, explained[:components])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S as doubles, and the exact sums of its squares (objects; null beyond a long)."""
    most = float(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
    if most * most * x.shape[1] < 2.0**62:
        u = x.astype(np.int64) * n - np.array(sums, np.int64)
        return u.astype(np.float64), (u * u).sum(axis=1).astype(object)
    u = x.astype(np.int64).astype(object) * n - np.array(sums, object)
    squares = (u * u).sum(axis=1)
    return u.astype(np.float64), np.array([s if s < 2**63 else None for s in squares], object)


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    d, k = w.columns.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                u, _ = _centred(_whole(batch, d), w.n, w.sums)
                z = np.concatenate([np.einsum("ij,jk->ik", u, w.columns, optimize=True), np.ones((len(u), 1))], axis=1)
                total += np.einsum("ki,kj->ij", z, z, optimize=True)
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    summed = np.zeros((k + 1, k + 1))
    for r in rows.select("v").mapInArrow(tidy(run), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        summed[r["i"], r["j"]] = r["s"]
    mean = summed[:k, k] / w.n  # of rows centred already, so only what rounding leaves
    return float(np.abs(summed[:k, :k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    Repeated rows stay. Components of variance 0 cannot be scaled and are left out, so that a table of equal vectors, of
    one vector or of none gives no rows. A deviation beyond a long is null. Other columns are ignored.
    """
    kinds = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kinds = kinds.format(vectors.schema["vec_id"].dataType.simpleString())
    w = fit(vectors, components)
    if w is None:
        return vectors.sparkSession.createDataFrame([], kinds)
    d, k = w.columns.shape
    rows = usable(vectors).where(F.size("v") == d)
    error = identity_error(rows, w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                u, deviation = _centred(_whole(batch, d), w.n, w.sums)
                z = np.einsum("ij,jk->ik", u, w.columns, optimize=True)
                each, count = np.repeat(np.arange(len(u)), k), len(u) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(u)), pa.int32()),
                    pa.array(np.full(count, w.n, np.int64)), pa.array(deviation.tolist(), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel()), pa.array(np.tile(w.explained, len(u))), pa.array(np.full(count, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(tidy(run), kinds)
