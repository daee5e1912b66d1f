"""Embedding whitening by spectrum slicing: leading eigenvectors of the covariance, found and numbered by inertia counts.

Three passes over the vectors, each an Arrow batch function with partial sums in its task; what leaves a task has the size of the
model, whatever the number of vectors:

1. sums per dimension of the whole numbers x = floor(64 c) + 1,000,000;
2. products of y = x - m, m being the whole number next to the mean, so they are small and their sums exact. With
   G = sum of y y', s = sum of y, the covariance is (n G - s s') / n^2, an exact fraction rounded once: the same bits in every run;
3. the projection of each vector.

On the driver lies one symmetric matrix of the embedding's dimensions. The number of positive pivots of L D L' = V - t I
(Bunch-Kaufman pivoting) is the number of eigenvalues over t. Halving t isolates the k-th eigenvalue between two
counts, Rayleigh quotient iteration from the middle of that interval converges cubically, and counts on both sides of the result certify its
number. An interval that cannot be split in double precision holds equal eigenvalues; their vectors are made orthogonal.

Defined results: null vectors, and those with a null or non-finite entry, go; of vectors of several lengths the most frequent length stays (of
equally frequent ones the longest); 64 c saturates at +-2^47; repeated rows and null or repeated ids are kept; a component whose eigenvalue
is zero to rounding (constant or dependent dimensions, fewer vectors than dimensions) cannot be whitened and has no rows; a deviation
over 63 bits is null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: entries beyond this saturate
LIMIT = 1 << 47
#: products of entries below this are summed as doubles without rounding, STEP rows at a time
SMALL, STEP = 1 << 20, 4096
EPS = float(np.finfo(np.float64).eps)


def whole(col: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> (rows, x): the usable vectors of a list column as whole numbers."""
    col = col.cast(pa.large_list(pa.float64()))
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    n = np.diff(off)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = np.asarray(col.is_valid()) & (bad[off[1:]] == bad[off[:-1]]) & (n > 0)
    out = {}
    for d in np.unique(n[ok]).tolist():
        rows = np.flatnonzero(ok & (n == d))
        c = flat[off[rows][:, None] + np.arange(d)]
        out[d] = rows, np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT
    return out


def _numbers(x: np.ndarray) -> pa.Array:
    """Whole numbers of any size as decimals."""
    return pa.array([Decimal(int(v)) for v in x], pa.decimal128(38, 0))


def _sums(batches):
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for d, (rows, x) in whole(b.column(0)).items():
            n[d] = n.get(d, 0) + len(rows)
            total[d] = total.get(d, 0) + x.sum(axis=0).astype(object)
    for d in n:
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n[d]] * d, pa.int64()), _numbers(total[d])],
                                         names=["d", "j", "n", "s"])


def _gram(y: np.ndarray) -> np.ndarray:
    """Sum of y y' in whole numbers."""
    large = np.abs(y).max(axis=1, initial=0) >= SMALL
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i in range(0, len(y), STEP):
        part = y[i:i + STEP][~large[i:i + STEP]].astype(np.float64)
        out += (part.T @ part).astype(np.int64)
    for row in y[large].astype(object):
        out += np.outer(row, row)
    return out


def _products(d: int, centre: np.ndarray):
    def run(batches):
        total = np.zeros((d, d), object)
        for b in batches:
            if d in (found := whole(b.column(0))):
                total += _gram(found[d][1] - centre)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _numbers(total[i, j])], names=["i", "j", "v"])
    return run


def above(a: np.ndarray, t: float) -> int:
    """How many eigenvalues of the symmetric ``a`` exceed ``t``: positive pivots of L D L' = a - t I."""
    a = a - t * np.eye(len(a))
    n, i, count = len(a), 0, 0
    bound = (1 + 17 ** 0.5) / 8

    def swap(p, q):
        if p != q:
            a[[p, q]] = a[[q, p]]
            a[:, [p, q]] = a[:, [q, p]]

    while i < n:
        below = np.abs(a[i + 1:, i])
        most = below.max(initial=0.0)
        if most == 0.0:
            count += a[i, i] > 0
            i += 1
            continue
        r = i + 1 + int(below.argmax())
        wide = 1
        if abs(a[i, i]) < bound * most:
            row = np.abs(a[r, i:])
            row[r - i] = 0.0
            other = row.max()
            if abs(a[i, i]) * other >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * other:
                swap(i, r)
            else:
                swap(i + 1, r)
                wide = 2
        if wide == 1:
            c = a[i + 1:, i].copy()
            count += a[i, i] > 0
            a[i + 1:, i + 1:] -= np.outer(c, c / a[i, i])
        else:  # such a block has one eigenvalue of either sign
            c = a[i + 2:, i:i + 2].copy()
            count += 1
            a[i + 2:, i + 2:] -= c @ np.linalg.solve(a[i:i + 2, i:i + 2], c.T)
        i += wide
    return int(count)


def _solve(v: np.ndarray, t: float, x: np.ndarray) -> np.ndarray:
    try:
        y = np.linalg.solve(v - t * np.eye(len(v)), x)
        if np.isfinite(y).all():
            return y / np.linalg.norm(y)
    except np.linalg.LinAlgError:
        pass
    return _solve(v, t + 4 * EPS * max(abs(t), float(np.abs(v).max())), x)


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to k largest eigenvalues (falling) of the positive semidefinite ``v`` that exceed rounding, and their unit vectors as columns."""
    d, top = len(v), float(np.trace(v))
    if not top > 0:
        return np.zeros(0), np.zeros((d, 0))
    fine = 8 * d * EPS * top
    counts = {2 * top: 0, fine: above(v, fine)}
    k = min(k, counts[fine])
    rng = np.random.default_rng(11)
    values: list[float] = []
    vectors = np.zeros((d, 0))
    for number in range(1, k + 1):
        def bounds(number=number):
            return max(t for t, c in counts.items() if c >= number), min(t for t, c in counts.items() if c < number)

        def halve():
            lo, hi = bounds()
            mid = (lo + hi) / 2
            counts[mid] = above(v, mid)
        lo, hi = bounds()
        while counts[lo] - counts[hi] > 1 and hi - lo > fine:
            halve()
            lo, hi = bounds()
        while True:
            x = rng.standard_normal(d)
            x -= vectors @ (vectors.T @ x)
            x /= np.linalg.norm(x)
            alone = counts[lo] - counts[hi] == 1
            for _ in range(2 if alone else 8):
                x = _solve(v, (lo + hi) / 2, x)
                if not alone:
                    x -= vectors @ (vectors.T @ x)
                    x /= np.linalg.norm(x)
            e, rest = float(x @ v @ x), np.inf
            for _ in range(50 if alone else 0):
                y = _solve(v, e, x)
                f = float(y @ v @ y)
                now = float(np.linalg.norm(v @ y - f * y))
                if not now < rest:
                    break
                x, e, rest = y, f, now
            if not alone or (lo - fine <= e <= hi + fine):
                break
            halve()  # the iteration left the interval for a neighbour
            lo, hi = bounds()
        near = fine if alone else 4 * fine
        if not above(v, e - near) >= number > above(v, e + near):
            raise ArithmeticError(f"eigenvalue {number} is not certified by the counts around {e}")
        x -= vectors @ (vectors.T @ x)  # a correction in the last bits
        values.append(e)
        vectors = np.column_stack([vectors, x / np.linalg.norm(x)])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n vectors, sums per dimension, whole centre, eigenvalues (falling), unit vectors as columns, trace."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """Fit over all usable vectors; None if there are none."""
    spark = vectors.sparkSession
    kit.small_batches(spark)
    only = vectors.select(F.col(column).cast("array<double>").alias("v"))
    sums = kit.write(spark, only.mapInArrow(_sums, "d int, j int, n long, s decimal(38,0)")
                     .groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")), "sums")
    length = sums.where("j = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not length:
        kit.discard(sums)
        return None
    d, n = length[0].d, length[0].n
    total = [int(r.s) for r in sums.where(F.col("d") == d).orderBy("j").collect()]  # one row a dimension
    kit.discard(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    left = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    v = np.zeros((d, d))
    products = only.mapInArrow(_products(d, centre), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
    for r in products.collect():  # one row a pair of dimensions
        v[r.i, r.j] = v[r.j, r.i] = (n * int(r.v) - left[r.i] * left[r.j]) / (n * n)
    values, unit = leading(v, components)
    return Whitening(n, total, centre, values, unit, float(np.trace(v)))


def _deviation(n: int, left: np.ndarray, y: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)^2 = (n y - s)^2, in whole numbers."""
    if n * float(np.abs(y).max(initial=0)) + float(np.abs(left).max(initial=0)) < (2 ** 62 / y.shape[1]) ** 0.5:
        far = n * y - left.astype(np.int64)
        return pa.array((far * far).sum(axis=1), pa.int64())
    far = n * y.astype(object) - left
    return pa.array([int(x) if x < 1 << 63 else None for x in (far * far).sum(axis=1)], pa.int64())


def _projection(model: Whitening):
    d = len(model.centre)
    left = np.array([s - model.n * int(c) for s, c in zip(model.sums, model.centre, strict=True)], object)
    offset = np.array([s / model.n for s in left], np.float64)
    axes = model.vectors / np.sqrt(model.values)

    def run(batches):
        for b in batches:
            if d not in (found := whole(b.column("__v"))):
                continue
            rows, x = found[d]
            y = x - model.centre
            w = (y - offset) @ axes
            k = w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            keep = [b.column(i).take(pa.array(rows)) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, _deviation(model.n, left, y), lists], names=[*b.schema.names[:-1], "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, model: Whitening, keep: tuple[str, ...] = ("vec_id",), column: str = "embedding") -> DataFrame:
    """(*keep, deviation, whitened array<double>) of each usable vector."""
    rows = vectors.select(*keep, F.col(column).cast("array<double>").alias("__v"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_projection(model), f"{kept}, deviation long, whitened array<double>")


def _moments(k: int, mean: np.ndarray | None):
    """Sums of whitened values, or of their products about the mean, as one row a task and first index."""
    def run(batches):
        total = np.zeros((1, k) if mean is None else (k, k))
        for b in batches:
            col = b.column(0)
            if len(col):
                w = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), k)
                total += w.sum(axis=0)[None] if mean is None else (w - mean).T @ (w - mean)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])
    return run


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened values (divisor n, centred first) minus the identity."""
    def sums(mean):
        found = whitened.select("whitened").mapInArrow(_moments(k, mean), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((1, k) if mean is None else (k, k))
        for r in found:
            out[r.i, r.j] = r.v
        return out / n
    return float(np.abs(sums(sums(None)[0]) - np.eye(k)).max())


def whitening_report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit_whitening(vectors, components)
    if model is None or not len(model.values):
        return vectors.select("vec_id", F.lit(0).alias("component"), *(F.lit(0).cast("long").alias(c) for c in ("n", "deviation")),
                              *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error"))).where(F.lit(False))
    rows = whiten(vectors, model)
    error = identity_error(rows, model.n, len(model.values))
    share = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(kit.table(spark, sf_dir, "embeddings"))
