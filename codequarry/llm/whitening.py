"""Embedding whitening: exact moments by Spark, principal components by FEAST contour integration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import written

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
CONTOUR = 8  # eigenvalues within one contour, more only where they lie too close to be parted
NODES = 16  # quadrature points on a contour's upper half
TURNS = 40


def _finite(column: pa.ListArray, length: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places in the column, integer rows x - OFFSET) of the vectors whose entries are all finite."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    out = {}
    for n in [length] if length else np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
        good = np.isfinite(values).all(axis=1)
        y = np.floor(SCALE * values[good])
        if y.size and np.abs(y).max() >= 2.0**52:
            raise OverflowError("an entry is too large for an exact long")
        out[n] = (at[good], y.astype(np.int64))
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vector: count and per-dimension sums of a partition."""
    total: dict[int, list] = {}
    for batch in batches:
        for n, (at, y) in _finite(batch.column(0)).items():
            mine = total.setdefault(n, [0, np.zeros(n, np.int64)])
            mine[0] += len(at)
            mine[1] += y.sum(axis=0)
    for n, (count, sums) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, n), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(np.full(n, count)), pa.array(sums)], ["length", "i", "n", "s"])


def _moments(vectors: DataFrame, length: int, rows: Callable[[np.ndarray], np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of ``rows(y)`` (``size`` columns) over all vectors; the driver gets size * (size + 1) numbers."""

    def run(batches):
        first, second = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            r = rows(_finite(batch.column(0), length)[length][1])
            first += r.sum(axis=0)
            second += r.T @ r
        both = np.vstack([first[None, :], second])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), pa.int32()), pa.array(list(both), pa.list_(pa.float64()))], ["i", "row"])

    parts = vectors.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    table = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    both = np.zeros((size + 1, size))
    both[table["i"].to_numpy(), table["j"].to_numpy()] = table["v"].to_numpy()
    return both[0], both[1:]


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix that is congruent (and similar) to symmetric ``a``."""
    a = np.array(a, np.float64)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        if not alpha:
            continue
        v[0] -= alpha
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = alpha
    return np.diag(a).copy(), np.diag(a, -1) ** 2


def inertia(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each of ``at``: positive pivots of the shifted matrix (Sylvester's law)."""
    above, q = np.zeros(len(at), np.int64), np.ones(len(at))
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    for k, d in enumerate(diagonal):
        q = d - at - (off[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        above += q > 0
    return above


def contours(v: np.ndarray, wanted: int) -> tuple[list[tuple[float, float, int]], int]:
    """Intervals ``(low, high, count)`` that together hold at least the ``wanted`` largest eigenvalues, and how many these are.

    Ends lie in gaps of the spectrum that inertia counts locate, so that no contour passes through an eigenvalue.
    Eigenvalues that are zero to double precision are not counted.
    """
    size, top = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    if not top:
        return [], 0
    diagonal, off = tridiagonal(v)
    floor = size * np.finfo(float).eps * top
    rank = int(inertia(diagonal, off, np.array([floor]))[0])
    wanted = min(wanted, rank)
    low, high = np.zeros(rank), np.full(rank, top * (1 + 1e-12))
    for _ in range(60):  # the kth largest eigenvalue is above low and not above high
        middle = (low + high) / 2
        more = inertia(diagonal, off, middle) >= np.arange(1, rank + 1)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    e = np.append((low + high) / 2, 0.0)
    out, begin = [], 0
    upper = e[0] + max(e[0] - e[1], 1e-3 * e[0]) / 2 if rank else 0.0
    while begin < wanted:
        near = 1e-8 * e[begin]
        gaps = [k for k in range(begin + 1, rank + 1) if e[k - 1] - e[k] > near or k == rank]
        few = [k for k in gaps if k <= begin + CONTOUR and (k >= begin + CONTOUR // 2 or k >= wanted)] or [k for k in gaps if k > begin + CONTOUR // 2][:1] or gaps[-1:]
        end = max(few, key=lambda k: (e[k - 1] - e[k]) / e[k - 1])
        lower = (e[end - 1] + e[end]) / 2 if end < rank else max(floor, e[end - 1] / 2)
        out.append((float(lower), float(upper), end - begin))
        begin, upper = end, lower
    counts = inertia(diagonal, off, np.array([c[0] for c in out]))
    if any(int(n) != sum(c[2] for c in out[: k + 1]) for k, n in enumerate(counts)):
        raise ArithmeticError("inertia counts of the contours' ends disagree")
    return out, wanted


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of ``v`` within the interval and their vectors.

    A rational filter, the quadrature of complex shifted solves along a circle through both ends, projects a random
    block onto the interval's eigenvectors; Rayleigh-Ritz extracts them, until residuals are at rounding and there are
    as many as the inertia counts say.
    """
    size, scale = len(v), np.abs(v).sum(axis=1).max()
    x, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 - x))
    middle, radius = (low + high) / 2, (high - low) / 2
    width, rng, best = min(size, 2 * count + 4), np.random.default_rng(11), np.inf
    block = rng.standard_normal((size, width))
    for k in range(TURNS):
        q = np.zeros_like(block)
        for t, w in zip(turn, weight):
            q += (w / 2) * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(size) - v, block)).real
        u, s, _ = np.linalg.svd(q, full_matrices=False)
        u = u[:, s > s[0] * 1e-15]
        e, ritz = np.linalg.eigh(u.T @ v @ u)
        block = u @ ritz
        inside = (e > low) & (e <= high)
        worst = np.linalg.norm(v @ block - block * e, axis=0)[inside].max(initial=0.0) / scale
        if inside.sum() == count and (worst <= 1e-15 or (worst >= best / 2 and worst <= 1e-12)):
            return e[inside], block[:, inside]
        best = min(best, worst) if inside.sum() == count else np.inf
        if inside.sum() != count and k and block.shape[1] < size:  # too narrow a block: wider
            block = np.hstack([block, rng.standard_normal((size, min(size - block.shape[1], count + 4)))])
    raise ArithmeticError(f"{inside.sum()} of {count} eigenvalues converged")


def components(spark, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``wanted`` eigenvalues of ``v``, falling, and their vectors as columns; each contour is one task."""
    cuts, wanted = contours(v, wanted)
    if not wanted:
        return np.zeros(0), np.zeros((len(v), 0))
    shared = spark.sparkContext.broadcast(v)

    def run(batches):
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = feast(shared.value, low, high, count)[1]
                yield pa.RecordBatch.from_arrays([pa.array(list(vectors.T), pa.list_(pa.float64()))], ["vector"])

    found = spark.createDataFrame(cuts, "low double, high double, count int").repartition(len(cuts)).mapInArrow(run, "vector array<double>").toArrow()
    block = np.array(found["vector"].to_pylist()).T
    if block.shape[1] != sum(c[2] for c in cuts):
        raise ArithmeticError("components are missing")
    q = np.linalg.qr(block)[0]  # once more over all contours, so that all are at right angles
    e, ritz = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(e)[::-1][:wanted]
    return e[order], q @ ritz[:, order]


def _deviation(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """sum over dimensions of (n * y - sums)^2 as exact longs."""
    if not len(y):
        return np.zeros(0, np.int64)
    if n * float(np.abs(y).max()) + float(np.abs(sums).max()) < 2.0**62:
        z = n * y - sums
        if len(sums) * float(np.abs(z).max()) ** 2 < 2.0**62:
            return (z * z).sum(axis=1)
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist())) for row in y.tolist()]
    if max(exact) >= 2**63:
        raise OverflowError("a deviation does not fit a long")
    return np.array(exact, np.int64)


def whiten(embeddings: DataFrame, vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    Entries c become x = floor(64 * c) + 1000000.  The mean and the covariance V (divisor n, centred on the exact mean
    first) are of all vectors; FEAST gives the ``wanted`` largest components, found in one task per contour and verified
    by inertia counts.  ``whitened`` is x - mean on the component over the root of its eigenvalue; ``identity_error`` is
    measured on all whitened rows.  Four passes read the vectors; between them the driver holds V alone, whose size
    goes with the dimension and not with the rows.

    Vectors that are null, empty, or hold null or non-finite entries give no row and are in no statistic.  Vectors whose
    length is not the commonest (ties: the longest) give none either, as they have no covariance with the others.
    Components with an eigenvalue of zero (to double precision) have no whitened value and are left out, so that equal
    vectors, or a single one, give no rows; an empty table gives none.  Null and repeated vec_ids keep a row each.
    Entries past 2^52 / 64, and a deviation past a long, raise OverflowError.  Further columns are ignored.
    """
    spark = embeddings.sparkSession
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    parts = written(given.select("v").mapInArrow(_sums, "length int, i int, n long, s long"), "sums")
    first = parts.where("i = 0").groupBy("length").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("length")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    length, n = first
    table = parts.where(F.col("length") == length).groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    sums = np.zeros(length, np.int64)
    sums[table["i"].to_numpy()] = table["s"].to_numpy()
    mean = sums / n
    covariance = _moments(given.select("v"), length, lambda y: y - mean, length)[1] / n
    covariance = (covariance + covariance.T) / 2
    e, vectors = components(spark, covariance, wanted)
    k = len(e)
    if not k:
        return spark.createDataFrame([], schema)
    to_white = vectors / np.sqrt(e)
    total, products = _moments(given.select("v"), length, lambda y: (y - mean) @ to_white, k)
    error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(k)).max())
    explained = e / np.trace(covariance)

    def run(batches):
        for batch in batches:
            at, y = _finite(batch.column(1), length)[length]
            rows = len(at)
            ids = batch.column(0).take(pa.array(np.repeat(at, k)))
            white = (y - mean) @ to_white
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n)), pa.array(np.repeat(_deviation(y, n, sums), k)), pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return given.mapInArrow(run, schema)
