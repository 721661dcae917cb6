"""Embedding whitening by cyclic Jacobi rotations of a scatter matrix that Spark sums up.

Three passes of mapInArrow over the vectors, each of which leaves sums per task that Spark adds up by row of the matrix:
the sums of each dimension, the scatter around the mean, and the covariance of the whitened vectors as a check. Entries are
made whole numbers, so the first two are exact: the scatter is taken around the mean rounded to whole numbers, and what
rounding left out is put right in whole numbers on the driver. Sums travel in parts of LIMB bits, which do not overflow.
The driver holds a matrix of the dimension's size only. It turns the matrix by Jacobi rotations, all pairs in cyclic
order, until every off-diagonal entry vanishes beside its two diagonal ones; so small eigenvalues are as accurate as
large ones. The whitening matrix goes to all tasks; its size depends on the dimension alone.

Defined cases: a vector that is null, or holds null or non-finite entries (or any too large for a whole number of 64
bits), is dropped; vectors have the length that most of the rest have (the smaller on ties), others are dropped, and so
are empty ones; rows that repeat count as often as they stand; a null vec_id is kept; a component without variance has
no whitened value and explains 0; a deviation that no long holds is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, docs_table, written

#: Entries are multiplied by SCALE, cut to whole numbers and shifted by SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: At most so many components are given out.
COMPONENTS = 32
#: Sums travel as LIMBS numbers of LIMB bits, the last one with the sign.
LIMB, LIMBS = 40, 4
#: Rows of a scatter block; a block's products stay whole numbers in doubles as long as entries are of common size.
BLOCK = 4096
EXACT = float(2**53)


def vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and the entries as doubles, of the rows whose vector is there and finite."""
    entry = F.transform(F.col(column), lambda c: c.cast("double"))
    fit = F.forall("v", lambda c: F.coalesce(F.abs(c) < float(2**62 // SCALE), F.lit(False)) & ~F.isnan(c))
    return table.select(F.col(id_column).cast("long").alias("vec_id"), entry.alias("v")).where(F.col("v").isNotNull() & fit)


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, which all have one length, as rows of whole numbers."""
    flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(b.num_rows, -1) + SHIFT


def _limbs(values: list[int]) -> list[list[int]]:
    """Whole numbers of any size, cut into LIMBS rows of parts."""
    out = []
    for k in range(LIMBS):
        last = k == LIMBS - 1
        out.append([v >> (LIMB * k) if last else (v >> (LIMB * k)) & ((1 << LIMB) - 1) for v in values])
    return out


def _added(parts: DataFrame, by: str) -> DataFrame:
    """The parts of equal rows, added entry by entry. A task meets a few arrays from each task before it and holds one sum a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        kind = None
        for b in batches:
            kind = b.column(by).type
            for k, row in zip(b.column(by).to_pylist(), b.column("parts")):
                row = row.values.to_numpy()
                if k in total:
                    total[k] += row
                else:
                    total[k] = row.copy()
        for k, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], kind), pa.array([row])], [by, "parts"])

    return parts.repartition(by).mapInArrow(run, parts.schema)


def _whole(parts: list[int]) -> list[int]:
    """What _limbs cut, put together again."""
    n = len(parts) // LIMBS
    return [sum(parts[k * n + j] << (LIMB * k) for k in range(LIMBS)) for j in range(n)]


def _sums(v: DataFrame) -> tuple[int, list[int]]:
    """(n, the sum of each dimension) of the vectors of the most common length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            lengths = np.asarray(b.column("v").value_lengths())
            for length in np.unique(lengths[lengths > 0]).tolist():
                x = _matrix(b.filter(pa.array(lengths == length)))
                high, low = x >> 20, x & ((1 << 20) - 1)  # so that no sum of a batch overflows
                held = total.setdefault(length, [0, [0] * length])
                held[0] += len(x)
                held[1] = [s + (int(h) << 20) + int(w) for s, h, w in zip(held[1], high.sum(0), low.sum(0))]
        for length, (n, sums) in total.items():
            yield pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "parts": pa.array([[n, *[x for k in _limbs(sums) for x in k]]], pa.list_(pa.int64()))})

    sums = written(_added(v.mapInArrow(run, "length int, parts array<long>"), "length"), "white-sums")
    top = sums.orderBy(F.col("parts")[0].desc(), "length").first()
    discard(sums)
    return (top["parts"][0], _whole(top["parts"][1:])) if top else (0, [])


def _scatter(v: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, divisor n, correctly rounded: n * (sum of y y^T) - d d^T over n^2, with y = x - m, m = round(S / n), d = S - n * m."""
    dims = len(sums)
    mean = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(mean, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[list[int]] = []
        block, rows, held = np.zeros((dims, dims)), 0, 0.0

        def take() -> None:
            got = block.astype(np.int64).tolist()
            total[:] = [[a + c for a, c in zip(x, y)] for x, y in zip(total, got)] if total else got

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                y = _matrix(b.slice(at, BLOCK)) - centre
                size = float(np.abs(y).max()) ** 2 * len(y)
                if size >= EXACT:  # entries out of all proportion: whole numbers of any size
                    big = y.astype(object)
                    got = (big.T @ big).tolist()
                    total = [[a + c for a, c in zip(x, z)] for x, z in zip(total, got)] if total else got
                    continue
                if held + size >= EXACT:
                    take()
                    block, held = np.zeros((dims, dims)), 0.0
                y = y.astype(np.float64)
                block += y.T @ y
                held, rows = held + size, rows + len(y)
        if rows:
            take()
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "parts": pa.array([[x for k in _limbs(row[i:]) for x in k]], pa.list_(pa.int64()))})

    out = np.zeros((dims, dims))
    rest = [s - n * m for s, m in zip(sums, mean)]
    for r in _added(v.mapInArrow(run, "i int, parts array<long>"), "i").toLocalIterator():
        for j, p in enumerate(_whole(r["parts"]), r["i"]):
            out[r["i"], j] = out[j, r["i"]] = (n * p - rest[r["i"]] * rest[j]) / (n * n)
    return out


def rounds(dims: int) -> np.ndarray:
    """The pairs of 0..dims-1 in cyclic order: each round pairs every index with another at most once, all rounds make all pairs."""
    ring = [*range(dims), *([-1] if dims % 2 else [])]
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        out.append([sorted(p) for p in zip(ring[:half], ring[:half - 1 : -1]) if -1 not in p])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return np.array(out, np.int64).reshape(len(out), -1, 2)


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix without negative eigenvalues.

    A sweep rotates every pair once, those of a round together as they share no row. It ends when each |a_pq| is below
    the rounding of sqrt(a_pp a_qq): the test that keeps small eigenvalues as accurate as the entries allow.
    """
    a, dims = matrix.copy(), len(matrix)
    turn = np.eye(dims)
    order = rounds(dims) if dims > 1 else np.zeros((0, 0, 2), np.int64)
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for pairs in order:
            p, q = pairs[:, 0], pairs[:, 1]
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            on = np.abs(apq) > eps * np.sqrt(np.abs(app)) * np.sqrt(np.abs(aqq))
            if not on.any():
                continue
            turned = True
            p, q, app, aqq, apq = p[on], q[on], app[on], aqq[on], apq[on]
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(1.0, theta))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            for m in (a, turn):
                left, right = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            upper, lower = a[p], a[q]
            a[p], a[q] = c[:, None] * upper - s[:, None] * lower, s[:, None] * upper + c[:, None] * lower
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    value = np.diag(a)
    falling = np.argsort(-value, kind="stable")
    return value[falling], turn[:, falling] / np.linalg.norm(turn[:, falling], axis=0)


class Whitening:
    """What is fitted: n, the sums, the eigenvalues and the whitening matrix, whose columns are components."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums = n, sums
        self.mean = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.mean)]
        value, vector = jacobi(covariance)
        k = min(components, len(sums))
        trace = float(np.trace(covariance))
        # below the rounding of the largest one times the dimension nothing tells an eigenvalue from zero
        self.flat = value[:k] <= max(0.0, value[0] * len(sums) * np.finfo(float).eps)
        self.values = np.where(self.flat, 0.0, value[:k])
        self.explained = self.values / trace if trace > 0 else np.zeros(k)
        self.matrix = vector[:, :k] / np.where(self.flat, np.inf, np.sqrt(np.where(self.flat, 1.0, value[:k])))

    @classmethod
    def of(cls, state: dict) -> Whitening:
        """The fit with this state: what is broadcast are plain arrays, which workers read before they can import anything."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, centred and whitened."""
        return ((x - np.array(self.mean, np.int64)) - np.array(self.rest, np.float64) / self.n) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2, exact; None where no long holds it."""
        y = x - np.array(self.mean, np.int64)
        most = self.n * (int(np.abs(y).max()) + 1) if len(y) else 0
        if most**2 * len(self.sums) < 2**63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * y.astype(object) - np.array(self.rest, object)) ** 2).sum(1)
        return [int(d) if d < 2**63 else None for d in exact]


def fit(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """(the vectors that remain, what they were fitted to; None where none remain)."""
    v = vectors(table, id_column, column)
    n, sums = _sums(v)
    if not n:
        return v.limit(0), None
    v = v.where(F.size("v") == len(sums))
    return v, Whitening(n, sums, _scatter(v, n, sums), components)


def identity_error(v: DataFrame, fitted: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the components with variance."""
    send = v.sparkSession.sparkContext.broadcast(vars(fitted))
    k = int((~fitted.flat).sum())
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Whitening.of(send.value)
        total, product = np.zeros(k), np.zeros((k, k))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                z = w.project(_matrix(b.slice(at, BLOCK)))[:, ~w.flat]
                total += z.sum(0)
                product += z.T @ z
        for i in range(k):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "parts": pa.array([[total[i], *product[i]]], pa.list_(pa.float64()))})

    got = {r["i"]: r["parts"] for r in _added(v.mapInArrow(run, "i int, parts array<double>"), "i").collect()}
    mean = np.array([got[i][0] for i in range(k)]) / fitted.n  # zero but for rounding, as the vectors are centred already
    return float(np.abs(np.array([got[i][1:] for i in range(k)]) / fitted.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each remaining vector and component: n, deviation, whitened, explained and identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v, fitted = fit(table, components, id_column, column)
    if fitted is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(v, fitted)
    send = table.sparkSession.sparkContext.broadcast(vars(fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Whitening.of(send.value)
        k = len(w.values)
        for big in batches:
            for at in range(0, big.num_rows, BLOCK):
                b = big.slice(at, BLOCK)
                x, rows = _matrix(b), b.num_rows
                each = pa.array(np.repeat(np.arange(rows), k))
                columns = [
                    b.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.n)),
                    pa.array(w.deviation(x), pa.int64()).take(each),
                    pa.array(w.project(x).ravel(), mask=np.tile(w.flat, rows)),
                    pa.array(np.tile(w.explained, rows)),
                    pa.array([error] * (rows * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return v.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(docs_table(spark, sf_dir, "embeddings"))
