"""Embedding whitening: leading eigenvectors of the covariance by spectrum slicing.

Vectors become whole numbers on a grid, which makes equality, counts and sums exact. The covariance, of the size of one
vector squared whatever the number of rows, is summed up in tasks; its leading eigenpairs are found on the driver. The
number of negative pivots in an LDLᵀ factorisation of V - s I is the number of eigenvalues below s, so such counts halve
intervals until each holds one eigenvalue; Rayleigh quotient iteration, which solves with the same factorisation, then
converges cubically, and two more counts prove that what was found is the k-th eigenvalue and no other.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import settle

COMPONENTS = 16
#: An entry c stands for floor(SCALE * c) + SHIFT; codes leave SHIFT out.
SCALE, SHIFT = 64, 1_000_000
#: Numbers held at once in a task, and the largest code: beyond it an entry has no 64-bit whole number.
SLICE_ENTRIES, LARGEST = 1 << 19, float(1 << 62)
EPS = float(np.finfo(float).eps)


# Codes: a vector's numbers in little-endian integers of 2, 4 or 8 bytes, the fewest that hold all of them, after their width.


def encoded(numbers: np.ndarray) -> list[bytes]:
    """The code of each row of whole numbers: equal for equal rows."""
    size = np.abs(numbers).max(axis=1)
    width = np.where(size < 1 << 15, 2, np.where(size < 1 << 31, 4, 8))
    out: list[bytes] = [b""] * len(numbers)
    for w in np.unique(width).tolist():
        for k in np.flatnonzero(width == w).tolist():
            out[k] = bytes([w]) + numbers[k].astype(f"<i{w}").tobytes()
    return out


def decoded(codes: list[bytes], dim: int) -> np.ndarray:
    numbers = np.zeros((len(codes), dim), np.int64)
    width = np.array([c[0] for c in codes])
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw = np.frombuffer(b"".join(codes[k] for k in at.tolist()), np.uint8).reshape(len(at), 1 + w * dim)
        numbers[at] = np.ascontiguousarray(raw[:, 1:]).view(f"<i{w}")
    return numbers


def coded(vectors: DataFrame, name: str) -> DataFrame:
    """vec_id, dim and code of each vector without null and non-finite entries; empty vectors go, too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
            size = np.where(np.asarray(lists.is_valid()), np.diff(offsets), 0)
            for dim in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == dim)
                for part in np.array_split(rows, max(1, len(rows) * dim // SLICE_ENTRIES)):
                    grid = np.floor(SCALE * values[offsets[part][:, None] + np.arange(dim)])
                    good = (np.abs(grid) < LARGEST).all(axis=1)  # false for NaN and infinities
                    if good.any():
                        codes = encoded(grid[good].astype(np.int64))
                        yield pa.record_batch([batch.column(0).take(pa.array(part[good])), pa.array([dim] * len(codes), pa.int32()), pa.array(codes, pa.binary())], ["vec_id", "dim", "code"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(name).cast("array<double>").alias("v")).mapInArrow(work, "vec_id long, dim int, code binary")


def numbers_of(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches in slices of bounded size, with the whole numbers that the codes in ``column`` stand for."""
    step = max(1, SLICE_ENTRIES // dim)
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part, decoded(part.column(column).to_pylist(), dim)


def exact_sum(numbers: np.ndarray) -> list[int]:
    if float(np.abs(numbers).max()) * len(numbers) < LARGEST:
        return numbers.sum(axis=0).tolist()
    return [sum(c) for c in numbers.T.tolist()]


def totals(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension: a row for each task and dimension is shuffled, ``dim`` rows come back."""

    def work(batches):
        n, sums = 0, [0] * dim
        for _, numbers in numbers_of(batches, 0, dim):
            n += len(numbers)
            sums = [a + b for a, b in zip(sums, exact_sum(numbers), strict=True)]
        if n:
            from decimal import Decimal

            yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array([n] * dim), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], ["j", "n", "s"])

    rows = fit.mapInArrow(work, "j int, n long, s decimal(38,0)").groupBy("j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by = {r.j: (r.n, int(r.s)) for r in rows}
    return (by[0][0], [by[j][1] for j in range(dim)]) if by else (0, [0] * dim)


def centred(numbers: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Numbers less the mean; the mean's whole part is taken off exactly."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    return (numbers - np.array(whole, np.int64)).astype(float) - rest


def products(fit: DataFrame, dim: int, n: int, sums: list[int], project: np.ndarray | None = None) -> np.ndarray:
    """The covariance (divisor n) of the centred rows, or of what ``project`` (rows: axes) makes of them; its mean is zero, as
    theirs is. Each task gives its sum row by row; rows of one index are added up in the order of the tasks."""
    size = dim if project is None else len(project)

    def work(batches):
        total = np.zeros((size, size))
        for _, numbers in numbers_of(batches, 0, dim):
            z = centred(numbers, n, sums)
            z = z if project is None else z @ project.T
            total += z.T @ z
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array([TaskContext.get().partitionId()] * size, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "part", "row"])

    def add(batches):
        key, total = None, np.zeros(size)
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if i != key:
                    if key is not None:
                        yield pa.record_batch([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "row"])
                    key, total = i, np.zeros(size)
                total = total + np.frombuffer(row)
        if key is not None:
            yield pa.record_batch([pa.array([key], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "row"])

    added = fit.mapInArrow(work, "i int, part int, row binary").repartition("i").sortWithinPartitions("i", "part").mapInArrow(add, "i int, row binary")
    out = np.zeros((size, size))
    for r in added.collect():  # as many rows as a vector has entries
        out[r.i] = np.frombuffer(bytes(r.row))
    return (out + out.T) / 2 / n


class Factor:
    """Pᵀ(A - s I)P = L D Lᵀ with symmetric pivots of one or two rows, chosen as Bunch and Kaufman do. Plain numpy without BLAS:
    its threads have been seen to wait for ever in a driver that has started Spark."""

    def __init__(self, a: np.ndarray, shift: float, tiny: float):
        n = len(a)
        w, self.order, self.blocks, self.positive = a - shift * np.eye(n), np.arange(n), [], 0
        self.low, k, alpha = np.eye(n), 0, (1 + 17**0.5) / 8

        def swap(i: int, j: int) -> None:
            if i != j:
                w[[i, j]], self.order[[i, j]] = w[[j, i]], self.order[[j, i]]
                w[:, [i, j]] = w[:, [j, i]]
                self.low[[i, j], :k] = self.low[[j, i], :k]

        while k < n:
            column = np.abs(w[k + 1 :, k])
            r = k + 1 + int(column.argmax()) if len(column) else k
            most, pair = float(column.max()) if len(column) else 0.0, False
            if abs(w[k, k]) < alpha * most:
                other = np.abs(w[r, k:])
                other[r - k] = 0
                beyond = float(other.max())
                if abs(w[k, k]) * beyond >= alpha * most**2:
                    pass
                elif abs(w[r, r]) >= alpha * beyond:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    pair = True
            if pair:
                block, below = w[k : k + 2, k : k + 2].copy(), w[k + 2 :, k : k + 2].copy()
                det = block[0, 0] * block[1, 1] - block[0, 1] ** 2  # negative: one eigenvalue of either sign
                inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det
                times = np.stack([below[:, 0] * inverse[0, j] + below[:, 1] * inverse[1, j] for j in (0, 1)], axis=1)
                w[k + 2 :, k + 2 :] -= np.outer(times[:, 0], below[:, 0]) + np.outer(times[:, 1], below[:, 1])
                self.low[k + 2 :, k : k + 2] = times
                self.blocks.append((k, inverse))
                self.positive += 1
                k += 2
                continue
            pivot = float(w[k, k]) if abs(w[k, k]) > tiny else -tiny  # the shift is an eigenvalue: counted as not above it
            below = w[k + 1 :, k].copy()
            w[k + 1 :, k + 1 :] -= np.outer(below / pivot, below)
            self.low[k + 1 :, k] = below / pivot
            self.blocks.append((k, np.array([[1 / pivot]])))
            self.positive += pivot > 0
            k += 1

    def solve(self, b: np.ndarray) -> np.ndarray:
        x, n = b[self.order].astype(float), len(b)
        for k in range(n):
            x[k + 1 :] -= self.low[k + 1 :, k] * x[k]
        for k, inverse in self.blocks:
            part = x[k : k + len(inverse)].copy()
            x[k : k + len(inverse)] = [(row * part).sum() for row in inverse]
        for k in range(n - 1, -1, -1):
            x[k] -= (self.low[k + 1 :, k] * x[k + 1 :]).sum()
        out = np.empty(n)
        out[self.order] = x
        return out


class Spectrum:
    """Eigenvalues of a symmetric matrix by number, from the largest; what each count shows is kept for the next ones."""

    def __init__(self, a: np.ndarray):
        self.a, self.norm = a, float(np.abs(a).sum(axis=1).max())
        self.tiny = max(EPS * self.norm * 2**-10, 1e-300)
        edge = self.norm * (1 + 1e-9) + 1e-290
        self.known = [(-edge, len(a)), (edge, 0)]  # (shift, eigenvalues above it), ascending in shifts
        self.values: list[float] = []
        self.vectors: list[np.ndarray] = []

    def factor(self, shift: float) -> Factor:
        f = Factor(self.a, shift, self.tiny)
        if all(s != shift for s, _ in self.known):
            insort(self.known, (shift, f.positive))
        return f

    def above(self, shift: float) -> int:
        """How many eigenvalues are larger."""
        counted = [n for s, n in self.known if s == shift]
        return counted[0] if counted else self.factor(shift).positive

    def interval(self, k: int) -> tuple[float, float, int]:
        """The narrowest known (low, high) that holds the k-th eigenvalue, and how many it holds."""
        low, below = max((s, n) for s, n in self.known if n >= k)
        high, over = min((s, n) for s, n in self.known if n < k and s > low)
        return low, high, below - over

    def unit(self, v: np.ndarray) -> np.ndarray:
        """Without what lies along the vectors found so far, of length one."""
        for _ in range(2):
            for u in self.vectors:
                v = v - (u * v).sum() * u
            v = v / np.sqrt((v * v).sum())
        return v

    def residual(self, v: np.ndarray) -> tuple[float, float]:
        av = np.einsum("ij,j->i", self.a, v)
        value = float((v * av).sum())
        return value, float(np.sqrt(((av - value * v) ** 2).sum()))

    def search(self, k: int) -> tuple[float, np.ndarray]:
        start, enough = np.random.default_rng(k).standard_normal(len(self.a)), 32 * EPS * self.norm
        while True:
            low, high, held = self.interval(k)
            close = high - low <= 64 * EPS * self.norm  # equal to double precision: any vectors of the common space do
            if held > 1 and not close:
                self.above((low + high) / 2)
                continue
            shift, v, best = (low + high) / 2, self.unit(start), (np.inf, 0.0, start)
            for turn in range(12):
                v = self.unit(self.factor(shift).solve(v))
                value, off = self.residual(v)
                best = min(best, (off, value, v), key=lambda x: x[0])
                if off <= enough or close and turn >= 3 or not (close or low < value < high):
                    break
                shift = shift if close or not turn else value  # one step at the middle, then Rayleigh quotients
            value, v = best[1:]
            if self.certified(k, value, v):
                return value, v
            if close:
                raise ArithmeticError(f"counts do not certify eigenvalue {k}")
            self.above((low + high) / 2)  # the interval is too wide yet for the iteration to stay in it

    def certified(self, k: int, value: float, v: np.ndarray) -> bool:
        """Whether counts on either side, as close as the residual allows, say that this is the k-th eigenvalue."""
        slack = max(4 * self.residual(v)[1], 128 * EPS * self.norm, 1e-280)
        return slack <= 1e-9 * self.norm and self.above(value + slack) < k <= self.above(value - slack)

    def next(self) -> None:
        value, v = self.search(len(self.values) + 1)
        self.values.append(value)
        self.vectors.append(v)


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a covariance that are above rounding, falling, and their unit vectors (rows)."""
    spectrum, trace = Spectrum(a), float(np.trace(a))
    for _ in range(min(count, len(a)) if trace > 0 else 0):
        spectrum.next()
        if spectrum.values[-1] <= 64 * len(a) * EPS * trace:
            spectrum.values.pop(), spectrum.vectors.pop()
            break
    order = sorted(range(len(spectrum.values)), key=lambda k: -spectrum.values[k])
    return np.array([spectrum.values[k] for k in order]), np.array([spectrum.vectors[k] for k in order]).reshape(len(order), len(a))


def deviations(numbers: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)², exact; none where it exceeds a 64-bit number."""
    if float(np.abs(numbers).max()) * n < LARGEST and max(map(abs, sums)) < LARGEST:
        apart = n * numbers - np.array(sums, np.int64)
        if float(np.abs(apart).max()) ** 2 * numbers.shape[1] < LARGEST:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * x - s) ** 2 for x, s in zip(row, sums, strict=True)) for row in numbers.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whiten(vectors: DataFrame, name: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row of ``vectors`` (vec_id, ``name``)
    and leading component.

    Rows whose vector is null, empty or holds a null or non-finite entry are dropped, and so are vectors of another length
    than the most frequent one (the longer of equally frequent ones) and entries beyond 2^62 / 64, which have no whole
    number. Each distinct vector counts once in the fit, however many rows hold it; rows of null or repeated vec_id are rows
    like others. Components of no variance (fewer distinct vectors than dimensions) are left out: nothing can be divided by
    their root. A deviation beyond 64 bits is null. A table without rows that remain gives an empty result; other columns
    are ignored.

    Distinct codes (two bytes an entry as a rule) are shuffled once, combined in each task first. The driver holds two square
    matrices of the size of a vector.
    """
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = settle(coded(vectors, name))
    common = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], out)
    dim = common.dim
    rows = rows.filter(F.col("dim") == dim)
    fit = settle(rows.select("code").distinct())
    n, sums = totals(fit, dim)
    covariance = products(fit, dim, n, sums)
    values, axes = leading(covariance, components)
    explained = values / np.trace(covariance) if len(values) else values
    project = axes / np.sqrt(values)[:, None]
    error = float(np.abs(products(fit, dim, n, sums, project) - np.eye(len(values))).max()) if len(values) else 0.0
    count = len(values)

    def work(batches):
        for part, numbers in numbers_of(batches, 1, dim):
            if count:
                white = centred(numbers, n, sums) @ project.T
                each = np.repeat(np.arange(len(numbers)), count)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), len(numbers)), pa.int32()), pa.array([n] * len(each)),
                        pa.array(deviations(numbers, n, sums), pa.int64()).take(pa.array(each)), pa.array(white.ravel()), pa.array(np.tile(explained, len(numbers))), pa.array([error] * len(each)),
                    ],
                    [x.split()[0] for x in out.split(", ")],
                )

    return rows.select("vec_id", "code").mapInArrow(work, out)
