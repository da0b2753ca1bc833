"""Whitening of embeddings by their leading principal components, found by spectrum slicing.

Spark gathers exact integer sums, then the covariance of the centred vectors: each task adds up one
matrix, matrices are added row by row in a shuffle, and one matrix as wide as a vector reaches the
driver, whatever the number of rows. There the number of eigenvalues above any shift is the number of
positive pivots of the LDL' factorisation of the shifted covariance (Sylvester's law of inertia). Shifts
are bisected until an interval holds one wanted eigenvalue, Rayleigh quotient iteration inside it
converges cubically, and counts on both sides of the result certify its number. Eigenvalues that no
shift of double precision can part share an interval, whose vectors are made orthogonal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000  # an entry c becomes the integer floor(SCALE * c) + OFFSET
LARGEST = 2.0**38  # entries of this size or more are treated like those that are not finite
ROWS_AT_ONCE = 2_000
EPSILON = np.finfo(float).eps
PIVOT = (1 + 17**0.5) / 8  # least size of a single pivot against its column


# ---------------------------------------------------------------- spectrum slicing


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """Positive pivots of the symmetric factorisation L D L' of matrix - shift * identity, with
    pivots of one or two rows (a pair, chosen where a single pivot would be small, has one of each sign)."""
    m = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(m):
        if len(m) == 1:
            return positive + int(m[0, 0] > 0)
        column = np.abs(m[1:, 0])
        r = 1 + int(column.argmax())
        size, own = column[r - 1], abs(m[0, 0])
        pair = False
        if own < PIVOT * size:
            across = np.abs(m[r])
            across[r] = 0
            widest = across.max()
            if own * widest < PIVOT * size * size:
                pair = abs(m[r, r]) < PIVOT * widest
                place = 1 if pair else 0
                order = np.arange(len(m))
                order[[place, r]] = order[[r, place]]
                m = m[np.ix_(order, order)]
        if pair:
            block, low = m[:2, :2], m[2:, :2]
            determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            positive += 1 if determinant < 0 else 2 * int(block[0, 0] + block[1, 1] > 0)
            m = m[2:, 2:] - low @ np.linalg.solve(block, low.T)
        else:
            head, low = m[0, 0], m[1:, 0]
            positive += int(head > 0)
            m = m[1:, 1:] - (np.outer(low, low / head) if head else 0)
    return positive


def intervals(matrix: np.ndarray, wanted: int, resolution: float) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): eigenvalues numbered first to last, from the largest one, lie between low
    and high. Bisected until one is alone or the interval is as narrow as the resolution."""
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    low = float((np.diag(matrix) - radius).min()) - resolution
    high = float((np.diag(matrix) + radius).max()) + resolution
    waiting, out = [(low, high, 1, len(matrix))], []
    while waiting:
        low, high, first, last = waiting.pop()
        if first > wanted:
            continue
        middle = (low + high) / 2
        if first == last or high - low <= resolution or middle in (low, high):
            out.append((low, high, first, last))
            continue
        above = min(max(eigenvalues_above(matrix, middle), first - 1), last)
        if above >= first:
            waiting.append((middle, high, first, above))
        if above < last:
            waiting.append((low, middle, above + 1, last))
    return sorted(out, key=lambda i: i[2])


def shifted_solve(matrix: np.ndarray, shift: float, vector: np.ndarray, scale: float) -> np.ndarray:
    """A unit vector along the solution, also where the shift is an eigenvalue."""
    eye = np.eye(len(matrix))
    for nudge in (0.0, EPSILON, 8 * EPSILON, 64 * EPSILON):
        try:
            found = np.linalg.solve(matrix - (shift + nudge * scale) * eye, vector)
        except np.linalg.LinAlgError:
            continue
        length = np.linalg.norm(found)
        if np.isfinite(length) and length > 0:
            return found / length
    raise RuntimeError(f"no solution near the shift {shift}")


def orthogonal(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    return vector / np.linalg.norm(vector)


def rayleigh(matrix, low, high, start, others, scale) -> tuple[float, np.ndarray, float]:
    """(value, vector, residual) from Rayleigh quotient iteration that begins between the two bounds."""
    x = orthogonal(start, others)
    for _ in range(2):
        x = orthogonal(shifted_solve(matrix, (low + high) / 2, x, scale), others)
    best = (0.0, x, np.inf)
    for _ in range(20):
        value = float(x @ matrix @ x)
        residual = float(np.linalg.norm(matrix @ x - value * x))
        if residual >= best[2]:
            break
        best = (value, x, residual)
        x = orthogonal(shifted_solve(matrix, value, x, scale), others)
    return best


def leading_eigenpairs(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, vectors as columns) of a symmetric matrix without negative eigenvalues: at
    most ``wanted``, and only values that double precision can tell from zero. RuntimeError if the counts
    contradict a value's number."""
    size = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((size, 0))
    close = 16 * EPSILON * size * scale
    wanted = min(wanted, eigenvalues_above(matrix, close))
    draw = np.random.default_rng(size)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for low, high, first, last in intervals(matrix, wanted, close):
        for number in range(first, min(last, wanted) + 1):
            while True:
                value, vector, residual = rayleigh(matrix, low, high, draw.standard_normal(size), vectors, scale)
                if low - close <= value <= high + close and residual <= 64 * close:
                    break
                if high - low <= close:
                    raise RuntimeError(f"eigenvalue {number} was not reached between {low} and {high}")
                middle = (low + high) / 2  # it went to a neighbour: begin nearer
                low, high = (middle, high) if eigenvalues_above(matrix, middle) >= number else (low, middle)
            values.append(value)
            vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")
    values = np.array(values)[order]
    for number, value in enumerate(values, 1):
        if eigenvalues_above(matrix, value + 64 * close) >= number or eigenvalues_above(matrix, value - 64 * close) < number:
            raise RuntimeError(f"counts contradict that {value} is eigenvalue {number}")
    columns = np.array(vectors).T[:, order] if len(order) else np.zeros((size, 0))
    return values, columns


# ---------------------------------------------------------------- Spark's part


def usable(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, integers as a matrix) for every length of the usable vectors."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    entries = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    lengths[np.asarray(lists.is_null())] = 0
    for length in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == length)
        for part in np.split(places, range(ROWS_AT_ONCE, len(places), ROWS_AT_ONCE)):
            found = entries[offsets[part][:, None] + np.arange(length)]
            with np.errstate(invalid="ignore"):
                good = (np.abs(found) < LARGEST).all(axis=1)
            if good.any():
                yield part[good], np.floor(SCALE * found[good]).astype(np.int64) + OFFSET


def vectors_of(table: DataFrame) -> DataFrame:
    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))


def totals(table: DataFrame) -> tuple[int, list[int]]:
    """Number of the vectors of the most frequent length and their exact sums for each dimension."""

    def run(batches):
        for batch in batches:
            for places, x in usable(batch.column(1)):
                size = x.shape[1]
                columns = [np.full(size, size), np.arange(size), np.full(size, len(x)), x.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "i", "n", "total"])

    parts = vectors_of(table).mapInArrow(run, "length long, i long, n long, total long")
    sums = parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    # One row for each dimension of the chosen length.
    chosen = sums.filter("i = 0").orderBy(F.desc("n"), "length").select("length").limit(1)
    rows = sums.join(F.broadcast(chosen), "length").select("i", "n", "total").collect()
    rows.sort(key=lambda r: r.i)
    return (rows[0].n, [int(r.total) for r in rows]) if rows else (0, [])


class Centre:
    """Takes the means from integer vectors: sums / n is a whole part and a remainder, so that the
    difference is rounded once."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.size = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 for each row, exactly; None where it is no long."""
        y = x - self.whole
        largest = self.n * (int(np.abs(y).max()) + 1)
        if largest * largest * self.size < 2**63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * y.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in exact]


def covariance(table: DataFrame, length: int, n: int, view: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Covariance (divisor n) of what ``view`` makes of the vectors, which must have means near 0; the
    means that rounding leaves are taken off. One matrix for each task, added by rows."""

    def run(batches):
        products, sums = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for _, x in usable(batch.column(1)):
                if x.shape[1] == length:
                    z = view(x)
                    products += z.T @ z
                    sums += z.sum(axis=0)
        if sums.any() or products.any():
            task = np.full(size + 1, TaskContext.get().partitionId())
            arrays = [pa.array(np.arange(size + 1)), pa.array(task), pa.array([*products, sums], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "task", "row"])

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")  # one order of adding, so reruns agree to the last bit
        total = np.zeros(size)
        for row in rows["row"]:
            total += np.asarray(row.values)
        return pa.table({"i": rows["i"][:1], "row": pa.array([total], pa.list_(pa.float64()))})

    parts = vectors_of(table).mapInArrow(run, "i long, task long, row array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "i long, row array<double>").toArrow().sort_by("i")
    if not len(rows):
        return np.zeros((size, size))
    found = np.array(rows["row"].to_pylist())
    means = found[size] / n
    products = found[:size] / n - np.outer(means, means)
    return (products + products.T) / 2


SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable row of
    (vec_id, embedding) and every component, numbered from 1 by falling eigenvalue.

    Dropped are rows whose vector is null, empty, holds null or non-finite entries or ones of 2^38 or
    more in size, or has another length than most (ties: the shorter length). Every other row counts and
    stays, repeated ones and those with a null vec_id too; other columns are not read. There are as
    many components as asked for, at most as many as the covariance has eigenvalues that double precision
    tells from zero, so one row, equal rows or an empty table give no rows. A deviation that is no long is
    null. The largest difference of the whitened rows' covariance from the identity is measured over all rows.
    """
    spark = table.sparkSession
    n, sums = totals(table)
    if not n:
        return spark.createDataFrame([], SCHEMA)
    centre, length = Centre(n, sums), len(sums)
    matrix = covariance(table, length, n, centre, length)
    values, columns = leading_eigenpairs(matrix, components)
    count = len(values)
    if not count:
        return spark.createDataFrame([], SCHEMA)
    scaled = columns / np.sqrt(values)
    own = covariance(table, length, n, lambda x: centre(x) @ scaled, count)
    error = float(np.abs(own - np.eye(count)).max())
    explained = values / np.trace(matrix)

    def run(batches):
        fields = [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
        schema = pa.schema([*fields, *[(c, pa.float64()) for c in ("whitened", "explained", "identity_error")]])
        for batch in batches:
            for places, x in usable(batch.column(1)):
                if x.shape[1] != length:
                    continue
                rows = len(x) * count
                each = pa.array(np.repeat(np.arange(len(x)), count))
                columns = [
                    batch.column(0).take(pa.array(np.repeat(places, count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(rows, n)),
                    pa.array(centre.deviation(x), pa.int64()).take(each),
                    pa.array((centre(x) @ scaled).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(rows, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return vectors_of(table).mapInArrow(run, SCHEMA)
