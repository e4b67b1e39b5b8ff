"""Embedding whitening by an exact integer scatter.

Entries become integers on a grid: floor(GRID * c) + OFFSET. A shift is subtracted, which no covariance notices, and every
task adds up the sums S and the cross-products X'X of its rows in integers of any size: entries are split into limbs of LIMB
bits, whose products over a block of rows are integers below 2 ** 53, so that matrix products of doubles give them exactly.
What a task found leaves it as 32-bit limbs, which Spark sums as longs, first inside a partition, then across; that is exact
for up to 2 ** 31 tasks. The driver gets one number for each pair of dimensions, never rows: n X'X - SS' is formed in Python
integers, and only then divided by n * n, to the nearest double, and decomposed by eigh. So the covariance doesn't depend on
the order of rows or tasks, and loses nothing to cancellation, however far from zero the vectors lie.

Whitened values project x - S / n, formed as (n x - S) / n from integers, on the components. Their covariance is measured in
one more pass over all rows; the largest entry of its difference from the identity is `identity_error`.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors of another length than most
have (the longer, if two lengths are as frequent). Entries beyond 2 ** 62 on the grid are held at that. Repeated rows count
each; a null id is an id like any other. Directions without variance (an eigenvalue not above d * 2.2e-16 of the largest) are
no components: one row, or equal ones, give none, and an empty table gives no rows. The sign of a component is such that its
entry of largest size is positive. `deviation` is null where it exceeds a long. Extra columns are ignored. The model grows
with the square of the dimension, not with rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Bits of a limb; rows of a block whose products doubles hold exactly: 2 ** (20 + 20 + 12) < 2 ** 53.
LIMB, BLOCK = 20, 4096
#: Entries are held within this.
MOST = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n rows, the sums of shifted entries, eigenvalues falling, unit eigenvectors as columns, each one's share of the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows whose vector is whole and finite."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("vec_id"), v.alias("vector")).where((F.size("vector") > 0) & ~odd)


def common_length(rows: DataFrame) -> int:
    """The length that most vectors have; 0 for an empty table."""
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("x")).first().x
    return most.d if most else 0


def shifted(column: pa.Array, d: int) -> np.ndarray:
    """The grid's integers less the shift, a row for each vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        x = np.floor(c * GRID)
    # The shift is OFFSET, so what is subtracted is what was added; values beyond MOST are cut before they become integers.
    return np.clip(x, -float(MOST), float(MOST)).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of doubles' integers, the k-th times 2 ** (LIMB * k), each at most 2 ** LIMB in size."""
    parts = []
    while len(y) and np.abs(y).max() >= 1 << LIMB:
        parts.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return [*parts, y.astype(np.float64)]


class Scatter:
    """Sums and cross-products of rows, exact."""

    def __init__(self, d: int) -> None:
        self.n, self.sums, self.products = 0, np.zeros(d, object), np.zeros((d, d), object)

    def add(self, y: np.ndarray) -> None:
        for k in range(0, len(y), BLOCK):
            parts = limbs(y[k : k + BLOCK])
            for i, a in enumerate(parts):
                self.sums += _whole(a.sum(axis=0)) * (1 << (LIMB * i))
                for j, b in enumerate(parts):
                    self.products += _whole(a.T @ b) * (1 << (LIMB * (i + j)))
        self.n += len(y)

    def pieces(self) -> Iterator[tuple[int, int, int, int]]:
        """i, j, place, limb of 32 bits: cross-products for i <= j; sums at j = -1; the number of rows at i = j = -1."""
        d = len(self.sums)
        numbers = [(-1, -1, self.n), *((i, -1, self.sums[i]) for i in range(d)), *((i, j, self.products[i, j]) for i in range(d) for j in range(i, d))]
        for i, j, v in numbers:
            sign, size, k = (-1 if v < 0 else 1), abs(v), 0
            while size:
                yield i, j, k, sign * (size & 0xFFFFFFFF)
                size, k = size >> 32, k + 1


def _whole(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).astype(object)


PIECES = "i int, j int, place int, limb long"


def _scatters(d: int):
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("limb", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, n = Scatter(d), [], 0
        for b in rows:
            held.append(shifted(b.column(0), d))
            n += b.num_rows
            if n >= BLOCK:
                own.add(np.concatenate(held))
                held, n = [], 0
        if held:
            own.add(np.concatenate(held))
        columns = list(zip(*own.pieces(), strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows' vectors (all of one length); None without rows or without variance."""
    prepare(rows.sparkSession)
    d = common_length(rows)
    if not d:
        return None
    found = rows.where(F.size("vector") == d).select("vector").mapInArrow(_scatters(d), PIECES).groupBy("i", "j", "place").agg(F.sum("limb").alias("limb"))
    totals: dict[tuple[int, int], int] = {}
    # At most four places or so for each pair of dimensions.
    for r in found.collect():
        totals[r.i, r.j] = totals.get((r.i, r.j), 0) + (r.limb << (32 * r.place))
    return decomposed(totals[-1, -1], [totals.get((i, -1), 0) for i in range(d)], totals, most)


def decomposed(n: int, sums: list[int], products: dict[tuple[int, int], int], most: int) -> Whitening | None:
    """n X'X - SS' in integers, then in doubles over n * n, then its eigenvectors."""
    d = len(sums)
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            # Python divides integers to the nearest double.
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > max(values[0], 0.0) * d * np.finfo(float).eps).sum()))
    if not k:
        return None
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)])
    return Whitening(n, sums, values[:k], vectors, values[:k] / np.trace(v))


def centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n x - S, exactly: longs where they suffice, else Python's integers."""
    size = max((abs(s) for s in model.sums), default=0) + model.n * int(np.abs(y).max(initial=0))
    if size < MOST:
        return y * np.int64(model.n) - np.array(model.sums, np.int64)
    return y.astype(object) * model.n - np.array(model.sums, object)


def deviations(c: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; None beyond a long."""
    size = int(np.abs(c).max(initial=0))
    if size * size * c.shape[1] < 1 << 63:
        return (c * c).sum(axis=1).tolist()
    return [x if x < 1 << 63 else None for x in (sum(int(e) ** 2 for e in row) for row in c)]


def projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    return (c / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened values' covariance minus the identity, over all rows."""
    d, k = len(model.sums), len(model.values)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("x", pa.float64())])
    a, b = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = projected(centred(shifted(batch.column(0), d), model), model)
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, np.arange(k))), pa.int32()), pa.array(np.concatenate((b, np.full(k, -1))), pa.int32()), pa.array(np.concatenate((products[a, b], sums)))], schema=schema)

    found = rows.where(F.size("vector") == d).select("vector").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    mean = {(r.i, r.j): r.x / model.n for r in found.collect()}
    # The values are centred before they are multiplied; what rounding left of their mean is taken off here.
    return max(abs(mean[i, j] - mean[i, -1] * mean[j, -1] - (i == j)) for i, j in zip(a.tolist(), b.tolist(), strict=True))


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _whitened(model: Whitening):
    k = len(model.values)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            c = centred(shifted(b.column(1), len(model.sums)), model)
            m = b.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)), pa.array(deviations(c), pa.int64()).take(pa.array(each)), pa.array(projected(c, model).ravel()), pa.array(np.tile(model.explained, m))],
                schema=schema,
            )

    return run


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector and component."""
    prepare(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where(F.size("vector") == len(model.sums))
    return rows.mapInArrow(_whitened(model), OUT)


def whiten(table: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit on all usable rows, then: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(table, id_col, vector_col)
    model = fit(rows, most)
    if model is None:
        return table.sparkSession.createDataFrame([], f"{OUT}, identity_error double")
    return transform(rows, model).withColumn("identity_error", F.lit(identity_error(rows, model)))
