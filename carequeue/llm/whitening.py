"""Whitened components of embeddings by block-wise QR and a bidiagonal qd solver.

Components become integers x. Every distinct vector counts once: their number n and sums S
are exact, and so is n * x - S, from which centred rows are taken. Tasks reduce centred
rows block by block to triangular factors; factors are stacked and reduced again, in
rounds, until one is left whose cross product is that of all centred rows. Forming no
cross product keeps small variances accurate. ``qd`` reduces the factor to bidiagonal
form, finds its singular values by dqds and their directions by twisted factorisations.

The driver sees sums of as many numbers as a vector has, one triangular factor and the
covariance of the whitened components; rows stay in tasks.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out,
and so are those with an entry of 2^25 or more and those with another length than the
vector of the least id. Directions without variance beyond rounding are no components: a
table with one distinct vector gives no rows. A ``deviation`` beyond a long is null.
Repeated rows are all returned; rows without an id keep it null. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carequeue.llm.qd import top_directions
from carequeue.operators.shared import written

SCALE = 64
OFFSET = 1_000_000
LIMIT = float(1 << 25)  # of an entry
COMPONENTS = 16
BLOCK_BYTES = 1 << 22  # of the centred rows reduced at once
FACTORS_AT_ONCE = 16

COLUMNS = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double,"
    " identity_error double"
)


def _usable(vector: str) -> str:
    return (
        f"{vector} is not null and forall({vector}, e -> e is not null and not isnan(e)"
        f" and abs(e) < {LIMIT}D)"
    )


def integer_rows(rows: DataFrame) -> tuple[DataFrame, int] | None:
    """(vec_id, x) of the usable rows, x as packed integers less ``OFFSET``, and the length."""
    wide = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    first = (
        wide.where(_usable("embedding"))
        .orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
        .select(F.size("embedding").alias("length"))
        .first()
    )
    if first is None:
        return None
    length = first.length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding"))
            batch = batch.filter(pc.fill_null(pc.equal(sizes, length), False))
            flat = pc.fill_null(batch.column("embedding").flatten(), np.nan)
            values = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
            fine = (np.abs(values) < LIMIT).all(axis=1)  # false for NaN
            x = np.floor(SCALE * values[fine]).astype("<i4")
            ids = batch.column("vec_id").filter(pa.array(fine))
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, packed], ["vec_id", "x"])

    return written(wide.mapInArrow(work, "vec_id long, x binary"), "white-rows"), length


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[np.ndarray]:
    """Integer vectors of batches with packed x, some at a time."""
    at_once = max(1, BLOCK_BYTES // (8 * max(length, 1)))
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.column("x").slice(at, at_once)
            data = b"".join(part.to_pylist())
            yield np.frombuffer(data, "<i4").reshape(len(part), length).astype(np.int64)


@dataclass(frozen=True)
class Centre:
    """Number and sums of the distinct vectors."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x less the sums, exact: in 64 bits where that holds it."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        scaled = self.scaled(x)
        size = int(np.abs(scaled).max(initial=0))
        if size * size * max(x.shape[1], 1) >= 1 << 62:
            exact = (scaled.astype(object) ** 2).sum(axis=1).tolist()
            return [v if v < 1 << 63 else None for v in exact]
        return (scaled * scaled).sum(axis=1).tolist()


def _summed(rows: DataFrame, of_block: Callable[[np.ndarray], np.ndarray], length: int, kind: str) -> np.ndarray:
    """Element-wise sum of an array that is made of every block; as many rows as elements."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, length):
            made = of_block(x)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"]
            )

    parts = rows.select("x").mapInArrow(work, f"at long, value {kind}")
    found = parts.groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(found)])


def centre_of(fit: DataFrame, length: int) -> Centre:
    sums = _summed(fit, lambda x: np.append(x.sum(axis=0), len(x)), length, "long")
    return Centre(int(sums[-1]), sums[:-1])


def _reduced(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows below another factor."""
    stacked = rows if factor is None else np.vstack([factor, rows])
    return np.linalg.qr(stacked, mode="r")


def _factor_row(factor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([len(factor)], pa.int64()), pa.array([factor.astype("<f8").tobytes()])],
        ["rows", "factor"],
    )


def triangular_factor(fit: DataFrame, centre: Centre, length: int) -> np.ndarray:
    """Square factor with the cross product of all centred rows."""
    columns = "rows long, factor binary"

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for x in _blocks(batches, length):
            factor = _reduced(factor, centre.centred(x))
        if factor is not None:
            yield _factor_row(factor)

    def of_factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = None
        for batch in batches:
            for data in batch.column("factor"):
                rows = np.frombuffer(data.as_py(), "<f8").reshape(-1, length)
                factor = _reduced(factor, rows)
        if factor is not None:
            yield _factor_row(factor)

    factors = written(fit.select("x").mapInArrow(of_rows, columns), "white-factors")
    while (n := factors.count()) > 1:
        fewer = factors.repartition(-(-n // FACTORS_AT_ONCE))
        factors = written(fewer.mapInArrow(of_factors, columns), "white-factors")
    found = np.frombuffer(factors.first().factor, "<f8").reshape(-1, length)
    return np.vstack([found, np.zeros((length - len(found), length))])


@dataclass(frozen=True)
class Whitening:
    """What turns a vector into its whitened components."""

    centre: Centre
    variances: np.ndarray  # of the components, falling
    directions: np.ndarray  # unit columns
    explained: np.ndarray  # shares of all variance

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions / np.sqrt(self.variances)


def fitted(fit: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    centre = centre_of(fit, length)
    factor = triangular_factor(fit, centre, length)
    squares, directions = top_directions(factor, components)
    total = float((factor * factor).sum())
    return Whitening(centre, squares / centre.n, directions, squares / total if total else squares)


def identity_error(fit: DataFrame, model: Whitening, length: int) -> float:
    """Largest entry, in size, of the whitened rows' covariance less the identity."""
    m = len(model.variances)

    def of_block(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    sums = _summed(fit, of_block, length, "double") / model.centre.n
    mean = sums[m * m :]
    return float(np.abs(sums[: m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max())


def whitened_embeddings(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component, largest variance first."""
    made = integer_rows(rows)
    if made is None or made[1] == 0:
        return rows.sparkSession.createDataFrame([], COLUMNS)
    kept, length = made
    fit = written(kept.select("x").distinct(), "white-fit")
    model = fitted(fit, length, components)
    m = len(model.variances)
    if not m:
        return rows.sparkSession.createDataFrame([], COLUMNS)
    error = identity_error(fit, model, length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(iter([batch]), length):
                n = len(x)
                ids = batch.column("vec_id").slice(at, n)
                at += n
                each = pa.array(np.repeat(np.arange(n), m))
                columns = [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * m, model.centre.n)),
                    pa.array(model.centre.deviation(x), pa.int64()).take(each),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.explained, n)),
                    pa.array(np.full(n * m, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])

    return kept.mapInArrow(work, COLUMNS)
