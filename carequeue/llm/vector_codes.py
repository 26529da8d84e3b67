"""Product codes of vectors, their codebooks fitted by k-means with norm-of-sum bounds.

Components become integers and a vector is cut into ``PARTS`` consecutive parts. Each part
position has a codebook; a code names the nearest entry of each. The first pass compares
every part with every entry and keeps, besides the nearest one, the distance to the next
nearest as a lower bound, stamped with its round. The codebooks of all rounds are retained.
Since an entry that moved from round s to now can have come nearer by no more than the
length of its net displacement, a bound of round s less the longest net displacement of
the other entries since s still holds. Entries that wander forth and back have moved
little, however much they drifted round by round. A part whose own entry, measured anew,
is nearer than its bound keeps it; only the others are compared with all entries again,
and get a new bound and stamp.

Distances are integers and compared exactly; bounds are kept in single precision, rounded
down, and a tie with a bound leads to a rescan. So codes equal those of full scans.

Vectors lie in blocks of rows with their codes, bounds and stamps, and with the block's
sums per entry. A round reads one table of blocks and writes the next. What the driver
sees per round is one row per codebook component, whatever the number of vectors.

Defined cases: rows whose vector is null or holds null or non-finite components are left
out, and so are those with a component of 2^19 or more, whose squared distances would not
fit a long, and those with another length than the vector of the least id. With less than
``ENTRIES`` distinct ids there are as many entries as ids; an id repeated gives its least
vector once. Rows without an id are encoded but are no first entry; only if no row has an
id there is no result. Lengths that ``PARTS`` does not divide give parts of nearly equal
length. Repeated rows are encoded and summed as often as they occur. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carequeue.operators.shared import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = float(1 << 19)  # of a component
BLOCK = 2048  # vectors of a block
BROADCAST_LABELS = 100_000

#: Entries of all part positions side by side: row j holds the j-th entry of every part.
Book = np.ndarray


def part_bounds(length: int) -> list[tuple[int, int]]:
    edges = [length * p // PARTS for p in range(PARTS + 1)]
    return list(zip(edges, edges[1:]))


def _usable(vector: str) -> str:
    return (
        f"{vector} is not null and forall({vector}, e -> e is not null and not isnan(e)"
        f" and abs(e) < {LIMIT}D)"
    )


def first_entries(rows: DataFrame) -> Book | None:
    """The integer vectors of the least ids; None if no row is usable.

    The driver sees ``ENTRIES`` rows at a time.
    """
    usable = rows.where(_usable("embedding")).where("vec_id is not null")
    found: dict[int, list[float]] = {}
    length = None
    while len(found) < ENTRIES:
        more = usable.where(F.col("vec_id") > max(found)) if found else usable
        if length is not None:
            more = more.where(F.size("embedding") == length)
        least = more.orderBy("vec_id", "embedding").limit(ENTRIES).collect()
        if not least:
            break
        length = len(least[0].embedding) if length is None else length
        for row in least:
            if len(row.embedding) == length and len(found) < ENTRIES:
                found.setdefault(row.vec_id, row.embedding)
        if not found:
            break
    if length is None:
        return None
    vectors = np.array([found[i] for i in sorted(found)], np.float64).reshape(len(found), length)
    return np.floor(SCALE * vectors).astype(np.int64)


def squared_distances(block: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of integers to each entry."""
    return (
        (block * block).sum(axis=1)[:, None]
        - 2 * (block @ entries.T)
        + (entries * entries).sum(axis=1)
    )


def longest_moves(history: Sequence[Book]) -> np.ndarray:
    """For each stamp, part and entry the longest net displacement of the other entries."""
    now = history[-1]
    moves = np.zeros((len(history), PARTS, len(now)))
    for stamp, then in enumerate(history[:-1]):
        for p, (lo, hi) in enumerate(part_bounds(now.shape[1])):
            step = now[:, lo:hi] - then[:, lo:hi]
            length = np.sqrt((step * step).sum(axis=1).astype(np.float64))
            order = np.sort(length)
            others = np.where(length == order[-1], order[-2:][0], order[-1])
            moves[stamp, p] = others if len(length) > 1 else 0.0
    return moves


class Codes:
    """Nearest entries of the parts of some vectors, and what is known of the others."""

    def __init__(self, n: int):
        self.code = np.zeros((n, PARTS), np.uint8)
        self.stamp = np.zeros((n, PARTS), np.uint8)
        self.lower = np.full((n, PARTS), -1.0, np.float32)  # nothing known
        self.scanned = 0

    def assign(self, x: np.ndarray, history: Sequence[Book], moves: np.ndarray) -> np.ndarray:
        """Assign every part to the nearest entry of the last codebook.

        Gives the squared distances of the parts.
        """
        now, book = len(history) - 1, history[-1]
        error = np.zeros((len(x), PARTS), np.int64)
        for p, (lo, hi) in enumerate(part_bounds(x.shape[1])):
            block, entries = x[:, lo:hi], book[:, lo:hi]
            code = self.code[:, p]
            off = block - entries[code]
            error[:, p] = (off * off).sum(axis=1)
            bound = self.lower[:, p].astype(np.float64) - moves[self.stamp[:, p], p, code]
            # the margin is far above the rounding of square roots and differences
            own = np.sqrt(error[:, p].astype(np.float64))
            open_ = np.flatnonzero(~(own * (1 + 1e-9) + 1e-6 < bound))
            if not len(open_):
                continue
            self.scanned += len(open_)
            distances = squared_distances(block[open_], entries)
            nearest = distances.argmin(axis=1)  # the first of equal ones
            rows = np.arange(len(open_))
            error[open_, p] = distances[rows, nearest]
            self.code[open_, p] = nearest
            self.stamp[open_, p] = now
            if len(entries) > 1:
                distances[rows, nearest] = np.iinfo(np.int64).max
                beyond = np.sqrt(distances.min(axis=1).astype(np.float64)).astype(np.float32)
            else:
                beyond = np.full(len(open_), np.inf, np.float32)
            self.lower[open_, p] = np.nextafter(beyond, np.float32(-np.inf))
        return error


def entry_sums(x: np.ndarray, code: np.ndarray, n_entries: int) -> np.ndarray:
    """Sums of the parts assigned to each entry, then the number of them."""
    sums = np.zeros((n_entries, x.shape[1]), np.int64)
    counts = np.zeros((n_entries, PARTS), np.int64)
    for p, (lo, hi) in enumerate(part_bounds(x.shape[1])):
        counts[:, p] = np.bincount(code[:, p], minlength=n_entries)
        for at in range(lo, hi):
            # below 2^53: a block has few rows and components are bounded
            sums[:, at] = np.bincount(code[:, p], weights=x[:, at], minlength=n_entries)
    return np.concatenate([sums.ravel(), counts.ravel()])


def moved(book: Book, totals: np.ndarray) -> Book:
    """Entries at the floored means of their parts; unused ones stay."""
    k, length = book.shape
    sums, counts = totals[: k * length].reshape(k, length), totals[k * length :].reshape(k, PARTS)
    after = book.copy()
    for p, (lo, hi) in enumerate(part_bounds(length)):
        used = counts[:, p] > 0
        after[used, lo:hi] = sums[used, lo:hi] // counts[used, p][:, None]
    return after


def _vectors(batch: pa.RecordBatch, length: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The usable rows of a batch and their integer vectors."""
    sizes = pc.list_value_length(batch.column("embedding"))
    batch = batch.filter(pc.fill_null(pc.equal(sizes, length), False))
    flat = pc.fill_null(pc.cast(batch.column("embedding").flatten(), pa.float64()), np.nan)
    values = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
    fine = (np.abs(values) < LIMIT).all(axis=1)  # false for NaN
    return batch.filter(pa.array(fine)), np.floor(SCALE * values[fine]).astype(np.int64)


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    width = 2 if not x.size or np.abs(x).max() < 1 << 15 else 4
    return x.astype(f"<i{width}").tobytes(), width


def _block_schema(label: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("vec_id", T.ArrayType(T.LongType())),
            T.StructField("label", T.ArrayType(label)),
            T.StructField("n", T.LongType()),
            T.StructField("x", T.BinaryType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("code", T.BinaryType()),
            T.StructField("stamp", T.BinaryType()),
            T.StructField("lower", T.BinaryType()),
            T.StructField("scanned", T.LongType()),
            T.StructField("sums", T.ArrayType(T.LongType())),
        ]
    )


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, codes: Codes, k: int, schema: pa.Schema):
    data, width = _packed(x)
    values = [
        [ids.to_pylist()],
        [labels.to_pylist()],
        [len(x)],
        [data],
        [width],
        [codes.code.tobytes()],
        [codes.stamp.tobytes()],
        [codes.lower.astype("<f4").tobytes()],
        [codes.scanned],
        [entry_sums(x, codes.code, k)],
    ]
    arrays = [pa.array(v, f.type) for v, f in zip(values, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _first_pass(rows: DataFrame, history: Sequence[Book]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _block_schema(rows.schema["label"].dataType)
    types = to_arrow_schema(schema)
    k, length = history[-1].shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = longest_moves(history)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part, x = _vectors(batch.slice(at, BLOCK), length)
                if part.num_rows:
                    codes = Codes(len(x))
                    codes.assign(x, history, moves)
                    yield _block(part.column("vec_id"), part.column("label"), x, codes, k, types)

    return rows.mapInArrow(work, schema)


def _unpacked(batch: pa.RecordBatch, row: int, length: int) -> tuple:
    """Ids, labels, integer vectors and codes of a block."""
    one = {c: batch.column(c)[row] for c in batch.schema.names}
    n = one["n"].as_py()
    x = np.frombuffer(one["x"].as_py(), f"<i{one['width'].as_py()}").reshape(n, length)
    codes = Codes(n)
    codes.code[:] = np.frombuffer(one["code"].as_py(), np.uint8).reshape(n, PARTS)
    codes.stamp[:] = np.frombuffer(one["stamp"].as_py(), np.uint8).reshape(n, PARTS)
    codes.lower[:] = np.frombuffer(one["lower"].as_py(), "<f4").reshape(n, PARTS)
    return one["vec_id"].values, one["label"].values, x.astype(np.int64), codes


def _next_pass(blocks: DataFrame, history: Sequence[Book]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(blocks.schema)
    k, length = history[-1].shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = longest_moves(history)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, x, codes = _unpacked(batch, row, length)
                codes.assign(x, history, moves)
                yield _block(ids, labels, x, codes, k, types)

    return blocks.mapInArrow(work, blocks.schema)


def _encoded(blocks: DataFrame, history: Sequence[Book]) -> DataFrame:
    """(vec_id, label, code, error) of every vector, by the last codebook."""
    label = blocks.schema["label"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("vec_id", T.LongType()),
            T.StructField("label", label),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )
    length = history[-1].shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = longest_moves(history)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, x, codes = _unpacked(batch, row, length)
                error = codes.assign(x, history, moves).sum(axis=1)
                texts = pa.array([c.tobytes().hex() for c in codes.code], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, texts, pa.array(error)], ["vec_id", "label", "code", "error"]
                )

    return blocks.select("vec_id", "label", "n", "x", "width", "code", "stamp", "lower").mapInArrow(
        work, schema
    )


def _totals(blocks: DataFrame) -> np.ndarray:
    """Sums over all blocks: one row per component of the codebooks."""
    sums = blocks.select(F.posexplode("sums").alias("at", "value"))
    rows = sums.groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r.value for r in sorted(rows)], np.int64)


def fitted(rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[Book], DataFrame | None]:
    """Codebooks of all rounds, and the blocks of vectors as assigned before the last."""
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    first = first_entries(rows)
    if first is None:
        return [], None
    history = [first]
    blocks = written(_first_pass(rows, history), "codes-blocks")
    for n in range(rounds):
        if n:
            blocks = written(_next_pass(blocks, history), "codes-blocks")
        history.append(moved(history[-1], _totals(blocks)))
    return history, blocks


def book_digest(book: Book) -> str:
    """Of all components in decimals, by part, entry and position."""
    listed = [
        str(v)
        for lo, hi in part_bounds(book.shape[1])
        for entry in book[:, lo:hi].tolist()
        for v in entry
    ]
    return hashlib.sha256(",".join(listed).encode()).hexdigest()


def vector_codes(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable vector."""
    history, blocks = fitted(rows, rounds)
    columns = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if blocks is None:
        return rows.sparkSession.createDataFrame([], columns)
    encoded = written(_encoded(blocks, history), "codes-encoded")
    errors = written(
        encoded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")),
        "codes-labels",
    )
    if errors.count() <= BROADCAST_LABELS:
        errors = F.broadcast(errors)
    return encoded.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(book_digest(history[-1])).alias("codebooks_sha256"),
    )
