"""Random forest of two classes, learned level by level over rows of bytes.

The job is that of ``pyspark.ml``'s ``RandomForestClassifier``: bootstrap counts of each
row and tree, up to ``maxBins`` bins a feature, features drawn for each node, Gini gains
from counts of all rows, one pass over the rows per level; leaves that predict the same
are merged. Its learner keeps each row as objects of about 420 bytes, in memory or read
back from disk at every level, and looks every tree and node up in maps. Here a row is one
byte per feature and tree, stored once, and workers count whole columns at a time. The
result is a ``RandomForestClassificationModel``.

What workers run is made by functions here and holds no name of this module.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.operators.shared import intermediate_tables, new_path

CHUNK_ROWS = 1 << 16  # rows that a worker counts at once
KEPT_POINTS = 1 << 16  # values of a feature that a worker holds, with the rows each stands for
SENT_POINTS = 1 << 12  # values of a feature that a task sends to the driver
NODES_PER_ROW = 16  # nodes whose counts travel in one row
BLOCKS_PER_PART = 8  # such rows that are worth a task of their own
CELLS = 64  # counts of a node and feature: 32 bins by 2 labels
ROWS_PER_FILE = 250_000
NODE = """treeID int, nodeData struct<id: int, prediction: double, impurity: double,
    impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int, rightChild: int,
    split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"""
ML = "org.apache.spark.ml.classification."


def fit_forest(
    learner: RandomForestClassifier,
    rows: DataFrame,
    numeric: Sequence[str],
    named: Sequence[tuple[str, Sequence[str]]],
) -> RandomForestClassificationModel:
    """A forest with the learner's parameters over double columns and flags of names.

    ``named`` has each category column and the values that have a flag, in the order in
    which the features are assembled. The rows hold no nulls in these columns.
    """
    if learner.getMaxBins() * 2 > CELLS:
        raise ValueError(f"more than {CELLS // 2} bins")
    with intermediate_tables(rows.sparkSession):
        cuts = thresholds(rows, numeric, learner.getMaxBins())
        cuts += [np.array([0.5]) for _, values in named for _ in values]
        stored = packed_rows(rows, learner, numeric, named, cuts)
        trees = grown_trees(stored, learner, cuts)
        return as_model(rows.sparkSession, learner, trees, cuts)


def _heaviest_points() -> Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]:
    """Function that sums up the weights of equal values and, beyond a number of points,
    lets each of so many even shares of the weight be one point. Weights stay whole."""

    def points(values, weights, most):
        values, at = np.unique(values, return_inverse=True)
        weights = np.bincount(at, weights, len(values)).astype(np.int64)
        if len(values) <= most:
            return values, weights
        up_to = np.cumsum(weights)
        share = (up_to - 1) * most // up_to[-1]  # of the last row with this value
        last = np.flatnonzero(np.append(share[1:] != share[:-1], True))
        return values[last], np.diff(up_to[last], prepend=0)

    return points


def thresholds(rows: DataFrame, numeric: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending thresholds of each column, from all rows: between all values if they are
    few, else between values nearest to even shares of the rows."""
    names, points = list(numeric), _heaviest_points()
    chunk, kept, sent = CHUNK_ROWS, KEPT_POINTS, SENT_POINTS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0), np.empty(0, np.int64)) for _ in names]
        waiting, n = [], 0

        def taken_in() -> None:
            for i in range(len(names)):
                new = np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in waiting])
                values, weights = held[i]
                held[i] = points(
                    np.append(values, new), np.append(weights, np.ones(len(new), np.int64)), kept
                )

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= chunk:
                taken_in()
                waiting, n = [], 0
        if n:
            taken_in()
        for i, (values, weights) in enumerate(held):
            values, weights = points(values, weights, sent)
            columns = [
                pa.array([i], pa.int32()),
                pa.array([values.tobytes()], pa.binary()),
                pa.array([weights.tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "points", "weights"])

    found = rows.select(*[F.col(c).cast("double") for c in names]).mapInArrow(
        work, "feature int, points binary, weights binary"
    ).collect()
    cuts = []
    for i in range(len(names)):
        values = np.concatenate([np.frombuffer(r.points) for r in found if r.feature == i])
        weights = np.concatenate(
            [np.frombuffer(r.weights, np.int64) for r in found if r.feature == i]
        )
        cuts.append(_cuts(*points(values, weights, len(values) + 1), bins))
    return cuts


def _cuts(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Middles between neighbouring values, fewer than ``bins``."""
    finite = np.isfinite(values)
    values, weights = values[finite], weights[finite]
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles
    up_to = np.cumsum(weights)
    stride = up_to[-1] / bins
    up_to, cuts, target = up_to.tolist(), [], stride
    for i in range(1, len(values)):
        if abs(up_to[i - 1] - target) < abs(up_to[i] - target):
            cuts.append(middles[i - 1])
            target += stride
    return np.array(cuts[: bins - 1])


def packed_rows(
    rows: DataFrame,
    learner: RandomForestClassifier,
    numeric: Sequence[str],
    named: Sequence[tuple[str, Sequence[str]]],
    cuts: Sequence[np.ndarray],
) -> DataFrame:
    """Each row as bytes, written once: label, bin of each feature, copies for each tree.

    A tree draws a row Poisson(1) times, as in ``pyspark.ml``; draws depend on the seed, the
    part and the place in it.
    """
    columns, values_of = list(numeric), [(c, list(v)) for c, v in named]
    cuts, seed, trees, chunk = list(cuts), learner.getSeed(), learner.getNumTrees(), CHUNK_ROWS
    n_numeric, n_features = len(columns), len(cuts)
    # bounds of an even 32-bit number for 1, 2, ... copies; the chance of more is below 2**-32
    chances = np.cumsum(np.exp(-1) / np.cumprod(np.array([1, *range(1, 13)], float)))
    bounds = np.minimum(np.round(chances * 2.0**32), 2**32 - 1).astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunks = TaskContext.get().partitionId(), 0

        def packed(waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            n = table.num_rows
            out = np.empty((1 + n_features + trees, n), np.uint8)
            out[0] = table.column(0).to_numpy()
            for i in range(n_numeric):
                out[1 + i] = np.searchsorted(cuts[i], table.column(1 + i).to_numpy())
            at = 1 + n_numeric
            for i, (_, values) in enumerate(values_of):
                column = table.column(1 + n_numeric + i)
                for value in values:
                    out[at] = pc.equal(column, value).to_numpy()
                    at += 1
            rng = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, part, chunks])))
            for t in range(trees):
                even = rng.integers(0, 1 << 32, n, np.uint32)
                copies = out[at + t]
                copies[:] = even >= bounds[0]
                for bound in bounds[1:]:
                    copies += even >= bound
            width = len(out)
            data = pa.py_buffer(np.ascontiguousarray(out.T).tobytes())
            ends = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes())
            array = pa.Array.from_buffers(pa.binary(), n, [None, ends, data])
            return pa.RecordBatch.from_arrays([array], names=["packed"])

        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield packed(waiting)
                waiting, n, chunks = [], 0, chunks + 1
        if n:
            yield packed(waiting)

    label = F.col(learner.getLabelCol()).cast("int")
    doubles = [F.col(c).cast("double") for c in columns]
    made = rows.select(label, *doubles, *[c for c, _ in values_of]).mapInArrow(work, "packed binary")
    path = new_path(rows.sparkSession, "packed")
    made.write.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


class Trees:
    """Nodes of all trees, each tree an array in which node i has children 2i+1 and 2i+2."""

    def __init__(self, trees: int, depth: int):
        nodes = (1 << (depth + 1)) - 1
        self.feature = np.zeros((trees, nodes), np.int64)
        self.bin = np.full((trees, nodes), 255, np.uint8)  # of the last bin that goes left
        self.split = np.zeros((trees, nodes), bool)
        self.gain = np.full((trees, nodes), -1.0)
        self.counts = np.zeros((trees, nodes, 2), np.int64)


def grown_trees(stored: DataFrame, learner: RandomForestClassifier, cuts: Sequence[np.ndarray]) -> Trees:
    """Split all nodes of a level at once, the root first."""
    depth, n_trees = learner.getMaxDepth(), learner.getNumTrees()
    trees = Trees(n_trees, depth)
    drawn = max(1, int(np.ceil(np.sqrt(len(cuts)))))
    splits = np.array([len(c) for c in cuts])
    tree, node = np.arange(n_trees), np.zeros(n_trees, np.int64)
    for level in range(depth):
        if not len(tree):
            break
        rng = np.random.default_rng([learner.getSeed(), level])
        subsets = np.argsort(rng.random((len(tree), len(cuts))), axis=1)[:, :drawn]
        best = _best_splits(stored, trees, level, tree, node, subsets, splits)
        at, slot = best["slot"], (tree[best["slot"]], node[best["slot"]])
        sides = np.stack([best[c] for c in ("left0", "left1", "right0", "right1")], 1).reshape(-1, 2, 2)
        if level == 0:
            trees.counts[slot] = sides.sum(1)
        better = best["gain"] > 0
        slot, sides, at = (slot[0][better], slot[1][better]), sides[better], at[better]
        trees.split[slot], trees.gain[slot] = True, best["gain"][better]
        trees.feature[slot] = subsets[at, best["feature"][better]]
        trees.bin[slot] = best["bin"][better]
        tree, node = np.repeat(slot[0], 2), np.stack([2 * slot[1] + 1, 2 * slot[1] + 2], 1).ravel()
        trees.counts[tree, node] = sides.reshape(-1, 2)
        mixed = (trees.counts[tree, node] > 0).all(1)
        tree, node = tree[mixed], node[mixed]
    return trees


def _best_splits(
    stored: DataFrame,
    trees: Trees,
    level: int,
    tree: np.ndarray,
    node: np.ndarray,
    subsets: np.ndarray,
    splits: np.ndarray,
) -> dict[str, np.ndarray]:
    """The best split of each node of a level, with the labels on either side of it.

    Tasks count labels by bin for each node and feature drawn for it; the counts are dealt
    by node, summed and compared there. Only the splits come to the driver.
    """
    spark = stored.sparkSession
    blocks = -(-len(tree) // NODES_PER_ROW)
    parts = min(-(-blocks // BLOCKS_PER_PART), 4 * spark.sparkContext.defaultParallelism)
    counted = stored.mapInArrow(
        _counting(trees, level, tree, node, subsets, len(splits)), "block int, counts binary"
    )
    best = counted.repartition(parts, "block").mapInArrow(
        _choosing(subsets, splits),
        """slot int, feature int, bin int, gain double, left0 bigint, left1 bigint,
           right0 bigint, right1 bigint""",
    ).toArrow()
    found = {c: best.column(c).to_numpy() for c in best.column_names}
    order = np.argsort(found["slot"])
    return {c: v[order] for c, v in found.items()}


def _counting(
    trees: Trees, level: int, tree: np.ndarray, node: np.ndarray, subsets: np.ndarray, n_features: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Worker's function that counts the rows of each node by bin and label."""
    chunk, cells, nodes_per_row = CHUNK_ROWS, CELLS, NODES_PER_ROW
    n_trees, drawn, first = len(trees.split), subsets.shape[1], (1 << level) - 1
    above = slice(0, 2 * first + 1)
    feature, last, split = trees.feature[:, above], trees.bin[:, above], trees.split[:, above]
    # a leaf's rows stay where they are: no bin is above 255
    left = np.where(split, 2 * np.arange(split.shape[1]) + 1, np.arange(split.shape[1]))
    last = np.where(split, last, 255).astype(np.uint8)
    place = np.full(split.shape, -1, np.int64)  # of an open node among those of its tree
    starts = np.searchsorted(tree, np.arange(n_trees + 1))
    place[tree, node] = np.arange(len(tree)) - starts[tree]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(tree), drawn, cells), np.int64)
        width = 1 + n_features + n_trees

        def count(waiting: list[pa.Array]) -> None:
            data = pa.concat_arrays(waiting)
            n = len(data)
            at = data.offset * width
            flat = np.frombuffer(data.buffers()[1], np.uint8)[at : at + n * width]
            by_column = np.ascontiguousarray(flat.reshape(n, width).T)
            bins = by_column[1 : 1 + n_features]
            labelled = (2 * bins + by_column[0]).ravel()
            bins = bins.ravel()
            for t in range(n_trees):
                some = slice(starts[t], starts[t + 1])
                if some.start == some.stop:
                    continue
                copies = by_column[1 + n_features + t]
                rows = np.flatnonzero(copies != 0)
                now = np.zeros(len(rows), np.int64)
                offset = feature[t] * n
                for step in range(level):
                    cell = offset.take(now)
                    cell += rows
                    right = bins.take(cell) > last[t].take(now)
                    now = left[t].take(now)
                    now += right
                    if step % 2 or step == level - 1:  # rows in leaves are dropped now and then
                        goes_on = now >= (2 << step) - 1
                        if np.count_nonzero(goes_on) < 0.9 * len(now):
                            rows, now = rows[goes_on], now[goes_on]
                at_node = place[t].take(now)
                is_open = at_node >= 0
                if not is_open.all():
                    rows, at_node = rows[is_open], at_node[is_open]
                weights = copies.take(rows).astype(np.float64)
                # alike rows follow each other: neighbours add to different copies of a count
                size = (some.stop - some.start) * cells
                lanes = 4 if size <= 1 << 13 else 1
                base = at_node * cells
                if lanes > 1:
                    base += (np.arange(len(base)) & (lanes - 1)) * size
                columns = subsets[some] * n
                for j in range(drawn):
                    cell = columns[:, j].take(at_node)
                    cell += rows
                    found = np.bincount(labelled.take(cell) + base, weights, lanes * size)
                    counts[some, j] += found.reshape(lanes, -1, cells).sum(0).astype(np.int64)

        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch.column(0).cast(pa.binary(width)))
            n += batch.num_rows
            if n >= chunk:
                count(waiting)
                waiting, n = [], 0
        if n:
            count(waiting)
        for block in range(-(-len(tree) // nodes_per_row)):
            held = counts[block * nodes_per_row : (block + 1) * nodes_per_row]
            if held.any():
                columns = [pa.array([block], pa.int32()), pa.array([held.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "counts"])

    return work


def _choosing(
    subsets: np.ndarray, splits: np.ndarray
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Worker's function that adds up the counts of nodes and finds the best split of each."""
    cells, nodes_per_row, drawn = CELLS, NODES_PER_ROW, subsets.shape[1]

    def gini(counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(-1), 1)
        return 1 - ((counts / total[..., None]) ** 2).sum(-1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(counts.as_buffer(), np.int64)
                held[block] = held[block] + new if block in held else new
        for block, counts in sorted(held.items()):
            by_bin = counts.reshape(-1, drawn, cells // 2, 2)
            slots = np.arange(len(by_bin)) + block * nodes_per_row
            up_to = by_bin.cumsum(2)
            total = up_to[:, :, -1:]
            left, right = up_to[:, :, :-1], total - up_to[:, :, :-1]
            n_left, n_right = left.sum(-1), right.sum(-1)
            gain = gini(total) - (n_left * gini(left) + n_right * gini(right)) / np.maximum(
                n_left + n_right, 1
            )
            known = np.arange(gain.shape[2]) < splits[subsets[slots]][:, :, None]
            gain[~known | (n_left == 0) | (n_right == 0)] = -1
            at = gain.reshape(len(slots), -1).argmax(1)
            j, b = np.divmod(at, gain.shape[2])
            each = np.arange(len(slots))
            sides = np.concatenate([left[each, j, b], right[each, j, b]], 1)
            columns = [slots.astype(np.int32), j.astype(np.int32), b.astype(np.int32)]
            columns += [gain[each, j, b], *sides.T]
            names = ["slot", "feature", "bin", "gain", "left0", "left1", "right0", "right1"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return work


def _merged(trees: Trees) -> np.ndarray:
    """Which nodes are split once leaves that predict the same are one, from below."""
    split = trees.split.copy()
    ones = trees.counts[:, :, 1] > trees.counts[:, :, 0]
    first = split.shape[1] // 2
    while first:
        first //= 2
        above = np.arange(first, 2 * first + 1)
        left, right = 2 * above + 1, 2 * above + 2
        inner = split[:, left] | split[:, right] | (ones[:, left] != ones[:, right])
        split[:, above] &= inner
    return split


def as_model(
    spark: SparkSession, learner: RandomForestClassifier, trees: Trees, cuts: Sequence[np.ndarray]
) -> RandomForestClassificationModel:
    """The trees as a model of ``pyspark.ml``, loaded from a table in its stored layout."""
    split, nodes = _merged(trees), []
    for t in range(len(split)):
        ids, reached = {0: 0}, [0]
        for i in reached:  # grows inside: by level
            if split[t, i]:
                for child in (2 * i + 1, 2 * i + 2):
                    ids[child] = len(reached)
                    reached.append(child)
        for i in reached:
            zeros, ones = (int(c) for c in trees.counts[t, i])
            n = max(zeros + ones, 1)
            rest = (-1.0, -1, -1, (-1, [], -1))
            if split[t, i]:
                f = int(trees.feature[t, i])
                cut = float(cuts[f][trees.bin[t, i]])
                rest = (float(trees.gain[t, i]), ids[2 * i + 1], ids[2 * i + 2], (f, [cut], -1))
            impurity = 1 - (zeros / n) ** 2 - (ones / n) ** 2
            stats = [float(zeros), float(ones)]
            nodes.append((t, (ids[i], float(ones > zeros), impurity, stats, zeros + ones, *rest)))

    def described(name: str, uid: str, params: dict, **more: int) -> str:
        about = {"class": ML + name, "timestamp": int(time.time() * 1000), "uid": uid}
        about |= {"sparkVersion": spark.version, "paramMap": params, "defaultParamMap": {}}
        return json.dumps(about | more)

    params = {p.name: v for p, v in learner.extractParamMap().items()}
    of_tree = {k: params[k] for k in ("featuresCol", "labelCol", "impurity", "maxBins", "maxDepth")}
    size = {"numFeatures": len(cuts), "numClasses": 2}
    forest = described(
        "RandomForestClassificationModel", learner.uid, params, **size, numTrees=len(split)
    )
    each = [
        (t, described("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", of_tree), 1.0)
        for t in range(len(split))
    ]
    path = new_path(spark, "forest")
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, NODE, verifySchema=False).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
