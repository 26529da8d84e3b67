"""Vector codes and whitening against plain recomputation with whole numbers and LAPACK."""

import hashlib
import math
import random

import numpy as np
import pytest

from carequeue.llm import qd, vector_codes, whitening
from carequeue.llm.registry import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x binary, n int"
FOLDER = "/root/testdata/sf0.001"


def floored(vector, scale):
    return [math.floor(scale * float(np.float32(c))) for c in vector]


def is_usable(vector, length):
    return (
        vector is not None
        and len(vector) == length
        and all(c is not None and math.isfinite(c) for c in vector)
    )


def awkward(rng, n, length):
    """Clustered vectors with repeated rows and ids, ties, and rows that must go."""
    centres = [[rng.uniform(-1, 1) for _ in range(length)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i * 3, [x + rng.gauss(0, 0.2) for x in c], rng.choice([1, 2, None])))
    rows += [(rows[0][0], rows[0][1], 2)] * 40  # a copy many times
    rows += [(10_000 + i, [0.0] * length, None) for i in range(5)]
    rows += [(None, rows[1][1], 1), (rows[2][0], rows[3][1], 1)]
    rows += [
        (20_000, None, 1),
        (20_001, [None] + [0.0] * (length - 1), 1),
        (20_002, [float("nan")] + [0.0] * (length - 1), 1),
        (20_003, [float("inf")] + [0.0] * (length - 1), 1),
        (20_004, [0.5] * (length + 1), 1),
        (20_005, [], 1),
    ]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y", 7) for r in rows], SCHEMA)


# -- codes ---------------------------------------------------------------------------


def plain_codes(rows, length, rounds=2):
    """Full scans over every entry, in Python integers."""
    kept = [r for r in rows if is_usable(r[1], length)]
    x = [floored(r[1], 256) for r in kept]
    bounds = vector_codes.part_bounds(length)
    least = {}
    for (vec_id, _, _), v in zip(kept, x):
        if vec_id is not None:
            least[vec_id] = min(v, least.get(vec_id, v))
    first = [least[i] for i in sorted(least)[:64]]
    books = [[v[lo:hi] for v in first] for lo, hi in bounds]

    def assign():
        found = []
        for v in x:
            row = []
            for (lo, hi), book in zip(bounds, books):
                d = [sum((a - b) ** 2 for a, b in zip(v[lo:hi], e)) for e in book]
                row.append((d.index(min(d)), min(d)))
            found.append(row)
        return found

    for _ in range(rounds):
        found = assign()
        for p, (lo, hi) in enumerate(bounds):
            for j in range(len(first)):
                own = [v[lo:hi] for v, row in zip(x, found) if row[p][0] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    digest = hashlib.sha256(
        ",".join(str(c) for book in books for e in book for c in e).encode()
    ).hexdigest()
    errors = [sum(d for _, d in row) for row in found]
    of_label = {}
    for r, e in zip(kept, errors):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    return sorted(
        (
            (r[0], "".join(f"{j:02x}" for j, _ in row), e, of_label[r[2]], digest)
            for r, row, e in zip(kept, found, errors)
        ),
        key=repr,
    )


@pytest.mark.parametrize(("n", "length"), [(150, 32), (90, 20), (30, 16), (12, 5)])
def test_codes_equal_full_scans(spark, n, length):
    rows = awkward(random.Random(n), n, length)
    found = vector_codes.vector_codes(frame(spark, rows).repartition(5))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_codes(rows, length)


def test_more_rounds_still_equal_full_scans(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rows = awkward(random.Random(8), 300, 16)
    found = vector_codes.vector_codes(frame(spark, rows), rounds=5)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_codes(rows, 16, rounds=5)


def test_bounds_spare_rescans_and_net_displacement_is_tighter(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (2000, 32))
    history = [x[:64].astype(np.int64)]
    codes = vector_codes.Codes(len(x))
    scanned, moves = [], None
    for _ in range(6):
        before = codes.scanned
        moves = vector_codes.longest_moves(history)
        errors = codes.assign(x, history, moves)
        scanned.append(codes.scanned - before)
        for p, (lo, hi) in enumerate(vector_codes.part_bounds(32)):
            d = vector_codes.squared_distances(x[:, lo:hi], history[-1][:, lo:hi])
            assert (codes.code[:, p] == d.argmin(axis=1)).all()
            assert (errors[:, p] == d.min(axis=1)).all()
        history.append(vector_codes.moved(history[-1], vector_codes.entry_sums(x, codes.code, 64)))
    assert scanned[0] == x.shape[0] * 16
    assert scanned[-1] < scanned[0] / 2
    assert (codes.stamp < len(history) - 2).any()  # some bounds are rounds old
    # the way travelled round by round is never shorter than the net displacement
    for stamp in range(len(history) - 1):
        parts = [vector_codes.longest_moves(history[i : i + 2])[0] for i in range(stamp, len(history) - 1)]
        net = vector_codes.longest_moves(history)[stamp]
        assert (net <= np.sum(parts, axis=0) + 1e-9).all()
    drift = np.sum([vector_codes.longest_moves(history[i : i + 2])[0] for i in range(len(history) - 1)], axis=0)
    assert (vector_codes.longest_moves(history)[0] < drift - 1e-6).any()


def test_codes_without_usable_rows(spark):
    for rows in ([], [(1, None, 1)], [(None, [1.0, 2.0], 1)]):
        assert vector_codes.vector_codes(frame(spark, rows)).count() == 0


def test_codes_query_equals_full_scans(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = LLM_QUERIES["op12_vector_codes"](spark, FOLDER).collect()
    assert sorted(map(tuple, found), key=repr) == plain_codes(rows, 64)


# -- whitening -----------------------------------------------------------------------


def plain_whitening(rows, length, most=16):
    """By LAPACK's symmetric solver: ids, variances, unsigned components, deviations."""
    kept = [(r[0], tuple(v + 1_000_000 for v in floored(r[1], 64))) for r in rows if is_usable(r[1], length)]
    fit = sorted({v for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    m = min(most, int((values > 1e-9 * values[0]).sum()))
    total = values.sum()
    out = []
    for vec_id, v in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        row = np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ vectors[:, :m] / np.sqrt(values[:m])
        out += [(vec_id, k + 1, n, deviation, abs(row[k]), values[k] / total) for k in range(m)]
    return out


def same_rows(found, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(abs(r[4]), 4))
    found, expected = sorted(found, key=key), sorted(expected, key=key)
    assert [tuple(r[:4]) for r in found] == [r[:4] for r in expected]
    for r, e in zip(found, expected):
        assert abs(r[4]) == pytest.approx(e[4], rel=1e-7, abs=1e-7)
        assert r[5] == pytest.approx(e[5], rel=1e-9)
        assert r[6] < 1e-9


@pytest.mark.parametrize(("n", "length"), [(200, 24), (60, 5), (9, 16)])
def test_whitening_equals_lapack(spark, n, length):
    rows = awkward(random.Random(n + 1), n, length)
    found = whitening.whitened_embeddings(frame(spark, rows).repartition(20)).collect()
    same_rows(found, plain_whitening(rows, length))


def test_signs_are_the_same_for_all_rows(spark):
    rows = [(i, [float(i), float(i % 3), 0.0], None) for i in range(30)]
    found = whitening.whitened_embeddings(frame(spark, rows)).where("component = 1")
    values = [r.whitened for r in found.orderBy("vec_id").collect()]
    assert values == sorted(values) or values == sorted(values, reverse=True)


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], [(1, [], 1)]):
        assert whitening.whitened_embeddings(frame(spark, rows)).count() == 0


def test_whitening_query_equals_lapack(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    found = LLM_QUERIES["op13_whitening"](spark, FOLDER)
    assert found.columns == [c.split()[0] for c in whitening.COLUMNS.split(", ")]
    same_rows(found.collect(), plain_whitening(rows, 64))


def test_deviation_is_exact_beyond_doubles():
    big = whitening.Centre(3_000_000_001, np.array([7, 5]))
    x = np.array([[1, 2], [3, -1]])
    assert big.deviation(x) == [
        v if v < 1 << 63 else None
        for v in (
            (3_000_000_001 - 7) ** 2 + (2 * 3_000_000_001 - 5) ** 2,
            (3 * 3_000_000_001 - 7) ** 2 + (-3_000_000_001 - 5) ** 2,
        )
    ]


def wilkinson():
    at = np.abs(np.arange(-10, 11.0))
    return np.linalg.cholesky(np.diag(at) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1) + 12 * np.eye(21)).T


def matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield "normal", rng.normal(size=(40, 40))
    yield "graded", rng.normal(size=(40, 40)) * np.logspace(0, -6, 40)
    yield "identity", np.eye(12)
    yield "repeated", (q * np.sqrt(np.r_[np.full(20, 5.0), np.linspace(1, 0.1, 20)])) @ q.T
    yield "nearly repeated", (q * (1 + 1e-13 * np.arange(40))) @ q.T
    yield "wilkinson", wilkinson()
    yield "low rank", rng.normal(size=(30, 4)) @ rng.normal(size=(4, 30))
    yield "zero", np.zeros((4, 4))
    yield "one", np.array([[3.0]])


@pytest.mark.parametrize(("name", "matrix"), list(matrices()), ids=lambda v: v if isinstance(v, str) else "")
def test_qd_solver_equals_lapack(name, matrix):
    factor = np.linalg.qr(matrix, mode="r")
    values, vectors = qd.top_directions(factor, 30)
    expected = np.linalg.svd(matrix, compute_uv=False)[: len(values)] ** 2
    assert len(values) == min(30, np.linalg.matrix_rank(matrix))
    np.testing.assert_allclose(values, expected, rtol=1e-9)
    if len(values):
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
        residual = matrix.T @ (matrix @ vectors) - vectors * values
        assert np.abs(residual).max() < 1e-12 * values[0] * len(matrix)
