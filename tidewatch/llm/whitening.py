"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers; sums are exact, and rows are centred before anything is multiplied. Starting from a random unit
vector, each step multiplies the centred table X from the right, Xv, takes out what earlier left vectors explain, multiplies
the outcome from the left, X'u, and takes out the earlier right vectors (full reorthogonalisation, twice, on both sides). The
small upper bidiagonal matrix B = U'XV that this leaves has X's singular values; its SVD turns V into the components.

One pass over the table a step: a left vector has as many entries as the table has rows, so it is held as the coefficients w
of u = Xw and never stored or shuffled; a task forms its rows' part of u, then their part of X'u, and sends the sums. What
reorthogonalisation of u needs, u_j'Xw, is (X'u_j)'w, which earlier steps have found. The driver holds vectors of the width and
at most GATHERED partial sums at a time; beyond, partial sums are added up in tasks first. A lost executor costs its tasks only.

A Krylov space holds one vector of an eigenvalue that occurs several times. So once the wanted components have converged,
they are locked and another run starts in what is left; it ends when a run finds nothing that is larger. A run that has spanned the whole
space needs no other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import finite_vector, list_matrix, stored, usual_width

#: Bytes of a block of rows; partial sums that go to the driver at most.
BLOCK_BYTES, GATHERED = 1 << 20, 256
#: An entry is at most so large in magnitude, so that sums of a block are exact.
MOST = 2**31 - 1
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


class Centred:
    """The blocks of the integer table, their exact sums, and sums of functions over the centred rows."""

    def __init__(self, rows: DataFrame, width: int, scale: float, offset: int):
        self.width = width
        kind = rows.schema["id"].dataType.simpleString()
        step = max(1, BLOCK_BYTES // (4 * width))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = np.floor(scale * list_matrix(part.column("v"), width).astype(float)) + offset
                    if np.abs(x).max() > MOST:
                        raise ValueError(f"an entry is beyond {MOST} in magnitude after scaling")
                    ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column("id"))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x.astype(np.int32).tobytes()], pa.binary())], ["ids", "x"])

        self.blocks = stored(rows.mapInArrow(packed, f"ids array<{kind}>, x binary"), "whitening-blocks")
        self.tasks = self.blocks.rdd.getNumPartitions()

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for x in _matrices(batches, width):
                yield np.concatenate([[len(x)], x.sum(0, dtype=np.int64)])

        found = self._summed(counted, np.int64)
        self.n, self.sums = int(found[0]), [int(s) for s in found[1:]]
        #: The mean as an integer and a rest: what is left of a row after the integer is exact.
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.sums])

    def _summed(self, part: Callable, kind: type) -> np.ndarray:
        """The sum of the vectors that `part` yields over all blocks."""
        sql = "bigint" if kind is np.int64 else "double"

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for vector in part(batches):
                total = vector if total is None else total + vector
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind)])], ["sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for row in batch.column("sums"):
                    vector = row.values.to_numpy()
                    total = vector if total is None else total + vector
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind)])], ["sums"])

        schema = f"sums array<{sql}>"
        sums = self.blocks.mapInArrow(partial, schema)
        tasks = self.tasks
        while tasks > GATHERED:
            tasks = math.ceil(math.sqrt(tasks))
            sums = sums.repartition(tasks).mapInArrow(added, schema)
        return np.sum([row.values.to_numpy() for row in sums.toArrow().column("sums")], axis=0)

    def product(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """(squared length of u, X'u) for u = Xw."""
        width, whole, rest = self.width, self.whole, self.rest

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for x in _matrices(batches, width):
                x = (x - whole) - rest
                u = x @ w
                yield np.concatenate([[u @ u], x.T @ u])

        found = self._summed(part, float)
        return float(found[0]), found[1:]

    def moments(self, projection: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(sum of squared lengths of centred rows, sums and sums of products of their projections)."""
        width, whole, rest, k = self.width, self.whole, self.rest, projection.shape[1]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for x in _matrices(batches, width):
                x = (x - whole) - rest
                y = x @ projection
                yield np.concatenate([[(x * x).sum()], y.sum(0), (y.T @ y).ravel()])

        found = self._summed(part, float)
        return float(found[0]), found[1 : 1 + k], found[1 + k :].reshape(k, k)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in batch.column("x"):
            yield np.frombuffer(block.as_buffer(), np.int32).reshape(-1, width)


def _without(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """x less its parts along the orthonormal columns of `basis`, twice, which is enough."""
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def _run(table: Centred, locked: np.ndarray, k: int, tolerance: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, bool]:
    """(singular values, right vectors, whether the space is spanned) of one run in the complement of `locked`."""
    width = table.width
    left = width - locked.shape[1]
    v = _without(rng.standard_normal(width), locked)
    v /= np.linalg.norm(v)
    right, alpha, beta = [v], [], []
    ws, zs = np.empty((width, 0)), np.empty((width, 0))  # u_j = X w_j, z_j = X'u_j
    while True:
        w = right[-1] - (beta[-1] * ws[:, -1] if beta else 0)
        for _ in range(2):
            w = w - ws @ (zs.T @ w)
        square, product = table.product(w)
        a = math.sqrt(max(0.0, square))
        largest = max([a, *alpha])
        nothing = a <= 1e-13 * largest or a == 0
        alpha.append(0.0 if nothing else a)
        if not nothing:
            ws, zs = np.column_stack([ws, w / a]), np.column_stack([zs, product / a])
            basis = np.column_stack([locked, *right])
            r = _without(product / a - a * right[-1], basis)
            b = float(np.linalg.norm(r))
        steps = len(alpha)
        p, s, qt = np.linalg.svd(np.diag(alpha) + np.diag(beta, 1))
        over = nothing or steps == left or b <= 1e-14 * largest
        if over or steps >= k and (np.abs(b * p[-1, :k]) <= tolerance * s[0]).all():
            return s, np.column_stack(right) @ qt.T, steps == left
        beta.append(b)
        right.append(r / b)


def principal(table: Centred, k: int, tolerance: float = 1e-15, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(variances, unit components as columns) of the k largest variances that are not nothing."""
    rng = np.random.default_rng(seed)
    values, vectors = np.empty(0), np.empty((table.width, 0))
    k = min(k, table.width)
    while vectors.shape[1] < table.width:
        s, found, spanned = _run(table, vectors, min(k, table.width - vectors.shape[1]), tolerance, rng)
        floor = values[k - 1] if len(values) >= k else 0.0
        more = (s[:k] > floor * (1 + 1e-12)) & (s[:k] > 1e-12 * max([s[0], *values]))
        values, vectors = np.concatenate([values, s[:k][more]]), np.column_stack([vectors, found[:, :k][:, more]])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        if spanned or not more.any():
            break
    vectors = vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values[:k] ** 2 / table.n, vectors


def whitened(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    An entry c becomes floor(scale * c) + offset. n: the usable rows; deviation: the sum over entries of (n * x - S) ** 2 with
    their exact sums S, null if it does not fit a long; whitened: the centred row along the component over the root of its
    variance; explained: the component's share of all variance; identity_error: the largest entry of the whitened rows'
    covariance minus the identity. The largest entry of a component is positive.

    Vectors that are null or empty, or hold a null or a number that is not finite, take no part, nor do those of another width than the
    most frequent one. Rows without an id and rows that share one are rows like others. Components without variance (a
    table of equal rows has no other) give no rows, nor does an empty table. Entries beyond 2**31 after scaling are an error.
    """
    rows = df.where(finite_vector(F.col(vector))).select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    schema = f"vec_id {rows.schema['id'].dataType.simpleString()}, {OUT}"
    width, n = usual_width(rows, "v")
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    table = Centred(rows.where(F.size("v") == width), width, scale, offset)
    variance, component = principal(table, components)
    if not len(variance):
        return df.sparkSession.createDataFrame([], schema)
    projection = component / np.sqrt(variance)
    squares, sums, products = table.moments(projection)
    error = float(np.abs(products / n - np.outer(sums / n, sums / n) - np.eye(len(variance))).max())
    share, k = variance / (squares / n), len(variance)
    whole, rest, total = table.whole, table.rest, [s % n for s in table.sums]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids"), _matrices(iter([batch]), width), strict=True):
                apart = x - whole
                deviation = _deviations(apart, n, total)
                y = (apart - rest) @ projection
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                        deviation.take(pa.array(np.repeat(np.arange(m), k))), pa.array(y.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return table.blocks.mapInArrow(put, schema)


def _deviations(apart: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """The sum of (n * apart - total) ** 2 of each row, exact."""
    most = n * int(np.abs(apart).max()) + n
    if most * most * apart.shape[1] < 2**63:
        return pa.array(((n * apart - np.array(total, np.int64)) ** 2).sum(1))
    exact = [sum((n * a - t) ** 2 for a, t in zip(row, total, strict=True)) for row in apart.tolist()]
    return pa.array([x if x < 2**63 else None for x in exact], pa.int64())
