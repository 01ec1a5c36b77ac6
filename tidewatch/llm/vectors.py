"""Approximate nearest neighbours: inverted lists of coarse centroids with product-quantised residuals.

Fit, on a bounded hash-ordered sample (`sample`): coarse centroids by k-means on two levels, and 16
codebooks of up to 256 residual parts each. The number of lists grows with the rows, so that a list
stays near `list_rows` vectors: up to sample / 16 lists are centroids of their own; beyond, each is
split by a second codebook of residual centroids, which all lists share (a list is a pair).
Index: every usable vector gets its list and its code.
Search: a query goes to the lists of the largest centroid scores. Small lists share a bundle; bundles
meet their queries in blocks of bounded size on both sides, so neither a hot list nor a hot query
region has to fit one task. In a block, asymmetric distance tables score the codes; those whose score may still reach the query's
floor are reranked by their exact inner product in double precision on the original vectors.

A query's floor is its k-th best exact score among a small part of the sample (an eighth of the
rows at most), a lower bound of its k-th best at all: candidates whose exact score is below it are
dropped, which loses nothing. The sample keeps the precision of the vectors. How many lists a query
probes, and by how much a code may underrate a vector, are calibrated on the sample by brute force,
so that each step alone finds a share `aim` of the sample's true neighbours.

The measure is the inner product; ties go to the smaller id. Equal vectors: a block looks at the
k + 1 smallest ids of each, which no larger id can beat.

Null, empty and all-zero vectors, and those that hold a null or a number that is not finite, take no
part; so do vectors of another width than the most frequent one, and rows without an id. Rows
that share an id are separate candidates of that id, and none of them is a candidate of its own query.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

SAMPLE, PARTS, CODES, BLOCK, QUERY_BLOCK, LIST_ROWS = 16_384, 16, 256, 4096, 1024, 4096


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    x = np.ascontiguousarray(x, np.float32)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centre = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centre)
        order = np.argsort(near, kind="stable")
        used, first, count = np.unique(near[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centre = centre.copy()
        centre[used] = sums / count[:, None]
        idle = np.setdiff1d(np.arange(k), used)
        if len(idle):
            centre[idle] = x[rng.choice(len(x), len(idle), replace=False)]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centre * centre).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = (half[None, :] - x[at : at + 4096] @ centre.T).argmin(1)
    return out


class Index:
    """Two levels of centroids, codebooks, the sample, and the calibrated effort."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: int, k: int, aim: float, list_rows: int = LIST_ROWS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.ids, self.x, self.rows = ids, x, rows
        low = x.astype(np.float32)
        most = max(1, len(x) // 16)
        lists = max(1, int(4 * math.sqrt(rows)), math.ceil(rows / list_rows))
        self.centre = _k_means(low, min(lists, most), rng)
        cell = nearest(low, self.centre)
        rest = low - self.centre[cell]
        split = min(most, math.ceil(lists / len(self.centre)))
        self.finer = _k_means(rest, split, rng) if split > 1 else np.zeros((1, x.shape[1]), np.float32)
        self.lists = len(self.centre) * len(self.finer)
        cell, rest = self._refine(cell, rest)
        width = x.shape[1]
        parts = max(p for p in range(1, PARTS + 1) if width % p == 0)
        self.step = width // parts
        self.books = []
        for p in range(parts):
            book = _k_means(rest[:, p * self.step : (p + 1) * self.step], min(CODES, max(1, len(x) // 4)), rng, 6)
            self.books.append(book)
        self._calibrate(low, cell, self._codes(rest), k, aim, rng)

    def _refine(self, cell: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        second = nearest(rest, self.finer)
        return cell * len(self.finer) + second, rest - self.finer[second]

    def _codes(self, rest: np.ndarray) -> np.ndarray:
        codes = [nearest(np.ascontiguousarray(rest[:, p * self.step : (p + 1) * self.step]), b) for p, b in enumerate(self.books)]
        return np.stack(codes, 1).astype(np.uint8)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of each vector."""
        cell = nearest(x, self.centre)
        cell, rest = self._refine(cell, x - self.centre[cell])
        return cell, self._codes(rest)

    def lists_by_score(self, q: np.ndarray, most: int) -> np.ndarray:
        """The `most` lists of the largest centroid scores for each query, in descending order."""
        out = np.empty((len(q), most), np.int32)
        step = max(1, (1 << 22) // self.lists)
        for at in range(0, len(q), step):
            part = q[at : at + step]
            score = ((part @ self.centre.T)[:, :, None] + (part @ self.finer.T)[:, None, :]).reshape(len(part), -1)
            top = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < score.shape[1] else np.tile(np.arange(most), (len(part), 1))
            order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
            out[at : at + step] = np.take_along_axis(top, order, 1)
        return out

    def approximate(self, q: np.ndarray, cell: np.ndarray | int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric scores of queries (rows) against coded vectors (columns) of one list or of several."""
        first, second = np.divmod(np.atleast_1d(cell), len(self.finer))
        score = np.array(np.broadcast_to(q @ (self.centre[first] + self.finer[second]).T, (len(q), len(codes))), np.float32, order="C")
        for p, book in enumerate(self.books):
            score += np.take(q[:, p * self.step : (p + 1) * self.step] @ book.T, codes[:, p], axis=1)
        return score

    def _calibrate(self, x: np.ndarray, cell: np.ndarray, codes: np.ndarray, k: int, aim: float, rng: np.random.Generator) -> None:
        asked = rng.choice(len(x), min(256, len(x)), replace=False)
        q = x[asked]
        true = self.x[asked].astype(float) @ self.x.T.astype(float)
        true[np.arange(len(q)), asked] = -np.inf
        k = max(1, min(k, len(x) - 1))
        best = np.argsort(-true, axis=1, kind="stable")[:, :k]
        depth = []
        for i in range(len(q)):
            place = np.empty(self.lists, np.int64)
            place[self.lists_by_score(q[i : i + 1], self.lists)[0]] = np.arange(self.lists)
            depth.append(place[cell[best[i]]])
        self.probes = int(min(self.lists, max(4, _at_share(np.concatenate(depth), aim) + 1)))
        # By how much the code of a true neighbour underrates it.
        short = [true[i, best[i]] - self.approximate(q[i : i + 1], cell[best[i]], codes[best[i]])[0] for i in range(len(q))]
        self.slack = float(max(0.0, _at_share(np.concatenate(short), aim)))

    def floors(self, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best exact score in a part of the sample, its own id left out; -inf if there are fewer.

        Less a margin for the order in which double products are summed."""
        n = min(len(self.x), self.rows // 8)
        if n < 4 * k:
            return np.full(len(q), -np.inf)
        part = self.x[:n].astype(float)
        score = q.astype(float) @ part.T
        score[ids[:, None] == self.ids[None, :n]] = -np.inf
        kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        return kth - 1e-12 * part.shape[1] * np.linalg.norm(q.astype(float), axis=1) * np.linalg.norm(part, axis=1).max()


def _at_share(values: np.ndarray, share: float) -> float:
    """The value that a share of the values reaches at most."""
    values = np.sort(values)
    return values[min(len(values) - 1, math.ceil(share * len(values)) - 1)]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def search_neighbours(
    df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, aim: float = 0.97, list_rows: int = LIST_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each usable row where `is_query`, its k nearest usable rows
    by inner product, its own id left out, nearest first."""
    spark = df.sparkSession
    rows = df.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks"))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not widths:
        return empty
    width, total = widths[0]["w"], widths[0]["count"]
    rows = rows.where(F.size("v") == width)
    # Rows of small hashes are ordered only: a little more than the sample, so that no task merges more.
    near = F.xxhash64(F.lit(5), "id")
    part = (sample + 8 * math.sqrt(sample)) / total
    few = rows.where(near <= int(-(2**63) + part * 2**64)) if part < 1 else rows
    taken = few.select("id", "v").orderBy(near, "id").limit(sample).toArrow()
    index = Index(taken.column("id").to_numpy(), _matrix(taken.column("v"), width), total, k, aim, list_rows)
    sent = spark.sparkContext.broadcast(pickle.dumps(index))  # the sample and its centroids: bounded by `sample`
    element = rows.schema["v"].dataType.elementType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            if batch.num_rows:
                cell, codes = own.encode(_matrix(batch.column("v"), width).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), batch.column("asks"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())],
                    ["id", "v", "asks", "cell", "code"],
                )

    held = stored(rows.mapInArrow(encoded, f"id long, v array<{element}>, asks boolean, cell int, code binary"), "vectors-index")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, q = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
                floor = own.floors(ids, q, k)
                order = own.lists_by_score(q.astype(np.float32), own.probes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(floor), pa.array(list(order), pa.list_(pa.int32()))], ["id", "v", "floor", "cells"]
                )

    asked = stored(held.where("asks").select("id", "v").mapInArrow(probed, f"id long, v array<{element}>, floor double, cells array<int>"), "vectors-asked")
    # Lists are dealt into bundles of about BLOCK rows, so that a query is sent to a bundle once, whatever number of its
    # lists it probes; a bundle of more rows (a hot list) is split. One row a bundle: one per BLOCK vectors.
    bundles = max(1, min(index.lists, math.ceil(total / BLOCK)))
    placed = held.withColumn("bundle", F.pmod("cell", F.lit(bundles)))
    size = placed.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sent_to = asked.withColumn("bundle", F.explode(F.array_distinct(F.transform("cells", lambda c: F.pmod(c, F.lit(bundles))))))
    sent_to = sent_to.withColumn("cells", F.filter("cells", lambda c: F.pmod(c, F.lit(bundles)) == F.col("bundle")))
    need = sent_to.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns"))
    grid = size.join(need, "bundle")
    left = placed.join(grid, "bundle").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    left = left.select("bundle", "block", "turn", "id", "v", "cell", "code")
    right = sent_to.join(grid, "bundle").withColumn("turn", F.pmod(F.xxhash64(F.lit(2), "id"), "turns").cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("bundle", "block", "turn", "id", "v", "floor", "cells")

    def found(key: tuple, mine: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if mine.num_rows and queries.num_rows:
            own = pickle.loads(sent.value)
            order = np.argsort(mine.column("id").to_numpy(), kind="stable")
            ids, x, cell = mine.column("id").to_numpy()[order], _matrix(mine.column("v"), width)[order], mine.column("cell").to_numpy()[order]
            codes = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            same = pd.Series(np.unique(np.ascontiguousarray(x).view([("", x.dtype)] * width).ravel(), return_inverse=True)[1])
            few = np.flatnonzero(same.groupby(same).cumcount().to_numpy() <= k)
            few = few[np.argsort(cell[few], kind="stable")]
            ids, x, codes, cell = ids[few], x[few].astype(float), codes[few], cell[few]
            asks, q, floors = queries.column("id").to_numpy(), _matrix(queries.column("v"), width), queries.column("floor").to_numpy()
            cells = queries.column("cells").combine_chunks()
            probed_cell, asker = cells.flatten().to_numpy(), np.repeat(np.arange(len(asks)), np.diff(cells.offsets.to_numpy()))
            low, exact_q = q.astype(np.float32), q.astype(float)
            for c in np.unique(cell):
                rows_at, who = slice(*np.searchsorted(cell, [c, c + 1])), asker[probed_cell == c]
                if not len(who):
                    continue
                guess = own.approximate(low[who], int(c), codes[rows_at])
                row, col = np.nonzero(guess >= (floors[who] - own.slack)[:, None])
                row, col = who[row], col + rows_at.start
                score = np.einsum("nd,nd->n", exact_q[row], x[col])
                hit = np.isfinite(score) & (score >= floors[row]) & (asks[row] != ids[col])
                row, col, score = row[hit], col[hit], score[hit]
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                out[0].append(asks[row[top]])
                out[1].append(ids[col[top]])
                out[2].append(score[top])
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(float))})

    keys = ("bundle", "block", "turn")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(found, "query_id long, vec_id long, score double")
    # Per query at most k rows a probed list, and only those that reach its floor.
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", nth.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
