"""Hard-negative mining with rotated one-bit codes, their stored alignments, and exact integer scores.

Every vector of integers is rotated (signs and Hadamard steps, fixed by the width) and coded in LEVELS one-bit codes: the signs
of the rotated vector, then of what is left of it, each with the stored alignment of its code vector and what it codes, so
that the vector is the aligned sum of its code vectors and a residual of known length, which is orthogonal to the last code vector. An anchor's rotated
vector is rounded to integers of PLANES bits.

The score of an anchor and a row is estimated by popcounts of the anchor's bit planes and the row's codes. It lies, without
exception, within an interval: by Cauchy-Schwarz the rounding counts at most its length times that of the coded sum, and the residual at
most its length times that part of the anchor which is orthogonal to the last code vector. Pairs whose interval cannot matter are
dropped; the score of every other pair is the integer inner product.

Anchors meet rows in a grid of blocks of bounded size on both sides. For positives rows are bundled by label and a hot label is
split; in a block an anchor needs only rows whose interval reaches above its k-th best lower bound. For negatives an anchor
meets all rows, and needs those whose interval meets the window of one of its positives. A block returns what can be among the first of an anchor
or window, so what is merged afterwards is a few rows an anchor and block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import finite_vector, list_matrix, stored, usual_width

LEVELS, PLANES = 4, 7
#: Rows and anchors of a block; anchors that are compared at a time.
ROW_BLOCK, ANCHOR_BLOCK, TILE = 8192, 4096, 128
#: What floating-point sums may add to an interval, as a share of the product of both lengths.
MARGIN = 1e-9


def rotation(width: int) -> np.ndarray:
    """A fixed orthogonal matrix (its columns' number is the next power of two): signs, then a Hadamard matrix, three times."""
    size = 1 << max(6, (width - 1).bit_length())
    h = np.ones((1, 1))
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    rng, m = np.random.default_rng(size), np.eye(size)
    for _ in range(3):
        m = (m * rng.choice([-1.0, 1.0], size)) @ h
    return m[:width] / size**1.5


class Codes:
    """The codes of rotated rows."""

    def __init__(self, x: np.ndarray, turned: np.ndarray):
        r = x @ turned
        rows, size = r.shape
        self.length = np.linalg.norm(r, axis=1)
        self.words, self.align, coded = [], [], np.zeros_like(r)
        for _ in range(LEVELS):
            up = r > 0
            align = np.abs(r).sum(1) / math.sqrt(size)
            step = np.where(up, 1.0, -1.0) * (align / math.sqrt(size))[:, None]
            coded += step
            r = r - step
            self.words.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64))
            self.align.append(align)
        self.coded, self.residual = np.linalg.norm(coded, axis=1), np.linalg.norm(r, axis=1)

    def packed(self) -> list[bytes]:
        """A row's code words, then its alignments, the lengths of the coded sum and of the residual, and its own."""
        figures = np.column_stack([*self.align, self.coded, self.residual, self.length])
        both = np.concatenate([np.concatenate(self.words, axis=1), figures.view(np.uint64)], axis=1)
        return [row.tobytes() for row in both]

    @classmethod
    def unpacked(cls, raw: list[bytes]) -> Codes:
        both = np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)
        own = cls.__new__(cls)
        figures = both[:, -(LEVELS + 3) :].copy().view(np.float64)
        own.words = np.split(both[:, : -(LEVELS + 3)], LEVELS, axis=1)
        own.align = list(figures[:, :LEVELS].T)
        own.coded, own.residual, own.length = figures[:, LEVELS], figures[:, LEVELS + 1], figures[:, LEVELS + 2]
        return own

    def only(self, rows: slice) -> Codes:
        own = Codes.__new__(Codes)
        own.words, own.align = [w[rows] for w in self.words], [a[rows] for a in self.align]
        own.coded, own.residual, own.length = self.coded[rows], self.residual[rows], self.length[rows]
        return own


class Planes:
    """Anchors, rotated and rounded, as bit planes."""

    def __init__(self, x: np.ndarray, turned: np.ndarray):
        g = x @ turned
        self.size, half = g.shape[1], 1 << (PLANES - 1)
        self.length = np.linalg.norm(g, axis=1)
        self.unit = np.maximum(np.abs(g).max(1), 1e-300) / (half - 1)
        near = np.rint(g / self.unit[:, None]).astype(np.int64)
        self.rounding = np.linalg.norm(g - near * self.unit[:, None], axis=1)
        self.sum = near.sum(1)
        shifted = (near + half).astype(np.uint8)
        self.planes = [np.packbits((shifted >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]
        self.half = half

    def bounds(self, rows: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of all anchors (lines) with all rows."""
        guess = np.zeros((len(self.length), len(rows.length)))
        along = guess
        for words, align in zip(rows.words, rows.align, strict=True):
            hits = np.zeros(guess.shape, np.int64)
            for w in range(words.shape[1]):
                ones = np.bitwise_count(words[:, w]).astype(np.int64)
                for j, plane in enumerate(self.planes):
                    hits += np.bitwise_count(plane[:, w][:, None] & words[:, w][None, :]).astype(np.int64) << j
                hits -= self.half * ones[None, :]
            # The anchor's part along the unit code vector.
            along = (2 * hits - self.sum[:, None]) * (self.unit / math.sqrt(self.size))[:, None]
            guess = guess + along * align[None, :]
        along = np.maximum(0.0, np.abs(along) - self.rounding[:, None])
        beside = np.sqrt(np.maximum(0.0, (self.length**2)[:, None] - along**2))
        width = beside * rows.residual[None, :] + self.rounding[:, None] * rows.coded[None, :] + MARGIN * self.length[:, None] * rows.length[None, :]
        return guess - width, guess + width


def _first(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, highest score first, ties to the smaller `tie`."""
    order = np.lexsort((tie, -score, group))
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < k]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of lines of integers."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), 1 << 16):
        np.einsum("nd,nd->n", a[at : at + (1 << 16)], b[at : at + (1 << 16)], out=out[at : at + (1 << 16)])
    return out


class _Block:
    """A block's rows, sorted by label, or its anchors."""

    def __init__(self, table: pa.Table, codes: bool):
        label = table.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.uid, self.id = table.column("uid").to_numpy()[order], table.column("id").to_numpy()[order]
        self.x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.int32).reshape(len(label), -1)[order].astype(np.int64)
        if codes:
            raw = table.column("code").to_pylist()
            self.codes = Codes.unpacked([raw[i] for i in order])


_BEST = "anchor long, anchor_id long, label int, row long, row_id long, score long"


def _table(parts: list[tuple], anchors: _Block, rows: _Block) -> pa.Table:
    who, what, score = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in range(3))
    who, what = who.astype(np.int64), what.astype(np.int64)
    return pa.table({
        "anchor": pa.array(anchors.uid[who]), "anchor_id": pa.array(anchors.id[who]), "label": pa.array(anchors.label[who]),
        "row": pa.array(rows.uid[what]), "row_id": pa.array(rows.id[what]), "score": pa.array(score.astype(np.int64)),
    })


def _prepared(df: DataFrame, vec_id: str, vector: str, label: Column, is_anchor: Column, scale: float) -> tuple[DataFrame, int, int]:
    """(uid, id, label, asks, x, code) of the usable rows, stored; their width and number."""
    fine = F.col(vec_id).isNotNull() & label.isNotNull() & finite_vector(F.col(vector))
    rows = df.where(fine).select(F.col(vec_id).cast("long").alias("id"), label.cast("int").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(vector).alias("v"))
    width, total = usual_width(rows, "v")
    if not total:
        return rows, 0, 0

    def coded(batches):
        turned = rotation(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = np.floor(scale * list_matrix(batch.column("v"), width).astype(float))
                if (x * x).sum(1).max() >= 2.0**62 or np.abs(x).max() >= 2**31:
                    raise ValueError("scores of so large entries do not fit a long")
                packed = Codes(x, turned).packed()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("label"), batch.column("asks"), pa.array([r.tobytes() for r in x.astype(np.int32)], pa.binary()), pa.array(packed, pa.binary())],
                    ["id", "label", "asks", "x", "code"],
                )

    made = rows.where(F.size("v") == width).mapInArrow(coded, "id long, label int, asks boolean, x binary, code binary")
    return stored(made.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows"), width, total


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column, vec_id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its integer inner product with the anchor, after entries became floor(scale * entry); higher scores come
    first, ties by smaller id. An anchor's positives are its first `positives` other rows of the same label. For each
    of them, the first `negatives` rows of another label whose score is at most the positive's and at least `percent` % of it.

    Rows without an id or label take no part, nor do vectors that are null or empty or hold a null or a number that is not finite, or
    of another width than the most frequent one. Zero vectors take part, with scores of 0. Rows that share an id are separate rows: each such
    anchor gets its own lists, and none of its namesakes is in them. An empty table gives no rows. Scores that
    cannot fit a long are an error.
    """
    rows, width, total = _prepared(df, vec_id, vector, label, is_anchor, scale)
    if not total:
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.where("asks").select("uid", "id", "label", "x").toDF("uid", "id", "label", "x")  # other columns than those of `rows` to the analyzer
    asked = anchors.count()
    blocks, turns = math.ceil(total / ROW_BLOCK), max(1, math.ceil(asked / ANCHOR_BLOCK))

    def block(n: Column | int, salt: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "uid"), n if isinstance(n, Column) else F.lit(n)).cast("int")

    def each(n: Column | int) -> Column:
        return F.explode(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1))

    # Positives: labels are bundled, so that small ones share a task; bundles of more rows than a block are split.
    bundle = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int")
    left, right = rows.withColumn("bundle", bundle), anchors.withColumn("bundle", bundle)
    size = left.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / ROW_BLOCK).cast("int").alias("blocks"))
    need = right.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK).cast("int").alias("turns"))
    grid = size.join(need, "bundle")
    left = left.join(grid, "bundle").withColumn("block", block(F.col("blocks"), 1)).withColumn("turn", each(F.col("turns"))).select("bundle", "block", "turn", "uid", "id", "label", "x", "code")
    right = right.join(grid, "bundle").withColumn("turn", block(F.col("turns"), 2)).withColumn("block", each(F.col("blocks"))).select("bundle", "block", "turn", "uid", "id", "label", "x")

    def nearest(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        held, asks, parts = _Block(mine, True), _Block(theirs, False), []
        turned = rotation(width)
        for name in np.unique(asks.label):
            own, who = slice(*np.searchsorted(held.label, [name, name + 1])), np.arange(*np.searchsorted(asks.label, [name, name + 1]))
            codes = held.codes.only(own)
            for at in range(0, len(who), TILE):
                some = who[at : at + TILE]
                low, high = Planes(asks.x[some].astype(float), turned).bounds(codes)
                others = asks.id[some][:, None] != held.id[None, own]
                low[~others] = -np.inf
                if low.shape[1] > positives:
                    others &= high >= -np.partition(-low, positives - 1, axis=1)[:, positives - 1 : positives]
                i, j = np.nonzero(others)
                i, j = some[i], j + own.start
                score = _exact(asks.x[i], held.x[j])
                top = _first(i, score, held.id[j], positives)
                parts.append((i[top], j[top], score[top]))
        return _table(parts, asks, held)

    keys = ("bundle", "block", "turn")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, _BEST)
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "row_id", "row"))
    best = stored(found.withColumn("nth", nth).where(F.col("nth") <= positives).select("anchor", "anchor_id", "nth", "row_id", "score"), "negatives-positives")
    # Negatives: an anchor goes with its positives' scores; without a positive of at least 0 its windows are empty.
    windows = best.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))  # `positives` at most
    asking = stored(anchors.join(windows, anchors["uid"] == windows["anchor"]).select("uid", "id", "label", "x", "scores"), "negatives-anchors")
    left = rows.select(block(blocks, 3).alias("block"), each(turns).alias("turn"), "uid", "id", "label", "x", "code")
    right = asking.select(block(turns, 4).alias("turn"), each(blocks).alias("block"), "uid", "id", "label", "x", "scores")

    def between(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        held, parts = _Block(mine, True), []
        asks = _Block(theirs, False)
        order = np.argsort(theirs.column("label").to_numpy(), kind="stable")
        lists = theirs.column("scores").combine_chunks()
        scores = [np.array(lists[i].as_py(), np.int64) for i in order.tolist()]
        turned = rotation(width)
        for at in range(0, len(scores), TILE):
            some = np.arange(at, min(len(scores), at + TILE))
            low, high = Planes(asks.x[some].astype(float), turned).bounds(held.codes)
            most, least = np.array([scores[s][0] for s in some]), np.array([scores[s][-1] for s in some])
            may = (low <= most[:, None]) & (100 * high >= (percent * least)[:, None] - 1) & (asks.label[some][:, None] != held.label[None, :]) & (asks.id[some][:, None] != held.id[None, :])
            i, j = np.nonzero(may)
            score = _exact(asks.x[some[i]], held.x[j])
            fits = (score <= most[i]) & (100 * score >= percent * least[i])
            i, j, score = i[fits], j[fits], score[fits]
            order = np.lexsort((held.id[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            edge = np.searchsorted(i, np.arange(len(some) + 1))
            for n, s in enumerate(some.tolist()):
                down, here = -score[edge[n] : edge[n + 1]], set()
                for p in scores[s].tolist():
                    start = int(np.searchsorted(down, -p, "left"))
                    here |= {q for q in range(start, min(len(down), start + negatives)) if 100 * -int(down[q]) >= percent * p}
                if here:
                    q = edge[n] + np.array(sorted(here))
                    parts.append((np.full(len(q), s), j[q], score[q]))
        return _table(parts, asks, held)

    keys = ("block", "turn")
    candidates = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(between, _BEST)
    candidates = candidates.select("anchor", "row", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    met = best.where("score >= 0").withColumnsRenamed({"row_id": "positive_id", "score": "positive_score"}).join(candidates, "anchor")
    met = met.where((F.lit(percent) * F.col("positive_score") <= 100 * F.col("negative_score")) & (F.col("negative_score") <= F.col("positive_score")))
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("negative_score"), "negative_id", "row")).cast("int")
    return met.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
