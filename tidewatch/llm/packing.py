"""Bound-certified best-fit packing of documents into token sequences.

A document is its token ids and one end id. Only documents longer than a sequence are cut, into
full pieces and a rest. Pieces are dealt by hash into partitions of bounded size, and each is
packed by best-fit decreasing. Dual-feasible functions give a lower bound on the bins of any set of
lengths, for the whole table from its histogram of lengths (at most one count per length) and for
each partition from its own. A partition whose bin count meets its unrounded bound is certified and
final; the others keep their full bins and release the rest. Released pieces are exchanged: dealt
anew into as many partitions as their number needs, and packed again, until the whole table meets
its bound or one partition holds all that is released; after `max_rounds` exchanges what is still
released is packed as it is dealt. Pieces are dealt by their row, so that repeats of a row spread.

Null texts are empty documents of one end id; repeated rows are packed each by itself. A text that
spells a special token of the tokenizer file gets that token's id.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, stored
from tidewatch.llm.tokens import WordBpe

CAPACITY, END_ID = 4096, 1
PIECES_PER_PARTITION = 16_384
#: A piece's number in the stored table: tells repeats of a row apart.
ROW = "_pack_row"


def tokenized(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece of (doc_id, text)."""
    small_batches(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordBpe(tokenizer)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 256):
                batch = whole.slice(at, 256)
                cols: list[list] = [[], [], [], [], [], []]
                texts = (t.as_py() or "" for t in batch.column("text"))
                for doc, ids in zip(batch.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        for col, value in zip(cols, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            col.append(value)
                out = [pa.array(cols[0], batch.schema.field("doc_id").type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array(cols[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return df.select("doc_id", "text").mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """Unrounded bins that no packing of the lengths can undercut; counts[x] pieces have length x (0 .. capacity)."""
    if not counts.any():
        return 0.0
    x = np.arange(capacity + 1)
    used = np.flatnonzero(counts)
    best = float(counts @ x) / capacity
    # u_k: rounds a length up or down to a multiple of capacity / (k + 1).
    for k in (1, 2, 3, 4, 5, 6, 7, 9, 11, 15):
        whole = (k + 1) * used % capacity == 0
        best = max(best, float((counts[used] * np.where(whole, used / capacity, (k + 1) * used // capacity / k)).sum()))
    # U_e: lengths over capacity - e count as a whole bin, lengths under e as none.
    heads, words = np.cumsum(counts), np.cumsum(counts * x)
    e = np.arange(1, capacity // 2 + 1)
    large = heads[-1] - heads[capacity - e]
    middle = words[capacity - e] - words[e - 1]
    return max(best, float((large + middle / capacity).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, lengths in descending order, and the room left in every bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while an open bin has room r
    left: list[int] = []
    for i, length in enumerate(lengths.tolist()):
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = room - length
        if left[b]:
            open_[left[b]].append(b)
            rooms |= 1 << left[b]
    return bins, offsets, np.array(left, np.int64)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, max_rounds: int = 8) -> DataFrame:
    """Adds sequence_id and offset to rows of (.., doc_id, piece, length, ids_crc32)."""
    names = pieces.columns
    pieces = stored(pieces.withColumn(ROW, F.monotonically_increasing_id()), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    least = math.ceil(lower_bound(counts, capacity) - 1e-9)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, released boolean"
    done, open_, waiting, total = None, pieces, int(counts.sum()), 0
    for turn in range(max_rounds):
        parts = max(1, math.ceil(waiting / per_partition))
        last = parts == 1 or turn == max_rounds - 1

        wanted = pa.schema([*(_field(pieces, c) for c in pieces.columns), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("released", pa.bool_())])
        dealt = open_.withColumn("_pack_part", F.pmod(F.xxhash64(F.lit(turn), ROW), F.lit(parts)))
        result = stored(dealt.groupBy("_pack_part").applyInArrow(_packer(turn, last, capacity, wanted), schema), f"pack-{turn}")
        kept = result.where("not released").drop("released")
        done = kept if done is None else done.union(kept)
        if last:
            break
        now = result.agg(F.sum(F.col("released").cast("long")), F.count_distinct("sequence_id"), F.count_distinct(F.when(~F.col("released"), F.col("sequence_id")))).first()
        waiting = now[0] or 0
        if not waiting:
            break
        if total + now[1] <= least:
            done = done.union(result.where("released").drop("released"))
            break
        total += now[2]
        open_ = result.where("released").select(*pieces.columns)
    return done.select(*names, "sequence_id", "offset")


def _packer(turn: int, last: bool, capacity: int, wanted: pa.Schema):
    """Packs one partition; in all turns but the last, one above its bound releases its bins with room."""

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        # Columns stay in Arrow, which keeps ids of any type as they are beside nulls.
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), (ROW, "ascending")]
        group = group.drop_columns("_pack_part").take(pc.sort_indices(group, sort_keys=order))
        lengths = group.column("length").to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        gap = len(left) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        released = left[bins] > 0 if gap > 1e-9 and not last else np.zeros(len(bins), bool)
        found = {"sequence_id": (turn << 56) + (int(key[0].as_py()) << 24) + bins, "offset": offsets, "released": released}
        for name, values in found.items():
            group = group.append_column(name, pa.array(values))
        return group.select(wanted.names).cast(wanted)

    return packed


def _field(df: DataFrame, name: str) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(name, to_arrow_type(df.schema[name].dataType))


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) per piece: `offset` is the
    piece's place in its sequence, gapless from 0; with keep_ids, `ids` holds its ids as binary."""
    return pack_pieces(tokenized(df, tokenizer, capacity, end_id, keep_ids), capacity)
