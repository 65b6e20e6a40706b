"""Bound-certified best-fit packing of documents into token sequences.

Tokenised pieces are dealt evenly to partitions that each pack with best-fit decreasing. Dual feasible functions give a
lower bound on a partition's number of bins. A partition that meets its bound is certified: no packing of its pieces is
better, so it hands on only its emptiest bin, whose pieces may still fill bins elsewhere. Any other partition keeps its
full bins and hands on the pieces of all bins with gaps. What was handed on is dealt anew and packed again, until one
partition holds it, the bound of all pieces is met, or a round saves next to nothing; a round that saves nothing is undone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import load
from .common import written

SEQUENCE = 2048
#: Pieces that a partition packs; what a task holds is a few dozen bytes for each.
PARTITION_PIECES = 20_000
#: Partitions of the first round at least, as long as each has LEAST_PIECES pieces.
FIRST_PARTITIONS, LEAST_PIECES = 8, 64
#: The part of a round's bins that it must save for another to follow.
GAIN = 0.001

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, certified boolean, settled boolean"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: all pieces are full but the first, which may be shorter."""
    first = n % size or size
    return [(0, min(first, n))] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """The token pieces of every document, each with the CRC-32 of its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(bpe.encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    for column, value in zip(out, (doc, k, start, length, zlib.crc32(ids[start : start + length])), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that any packing of these lengths needs."""
    return histogram_bound(*np.unique(lengths, return_counts=True), size)


def histogram_bound(x: np.ndarray, n: np.ndarray, size: int) -> int:
    """Bins that n[i] pieces of each length x[i], in order, need, by two families of dual feasible functions."""
    if not len(x):
        return 0
    bound = -(-int((x * n).sum()) // size)
    for k in range(1, 33):  # u_k(x) = x where (k + 1) x is whole, floor((k + 1) x) / k elsewhere; here times k * size
        up = (k + 1) * x
        total = int((np.where(up % size == 0, k * x, up // size * size) * n).sum())
        bound = max(bound, -(-total // (k * size)))
    low = x[x <= size // 2]
    if len(low):  # U_e(x) = 1 for x > 1 - e, x for e <= x <= 1 - e, 0 for less; the useful e are the lengths themselves
        e = low[:, None]
        value = np.where(x[None, :] > size - e, size, np.where(x[None, :] >= e, x[None, :], 0))
        bound = max(bound, int((-(-(value * n).sum(axis=1) // size)).max()))
    return max(bound, int(n[x > size // 2].sum()))


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the room left in each bin."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    open_rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = open_rooms >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                open_rooms &= ~(1 << left)
        else:
            b, left = len(room), size
            room.append(size)
        bins[i], offsets[i] = b, size - left
        left -= need
        room[b] = left
        if left:
            by_room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(room, dtype=np.int64)


def bound_of(rows: DataFrame, size: int) -> int:
    """Bins that any packing of all pieces needs; the driver sees one count for each length."""
    found = rows.groupBy("length").count().orderBy("length").toArrow()
    return histogram_bound(found.column("length").to_numpy().astype(np.int64), found.column("count").to_numpy().astype(np.int64), size)


def pack_round(dealt: DataFrame, number: int, size: int) -> DataFrame:
    """Packs each partition; certified rows are those of partitions that meet their bound, and rows that are not settled are handed on."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        lengths = rows.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, size)
        certified = len(room) == lower_bound(lengths, size)
        if certified:
            settled = bins != int(room.argmax()) if room.max() else np.ones(len(bins), dtype=bool)
        else:
            settled = room[bins] == 0
        for name, values in (("sequence_id", bins + base), ("offset", offsets), ("certified", np.full(len(bins), certified)), ("settled", settled)):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.combine_chunks().to_batches()

    return dealt.mapInArrow(pack, PACKED)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A document is its ids and then id 0; only a document longer than `size` is cut. A null or empty text is the single
    id 0. Rows are packed as they are: repeated rows and null ids each keep their pieces. Columns other than the id and
    the text are not read. An empty table gives no rows. Each sequence is filled without a gap from offset 0. certified
    tells whether the partition that packed the piece last met its lower bound; certificate() tells of the whole.
    """
    return exchange(pieces(docs, vocabulary, id_col, text_col, size), size)


def exchange(found: DataFrame, size: int, most: int | None = None, first: int | None = None) -> DataFrame:
    """Packs pieces, `most` (PARTITION_PIECES) to a partition and in `first` (FIRST_PARTITIONS) partitions or more at the start.

    Where the bound of all pieces isn't met in the end and one partition can hold them all, they are all exchanged once
    more, full bins too, and the better packing stands.
    """
    most, first = most or PARTITION_PIECES, first or FIRST_PARTITIONS
    found = left = written(found)
    n, least = left.count(), bound_of(left, size)
    parts = max(-(-n // most), min(first, n // LEAST_PIECES), 1)
    opens = F.col("offset") == 0  # one piece of each bin
    done: list[DataFrame] = []
    number = fixed = before = 0  # fixed: bins that are settled; before: bins that hold what is left
    while True:
        packed = written(pack_round(left.select(*found.columns).repartition(parts), number, size))
        after, kept, open_ = packed.agg(F.count_if(opens), F.count_if(opens & F.col("settled")), F.count_if(~F.col("settled"))).first()
        undone = number > 0 and after >= before
        if undone:  # what is left stays as the round before packed it
            packed, after = left, before
        if undone or parts == 1 or not open_ or fixed + after == least or number and before - after < GAIN * before:
            break
        done.append(packed.filter("settled"))
        left = packed.filter("not settled")
        fixed, before, number = fixed + kept, after - kept, number + 1
        parts = -(-open_ // most)
    if done and fixed + after > least and n <= most:
        again = written(pack_round(found.repartition(1), number + 1, size))
        if again.filter(opens).count() < fixed + after:
            done, packed = [], again
    return reduce(DataFrame.unionByName, done, packed).drop("settled")


def certificate(packed: DataFrame, size: int = SEQUENCE) -> dict[str, int]:
    """The sequences of a packing, and how many any packing of its pieces needs."""
    return {"sequences": packed.filter("offset = 0").count(), "lower_bound": bound_of(packed, size)}
