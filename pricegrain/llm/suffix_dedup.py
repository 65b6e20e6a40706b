"""Removal of repeated byte strings by bucket-pointer refinement.

Every window of LENGTH bytes is assigned to an anchor in it: the q-gram of smallest hash, leftmost on ties. Equal windows
so have equal anchors, and the initial buckets are those of equal anchor q-grams. A bucket of one anchor is done. The
windows of an anchor form one segment; equal segments of a bucket are settled together, and the first occurrence stands
for all. The few buckets that may hold much of all anchors are found by a sketch; they are settled in shares first, and
only the first copies in each share go on. Where a bucket holds different segments, their windows are told apart by refinement:
buckets of q-grams are sorted by the bucket pointers of later offsets, pointers are updated, and the next, twice as deep
refinement reuses them, until LENGTH bytes are covered. Of each final bucket, every window but the first is removed.

A bucket of more than SHARE segments is refined across tasks first. Its windows fall into ranges by the bytes that they have
before the anchor; those of a range share a core of bytes around it, and the next buckets are those of equal (bucket,
range, core). A segment gives one row for each range, and WIDTHS says how many windows a range has. Equal parts of segments
are settled again, and what still differs in too large a bucket is refined by the next width. Where a range has one window,
all parts of a bucket are equal, so the last round leaves nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .exact_dedup import frequent
from .simhash import whole_groups

LENGTH = 100
#: Bytes of an anchor, and of the first buckets of the refinement.
ANCHOR, GRAM = 32, 8
#: Segments of a bucket that one task refines; a larger bucket is refined across tasks until its buckets are as small.
SHARE = 512
#: Windows of a range in each round across tasks, of the LENGTH - ANCHOR + 1 that an anchor may have.
WIDTHS = (27, 9, 3, 1)
#: Shares into which each bucket that may hold much of all anchors is split at first.
HOT_SHARES = 128
#: Window starts that are handled at once; a position in a chunk takes CHUNK_BITS bits.
CHUNK_BITS = 17
CHUNK = (1 << CHUNK_BITS) - 2 * LENGTH
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15
#: The layout of `place`: start of the segment's windows, the number of windows - 1, and the anchor's offset.
WINDOW_BITS = 7


class Hashes:
    """Polynomial hashes modulo 2^64 of all strings of a chunk, from sums of its bytes' terms."""

    def __init__(self) -> None:
        rng = np.random.default_rng(5)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        n = (1 << CHUNK_BITS) + 1
        self.power = self._powers(BASE, n)
        self.inverse = self._powers(pow(BASE, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.inverse[start]


HASHES: list[Hashes] = []


def hashes() -> Hashes:
    if not HASHES:
        HASHES.append(Hashes())
    return HASHES[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def chunk_segments(data: np.ndarray, owner: np.ndarray, starts: int) -> tuple[np.ndarray, ...]:
    """For windows that start before `starts` and lie in one text: bucket, segment digest, and first, last window and anchor of each anchor."""
    empty = np.empty(0, dtype=np.int64)
    if len(data) < LENGTH:
        return (empty.astype(np.uint64),) * 2 + (empty,) * 3
    h = hashes()
    sums = h.sums(data)
    n = len(data) - ANCHOR + 1
    gram = mixed((sums[ANCHOR:] - sums[:n]) * h.inverse[:n])
    low = np.uint64((1 << CHUNK_BITS) - 1)
    least = sliding_min(gram & ~low | np.arange(n, dtype=np.uint64), LENGTH - ANCHOR + 1)[:starts]
    fits = np.flatnonzero(owner[: len(least)] == owner[LENGTH - 1 : LENGTH - 1 + len(least)])
    if not len(fits):
        return (empty.astype(np.uint64),) * 2 + (empty,) * 3
    anchor = (least[fits] & low).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1] + 1))))
    first, anchor = fits[edge], anchor[edge]
    last = fits[np.append(edge[1:], len(fits)) - 1]
    segment = mixed(h.of(sums, first, last + LENGTH) + np.uint64(BASE) * (anchor - first + LENGTH * (last - first)).astype(np.uint64))
    return gram[anchor], segment, first, last, anchor


def chunked(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, number of the text of each byte, its offset in the text, window starts) of chunks that cover all windows."""
    held: list[int] = []
    size = 0

    def joined(numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        data = np.frombuffer(b"".join(raw[i] for i in numbers), np.uint8)
        lengths = [len(raw[i]) for i in numbers]
        offset = np.concatenate([np.arange(n) for n in lengths]) if lengths else np.empty(0, dtype=np.int64)
        return data, np.repeat(np.array(numbers, dtype=np.int64), lengths), offset, len(data)

    for i, text in enumerate(raw):
        if len(text) < LENGTH:
            continue
        if held and size + len(text) > CHUNK:
            yield joined(held)
            held, size = [], 0
        if len(text) > CHUNK:
            for at in range(0, len(text) - LENGTH + 1, CHUNK):
                data = np.frombuffer(text, np.uint8)[at : at + CHUNK + LENGTH - 1]
                yield data, np.full(len(data), i, dtype=np.int64), np.arange(at, at + len(data)), CHUNK
            continue
        held.append(i)
        size += len(text)
    if held:
        yield joined(held)


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, segment, ord, tag, place of every anchor of (ord, tag, text) rows."""
    for batch in batches:
        order, tag = batch.column("ord").to_numpy(), batch.column("tag").to_numpy()
        for data, owner, offset, starts in chunked(raw_texts(batch.column("text"))):
            bucket, segment, first, last, anchor = chunk_segments(data, owner, starts)
            if not len(first):
                continue
            text = owner[first]
            place = (offset[first] << WINDOW_BITS | last - first) << WINDOW_BITS | anchor - first
            # 40 bits tell buckets apart well enough: a bucket of two q-grams only makes the refinement see more segments.
            yield pa.RecordBatch.from_arrays([pa.array((bucket >> np.uint64(24)).astype(np.int64)), pa.array(segment.view(np.int64)), pa.array(order[text]), pa.array(tag[text]), pa.array(place)], names=["bucket", "segment", "ord", "tag", "place"])


def identity(values: list[bytes], *numbers: list[int]) -> pa.Array:
    """64-bit identifiers of strings together with numbers."""
    head = (b"".join(n.to_bytes(8, "little", signed=True) for n in row) for row in zip(*numbers, strict=True))
    return pa.array(np.fromiter((xxhash.xxh64_intdigest(v, xxhash.xxh64_intdigest(h)) for v, h in zip(values, head, strict=True)), np.uint64, len(values)).view(np.int64))


def parts(rows: list[tuple[int, int, int, int, int, bytes]], width: int) -> pa.RecordBatch:
    """Rows of CUT for the parts, of `width` windows, of segments (bucket, ord, tag, start, before, raw).

    before: bytes of raw before the anchor; the windows of a range have from low to high bytes before it.
    """
    bucket, order, tag, start, before, raw, core, range_, last = ([] for _ in range(9))
    for b, o, t, s, most, whole in rows:
        least = most - (len(whole) - LENGTH)
        for k in range(least // width, most // width + 1):
            low, high = k * width, min((k + 1) * width - 1, LENGTH - ANCHOR)
            fewest, own = max(least, low), min(most, high)
            piece = whole[most - own : most + LENGTH - fewest]
            for column, value in zip((bucket, order, tag, start, before, raw, core, range_, last), (b, o, t, s + most - own, own, piece, piece[own - low : own + LENGTH - high], k, fewest), strict=True):
                column.append(value)
    return cut_rows(identity(core, bucket, range_), identity(raw, before, last), order, tag, start, before, raw)


#: Cut segments: those that one task refines have a bucket alone, those of crowded buckets a segment (of the part) too.
CUT = "bucket long, segment long, ord long, tag long, start long, before int, raw binary"


def cut_rows(bucket: pa.Array, segment: pa.Array | None, order: list[int], tag: list[int], start: list[int], before: list[int], raw: list[bytes]) -> pa.RecordBatch:
    segment = pa.nulls(len(order), pa.int64()) if segment is None else segment
    return pa.RecordBatch.from_arrays([bucket, segment, pa.array(order, pa.int64()), pa.array(tag, pa.int64()), pa.array(start, pa.int64()), pa.array(before, pa.int32()), pa.array(raw, pa.binary())], names=["bucket", "segment", "ord", "tag", "start", "before", "raw"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CUT rows of the asked segments of (ord, tag, text, asked) rows; repeated rows, which come one after another, count once."""
    last = None
    for batch in batches:
        small: list[tuple[int, int, int, int, int, bytes]] = []
        crowded: list[tuple[int, int, int, int, int, bytes]] = []
        for order, tag, raw, asked in zip(batch.column("ord").to_pylist(), batch.column("tag").to_pylist(), raw_texts(batch.column("text")), batch.column("asked").to_pylist(), strict=True):
            if (order, tag) == last:
                continue
            last = (order, tag)
            for x in asked:
                place = x["place"]
                start, count, before = place >> 2 * WINDOW_BITS, (place >> WINDOW_BITS & (1 << WINDOW_BITS) - 1) + 1, place & (1 << WINDOW_BITS) - 1
                (crowded if x["crowded"] else small).append((x["meeting"], order, tag, start, before, raw[start : start + count + LENGTH - 1]))
        if small:
            meeting, *rest = zip(*small, strict=True)
            yield cut_rows(pa.array(meeting, pa.int64()), None, *rest)
        if crowded:
            yield parts(crowded, WIDTHS[0])


def refine(data: np.ndarray, room: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Bucket pointers of the positions of data: equal for positions whose next `length` bytes are equal, where room >= length.

    room: bytes from a position to the end of its own string. Pointers are places in the sorted order of the strings.
    """
    n = len(data)
    pointer = np.full(n, -1, dtype=np.int64)
    live = np.flatnonzero(room >= gram)
    if not len(live):
        return pointer
    padded = np.concatenate((data, np.zeros(gram, dtype=np.uint8)))
    first = np.lib.stride_tricks.sliding_window_view(padded, gram)[:n]
    value = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        value = value << np.uint64(8) | first[:, k]
    order = live[np.argsort(value[live], kind="stable")]
    new = np.concatenate(([True], value[order[1:]] != value[order[:-1]]))
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    depth = gram
    while depth < length:
        step = min(depth, length - depth)
        size = np.bincount(pointer[live], minlength=len(order))
        # Buckets of one need no sorting; positions without room for the new depth are no longer compared.
        open_ = live[(size[pointer[live]] > 1) & (room[live] >= depth + step)]
        if not len(open_):
            break
        later = pointer[open_ + step]
        by = np.lexsort((later, pointer[open_]))
        open_, later = open_[by], later[by]
        bucket = pointer[open_]
        fresh_bucket = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        fresh = fresh_bucket | np.concatenate(([True], later[1:] != later[:-1]))
        place = np.arange(len(open_))
        base = np.maximum.accumulate(np.where(fresh_bucket, place, 0))
        pointer[open_] = bucket + np.maximum.accumulate(np.where(fresh, place, 0)) - base
        depth += step
        live = live[room[live] >= depth]
    return pointer


def window_table(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(pointer, ord, start, tag, position) of each window of the segments (ord, tag, start, raw)."""
    raw = table.column("raw").to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    row = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    room = (begin + lengths)[row] - np.arange(len(data))
    pointer = refine(data, room)
    position = np.flatnonzero(room >= LENGTH)
    row = row[position]
    order, tag, start = (table.column(c).to_numpy()[row] for c in ("ord", "tag", "start"))
    return pointer[position], order, start + position - begin[row], tag, position


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ord, tag, start, stop: bytes of windows that start earlier in another segment of the task."""
    for table in whole_groups(batches, "bucket"):
        pointer, order, start, tag, position = window_table(table)
        by = np.lexsort((start, order, pointer))
        head = np.concatenate(([True], pointer[by[1:]] != pointer[by[:-1]])) if len(by) else np.empty(0, dtype=bool)
        best = np.empty(len(by), dtype=np.int64)
        best[by] = by[np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))]  # the first of the windows equal to each
        gone = (order[best] < order) | (order[best] == order) & (start[best] < start)
        keep = np.flatnonzero(gone)
        if not len(keep):
            continue
        edge = np.concatenate(([True], (np.diff(position[keep]) != 1) | (start[keep[1:]] != start[keep[:-1]] + 1)))
        first, last = keep[edge], keep[np.append(np.flatnonzero(edge)[1:], len(keep)) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(order[first]), pa.array(tag[first]), pa.array(start[first]), pa.array(start[last] + LENGTH)], names=["ord", "tag", "start", "stop"])


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept bytes and the removed spans of (doc_id, text, gone, ...) rows."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for raw, gone in zip(raw_texts(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for start, stop in sorted((x["start"], x["stop"]) for x in gone or ()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([start, stop])
            kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True))
            for column, value in zip(out, (len(raw), len(raw) - len(kept), spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string())
        more = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.startswith("carried_")]
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256", *(n for n, _ in more)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True)), *(c for _, c in more)], names=names)


#: Rows of settled anchors: spans (start, stop), segments to refine (meeting, crowded), and first copies in a share (bucket, segment).
SETTLED = "bucket long, segment long, ord long, tag long, place long, start long, stop long, meeting long, crowded boolean"


def settled_rows(order: np.ndarray, tag: np.ndarray, place: np.ndarray, **known: pa.Array) -> pa.RecordBatch:
    """A batch of SETTLED, null where nothing is known."""
    types = {"bucket": pa.int64(), "segment": pa.int64(), "ord": pa.int64(), "tag": pa.int64(), "place": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "meeting": pa.int64(), "crowded": pa.bool_()}
    known |= {"ord": pa.array(order), "tag": pa.array(tag), "place": pa.array(place)}
    return pa.RecordBatch.from_arrays([known.get(n, pa.nulls(len(order), t)) for n, t in types.items()], names=list(types))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, and segments to refine (with their meeting), of anchors sorted by bucket, segment, ord and place.

    A segment's later copies are spans. Of a bucket with different segments, the first copies meet; over SHARE of them are
    crowded. What is kept between batches is the last segment's first copy and at most SHARE of the last bucket's segments.
    """
    last: tuple[int, int] | None = None  # bucket and segment of the last row
    first = np.zeros(2, dtype=np.int64)  # ord and place of its segment's first copy
    held, asked = np.empty((0, 4), dtype=np.int64), (0, 0)  # segments (bucket, ord, tag, place) of the last bucket; a bucket and how many of it were asked for
    low = 2 * WINDOW_BITS

    def asks(kinds: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate(([True], kinds[1:, 0] != kinds[:-1, 0])))
        size = np.diff(np.append(start, len(kinds)))
        total = size.copy()
        total[0] += asked[1] if kinds[0, 0] == asked[0] else 0
        use = np.repeat(total > 1, size)
        return settled_rows(*kinds[use, 1:].T, meeting=pa.array(kinds[use, 0]), crowded=pa.array(np.repeat(total > SHARE, size)[use]))

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, segment, order, tag, place = (batch.column(c).to_numpy() for c in ("bucket", "segment", "ord", "tag", "place"))
        new_bucket = np.concatenate(([last is None or last[0] != bucket[0]], bucket[1:] != bucket[:-1]))
        new_segment = new_bucket | np.concatenate(([last is None or last[1] != segment[0]], segment[1:] != segment[:-1]))
        lead = np.maximum.accumulate(np.where(new_segment, np.arange(len(bucket)), -1))
        first_order, first_place = np.where(lead >= 0, order[lead], first[0]), np.where(lead >= 0, place[lead], first[1])
        start = place >> low
        gone = np.flatnonzero((first_order < order) | (first_order == order) & (first_place >> low < start))
        if len(gone):
            stop = start[gone] + (place[gone] >> WINDOW_BITS & (1 << WINDOW_BITS) - 1) + LENGTH
            yield settled_rows(order[gone], tag[gone], place[gone], start=pa.array(start[gone]), stop=pa.array(stop))
        last, first = (int(bucket[-1]), int(segment[-1])), np.array([first_order[-1], first_place[-1]])
        kinds = np.concatenate((held, np.stack((bucket, order, tag, place), axis=1)[new_segment]))
        goes_on = np.flatnonzero(kinds[:, 0] != last[0]) if len(kinds) else np.empty(0, dtype=np.int64)
        cut = int(goes_on[-1]) + 1 if len(goes_on) else 0
        if cut:
            yield asks(kinds[:cut])
        held = kinds[cut:]
        before = asked[1] if asked[0] == last[0] else 0
        if len(held) and len(held) + before > SHARE:
            yield asks(held)
            held, asked = held[:0], (last[0], before + len(held))
    if len(held):
        yield asks(held)


def settle_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors of hot buckets, sorted by bucket, share, segment, ord and place: a share's first copies of each segment, and spans of its later ones."""
    last: tuple[int, int, int] | None = None
    first = np.zeros(2, dtype=np.int64)
    low = 2 * WINDOW_BITS
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in ("bucket", "share", "segment")]
        order, tag, place = (batch.column(c).to_numpy() for c in ("ord", "tag", "place"))
        new = np.concatenate(([last is None or last != tuple(int(k[0]) for k in key)], np.any([k[1:] != k[:-1] for k in key], axis=0)))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), -1))
        first_order, first_place = np.where(lead >= 0, order[lead], first[0]), np.where(lead >= 0, place[lead], first[1])
        start = place >> low
        gone = (first_order < order) | (first_order == order) & (first_place >> low < start)
        last, first = tuple(int(k[-1]) for k in key), np.array([first_order[-1], first_place[-1]])
        stop = start + (place >> WINDOW_BITS & (1 << WINDOW_BITS) - 1) + LENGTH
        use = new | gone
        hidden = new[use]
        yield settled_rows(order[use], tag[use], place[use], bucket=pa.array(key[0][use]), segment=pa.array(key[2][use]), start=pa.array(start[use], mask=hidden), stop=pa.array(stop[use], mask=hidden))


def settle_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles anchors sorted by share, bucket, segment, ord and place: cold buckets, of share -1, as a whole, hot ones a share at a time."""
    batches = iter(batches)
    rest: list[pa.RecordBatch] = []

    def cold() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = int(np.searchsorted(batch.column("share").to_numpy(), 0))
            yield batch.slice(0, n)
            if n < batch.num_rows:
                rest.append(batch.slice(n))
                return

    yield from settle(cold())
    yield from settle_share(chain(rest, batches))


def narrower(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield parts(list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "ord", "tag", "start", "before", "raw")), strict=True)), width)

    return run


def judged(rows: DataFrame) -> DataFrame:
    """Rows (bucket, segment, ord, tag, start, ...) with `gone`, whether an equal segment of the bucket starts earlier, and `kinds`, the bucket's different segments.

    Of the rows that aren't gone, one of each segment stays, and none where the bucket has no other segment.
    """
    own = F.struct("ord", "start", "tag")
    first = rows.groupBy("bucket", "segment").agg(F.min(own).alias("first"))
    kinds = first.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"))
    gone = F.struct("first.ord", "first.start") < F.struct("ord", "start")
    seen = rows.join(first, ["bucket", "segment"]).join(kinds, "bucket").withColumn("gone", gone)
    return seen.filter(F.col("gone") | (F.col("first") == own) & (F.col("kinds") > 1)).drop("first")


def removed_spans(rows: DataFrame) -> DataFrame:
    """ord, tag, start, stop of bytes to remove from rows (ord, tag, text, ...); spans may overlap."""
    anchors = rows.select("ord", "tag", "text").mapInArrow(segments, "bucket long, segment long, ord long, tag long, place long")
    hot = written(frequent(anchors, "bucket"))
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("ord", "tag", "place"), F.lit(HOT_SHARES))).otherwise(-1).cast("int").alias("share")
    split = anchors.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "bucket", "left").select("bucket", share, "segment", "ord", "tag", "place")
    once = written(split.repartition("bucket", "share").sortWithinPartitions("share", "bucket", "segment", "ord", "place").mapInArrow(settle_once, SETTLED))
    dropped(hot)
    start, windows = F.shiftright("place", 2 * WINDOW_BITS), F.shiftright("place", WINDOW_BITS).bitwiseAND(F.lit((1 << WINDOW_BITS) - 1))
    leading = once.filter("bucket is not null and start is null").select("bucket", "segment", "ord", "tag", "place", start.alias("start"), (start + windows + LENGTH).alias("stop"))
    again = written(judged(leading))
    spans = [once.filter("start is not null"), again.filter("gone")]
    ask = lambda meeting, crowded: F.struct(F.col(meeting).alias("meeting"), crowded.alias("crowded"), "place").alias("ask")
    asked = once.filter("meeting is not null").select("ord", "tag", ask("meeting", F.col("crowded")))
    asked = asked.unionByName(again.filter("not gone").select("ord", "tag", ask("bucket", F.col("kinds") > SHARE)))
    cut = written(rows.select("ord", "tag", "text").join(asked.groupBy("ord", "tag").agg(F.collect_set("ask").alias("asked")), ["ord", "tag"]).mapInArrow(cut_out, CUT))
    small, crowded = [cut.filter("segment is null")], cut.filter("segment is not null")
    for width in (*WIDTHS[1:], None):
        if crowded.isEmpty():
            break
        seen = written(judged(crowded.withColumn("stop", F.col("start") + F.length("raw"))))
        spans.append(seen.filter("gone"))
        if width is not None:
            small.append(seen.filter(~F.col("gone") & (F.col("kinds") <= SHARE)))
            crowded = written(seen.filter(~F.col("gone") & (F.col("kinds") > SHARE)).mapInArrow(narrower(width), CUT))
    met = reduce(DataFrame.unionByName, (x.select("bucket", "ord", "tag", "start", "raw") for x in small))
    refined = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(repeats, "ord long, tag long, start long, stop long")
    return reduce(DataFrame.unionByName, (x.select("ord", "tag", "start", "stop") for x in spans), refined)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans, kept (bytes), kept_sha256, and the columns to carry.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller id, or earlier
    in the same one. Strings are judged on the input and never cross documents; spans are the maximal removed runs. A
    null text is empty. A null id comes after all others. Rows of one id are judged apart; between them no start is
    earlier unless its offset is smaller. Carried columns come as carried_<name>; others are not read. An empty table
    gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("tag"))
    more = [F.col(f"`{c}`").alias(f"carried_{c}") for c in carry]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *key, text.alias("text"), *more)
    # Repeated rows find the same spans; sets keep what each of them is given from growing with their number.
    gone = removed_spans(rows).groupBy("ord", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    done = rows.join(gone, ["ord", "tag"], "left").drop("ord", "tag")
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name.startswith("carried_"))
    return done.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string" + kinds)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their repeated strings: text shortened, n_chars counted anew, all columns kept.

    Where a removed run cuts a character in two, the rest of its bytes goes too. Cases as in suffix_dedup().
    """

    @F.pandas_udf("string")
    def whole_characters(raw):  # noqa: ANN001, ANN202
        return raw.map(lambda b: b.decode("utf-8", "ignore"))

    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    done = suffix_dedup(docs, carry=carry)
    kept = done.withColumns({"text": whole_characters("kept")}).withColumn("n_chars", F.length("text").cast("long"))
    own = {c: F.col(f"carried_{c}") for c in carry} | {c: F.col(c) for c in ("doc_id", "text", "n_chars")}
    return kept.select(*(own[c].alias(c) for c in docs.columns))
