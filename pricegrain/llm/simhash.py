"""SimHash near-duplicates: fingerprints linked by Hamming distance, with pivot distance tables.

Each distinct fingerprint carries its Hamming distances to a table of reference fingerprints. By the triangle inequality
two fingerprints within r bits differ by at most r in every coordinate, so a pair whose largest coordinate difference
exceeds r is discarded without looking at the fingerprints; survivors are verified bit by bit. Which pairs meet at all is
bounded without loss: of b bit blocks, two fingerprints within r bits agree in b - r at least, so fingerprints meet only
where such a choice of blocks agrees, and a crowded meeting is split into pairs of shares of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, local_labels

SEED = 42
BITS = 3
#: Rows that may agree by chance where fingerprints meet; more rows are cut into more blocks.
CHANCE = 64
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Words of a fingerprint that tells resemblance.
WORDS = 16
#: Fingerprints of a meeting that one task compares with each other, and texts whose shingle sets it compares.
SHARE, TEXTS = 2048, 1024
#: Keys under which texts meet, and least hashes of a key: of pairs of resemblance 0.8, 3 in a million share no key.
KEYS, LEAST = 32, 5
#: Columns of the matrix by which shingle sets are intersected.
COLUMNS = 4096


def shingles(text: str, width: int) -> list[bytes]:
    """Shingles of words, joined by spaces; fewer words give the whole sequence, none give nothing."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and white space 0x20 and 0x09-0x0D only
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint(grams: list[bytes], words: int = 1) -> np.ndarray:
    """`words` times 64 bits, each set if it is set in over half of the grams' hashes; 0 without grams. Signed, as Spark's long is.

    The first word's hash is XXH64; those of further words are mixed from it.
    """
    ones = np.zeros((words, 64), dtype=np.int64)
    for k in range(0, len(grams), 1 << 14):
        part = grams[k : k + (1 << 14)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        for word in range(words):
            if word:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * word)
            ones[word] += np.unpackbits((h ^ (h >> np.uint64(32)) if word else h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(grams), axis=1, bitorder="little").view(np.int64)[:, 0] if grams else np.zeros(words, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 1) -> DataFrame:
    """doc_id, and fp or for several words their array: one row per document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingles(t.as_py() or "", width), words) for t in batch.column(1)]
            column = pa.array([int(f[0]) for f in found], pa.int64()) if words == 1 else pa.array([f.tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "fp"])

    kind = "long" if words == 1 else "array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, fp {kind}")


def blocks_for(rows: int, bits: int = BITS) -> int:
    """Blocks of a one-word fingerprint, so many that all but `bits` of them tell `rows` fingerprints apart to about CHANCE."""
    return next((b for b in range(bits + 2, 16) if rows <= CHANCE << 64 * (b - bits) // b), 16)


def block_masks(bits: int, blocks: int) -> list[tuple[int, int]]:
    """For each choice of blocks - bits blocks of a one-word fingerprint, word 0 and the mask of its bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [(0, sum(one[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - bits)]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    grams = shingles(text or "", width)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)))


def meeting_keys(grams: np.ndarray) -> np.ndarray:
    """KEYS keys of a set of hashes, each of LEAST least values under other orders; the empty set has keys too."""
    rng = np.random.default_rng(SEED)
    flip, factor = rng.integers(0, 1 << 64, (2, KEYS * LEAST, 1), dtype=np.uint64)
    least = np.full(KEYS * LEAST, (1 << 64) - 1, dtype=np.uint64)
    for k in range(0, len(grams), 1 << 12):
        least = np.minimum(least, ((grams[k : k + (1 << 12)] ^ flip) * (factor | np.uint64(1))).min(axis=1))
    key = np.zeros(KEYS, dtype=np.uint64)
    for part in least.reshape(KEYS, LEAST).T:
        key = (key ^ part ^ (part >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def pivots(words: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, (PIVOTS, words), dtype=np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def near_pairs(prints: np.ndarray, meeting: np.ndarray, side: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one meeting within `bits`; rows (of words) are sorted by meeting. side: 0 to compare within it, 1 and 2 to compare only across."""
    table = np.stack([distance(prints, p) for p in pivots(prints.shape[1])], axis=1)
    starts = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1]))) if len(prints) else np.array([], dtype=np.int64)
    size = np.diff(np.append(starts, len(prints)))
    left = np.repeat(starts + size, size) - np.arange(len(prints))  # rows from this one to the end of its meeting
    rows, step = np.flatnonzero(left > 1), 1
    while len(rows):
        for part in np.array_split(rows, max(1, len(rows) >> 16)):
            a, b = part, part + step
            use = (side[a] != side[b]) | (side[a] == 0)
            a, b = a[use], b[use]
            for k in range(table.shape[1]):
                near = np.abs(table[a, k] - table[b, k]) <= bits
                a, b = a[near], b[near]
            near = distance(prints[a], prints[b]) <= bits
            yield a[near], b[near]
        step += 1
        rows = rows[left[rows] > step]


def mask_keys(masks: list[tuple[int, int]]) -> Column:
    return F.array(*(F.element_at("words", word + 1).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for word, m in masks))


def links(prints: DataFrame, bits: int, keys: Column, late: bool = False) -> DataFrame:
    """a, b: links between nodes (node, words, ...) that join the same nodes as all pairs within `bits` that agree in a place of `keys` do.

    late: words, if they are long, are joined to those rows alone that meet another one.
    """
    met = prints.select("node", *([] if late else ["words"]), F.posexplode(keys).alias("choice", "bits"))
    shares = met.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("choice", "bits", F.ceil(F.col("n") / SHARE).cast("int").alias("shares"))
    own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    other = F.sequence(F.lit(0), F.col("shares") - 1)
    met = met.join(shares, ["choice", "bits"])
    met = met.join(prints.select("node", "words"), "node") if late else met
    dealt = met.select("choice", "bits", own.alias("own"), F.explode(other).alias("other"), "node", "words")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("choice", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), side.alias("side"), "node", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "meeting"):
            node = rows.column("node").to_numpy()
            words = rows.column("words").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
            label = np.arange(len(node))
            for a, b in near_pairs(words, rows.column("meeting").to_numpy(), rows.column("side").to_numpy(), bits):
                label = local_labels(label, a, b)
            linked = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[linked]]), pa.array(node[linked])], names=["a", "b"])

    return dealt.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables that hold the groups of a sorted column whole, of about a batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def grouped(prints: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, node, component_id for rows (doc_id, node): component_id is the smallest id reachable over links (a, b)."""
    distinct = prints.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    linked = distinct.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_node = linked.join(best, "label").select("node", "component_id")
    return prints.join(of_node, "node").select("doc_id", "node", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id.

    A null or empty text has fingerprint zero, which links like any other. Rows of equal fingerprint are one node, so
    copies never form pairs. Repeated rows repeat in the result; a null id keeps its row and never names a component
    unless all ids of the component are null. Other columns are not read. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, width).withColumnRenamed("fp", "node"))
    nodes = prints.select("node", F.array("node").alias("words")).distinct()
    found = grouped(prints, links(nodes, bits, mask_keys(block_masks(bits, blocks_for(prints.count(), bits)))))
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def resemblance(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard coefficient of each two sets; 1 for two empty ones."""
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:] if size.any() else (row, row)
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (k, k + COLUMNS))
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - k)), dtype=np.float32)
        held[row[a:b], column[a:b] - k] = 1
        common += held @ held.T
    union = size[:, None] + size[None] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def resembling(texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """a, b: links between texts (node, label, text) that join the same nodes as all pairs of one label that resemble each other do."""
    shares = texts.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("shares"))
    own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    dealt = texts.join(shares, "label").select("label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("other"), "node", "text")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), side.alias("side"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "meeting"):
            node, meeting, side = (rows.column(c).to_numpy() for c in ("node", "meeting", "side"))
            label = np.arange(len(node))
            edges = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1], [True])))
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                near = resemblance([shingle_set(t.as_py(), width) for t in rows.column("text").slice(start, stop - start)]) >= similarity
                a, b = start + np.array(np.nonzero(np.triu(near, 1)))
                use = (side[a] != side[b]) | (side[a] == 0)
                label = local_labels(label, a[use], b[use])
            linked = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[linked]]), pa.array(node[linked])], names=["a", "b"])

    return dealt.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "a long, b long").distinct()


def similar_texts(rows: DataFrame, similarity: float, width: int, words: int) -> tuple[DataFrame, DataFrame]:
    """(node, doc_id) of rows (doc_id, node, text), and links (a, b) between nodes; see similar_groups()."""
    share = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = int(64 * words * share + 6 * np.sqrt(64 * words * share * (1 - share)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            found = [fingerprint(list(set(shingles(t, width))), words).tolist() for t in texts]
            keys = [meeting_keys(shingle_set(t, width)).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "words", "keys"])

    prints = written(rows.mapInArrow(run, "doc_id long, node long, words array<long>, keys array<long>"))
    near = components(links(prints.dropDuplicates(["node"]), bits, F.col("keys"), late=True))
    near = near.unionByName(near.select(F.col("label").alias("node"), "label")).distinct()
    texts = written(rows.select("node", "text").join(near, "node").dropDuplicates(["node"]).select("node", "label", "text"))
    return prints.select("doc_id", "node"), resembling(texts, similarity, width)


def similar_groups(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = WORDS) -> DataFrame:
    """One row per input row: doc_id, component_id, for links at a resemblance (Jaccard) of sets of distinct shingles.

    Fingerprints only propose: pairs meet where one of KEYS keys of least hashes agrees, and are candidates within a loose
    number of bits. Two sets of resemblance s differ in about a share acos(2s / (1 + s)) / pi of the bits of a fingerprint,
    sets of a few shingles in up to a quarter more; the limit is six standard deviations above that, and so wide that the
    pivot table prunes next to nothing here. All pairs within a group of linked candidates are then compared by their sets,
    and only those of the asked resemblance link. At 0.8 a pair is missed 3 times in a million, at more less often; no
    pair below it links. Nulls, empty texts, repeated rows and an empty table are as in simhash_groups.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_node(text_col).alias("node"), F.col(text_col).alias("text"))
    prints, found = similar_texts(rows, similarity, width, words)
    return grouped(prints, found).select("doc_id", "component_id")


def text_node(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def distinct_documents(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", width: int = 5, words: int = WORDS) -> DataFrame:
    """The documents, with all their columns, without those that resemble one that stays or are linked to it by others.

    Of a group, as in similar_groups(), the text with the smallest id stays; texts without an id come after all others, in the
    order of their hashes. Rows of equal text stay or go together.
    """
    names = docs.columns
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_node(text_col).alias("node"), F.col(text_col).alias("text"))
    prints, found = similar_texts(rows, similarity, width, words)
    label = components(found)
    label = label.unionByName(label.select(F.col("label").alias("node"), "label")).distinct()
    first = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(label, "node").select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node").alias("order"))
    stays = first.groupBy("label").agg(F.min("order").alias("best"))
    goes = first.join(stays, "label").filter("order != best").select(F.col("order.node").alias("__node"))
    return docs.withColumn("__node", text_node(text_col)).join(goes, "__node", "left_anti").select(*(F.col(f"`{c}`") for c in names))
