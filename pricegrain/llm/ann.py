"""Approximate nearest neighbours by cosine, over balanced posting lists.

A bounded sample is halved again and again into groups of equal size, whose mean directions are the centroids. Every vector goes
to the list of its nearest centroid and, near a boundary, to a few more lists. Centroids are linked to a graph that tasks
hold in memory; a beam search over it finds the nearest ones of a vector. A query reads the lists whose centroid is
within a distance ratio of its nearest one. Lists are cut into shares of bounded size, queries meet shares, and each
meeting gives at most k rows, scored in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .simhash import whole_groups

#: Vectors that the centroids are fitted on, at most: those whose ids have the smallest hashes.
SAMPLE = 65_536
#: Vectors of a list on average, the least vectors of the sample behind a centroid, and rows of a share.
LIST, BEHIND, SHARE = 256, 8, 512
#: Lists that hold a vector at most, and how much farther than the nearest centroid another one may be for that.
REPLICAS, BOUNDARY = 8, 1.15
#: How much farther than the nearest centroid a list that a query reads may be; and the lists that it reads anyway.
RATIO, LEAST_LISTS = 1.25, 4
#: Rows that a task gathers before it keeps only the best of each query.
GATHERED = 200_000
#: Links of a centroid in the graph, and centroids that a search for storing keeps in view.
DEGREE, BEAM = 24, 48


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, n: int) -> np.ndarray:
    """Means of n groups of equal size (give or take one), by halving along the line between two means."""
    rng = np.random.default_rng(11)
    out: list[np.ndarray] = []
    todo = [(np.arange(len(x)), n)]
    while todo:
        rows, parts = todo.pop()
        if parts <= 1 or len(rows) < 2:
            out.append(x[rows].mean(axis=0))
            continue
        left = parts // 2
        cut = len(rows) * left // parts or 1
        a, b = x[rng.choice(rows, 2, replace=False)]
        for _ in range(6):
            order = np.argsort(x[rows] @ (b - a), kind="stable")
            a, b = x[rows[order[:cut]]].mean(axis=0), x[rows[order[cut:]]].mean(axis=0)
        todo += [(rows[order[:cut]], left), (rows[order[cut:]], parts - left)]
    return np.array(out)


def nearest_rows(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    norm, out = (x * x).sum(axis=1), []
    for i in range(0, len(x), 1024):
        d = norm[None] - 2 * x[i : i + 1024] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


@dataclass
class Lists:
    centre: np.ndarray
    graph: np.ndarray
    entry: np.ndarray

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near each row, nearest first, and their distances: beam search over the graph for all rows at once."""
        n, beam = len(self.centre), min(beam, len(self.centre))
        norm = (self.centre**2).sum(axis=1)

        def distance(ids: np.ndarray) -> np.ndarray:
            return norm[ids] - 2 * np.einsum("rd,rkd->rk", x, self.centre[ids])

        row = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), dtype=bool)
        ids = np.tile(self.entry, (len(x), 1))
        seen[row, ids] = True
        near, opened = distance(ids), np.zeros(ids.shape, dtype=bool)
        while True:
            order = np.argsort(near, axis=1, kind="stable")[:, :beam]
            ids, near, opened = ids[row, order], near[row, order], opened[row, order]
            waiting = np.where(opened | np.isinf(near), np.inf, near)
            pick = np.argsort(waiting, axis=1, kind="stable")[:, :4]
            live = np.isfinite(waiting[row, pick])
            if not live.any():
                break
            opened[row, pick] = True
            found = self.graph[ids[row, pick]].reshape(len(x), -1)
            fresh = ~seen[row, found] & np.repeat(live, self.graph.shape[1], axis=1)
            order = np.argsort(found, axis=1, kind="stable")  # the same centroid may come from two sides
            ordered = found[row, order]
            twice = np.concatenate((np.zeros((len(x), 1), dtype=bool), ordered[:, 1:] == ordered[:, :-1]), axis=1)
            again = np.empty_like(twice)
            again[row, order] = twice
            first = ~again
            seen[row, found] = True
            far = np.where(fresh & first, distance(found), np.inf)
            ids, near = np.concatenate((ids, found), axis=1), np.concatenate((near, far), axis=1)
            opened = np.concatenate((opened, np.zeros(found.shape, dtype=bool)), axis=1)
        full = near + (x * x).sum(axis=1)[:, None]
        return ids, np.where(np.isfinite(near), np.sqrt(np.maximum(full, 0)), np.inf)

    def stored_in(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the lists that hold each row: a further list must be nearer to the row than to any list it is in."""
        ids, far = self.search(x, BEAM)
        chosen = np.zeros(ids.shape, dtype=bool)
        chosen[:, 0] = True
        for k in range(1, min(ids.shape[1], 4 * REPLICAS)):
            apart = np.linalg.norm(self.centre[ids[:, :k]] - self.centre[ids[:, k]][:, None], axis=2)
            hidden = (chosen[:, :k] & (apart < far[:, k][:, None])).any(axis=1)
            chosen[:, k] = (far[:, k] <= BOUNDARY * far[:, 0]) & ~hidden & (chosen.sum(axis=1) < REPLICAS)
        row, k = np.nonzero(chosen)
        return row, ids[row, k]

    def read_by(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the lists that each query reads; the beam widens until it ends beyond the ratio."""
        beam = BEAM
        while True:
            ids, far = self.search(x, beam)
            if ids.shape[1] >= len(self.centre) or (far[:, -1] > ratio * far[:, 0]).all():
                break
            beam *= 2
        near = far <= ratio * far[:, :1]
        near[:, :LEAST_LISTS] = np.isfinite(far[:, :LEAST_LISTS])
        row, k = np.nonzero(near)
        return row, ids[row, k]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))


def build(rows: DataFrame, sample: int = SAMPLE) -> tuple[Lists | None, int]:
    """The lists for the most common length of vector, and that length."""
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return None, 0
    total = sizes["count"]
    ids = rows.filter(F.size("v") == sizes["n"]).orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", F.transform("v", lambda c: c.cast("float")).alias("v")).limit(sample).toArrow()
    x = units(ids.column("v").combine_chunks().values.to_numpy().reshape(-1, sizes["n"]).astype(np.float64))
    n = max(1, min(-(-total // LIST), len(x) // BEHIND))
    centre = centroids(x, n)
    centre = (centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    if n <= 2:
        return Lists(centre, np.zeros((n, 1), dtype=np.int64), np.arange(n)), sizes["n"]
    near = nearest_rows(centre, min(DEGREE, n - 1))
    leap = np.random.default_rng(3).integers(0, n, (n, 4))  # a few far links, so no part of the graph is cut off
    ring = (np.arange(n)[:, None] + 1) % n
    return Lists(centre, np.concatenate((near, leap, ring), axis=1), np.unique(np.linspace(0, n - 1, 16).astype(np.int64))), sizes["n"]


def best_of(query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k nearest of each query, ties to the smaller id; equal vectors are scored once."""
    order = np.lexsort((vec_id,))
    vec_id, v = vec_id[order], v[order]
    first, inverse = np.unique(v, axis=0, return_index=True, return_inverse=True)[1:]
    inverse = inverse.reshape(-1)
    members = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[members], np.arange(len(first)))
    group = inverse[members]
    kept = members[np.arange(len(members)) - starts[group] <= k]  # of equal vectors, the k smallest ids beside the query's own
    distinct = units(v[first])
    rough = units(q) @ distinct.T
    take = min(2 * k + 2, len(first))
    near = np.argpartition(-rough, take - 1, axis=1)[:, :take]
    size = np.bincount(inverse[kept], minlength=len(first))
    begin = np.cumsum(size) - size
    flat = near.reshape(-1)
    row = np.repeat(np.repeat(np.arange(len(q)), take), size[flat])
    member = kept[np.repeat(begin[flat], size[flat]) + np.arange(size[flat].sum()) - np.repeat(np.cumsum(size[flat]) - size[flat], size[flat])]
    score = (q[row] * v[member]).sum(axis=1) / (np.sqrt((q[row] ** 2).sum(axis=1)) * np.sqrt((v[member] ** 2).sum(axis=1)))
    own = vec_id[member] == query_id[row]
    row, member, score = row[~own], member[~own], score[~own]
    order = np.lexsort((vec_id[member], -score, row))
    row, member, score = row[order], member[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    use = place < k
    return query_id[row[use]], vec_id[member[use]], score[use]


def best_rows(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of several meetings, the k nearest of each query, each candidate once."""
    order = np.lexsort((-score, vec_id, query_id))
    query_id, vec_id, score = query_id[order], vec_id[order], score[order]
    once = np.concatenate(([True], (query_id[1:] != query_id[:-1]) | (vec_id[1:] != vec_id[:-1])))
    query_id, vec_id, score = query_id[once], vec_id[once], score[once]
    order = np.lexsort((vec_id, -score, query_id))
    query_id, vec_id, score = query_id[order], vec_id[order], score[order]
    use = np.arange(len(query_id)) - np.searchsorted(query_id, query_id) < k
    return query_id[use], vec_id[use], score[use]


def nearest(vectors: DataFrame, is_query, k: int = 5, ratio: float = RATIO, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query (a condition on vec_id) holds.

    The nearest has rank 1; ties go to the smaller id. Null and zero vectors, vectors with a null or non-finite component,
    rows with a null id, and vectors of another length than most take no part. An id on several rows is one candidate,
    with its best score. Columns other than the id and the vector are not read. An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vector_col)
    lists, size = build(rows, sample)
    schema = "list int, vec_id long, v array<double>"

    def spread(assign):  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    x = np.array(part.column("v").to_pylist(), dtype=np.float64).reshape(-1, size)
                    row, at = assign(units(x).astype(np.float32))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(part.column(c).take(pa.array(row)) for c in ("vec_id", "v"))], names=["list", "vec_id", "v"])

        return run

    if lists is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    rows = rows.filter(F.size("v") == size)
    postings = written(rows.mapInArrow(spread(lists.stored_in), schema))
    shares = {r["list"]: -(-r["count"] // SHARE) for r in postings.groupBy("list").count().collect()}  # as many rows as lists
    width = np.array([shares.get(i, 0) for i in range(len(lists.centre))])

    asked = rows.filter(is_query).mapInArrow(spread(lambda x: lists.read_by(x, ratio)), schema)
    wide = F.element_at(F.lit(width.tolist()).cast("array<int>"), F.col("list") + 1)
    stored = postings.select("list", F.pmod(F.xxhash64("vec_id", "v"), wide).cast("int").alias("share"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = asked.filter(wide > 0).select("list", F.explode(F.sequence(F.lit(0), wide - 1)).alias("share"), F.lit(True).alias("asks"), "vec_id", "v")
    met = stored.unionByName(asked).withColumn("meeting", F.col("list").cast("long") * (1 << 31) + F.col("share"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        row_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["query_id", "vec_id", "score"])
        for table in whole_groups(batches, "meeting"):
            meeting, asks, ids = (table.column(c).to_numpy() for c in ("meeting", "asks", "vec_id"))
            v = table.column("v").combine_chunks().values.to_numpy().reshape(-1, size) if table.num_rows else np.empty((0, size))
            edges = np.flatnonzero(np.concatenate(([True], meeting[1:] != meeting[:-1], [True])))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                q, s = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                if len(q) and len(s):
                    new = [best_of(ids[part], v[part], ids[s], v[s], k) for part in np.array_split(q, -(-len(q) // 1024))]
                    found += new
                    held += sum(len(n[0]) for n in new)
            if held > GATHERED:
                found = [best_rows(*map(np.concatenate, zip(*found, strict=True)), k)]
                held = len(found[0][0])
                if held > GATHERED // 2:  # many queries: what is gathered goes on
                    yield row_batch(found[0])
                    found, held = [], 0
        if held:
            yield row_batch(best_rows(*map(np.concatenate, zip(*found, strict=True)), k))

    pairs = met.select("meeting", "asks", "vec_id", "v").repartition("meeting").sortWithinPartitions("meeting").mapInArrow(meet, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
