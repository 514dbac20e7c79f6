"""Approximate nearest neighbours by collision counting.

Every vector is projected on random lines. Per line the projections are kept sorted, and a query opens a
window around its own projection. Windows grow from round to round (virtual rehashing: no table
is rebuilt); their ends are found by binary search, and only entries that a round adds are touched. Each vector's
collisions, the windows it is in, are counted. Vectors above the collision threshold are verified by their true distance. A query ends when its windows reach the distance
of its k-th neighbour, so that nearer vectors would nearly surely have passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES, THRESHOLD = 40, 20
# Half window over distance at which a search ends: a vector at this distance then lies in each window with
# probability 0.71, and in fewer than half of 40 windows once in 400 times.
REACH = 1.05
GROWTH = 1.3
# Rows of one index, queries sent to it together, and those of them searched at a time.
INDEX_ROWS, QUERY_ROWS, AT_ONCE = 8192, 8192, 64

FOUND = "query_id bigint, query_key bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    return F.coalesce(
        vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


class LineIndex:
    """Sorted projections of vectors, and the search over them."""

    def __init__(self, vectors, ids, lines: int = LINES, seed: int = 7):
        import numpy as np

        self.vectors, self.ids = vectors, ids
        n = len(vectors)
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], lines))
        projected = (vectors @ self.directions).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def _windows(self, at, half: float):
        """Per line and query, the first place inside the window of half width ``half`` and the first behind it."""
        import numpy as np

        begin = [np.searchsorted(line, q - half, "left") for line, q in zip(self.sorted, at)]
        end = [np.searchsorted(line, q + half, "right") for line, q in zip(self.sorted, at)]
        return np.array(begin).T, np.array(end).T

    def search(self, queries, own, k: int, threshold: int = THRESHOLD):
        """(query, row, distance) of the k nearest verified rows per query; ids equal to ``own`` are left out."""
        out = []
        for start in range(0, len(queries), AT_ONCE):
            some = slice(start, start + AT_ONCE)
            out += [(start + q, r, d) for q, r, d in self._search(queries[some], own[some], k, threshold)]
        return out

    def _search(self, queries, own, k: int, threshold: int):
        import numpy as np

        n, count = len(self.ids), len(queries)
        at = (queries @ self.directions).T
        fresh = self.ids[None, :] != own[:, None]
        wanted = np.minimum(k, fresh.sum(axis=1))
        collisions = np.zeros((count, n), dtype=np.int32)
        found = [(np.empty(0, dtype=np.int64), np.empty(0))] * count
        active = np.flatnonzero(wanted > 0)
        # Windows begin empty, at the place of the query.
        begin = np.array([np.searchsorted(line, q, "left") for line, q in zip(self.sorted, at)]).T
        end = begin.copy()
        spread = self.sorted[:, -1] - self.sorted[:, 0]
        half = max(float(spread.max()) / 16, 1e-12)
        while len(active):
            left, right = self._windows(at[:, active], half)
            last = np.full(len(active), np.inf)
            for i, q in enumerate(active.tolist()):
                before = [o[b:e] for o, b, e in zip(self.order, left[i].tolist(), begin[q].tolist())]
                behind = [o[b:e] for o, b, e in zip(self.order, end[q].tolist(), right[i].tolist())]
                begin[q], end[q] = left[i], right[i]
                collisions[q] += np.bincount(np.concatenate(before + behind), minlength=n).astype(np.int32)
                rows = np.flatnonzero((collisions[q] >= threshold) & fresh[q])
                if len(rows):
                    gap = self.vectors[rows] - queries[q]
                    distance = np.sqrt((gap * gap).sum(axis=1))
                    fresh[q, rows] = False
                    found[q] = np.append(found[q][0], rows), np.append(found[q][1], distance)
                if len(found[q][1]) >= wanted[q]:
                    last[i] = np.partition(found[q][1], wanted[q] - 1)[wanted[q] - 1]
            active = active[~(half >= REACH * last)]
            half *= GROWTH
        out = []
        for q, (rows, distance) in enumerate(found):
            best = np.lexsort((self.ids[rows], distance))[:k]
            out += [(q, int(rows[i]), float(distance[i])) for i in best]
        return out


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` found neighbours of each query row, nearest first.

    Scores are Euclidean distances in double precision; ties go to the smaller id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part on either side, nor do null ids. Only
    vectors of equal length are compared, and none of the query's own id. Repeated rows are candidates
    each; of repeated query rows one asks. Other columns are not read.

    Rows are dealt into indexes of about INDEX_ROWS by a hash of their id, queries into groups of about
    QUERY_ROWS; a task builds one index and searches it for one group, AT_ONCE queries at a time. Rows are
    copied once per group and queries once per index.
    """
    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(
            F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
            F.col(f"`{embedding}`").cast("array<double>").alias("vector"),
        )
        return rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    rows, asked = clean(vectors), clean(queries).distinct()
    blocks = max(1, -(-rows.count() // INDEX_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    rows = rows.select(
        F.size("vector").alias("dim"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"),
        "vec_id", "vector",
    )
    asked = asked.select(
        F.size("vector").alias("dim"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"),
        "vec_id", F.xxhash64("vec_id", "vector").alias("query_key"), "vector",
    )

    def search(index, group):
        import numpy as np
        import pyarrow as pa

        found = []
        if index.num_rows and group.num_rows:
            index, group = index.sort_by("vec_id"), group.sort_by("vec_id")
            dim = index.column("dim")[0].as_py()
            matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            own = group.column("vec_id").to_numpy()
            lines = LineIndex(matrix(index), index.column("vec_id").to_numpy())
            keys = group.column("query_key").to_numpy()
            for q, row, score in lines.search(matrix(group), own, k):
                found.append((own[q], keys[q], lines.ids[row], score))
        columns = list(zip(*found)) if found else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays(
            [pa.array(np.asarray(c), t) if len(c) else pa.array([], t) for c, t in zip(columns, kinds)],
            ["query_id", "query_key", "vec_id", "score"],
        )

    met = rows.groupBy("dim", "block", "part").cogroup(asked.groupBy("dim", "block", "part"))
    found = met.applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
