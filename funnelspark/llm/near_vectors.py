"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on random lines. Two vectors collide on a line if one lies in a window around the other's
projection; the projections are sorted, so the window's ends are found by binary search and only what is in
it is touched. Pairs with enough collisions, a number calibrated for the wanted recall, are verified by their
true cosine.

Rows that are far apart never meet: each of several rounds cuts the space into cells by some further
projections, and a task counts collisions inside its cells. The number of lines per round follows the number of
vectors, so that cells stay small, and the number of rounds follows from the chance that a pair just above
the threshold meets in one and passes its count.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import spread_left_join
from ..session import stage
from .ann import usable
from .components import components
from .hashing import mix

THRESHOLD = 0.95
# Chance that a pair at the threshold is missed; closer pairs are missed far less often.
MISS = 5e-4
# Lines on which collisions are counted; half window and width of a cell, over the distance at the threshold.
LINES, HALF, WIDTH = 16, 1.5, 8.0
# Random vectors per cell, about; rows of a cell that one task takes; (query, row) counters at once.
CELL_ROWS, BLOCK_ROWS, COUNTERS = 512, 4096, 1 << 21
# Hot cells sent to every task; more are joined by a shuffle.
SMALL_CELLS = 100_000
# Whole numbers make projections exact, so a row falls into the same cells wherever it is projected.
VECTOR_SCALE, LINE_SCALE = 1 << 14, 1 << 8

VECTORS = "vec_id bigint, digest binary, dim int, norm double, vector binary"
KEYED = "node bigint, tag bigint, weight bigint, dim int, norm double, vector binary, keys array<int>"
FOUND = "node bigint, tag bigint, links bigint, root bigint"


@functools.lru_cache(maxsize=8)
def plan(rows: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """(lines per round, rounds, collisions that pass) for so many vectors."""
    near, far = math.sqrt(2 - 2 * threshold), math.sqrt(2)

    def same_cell(distance: float) -> float:
        # Chance that two points at a distance fall into one interval on a random line.
        c = WIDTH * near / distance
        return math.erf(c / math.sqrt(2)) - math.sqrt(2 / math.pi) / c * (1 - math.exp(-c * c / 2))

    lines = max(0, math.ceil(math.log(max(rows, 1) / CELL_ROWS) / -math.log(same_cell(far))))
    # The largest count that all but MISS / 2 of the pairs at the threshold reach.
    hit, enough, reached = math.erf(HALF / math.sqrt(2)), LINES, math.erf(HALF / math.sqrt(2)) ** LINES
    while enough > 1 and 1 - reached > MISS / 2:
        enough -= 1
        reached += math.comb(LINES, enough) * hit**enough * (1 - hit) ** (LINES - enough)
    rounds = math.ceil(math.log(MISS / 2) / math.log(1 - same_cell(near) ** lines)) if lines else 1
    return lines, rounds, enough


@functools.lru_cache(maxsize=8)
def _lines(dim: int, count: int, seed: int) -> np.ndarray:
    """Random directions with whole components, LINE_SCALE standing for one."""
    return np.rint(np.random.default_rng([seed, dim]).standard_normal((dim, count)) * LINE_SCALE)


def project(vectors: np.ndarray, norms: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Projections of the unit vectors. Sums of whole numbers below 2**53 are exact in any order."""
    whole = np.rint(vectors / norms[:, None] * VECTOR_SCALE)
    return (whole @ lines) / (VECTOR_SCALE * LINE_SCALE)


def cell_keys(vectors: np.ndarray, norms: np.ndarray, lines: int, rounds: int, width: float) -> np.ndarray:
    """Key of each vector's cell in each round."""
    keys = np.zeros((len(vectors), rounds), dtype=np.uint64)
    if lines and len(vectors):
        dim = vectors.shape[1]
        shift = np.random.default_rng([2, dim]).random(lines * rounds)
        places = np.floor(project(vectors, norms, _lines(dim, lines * rounds, 1)) / width + shift)
        places = places.astype(np.int64).astype(np.uint64).reshape(len(vectors), rounds, lines)
        for k in range(lines):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + places[:, :, k] + np.uint64(k + 1))
    return (keys >> np.uint64(33)).astype(np.int32)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after rows a and b (arrays) are joined pair by pair; a root is labelled with itself."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, np.maximum(x, y), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def linked(ids, weights, vectors, norms, group, side, turn, keys, threshold, enough):
    """(links, root row) of each row: links with rows of its group, of the other side where it has two.

    ``group`` ascends. ``side`` is -1 in groups without sides. ``turn`` is the group's round; a pair that shares a cell
    of an earlier round is left to that one.
    """
    n = len(ids)
    links, label = np.zeros(n, dtype=np.int64), np.arange(n)
    size = np.bincount(group)
    begin = np.cumsum(size) - size
    local, widest = np.arange(n) - begin[group], int(size.max())
    half = HALF * math.sqrt(2 - 2 * threshold)
    at = project(vectors, norms, _lines(vectors.shape[1], LINES, 3))
    # Groups lie apart on each line, further than any window reaches.
    at += (group * (2 * np.abs(at).max() + 2 * half + 1))[:, None]
    order = np.argsort(at, axis=0, kind="stable")
    ahead = np.arange(keys.shape[1])
    step = max(1, COUNTERS // widest)
    for q0 in range(0, n, step):
        q1 = min(n, q0 + step)
        count = np.zeros((q1 - q0) * widest, dtype=np.uint8)
        for line in range(LINES):
            there = at[order[:, line], line]
            lo = np.searchsorted(there, at[q0:q1, line] - half, "left")
            width = np.searchsorted(there, at[q0:q1, line] + half, "right") - lo
            ends = np.cumsum(width)
            inside = np.arange(int(ends[-1])) + np.repeat(lo - (ends - width), width)
            hit = np.repeat(np.arange(q1 - q0) * widest, width) + local[order[inside, line]]
            count += np.bincount(hit, minlength=len(count)).astype(np.uint8)
        query, row = np.divmod(np.flatnonzero(count >= enough), widest)
        query += q0
        row += begin[group[query]]
        stays = (row != query) & ((side[query] < 0) | (side[query] != side[row]))
        query, row = query[stays], row[stays]
        for k in range(0, len(query), 1 << 16):
            a, b = query[k : k + (1 << 16)], row[k : k + (1 << 16)]
            near = np.einsum("ij,ij->i", vectors[a], vectors[b]) / (norms[a] * norms[b]) >= threshold
            a, b = a[near], b[near]
            met = ((keys[a] == keys[b]) & (ahead[None, :] < turn[a][:, None])).any(axis=1)
            a, b = a[~met], b[~met]
            np.add.at(links, a, weights[b])
            label = joined(label, a, b)
    return links, label


def _read(batches):
    """Column arrays of Arrow batches; vectors stay bytes."""
    for batch in batches:
        yield {
            name: batch.column(name).to_pylist() if name == "vector" else batch.column(name).to_numpy(zero_copy_only=False)
            for name in batch.schema.names
        }


def _matrix(vectors: list[bytes], kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), dim).astype(np.float64)


def _digested(kind: str):
    """Function that gives vectors as bytes, with digest and norm."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector")):
                # Adding zero makes one zero of both.
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), kind) + np.zeros(1, kind)
                wide = x.astype(np.float64)
                raw = x.tobytes()
                out.append((i, hashlib.sha256(raw).digest(), len(x), math.sqrt(math.fsum(wide * wide)), raw))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["vec_id", "digest", "dim", "norm", "vector"]
            )

    return run


def _keyed(kind: str, lines: int, rounds: int, width: float):
    """Function that adds the keys of the cells."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims, norms = batch.column("dim").to_numpy(), batch.column("norm").to_numpy()
            raw = batch.column("vector").to_pylist()
            keys = np.zeros((len(raw), rounds), dtype=np.int32)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                keys[own] = cell_keys(_matrix([raw[i] for i in own], kind, dim), norms[own], lines, rounds, width)
            listed = pa.ListArray.from_arrays(np.arange(len(raw) + 1, dtype=np.int32) * rounds, keys.ravel())
            kept = ["node", "tag", "weight", "dim", "norm", "vector"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], listed], [*kept, "keys"])

    return run


def _searched(kind: str, rounds: int, lines: int, width: float, threshold: float, enough: int):
    """Function that links the rows of sorted cells."""
    marks = ["dim", "turn", "key", "low", "high"]

    def link(rows):
        import pyarrow as pa

        n = len(rows["node"])
        new = np.zeros(n, dtype=bool)
        for c in marks:
            new[1:] |= rows[c][1:] != rows[c][:-1]
        group = np.cumsum(new)
        vectors = _matrix(rows["vector"], kind, int(rows["dim"][0]))
        keys = cell_keys(vectors, rows["norm"], lines, rounds, width)
        side = np.where(rows["low"] == rows["high"], -1, rows["block"])
        links, label = linked(
            rows["node"], rows["weight"], vectors, rows["norm"], group, side, rows["turn"], keys, threshold, enough
        )
        some = links > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (rows["node"][some], rows["tag"][some], links[some], rows["node"][label[some]])],
            ["node", "tag", "links", "root"],
        )

    def run(batches):
        held = None
        for rows in _read(batches):
            if held is not None:
                rows = {c: held[c] + v if c == "vector" else np.concatenate([held[c], v]) for c, v in rows.items()}
            n = len(rows["node"])
            new = np.zeros(n, dtype=bool)
            for c in marks:
                new[1:] |= rows[c][1:] != rows[c][:-1]
            # Whole cells, as many together as their counters allow; the last one may go on.
            begin = [0, *np.flatnonzero(new).tolist()]
            first, widest = 0, 0
            for i, size in enumerate(np.diff(begin).tolist()):
                many = (begin[i + 1] - begin[first]) * max(widest, size) > COUNTERS
                if i > first and (many or rows["dim"][begin[i]] != rows["dim"][begin[first]]):
                    yield link({c: v[begin[first] : begin[i]] for c, v in rows.items()})
                    first, widest = i, 0
                widest = max(widest, size)
            if begin[first] < begin[-1]:
                yield link({c: v[begin[first] : begin[-1]] for c, v in rows.items()})
            held = {c: v[begin[-1] :] for c, v in rows.items()}
        if held is not None and len(held["node"]):
            yield link(held)

    return run


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Two vectors of equal length are linked if their cosine, in double precision, is ``threshold`` or more and they were
    found; none below it is. ``n_links`` counts the other vectors linked with a row's, copies included;
    ``component_id`` is the smallest id reached over links, and the row of that id is kept. Rows of equal
    id and vector are one vector. Rows of equal id with different vectors are vectors each, of one component. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do rows without an id, which are kept.
    Other columns are not read.

    Equal vectors are one node, so a vector that very many rows share is compared once. Cells with more than
    BLOCK_ROWS rows, as of a large group of near copies, are dealt to tasks as pairs of blocks.
    """
    spark = vectors.sparkSession
    single = vectors.schema[embedding].dataType.elementType.simpleString() == "float"
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").cast(f"array<{element}>").alias("vector")
    )
    fit = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    fit = stage(fit.mapInArrow(_digested(kind), VECTORS), "vectors")
    once = fit.groupBy("digest", "vec_id").agg(F.first("dim").alias("dim"), F.first("norm").alias("norm"), F.first("vector").alias("vector"))
    nodes = once.groupBy("digest").agg(
        F.min(F.struct("vec_id", "dim", "norm", "vector")).alias("one"), F.count("*").alias("weight")
    )
    # A node is named by its smallest id; the tag tells vectors of one id apart.
    nodes = nodes.select(
        "digest", F.col("one.vec_id").alias("node"), F.xxhash64("digest").alias("tag"), "weight", "one.dim", "one.norm", "one.vector"
    )
    nodes = stage(nodes, "nodes")
    lines, rounds, enough = plan(nodes.count(), threshold)
    width = WIDTH * math.sqrt(2 - 2 * threshold)
    keyed = nodes.select("node", "tag", "weight", "dim", "norm", "vector")
    keyed = stage(keyed.mapInArrow(_keyed(kind, lines, rounds, width), KEYED), "cells")
    cell = ["dim", "turn", "key"]
    hot = keyed.select("dim", F.posexplode("keys").alias("turn", "key")).groupBy(*cell).count()
    hot = stage(hot.filter(F.col("count") > BLOCK_ROWS).select(*cell, F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")), "hot-cells")
    met = keyed.select("*", F.posexplode("keys").alias("turn", "key")).drop("keys")
    met = met.join(F.broadcast(hot) if hot.count() <= SMALL_CELLS else hot, cell, "left")
    met = met.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("node", "turn"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "blocks")
    cells = [*cell, "low", "high"]
    met = met.repartition(*cells).sortWithinPartitions(*cells)
    found = met.mapInArrow(_searched(kind, rounds, lines, width, threshold, enough), FOUND)
    found = stage(found, "links")
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b")
    # An id with several vectors joins their components.
    several = once.select("vec_id", "digest").groupBy("vec_id").agg(F.collect_set("digest").alias("digests")).filter(F.size("digests") > 1)
    same = several.select(F.col("vec_id").alias("a"), F.explode("digests").alias("digest")).join(
        nodes.select("digest", F.col("node").alias("b")), "digest"
    )
    edges = edges.unionByName(same.select("a", "b").filter("a != b")).distinct()
    parts = components(edges)
    links = found.groupBy("node", "tag").agg(F.sum("links").alias("links"))
    done = nodes.select("digest", "node", "tag", "weight").join(links, ["node", "tag"], "left").join(parts, "node", "left")
    done = done.select(
        "digest", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"),
    )
    named = fit.select("vec_id", "digest")
    rest = rows.filter(~F.coalesce(F.col("vec_id").isNotNull() & usable(F.col("vector")), F.lit(False)))
    rest = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = spread_left_join(named, done, ["digest"], "weight").select("vec_id", "n_links", "component_id")
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
