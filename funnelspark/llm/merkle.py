"""Merkle manifest of a dataset by time-forward processing.

The tree is cut into blocks of FAN ** LEVELS neighbouring nodes. Inside a block a priority queue ordered by node label
(level, then place) delivers child digests to parents; then a sweep in the opposite order delivers to every
node its proof suffix, the siblings on the way to the root. Between blocks Spark's sorted shuffle is the queue:
each block sends its digest to the block above, and on the way back each block's suffix is a message sorted
in front of the nodes it is for. A round handles LEVELS levels, so a billion leaves take three rounds each way.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import running_totals
from ..session import stage

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
# Rows per Arrow batch that is handed back.
BATCH = 2048

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "tree string, pos bigint, digest string"
# A path is, per level up to the root, "digests to the left:digests to the right", levels joined by "/".
PATHS = "tree string, block bigint, path string, subroot string"
RESULT = (
    "doc_id bigint, source string, leaf string, place bigint, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def digest(text: str) -> str:
    """Lower-case hex SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and the value, or - for null."""
    parts = []
    for v in values:
        said = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ascend(digests: list[str], alone: bool) -> list[list[str]]:
    """Digests of a block, level by level.

    Nodes are taken in order of their labels (level, place); a queue ordered by label holds what children
    have sent to parents. A block that is a tree of its own (``alone``) ends at a single node, any other
    after LEVELS levels.
    """
    made, queue = [digests], [(1, i // FAN, i, d) for i, d in enumerate(digests)]
    last = LEVELS
    if alone:
        last, left = 0, len(digests)
        while left > 1:
            last, left = last + 1, -(-left // FAN)
    while queue and queue[0][0] <= last:
        level, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, place):
            run.append(heapq.heappop(queue)[3])
        if len(made) == level:
            made.append([])
        made[level].append(digest("".join(run)))
        heapq.heappush(queue, (level + 1, place // FAN, place, made[level][-1]))
    return made


def descend(made: list[list[str]], above: str) -> list[str]:
    """Path of each lowest node of a block, from the path of the block's top node."""
    paths = [above]
    for level in reversed(made[:-1]):
        below = []
        for i in range(len(level)):
            run = level[i - i % FAN : i - i % FAN + FAN]
            step = "".join(run[: i % FAN]) + ":" + "".join(run[i % FAN + 1 :])
            suffix = paths[i // FAN]
            below.append(f"{step}/{suffix}" if suffix else step)
        paths = below
    return paths


def _steps(path: str) -> list[tuple[str, str]]:
    return [tuple(s.split(":")) for s in path.split("/")] if path else []


def proof(path: str) -> str:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest("".join(a + b for a, b in _steps(path)))


def fold(start: str, path: str) -> str:
    """The root that a digest and the siblings of its path lead to."""
    for left, right in _steps(path):
        start = digest(left + start + right)
    return start


def _blocks(batches):
    """(tree, block, rows) of sorted Arrow batches; rows are dicts."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for (tree, block), found in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield tree, block, list(found)


def _handed(rows, schema):
    """Rows as Arrow batches of bounded size."""
    import pyarrow as pa

    held = []
    for r in rows:
        held.append(r)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _queued(df: DataFrame) -> DataFrame:
    """Rows of a block in one task, in order of their places."""
    keyed = df.withColumn("block", F.coalesce("block", F.expr(f"pos div {BLOCK}")))
    return keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _raised(nodes: DataFrame) -> DataFrame:
    """The top node of each block, as nodes of the round above."""
    schema = _arrow(NODES)

    def up(batches):
        def tops():
            for tree, block, rows in _blocks(batches):
                # Only the last block of a tree is not full: a first one that is not full is the whole tree.
                made = ascend([r["digest"] for r in rows], alone=block == 0)
                yield {"tree": tree, "pos": block, "digest": made[-1][-1]}

        return _handed(tops(), schema)

    queued = _queued(nodes.select("tree", "pos", "digest", F.lit(None).cast("bigint").alias("block")))
    return stage(queued.mapInArrow(up, NODES), "merkle-nodes")


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round; the last has one per tree."""
    found = [nodes]
    while not found[-1].filter("pos > 0").isEmpty():
        found.append(_raised(found[-1]))
    return found


def _with_messages(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Nodes, and in front of each block its message."""
    sent = messages.select("tree", "block", "path", "subroot", F.lit(-1).cast("bigint").alias("pos"))
    return _queued(nodes.unionByName(sent, allowMissingColumns=True))


def _delivered(batches):
    """(tree, message, [(row, path)]) of each block."""
    for tree, block, (message, *rows) in _blocks(batches):
        made = ascend([r["digest"] for r in rows], alone=block == 0)
        yield tree, message, zip(rows, descend(made, message["path"]))


def _lowered(nodes: DataFrame, messages: DataFrame, own: bool) -> DataFrame:
    """Messages to the blocks below ``nodes``: the path of each. With ``own``, a node is a subroot."""
    schema = _arrow(PATHS)

    def down(batches):
        def sent():
            for tree, message, found in _delivered(batches):
                for row, path in found:
                    yield {
                        "tree": row["digest_of"] if own else tree,
                        "block": 0 if own else row["pos"],
                        "path": path,
                        "subroot": row["digest"] if own else message["subroot"],
                    }

        return _handed(sent(), schema)

    return stage(_with_messages(nodes, messages).mapInArrow(down, PATHS), "merkle-paths")


def manifest(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: list[str] | None = None,
    altered: Column | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, leaf, place (from 0 in its source), subroot, root, proof_sha256,
    folded_root, verified.

    A leaf is the digest of ``fields``, nulls included. Leaves of a source ascend by doc_id (null first), rows of
    equal id by their digest; every FAN consecutive nodes have a parent until one is left. Subroots ascend
    by source (null first, a source of its own) and lead to the root the same way. ``proof_sha256`` is the digest of all siblings
    up to the root; ``folded_root`` is what they and the leaf lead to. ``altered``, the digest of
    another version of the row, takes the leaf's place in that check where it is not null. Repeated
    rows are leaves each. An empty table gives no rows. Other columns are not read.
    """
    fields = FIELDS if fields is None else fields
    leaves = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.col(f"`{source}`").cast("string").alias("source"),
        leaf_digest([F.col(f"`{c}`") for c in fields]).alias("digest"),
        (F.lit(None) if altered is None else altered).cast("string").alias("changed"),
    )
    placed = running_totals(leaves, ["doc_id", "digest"], {"_n": F.lit(1)}, groups=["source"])
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    nodes = placed.select(tree.alias("tree"), (F.col("_n") - 1).alias("pos"), "digest", "doc_id", "source", "changed")
    nodes = stage(nodes, "merkle-leaves")
    rounds = _rounds(nodes)
    # Subroots are the leaves of one more tree; "" sorts before "=" and any source.
    subroots = running_totals(rounds[-1].select("tree", "digest"), ["tree"], {"_n": F.lit(1)})
    top = subroots.select(
        F.lit("root").alias("tree"), (F.col("_n") - 1).alias("pos"), "digest", F.col("tree").alias("digest_of")
    )
    top = _rounds(stage(top, "merkle-subroots"))
    found = top[-1].first()
    root = found["digest"] if found else ""
    messages = docs.sparkSession.createDataFrame([("root", 0, "", None)] if found else [], PATHS)
    # The nodes of a last round are the tops of their trees: the message for one is that for its block.
    for k in reversed(range(max(1, len(top) - 1))):
        messages = _lowered(top[k], messages, own=k == 0)
    for k in reversed(range(1, len(rounds) - 1)):
        messages = _lowered(rounds[k], messages, own=False)
    schema = _arrow(RESULT)

    def down(batches):
        def results():
            for _tree, message, block in _delivered(batches):
                for row, path in block:
                    folded = fold(row["changed"] or row["digest"], path)
                    yield {
                        "doc_id": row["doc_id"], "source": row["source"], "leaf": row["digest"],
                        "place": row["pos"], "subroot": message["subroot"], "root": root,
                        "proof_sha256": proof(path), "folded_root": folded, "verified": folded == root,
                    }

        return _handed(results(), schema)

    return _with_messages(nodes, messages).mapInArrow(down, RESULT)
