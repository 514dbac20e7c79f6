"""Removal of passages that occur earlier in the corpus, by windows of words.

A merged count-min sketch first says which windows can be repeated at all; only these are then grouped exactly, by
128 bits of their words' hash (two hashes of 64 bits, both compared in every step). Each chunk of documents sends a repeated window once, with its earliest
document, and learns for each whether an earlier document has it, so a passage that stands in
very many documents is one row per chunk.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .hashing import text_bytes, window_hashes

WINDOW = 20
ROWS, PER_WINDOW = 2, 4

REPEATED = "chunk int, bucket int, keys binary, checks binary, docs binary"
# Answers of both kinds; line is -1 for the exact ones.
ALL_ANSWERS = "chunk int, line int, bucket int, counts binary"


def _sorted(table):
    """Rows of a chunk in order of key, then text."""
    return table.sort_by([("key", "ascending"), ("text", "ascending")])


def unlike(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first hash of each different pair, index of its first pair, pair -> different pair), by pairs of hashes."""
    distinct, first, inverse = np.unique(one, return_index=True, return_inverse=True)
    if (two == two[first][inverse]).all():
        return distinct, first, inverse
    # Equal in one hash only: rare enough to sort by both.
    order = np.lexsort((np.arange(len(one)), two, one))
    a, b = one[order], two[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    inverse = np.empty(len(one), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return a[new], order[new], inverse


def _windows(table, size: int):
    """(distinct hashes, index of the first window of each, window -> distinct, hashes, ...)."""
    data, offsets = text_bytes(table.column("text"))
    hashes, per_doc, words = window_hashes(data, offsets, size, 2)
    distinct, first, inverse = unlike(*hashes)
    return distinct, first, inverse, hashes, per_doc, words


def _bucket(keys: np.ndarray, cut: int) -> np.ndarray:
    return (keys >> np.uint64(64 - cut)).astype(np.int64) if cut else np.zeros(len(keys), np.int64)


def _exact(repeated: DataFrame) -> DataFrame:
    """For each window of each block: 1 if an earlier document has it too."""

    def group(table):
        import pyarrow as pa

        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        checks = np.frombuffer(b"".join(table.column("checks").to_pylist()), "<u8")
        docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), "<i8")
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        order = np.lexsort((docs, checks, keys))
        k, c = keys[order], checks[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        least = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        earlier = np.empty(len(order), np.uint8)
        earlier[order] = least < docs[order]
        ends = np.cumsum(sizes).tolist()
        parts = [earlier[b - n : b].tobytes() for b, n in zip(ends, sizes)]
        n = table.num_rows
        return pa.Table.from_arrays(
            [table.column("chunk"), pa.array(np.full(n, -1), pa.int32()), table.column("bucket"),
             pa.array(parts, pa.binary())],
            ["chunk", "line", "bucket", "counts"],
        )

    return repeated.groupBy("bucket").applyInArrow(group, ALL_ANSWERS)


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW,
    keep: list[str] | None = None, whole: bool = False,
) -> DataFrame:
    """doc_id, the ``keep`` columns, text (kept words joined by one space), n_words, n_removed.

    A word goes if a window of ``size`` words over it also starts earlier: in a document of smaller
    id, or earlier in the same one. Windows are those of the input. One row per input row. Null and
    empty texts have no words and an empty text. Rows of equal id are taken in order of their texts, so of
    repeated rows the first keeps its words. Rows without an id come after all others, in the order
    of a hash of their texts. With ``whole``, a text that loses no word stays as it is, line ends and
    all. Kept columns named like result columns are replaced.
    """
    added = [doc_id, "text", "n_words", "n_removed"]
    keep = [c for c in (keep or []) if c not in added]
    shape = sketch.layout(docs, text, ROWS, PER_WINDOW)
    cut = shape.cut
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    nameless = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(body), 2)
    key = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), nameless)
    rows = docs.select(
        F.pmod(F.xxhash64(key), F.lit(shape.chunks)).cast("int").alias("chunk"),
        key.alias("key"),
        body.alias("text"),
        F.struct(
            F.col(f"`{doc_id}`").alias("id"), *[F.col(f"`{c}`").alias(c) for c in keep]
        ).alias("kept"),
    )
    chunks = rows.groupBy("chunk")

    def ask_sketch(table):
        distinct, _, inverse, *_ = _windows(table, size)
        counts = np.minimum(np.bincount(inverse, minlength=len(distinct)), sketch.MOST)
        return sketch.requests(table.column("chunk")[0].as_py(), distinct, counts, shape)

    def ask_exact(table, answers):
        import pyarrow as pa

        chunk = table.column("chunk")[0].as_py() if table.num_rows else 0
        table = _sorted(table)
        distinct, first, _, hashes, per_doc, _ = _windows(table, size)
        seen = np.flatnonzero(sketch.estimates(distinct, answers.to_pylist(), shape) > 1)
        doc = np.repeat(table.column("key").to_numpy(), per_doc)[first[seen]]
        keys, checks = distinct[seen], hashes[1][first[seen]]
        bucket = _bucket(keys, cut)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(seen) else [0]
        spans = list(zip(edges[:-1], edges[1:]))
        return pa.Table.from_arrays(
            [
                pa.array(np.full(len(spans), chunk), pa.int32()),
                pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                pa.array([keys[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
                pa.array([checks[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()),
                pa.array([doc[a:b].astype("<i8").tobytes() for a, b in spans], pa.binary()),
            ],
            ["chunk", "bucket", "keys", "checks", "docs"],
        )

    kept_type = rows.schema["kept"]
    out_type = T.StructType(
        [
            kept_type,
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
        ]
    )

    def remove(table, answers):
        import pyarrow as pa

        table = _sorted(table)
        distinct, first, inverse, _, per_doc, words = _windows(table, size)
        said = answers.to_pylist()
        seen = sketch.estimates(distinct, [a for a in said if a["line"] >= 0], shape) > 1
        exact = sorted((a for a in said if a["line"] < 0), key=lambda a: a["bucket"])
        earlier = np.zeros(len(distinct), dtype=bool)
        earlier[seen] = np.frombuffer(b"".join(a["counts"] for a in exact), np.uint8) > 0
        again = earlier[inverse] | (first[inverse] != np.arange(len(inverse)))
        # Windows that go cover the words from their start on.
        ends = np.cumsum(words)
        at = np.repeat((ends - words) - (np.cumsum(per_doc) - per_doc), per_doc)
        start = (at + np.arange(len(inverse)))[again]
        total = int(ends[-1]) if len(ends) else 0
        change = np.zeros(total + size + 1, dtype=np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + size, -1)
        stays = np.cumsum(change)[:total] == 0
        texts, removed = [], []
        for body, b, n in zip(table.column("text").to_pylist(), ends.tolist(), words.tolist()):
            mask = stays[b - n : b]
            gone = n - int(mask.sum())
            removed.append(gone)
            if whole and not gone:
                texts.append(body)
                continue
            left = body.encode().split()
            if gone:
                left = compress(left, mask.tolist())
            texts.append(b" ".join(left).decode())
        return pa.Table.from_arrays(
            [table.column("kept"), pa.array(texts, pa.string()), pa.array(words, pa.int64()),
             pa.array(removed, pa.int64())],
            ["kept", "text", "n_words", "n_removed"],
        )

    estimated = sketch.merged(chunks.applyInArrow(ask_sketch, sketch.BLOCKS))
    repeated = chunks.cogroup(estimated.groupBy("chunk")).applyInArrow(ask_exact, REPEATED)
    answers = estimated.unionByName(_exact(repeated))
    done = chunks.cogroup(answers.groupBy("chunk")).applyInArrow(remove, out_type)
    return done.select(
        F.col("kept.id").alias("doc_id"), *[F.col(f"kept.`{c}`").alias(c) for c in keep],
        "text", "n_words", "n_removed",
    )
