"""Order-preserving packing of documents into sequences of bounded length.

All documents, in ascending order of doc_id, form one stream of ids. Sequences are windows
of the stream, cut at ends of documents or sentences, or, inside very long sentences, at fixed steps.
Dynamic programming picks the cuts with the least padding plus truncation penalties. A sequence is
padded to the full length unless its own length is a power of two. Over the cuts
that a window can start from, the best padded one is the front of a monotone queue, and the unpadded
ones are found by their distance.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranges import in_order, totals_before
from .tokens import library_encoder, read_vocabulary, text_runs

SEQUENCE = 1024
# Tokens of padding that a cut inside a document is worth avoiding: after a sentence, elsewhere.
SENTENCE_CUT = 8
WORD_CUT = 64
# Sentences longer than this may be cut at every such step.
LONG_SENTENCE = 128
# Possible cuts judged in one go.
CUT_BLOCK = 1 << 12
# Ids packed in one go; a segment ends with a document.
SEGMENT = 1 << 20

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "part int, sequence bigint, offset bigint, sequences bigint"
)


@functools.lru_cache(maxsize=2)
def sentence_ends(path: str):
    """For each id, whether a sentence may end after it: its text ends with . ! ? or has a line end."""
    import numpy as np

    said = read_vocabulary(path)
    vocab = said["model"]["vocab"]
    line_end = chr(0x100 + ord("\n"))
    ids = [*vocab.values(), *[t["id"] for t in said["added_tokens"]]]
    ends = np.zeros(1 + max(ids), dtype=bool)
    for symbol, i in vocab.items():
        ends[i] = symbol[-1] in ".!?" or line_end in symbol
    return ends


def cut_points(doc_ends, ends, long_sentence: int = LONG_SENTENCE):
    """(positions, penalties) of all places where the stream may be cut, 0 included.

    ``doc_ends``: position after each document; ``ends``: for each id, whether a sentence ends there.
    """
    import numpy as np

    total = int(doc_ends[-1])
    penalty = np.full(total + 1, -1, dtype=np.int64)
    penalty[np.flatnonzero(ends) + 1] = SENTENCE_CUT
    penalty[doc_ends] = 0
    penalty[0] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    wide = np.flatnonzero(gaps > long_sentence)
    for a, b in zip(at[wide].tolist(), at[wide + 1].tolist()):
        penalty[a + long_sentence : b : long_sentence] = WORD_CUT
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at, penalties, size: int = SEQUENCE) -> list[int]:
    """Positions of the cuts of the cheapest packing of ``at[0]`` to ``at[-1]``.

    Cost: for each sequence the penalty of the cut at its end, and its padding to ``size`` unless its length
    is a power of two. ``at`` ascends in steps of at most ``size``. Ties: the earlier start.
    """
    import numpy as np

    n, origin = len(at), int(at[0])
    powers = 1 << np.arange(size.bit_length())
    # Arrays, block by block: in a segment of short sentences every position may be a cut.
    index = np.full(int(at[-1]) - origin + 1, -1, dtype=np.int32)
    index[at - origin] = np.arange(n, dtype=np.int32)
    cost, back = array("q", bytes(8 * n)), array("i", bytes(4 * n))
    queue: deque[tuple[int, int, int]] = deque([(origin, 0, origin)])  # (cost + position, index, position), ascending
    for first in range(1, n, CUT_BLOCK):
        block = slice(first, first + CUT_BLOCK)
        # Cuts a power of two before each one of the block, end to end.
        before = at[block, None] - origin - powers
        near = np.where(before < 0, -1, index[np.maximum(before, 0)])
        upto = np.cumsum((near >= 0).sum(axis=1)).tolist()
        near = near[near >= 0].tolist()
        k = 0
        for j, (here, penalty, end) in enumerate(zip(at[block].tolist(), penalties[block].tolist(), upto), first):
            low = here - size
            while queue[0][2] < low:
                queue.popleft()
            value, start, _ = queue[0]
            best = value + size - here
            while k < end:
                i = near[k]
                k += 1
                if cost[i] < best or cost[i] == best and i < start:
                    best, start = cost[i], i
            best += penalty
            cost[j], back[j] = best, start
            value = best + here
            while queue and queue[-1][0] > value:
                queue.pop()
            queue.append((value, j, here))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return at[cuts[::-1]].tolist()


def _pack_segment(docs, sizes, ids, ends, size, long_sentence):
    """Columns of the pieces of one segment: doc number, start, length, crc, sequence, offset."""
    import numpy as np

    doc_ends = np.cumsum(sizes)
    at, penalties = cut_points(doc_ends, ends[ids], long_sentence)
    cuts = np.array(best_cuts(at, penalties, size))
    edges = np.union1d(cuts, doc_ends)
    begin, stop = np.r_[0, edges[edges > 0]][:-1], edges[edges > 0]
    doc = np.searchsorted(doc_ends, begin, side="right")
    sequence = np.searchsorted(cuts, begin, side="right") - 1
    data = memoryview(ids.astype("<u4").tobytes())
    crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist())]
    return doc, begin - (doc_ends - sizes)[doc], stop - begin, crcs, sequence, begin - cuts[sequence], len(cuts) - 1


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
    size: int = SEQUENCE, long_sentence: int = LONG_SENTENCE, parts: int | None = None,
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents go in ascending doc_id (nulls first; rows of equal id by their text, repeated rows
    each on their own); a null or empty text is the end id alone. Sequence ids ascend with the
    stream, without gaps. Parts of the stream, and segments of about SEGMENT ids inside them, are
    packed on their own, so a task holds one segment. No rows give no pieces. Other columns are not
    read.
    """
    spark = docs.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ordered = in_order(rows, ["doc_id", "tie"], parts).select("doc_id", "text", "part")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder, ends = library_encoder(path), sentence_ends(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        sequences = 0

        def flush(part):
            nonlocal sequences
            sizes = np.array([len(x) for x in found], dtype=np.int64) // encoder.dtype.itemsize
            ids = np.frombuffer(b"".join(found), encoder.dtype)
            doc, start, length, crcs, sequence, offset, n = _pack_segment(
                names, sizes, ids, ends, size, long_sentence
            )
            known = pa.array(names, pa.int64()).take(pa.array(doc))
            # The number of sequences stands in one row of the segment.
            made = np.zeros(len(doc), dtype=np.int64)
            made[0] = n
            arrays = [
                known, pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                pa.array(sizes[doc]), pa.array(np.full(len(doc), part, np.int32)),
                pa.array(sequence + sequences), pa.array(offset), pa.array(made),
            ]
            sequences += n
            return pa.RecordBatch.from_arrays(
                arrays,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "sequence",
                 "offset", "sequences"],
            )

        names, found, held, part = [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            for rows in text_runs(batch):
                coded = encoder.encode_many(rows.column("text").to_pylist())
                for name, ids in zip(rows.column("doc_id").to_pylist(), coded):
                    names.append(name)
                    found.append(ids + end)
                    held += len(found[-1]) // encoder.dtype.itemsize
                    if held >= SEGMENT:
                        yield flush(part)
                        names, found, held = [], [], 0
        if names:
            yield flush(part)

    packed = stage(ordered.mapInArrow(run, PIECES), "packed")
    # One row per part.
    first = totals_before(packed, "part", F.col("sequences"), "_first")
    return packed.join(F.broadcast(first), "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.col("_first")).alias("sequence_id"), "offset",
    )
