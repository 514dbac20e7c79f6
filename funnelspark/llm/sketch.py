"""Count-min sketches of a corpus whose width follows the corpus.

Documents are dealt into chunks, one task each. A chunk's sketch is kept sparse: for every row
of the sketch the sorted counters it touches, cut into buckets. Buckets of all chunks are merged by adding counters, and every
chunk gets back the merged values of the counters it asked for, in its own order. So no task, and not
the driver, ever holds the whole sketch, and a count is never too small.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import mix

# Text per chunk, and counters per row of a bucket: at most, and, to use all tasks, at least.
CHUNK_BYTES = (16 << 20, 1 << 19)
BUCKET_COUNTERS = (1 << 21, 1 << 16)
MOST = 255

BLOCKS = "chunk int, line int, bucket int, counters binary, counts binary"
ANSWERS = "chunk int, line int, bucket int, counts binary"


@dataclass(frozen=True)
class Layout:
    """Shape of a sketch: rows, counters per row (2**bits), buckets per row (2**cut), chunks."""

    rows: int
    bits: int
    cut: int
    chunks: int


def layout(docs: DataFrame, text: str, rows: int, per_window: int) -> Layout:
    """Sketch with at least ``per_window`` counters per row and word of the corpus.

    Reads the sizes of all texts once. The figures change how well the sketch tells counts apart
    and how the work is cut, never a result.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    tasks = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = max(1, size // 5)

    def pieces(amount: int, most: int, least: int) -> int:
        # Four groups per task even out what a hash deals; small ones would only make many blocks.
        return max(1, -(-amount // most), min(4 * tasks, amount // least))

    chunks, buckets = pieces(size, *CHUNK_BYTES), pieces(words, *BUCKET_COUNTERS)
    bits = max(16, (per_window * words - 1).bit_length())
    return Layout(rows, bits, min(bits, (buckets - 1).bit_length()), chunks)


def _counters(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Counter of each hash in a row of the sketch."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (row + 1)) & (1 << 64) - 1)
    return mix(hashes ^ seed) >> np.uint64(64 - bits)


def _packed(ascending: np.ndarray) -> bytes:
    """Steps between ascending numbers, in the smallest type that holds them."""
    steps = np.diff(ascending, prepend=ascending[:1] * 0)
    top = int(steps.max())
    kind = "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    return kind[-1].encode() + steps.astype(kind).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, dtype=f"<u{packed[:1].decode()}", offset=1)
    return np.cumsum(steps, dtype=np.uint64)


def requests(chunk: int, hashes: np.ndarray, counts: np.ndarray, shape: Layout):
    """Arrow batch of a chunk's sketch. ``hashes`` are distinct; ``counts`` how often each occurs."""
    import pyarrow as pa

    out = {"line": [], "bucket": [], "counters": [], "counts": []}
    low = np.uint64(shape.bits - shape.cut)
    for row in range(shape.rows if len(hashes) else 0):
        counter, inverse = np.unique(_counters(hashes, row, shape.bits), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(counter))
        total = np.minimum(total, MOST).astype(np.uint8)
        bucket = (counter >> low).astype(np.int64)
        rest = counter & ((np.uint64(1) << low) - np.uint64(1))
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            out["line"].append(row)
            out["bucket"].append(int(bucket[a]))
            out["counters"].append(_packed(rest[a:b]))
            out["counts"].append(total[a:b].tobytes())
    n = len(out["line"])
    arrays = [
        pa.array(np.full(n, chunk), pa.int32()),
        pa.array(out["line"], pa.int32()),
        pa.array(out["bucket"], pa.int32()),
        pa.array(out["counters"], pa.binary()),
        pa.array(out["counts"], pa.binary()),
    ]
    return pa.Table.from_arrays(arrays, ["chunk", "line", "bucket", "counters", "counts"])


def merged(blocks: DataFrame) -> DataFrame:
    """Answers to every block: the sums over all chunks of the counters it names, at most MOST."""

    def add(table):
        import pyarrow as pa

        counters = [_unpacked(x) for x in table.column("counters").to_pylist()]
        sizes = [len(c) for c in counters]
        own = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8)
        _, inverse = np.unique(np.concatenate(counters), return_inverse=True)
        total = np.bincount(inverse, weights=own)
        total = np.minimum(total, MOST).astype(np.uint8)[inverse]
        ends = np.cumsum(sizes).tolist()
        parts = [total[b - n : b].tobytes() for b, n in zip(ends, sizes)]
        kept = [table.column(c) for c in ("chunk", "line", "bucket")]
        return pa.Table.from_arrays(
            [*kept, pa.array(parts, pa.binary())], ["chunk", "line", "bucket", "counts"]
        )

    return blocks.groupBy("line", "bucket").applyInArrow(add, ANSWERS)


def estimates(hashes: np.ndarray, answers: list[dict], shape: Layout) -> np.ndarray:
    """Estimated count of each hash of a chunk over the corpus: at least the count, at most MOST."""
    found = np.full(len(hashes), MOST, dtype=np.uint8)
    parts = sorted(answers, key=lambda a: (a["line"], a["bucket"]))
    for row in range(shape.rows if len(hashes) else 0):
        _, inverse = np.unique(_counters(hashes, row, shape.bits), return_inverse=True)
        counts = b"".join(a["counts"] for a in parts if a["line"] == row)
        found = np.minimum(found, np.frombuffer(counts, np.uint8)[inverse])
    return found
