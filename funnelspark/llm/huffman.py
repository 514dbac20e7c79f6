"""Token-id files in canonical length-limited Huffman code.

Ids are counted over the whole corpus, code lengths come from package-merge, and codes are given
out in order of (length, id), so a file needs only the lengths. Documents are taken in
ascending order of doc_id and coded in blocks, each from a whole byte on. Every ``STEP`` ids the bit offset is noted, and
decoding starts at all these checkpoints at once: one table lookup per id and checkpoint.
"""

from __future__ import annotations

import functools
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staging_path
from .ranges import in_order, totals_before
from .tokens import library_encoder, read_vocabulary, text_runs

MAX_BITS = 18
STEP = 512
BLOCK_IDS = 1 << 18
# Blocks of about so many ids are decoded together.
GROUP_IDS = 1 << 20

TOKENS = (
    "part int, block int, doc_ids array<bigint>, n_tokens array<bigint>, before bigint, ids binary"
)
BLOCKS = (
    "part int, block int, doc_ids array<bigint>, n_tokens array<bigint>, before bigint, "
    "payload binary, offsets array<bigint>"
)


def code_lengths(counts, max_bits: int = MAX_BITS):
    """Bits per id (0: no code) of the shortest prefix code with at most ``max_bits`` bits.

    Package-merge by levels: the smallest items of a level, packed in pairs, join the next one.
    """
    import numpy as np

    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n == 0:
        return lengths
    if n == 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit into {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order]
    weights, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        sort = np.argsort(both, kind="stable")
        weights = both[sort]
        is_leaf.append(sort < n)
    take = 2 * n - 2
    for level in reversed(is_leaf):
        chosen = int(level[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths):
    """Code of each id: ascending in order of (length, id)."""
    import numpy as np

    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, bits = 0, 0
    for i in order.tolist():
        length = int(lengths[i])
        code <<= length - bits
        bits = length
        codes[i] = code
        code += 1
    return codes


@functools.lru_cache(maxsize=4)
def decode_table(lengths: bytes):
    """(bits, for each value of the next bits: 32 * id + length of the code they start with)."""
    import numpy as np

    lengths = np.frombuffer(lengths, dtype=np.uint8)
    bits = int(lengths.max()) if len(lengths) else 0
    if not bits:
        return 0, np.ones(1, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    entries = np.ones(1 << bits, np.int64)
    filled = int(spans.sum())
    entries[:filled] = np.repeat(32 * order + lengths[order], spans)
    return bits, entries


def _every(sizes, step: int):
    """Positions of every ``step``-th id of each document, for documents laid end to end."""
    import numpy as np

    runs = -(-sizes // step)
    first = np.cumsum(sizes) - sizes
    nth = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    return np.repeat(first, runs) + step * nth


def encode_ids(ids, sizes, codes, lengths, step: int = STEP):
    """(payload, offsets) of consecutive documents with ``sizes`` ids each.

    A document starts at a whole byte. Offsets are the bits before every ``step``-th id of a document.
    """
    import numpy as np

    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    bits = lengths[ids]
    upto = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum(bits, out=upto[1:])
    last = np.cumsum(sizes)
    first = last - sizes
    room = (upto[last] - upto[first] + 7) // 8 * 8
    shift = np.cumsum(room) - room - upto[first]
    starts = upto[:-1]
    starts += np.repeat(shift, sizes)
    total = int(room.sum())
    # Codes from the highest bit of a word on, moved to their place in it.
    code = (codes << (64 - lengths.astype(np.uint64)))[ids]
    word, at = starts >> 6, (starts & 63).astype(np.uint8)
    out = np.zeros(total // 64 + 2, dtype=np.uint64)
    turn = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[turn]] = np.bitwise_or.reduceat(code >> at, turn)
    # At most one code reaches over the end of a word.
    over = np.flatnonzero(at + bits > 64)
    out[word[over] + 1] |= code[over] << (64 - at[over])
    return out.astype(">u8").tobytes()[: total // 8], starts[_every(sizes, step)]


def decode_ids(payload: bytes, offsets, sizes, lengths: bytes, step: int = STEP):
    """Ids of consecutive documents: ``sizes`` ids each, ``offsets`` their checkpoints in bits.

    All checkpoints advance together, one id per step.
    """
    import numpy as np

    sizes = np.asarray(sizes, dtype=np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint32)
    bits, entries = decode_table(lengths)
    where = _every(sizes, step)
    counts = np.diff(where, append=total)
    order = np.argsort(-counts, kind="stable")
    pos = np.asarray(offsets, dtype=np.int64)[order]
    into, left = where[order], counts[order]
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8).astype(np.uint32)
    # Four bytes from each byte on, so one read gets the next bits.
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    out = np.empty(total, dtype=np.uint32)
    mask, spare = (1 << bits) - 1, 32 - bits
    # So many checkpoints have an i-th id.
    active = np.searchsorted(-left, -np.arange(int(left[0])), side="left").tolist()
    for i, n in enumerate(active):
        p = pos[:n]
        code = ahead.take(p >> 3).astype(np.int64)
        code >>= spare - (p & 7)
        code &= mask
        entry = entries.take(code)
        out[into[:n] + i] = entry >> 5
        p += entry & 31
    return out


def token_blocks(
    docs: DataFrame, path: str, end_id: int, doc_id: str, text: str, parts: int
) -> DataFrame:
    """Rows of TOKENS: blocks of about BLOCK_IDS ids in ascending order of doc_id.

    Each document's ids end with ``end_id``; ``before`` counts the ids of its part before a block.
    """
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    ordered = in_order(rows, ["doc_id", "tie"], parts).select("doc_id", "text", "part")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = library_encoder(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        block, before, part = 0, 0, 0
        names, found, held = [], [], 0

        def flush():
            sizes = [len(x) // encoder.dtype.itemsize for x in found]
            row = [[part], [block], [names], [sizes], [before], [b"".join(found)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, kinds)],
                ["part", "block", "doc_ids", "n_tokens", "before", "ids"],
            )

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
                    if held >= BLOCK_IDS:
                        yield flush()
                        block, before = block + 1, before + held
                        names, found, held = [], [], 0
        if names:
            yield flush()

    return ordered.mapInArrow(run, TOKENS)


def id_counts(tokens: DataFrame, dtype: str, n_ids: int):
    """Occurrences of each id below ``n_ids`` over the whole corpus; tasks add up their own first."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(n_ids, dtype=np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), dtype), minlength=n_ids)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    per = tokens.select("ids").mapInArrow(run, "id bigint, n bigint")
    total = np.zeros(n_ids, dtype=np.int64)
    for row in per.groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row per id at most
        total[row["id"]] = row["n"]
    return total


def _coded(tokens: DataFrame, dtype: str, lengths: bytes) -> DataFrame:
    """Rows of BLOCKS from rows of TOKENS."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(lengths, np.uint8)
        codes = canonical_codes(bits)
        for batch in batches:
            payloads, offsets = [], []
            for ids, sizes in zip(batch.column("ids"), batch.column("n_tokens")):
                ids = np.frombuffer(ids.as_buffer(), dtype)
                payload, at = encode_ids(ids, sizes.values.to_numpy(), codes, bits)
                payloads.append(payload)
                offsets.append(at.astype(np.int64))
            kept = [batch.column(c) for c in ("part", "block", "doc_ids", "n_tokens", "before")]
            made = [pa.array(payloads, pa.binary()), pa.array(offsets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*kept, *made],
                ["part", "block", "doc_ids", "n_tokens", "before", "payload", "offsets"],
            )

    return tokens.mapInArrow(run, BLOCKS)


def write_ids(
    docs: DataFrame, path: str, out: str, end_id: int = 0, doc_id: str = "doc_id",
    text: str = "text", parts: int | None = None,
) -> None:
    """Encode every text and write ids to ``out``: ``blocks`` in ascending doc_id, ``lengths``.

    Null and empty texts have the end id alone. Null ids come first, rows of equal id stay
    repeated and go by a hash of their texts. No rows give an empty file. Other columns are not read.
    """
    import numpy as np

    spark = docs.sparkSession
    encoder = library_encoder(path)
    dtype = encoder.dtype.str
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = token_blocks(docs, path, end_id, doc_id, text, parts)
    held = staging_path(spark, "tokens")
    blocks.write.option("compression", "zstd").parquet(held)
    tokens = spark.read.schema(blocks.schema).parquet(held)
    # One code length per possible id: the vocabulary bounds what reaches the driver.
    said = read_vocabulary(path)
    n_ids = 1 + max(end_id, *said["model"]["vocab"].values(), *[t["id"] for t in said["added_tokens"]])
    lengths = code_lengths(id_counts(tokens, dtype, n_ids)).tobytes()
    # The code is dense; compressing it again would only take time.
    # Files, and blocks in them, ascend as their documents do, in whatever order the ids were read back.
    # A part goes to the task of its number.
    coded = _coded(tokens, dtype, lengths).repartitionById(parts, "part").sortWithinPartitions("part", "block")
    coded.write.option("compression", "none").parquet(f"{out}/blocks")
    used = np.frombuffer(lengths, np.uint8)
    known = [(int(i), int(used[i])) for i in np.flatnonzero(used)]
    spark.createDataFrame(known, "id bigint, bits int").coalesce(1).write.parquet(f"{out}/lengths")


def read_lengths(spark: SparkSession, out: str) -> bytes:
    """Code lengths of a file, by id; the vocabulary bounds their number."""
    import numpy as np

    rows = spark.read.parquet(f"{out}/lengths").collect()
    lengths = np.zeros(max([r["id"] + 1 for r in rows], default=0), np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return lengths.tobytes()


def _located(spark: SparkSession, out: str) -> DataFrame:
    """Blocks with ``start``: ids of all blocks before them."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    sizes = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    # One row per part.
    first = totals_before(sizes, "part", F.col("n"), "_first")
    return blocks.join(F.broadcast(first), "part").withColumn("start", F.col("before") + F.col("_first"))


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a file; start counts the ids before it."""
    lengths = read_lengths(spark, out)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for ids_of, start, doc_ids, sizes in _decoded(batches, lengths):
            arrays = [
                doc_ids,
                pa.array(start),
                pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids_of, pa.int64())
                ),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "ids"])

    return _located(spark, out).mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def _decoded(batches, lengths: bytes, group: int = GROUP_IDS):
    """(ids, start of each document, doc_ids, sizes) of about ``group`` ids of consecutive blocks."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        doc_ids, sizes, offsets = (batch.column(c) for c in ("doc_ids", "n_tokens", "offsets"))
        docs, marks = (np.cumsum(x.value_lengths().to_numpy(), dtype=np.int64) for x in (sizes, offsets))
        doc_ids, sizes, offsets = doc_ids.flatten(), sizes.flatten().to_numpy(), offsets.flatten().to_numpy()
        payloads = [x.as_buffer() for x in batch.column("payload")]
        upto = np.cumsum(sizes)
        # Ids at the end of each block, and what the ids before its documents are short of its start.
        ends = upto[docs - 1]
        ahead = np.repeat(batch.column("start").to_numpy() - np.r_[0, ends[:-1]], np.diff(docs, prepend=0))
        bits = np.cumsum([0] + [8 * x.size for x in payloads])
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + group, side="right")))
            d = slice(docs[i - 1] if i else 0, docs[j - 1])
            m = slice(marks[i - 1] if i else 0, marks[j - 1])
            shift = np.repeat(bits[i:j] - bits[i], np.diff(marks, prepend=0)[i:j])
            ids = decode_ids(b"".join(payloads[i:j]), offsets[m] + shift, sizes[d], lengths)
            yield ids, (ahead + upto - sizes)[d], doc_ids[d], sizes[d]
            i = j


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file, from its decoded ids."""
    lengths = read_lengths(spark, out)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for ids, start, doc_ids, sizes in _decoded(batches, lengths):
            data = memoryview(ids.astype("<u4").tobytes())
            ends = (4 * np.cumsum(sizes)).tolist()
            crcs = [zlib.crc32(data[b - 4 * n : b]) for b, n in zip(ends, sizes.tolist())]
            arrays = [doc_ids, pa.array(start), pa.array(sizes), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return _located(spark, out).mapInArrow(run, schema)


def new_file(spark: SparkSession) -> str:
    """A path for one file in the shared folder."""
    return staging_path(spark, "ids")
