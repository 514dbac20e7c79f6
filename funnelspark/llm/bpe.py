"""BPE by a tokenization automaton.

The automaton reads token ids and accepts exactly the id sequences that BPE merging produces. It is
compiled merge by merge. At first one state has an arc for every byte. A merge of u and v gives
the state that u leads to a copy without the arc v, to which u leads from then on, and gives every
state with an arc u an arc uv. States keep the arcs taken away and the time it happened;
whether an arc is there follows from its token's own merges.

A pre-split word is encoded in one pass: from each position, in the state reached there, the arcs
whose labels match the coming bytes are taken. Every prefix has one accepted path, so each position is
reached once. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import PieceEncoder, byte_of_symbol, id_type, library_splitter, read_vocabulary, text_runs

NEVER = 1 << 40


class MergeAutomaton:
    """Deterministic automaton over token ids, compiled from merges in order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """``labels``: bytes of each id; ``merges``: (left, right, product) in order of rank."""
        self.labels = labels
        self._made = {}  # product -> (time, left)
        # A state: arcs taken away with their time, the state it is a copy of, the time of the copy.
        self._gone: list[dict[int, int]] = [{}]
        self._copy_of = [0]
        self._copied = [-1]
        self.after = {t: 0 for t, b in labels.items() if len(b) == 1}
        # Tokens that lead to each state; the first is also where every word begins.
        owners = [len(self.after) + 1]
        for time, (u, v, uv) in enumerate(merges):
            if u not in self.after or v not in self.after:
                continue
            state = self.after[u]
            if not self._has(state, v, time):
                continue
            self._made[uv] = (time, u)
            # uv leads where v led from the state that u led to. If u is v, it is that state.
            self.after[uv] = self.after[v]
            owners[self.after[v]] += 1
            if owners[state] > 1:
                owners[state] -= 1
                owners.append(1)
                self._gone.append({v: time})
                self._copy_of.append(state)
                self._copied.append(time)
                self.after[u] = len(owners) - 1
            else:
                self._gone[state][v] = time
        # Transition tables: per state the tokens seen so far and whether there is an arc; per node
        # of the label tree the next nodes by byte, and the token that ends there under -1.
        self._arcs: list[dict[int, bool]] = [{} for _ in owners]
        self._tree: dict = {}
        self._longest = max(map(len, labels.values()), default=0)
        for token in self.after:
            node = self._tree
            for byte in labels[token]:
                node = node.setdefault(byte, {})
            node[-1] = token

    def _taken(self, state: int, token: int) -> int:
        """Time when the arc was taken away, or NEVER."""
        until = NEVER
        while True:
            time = self._gone[state].get(token)
            if time is not None and time < until:
                return time
            if state == 0:
                return NEVER
            until = min(until, self._copied[state])
            state = self._copy_of[state]

    def _has(self, state: int, token: int, time: int) -> bool:
        """Whether the arc is there just before ``time``."""
        if self._taken(state, token) < time:
            return False
        while token in self._made:
            made, left = self._made[token]
            if self._taken(state, left) <= made:
                return False
            token = left
        return True

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        n = len(word)
        # The arc that reaches each position, and the state it leads to.
        states, tokens = [None] * (n + 1), [0] * (n + 1)
        states[0] = 0
        tree, arcs, after = self._tree, self._arcs, self.after
        for i in range(n):
            state, node, j = states[i], tree, i
            known = arcs[state]
            for byte in word[i : i + self._longest]:
                node = node.get(byte)
                if node is None:
                    break
                j += 1
                if states[j] is None and -1 in node:
                    token = node[-1]
                    found = known.get(token)
                    if found is None:
                        found = known[token] = self._has(state, token, NEVER)
                    if found:
                        states[j], tokens[j] = after[token], token
        ids, at, labels = [], n, self.labels
        while at:
            ids.append(tokens[at])
            at -= len(labels[tokens[at]])
        ids.reverse()
        return ids


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> tuple[MergeAutomaton, PieceEncoder, dict[int, bytes]]:
    """Automaton, text encoder and labels of all ids; compiled once per worker and file."""
    import numpy as np

    said = read_vocabulary(path)
    vocab, byte = said["model"]["vocab"], byte_of_symbol()
    labels = {i: bytes(map(byte.__getitem__, s)) for s, i in vocab.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
    merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    automaton = MergeAutomaton(labels, merges)
    dtype = id_type(said)

    def encode_words(words: list[str]) -> list[bytes]:
        return [np.array(automaton.encode(w.encode()), dtype).tobytes() for w in words]

    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    encoder = PieceEncoder(encode_words, library_splitter(path), special, dtype)
    return automaton, encoder, labels | {i: s.encode() for s, i in special.items()}


def encode_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids) of every row, as the tokenizers library encodes without special tokens added.

    A null or empty text has no ids. Repeated rows are encoded each. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = compiled(path)[1]
        for batch in (b for whole in batches for b in text_runs(whole)):
            ids = [
                np.frombuffer(b, encoder.dtype).astype("i4")
                for b in encoder.encode_many(batch.column("text").to_pylist())
            ]
            column = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are not UTF-8 become U+FFFD. Null ids: empty."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        label = compiled(path)[2].__getitem__
        for batch in batches:
            texts = [
                b"".join(map(label, ids or [])).decode("utf-8", "replace")
                for ids in batch.column("ids").to_pylist()
            ]
            columns = [batch.column("doc_id"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded in one task.

    The same work as ``decode_documents`` of ``encode_documents`` without moving ids between
    processes: digests of the decimal ids joined by commas and of the decoded text.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches):
        import numpy as np
        import pyarrow as pa

        _, encoder, labels = compiled(path)
        label = labels.__getitem__
        decimal = {i: str(i) for i in labels}.__getitem__
        for batch in (b for whole in batches for b in text_runs(whole)):
            sizes, said, back = [], [], []
            for coded in encoder.encode_many(batch.column("text").to_pylist()):
                ids = np.frombuffer(coded, encoder.dtype).tolist()
                sizes.append(len(ids))
                said.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded = b"".join(map(label, ids)).decode("utf-8", "replace")
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(said), pa.array(back)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
