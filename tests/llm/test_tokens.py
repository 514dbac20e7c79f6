import hashlib
import random
import zlib

import numpy as np
import plain
import pytest

pytest.importorskip("public_tokenizers")
from funnelspark.llm import bpe, huffman, packing, tokens  # noqa: E402
from funnelspark.llm.q_tokens import vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    r = random.Random(3)
    signs = "ab cd'\n \t.,1é½日<|>stremvl\x1c \xa0"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(chr(r.randint(1, 0x2FF)) for _ in range(r.randint(1, 30))) for _ in range(500)]
    texts += [t for _, t in plain.HARD if t] + ["it's 'so' don't'll 's've x're", "a" * 3000, "<|endoftext|>" * 2]
    return texts


@pytest.mark.parametrize("kind", ["automaton", "library"])
def test_encoders_equal_the_library(library, kind):
    path = vocabulary()
    encoder = bpe.compiled(path)[1] if kind == "automaton" else tokens.library_encoder(path)
    texts = odd_texts()
    for text, ids in zip(texts, encoder.encode_many(texts)):
        assert np.frombuffer(ids, encoder.dtype).tolist() == library(text), repr(text)


def test_a_full_table_starts_anew(library):
    path = vocabulary()
    small = tokens.PieceEncoder(
        tokens.library_encoder(path)._words, tokens.library_splitter(path), {}, "<u2", limit=10
    )
    for text in ["one two three " * 9, "four five, six seven eight nine ten " * 3] * 3:
        assert np.frombuffer(small.encode(text), "<u2").tolist() == library(text)


def merge_by_rank(word, ranks):
    """Pairs of least rank first, from the left."""
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_equals_merging_on_small_vocabularies():
    r = random.Random(5)
    for _ in range(60):
        known, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            u, v = r.choice(known), r.choice(known)
            if u + v not in known:
                known.append(u + v)
                merges.append((u, v))
        number = {s: i for i, s in enumerate(known)}
        automaton = bpe.MergeAutomaton(
            {i: s.encode() for s, i in number.items()},
            [(number[u], number[v], number[u + v]) for u, v in merges],
        )
        ranks = {pair: i for i, pair in enumerate(merges)}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(0, 14)))
            assert [known[i] for i in automaton.encode(word.encode())] == merge_by_rank(word, ranks)


def test_documents_round_trip(spark, library):
    docs = plain.documents(spark)
    coded = bpe.encode_documents(docs, vocabulary())
    got = sorted((r["doc_id"], list(r["ids"])) for r in coded.collect())
    assert got == sorted((i, library(t)) for i, t in plain.HARD)
    back = sorted((r["doc_id"], r["text"]) for r in bpe.decode_documents(coded, vocabulary()).collect())
    assert back == sorted((i, t or "") for i, t in plain.HARD)
    for r in bpe.round_trip(docs, vocabulary()).collect():
        texts = [t or "" for i, t in plain.HARD if i == r["doc_id"]]
        ids = library(texts[0])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[0].encode()).hexdigest()
    assert bpe.round_trip(plain.documents(spark, []), vocabulary()).count() == 0


def test_code_lengths_are_shortest_within_the_limit():
    import heapq

    r = np.random.default_rng(1)
    counts = r.integers(0, 2000, 300) ** 2
    free = huffman.code_lengths(counts, 30)
    heap = [(int(c), i) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost, n = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        n += 1
        heapq.heappush(heap, (a[0] + b[0], 300 + n))
    assert int((free * counts).sum()) == cost
    tight = huffman.code_lengths(2 ** np.arange(20), 6)
    assert tight.max() <= 6 and (0.5 ** tight[tight > 0].astype(float)).sum() <= 1
    assert huffman.code_lengths(np.zeros(4)).sum() == 0
    assert huffman.code_lengths([0, 9, 0]).tolist() == [0, 1, 0]


def test_coding_round_trip():
    r = np.random.default_rng(2)
    for n_ids in (1, 2, 500):
        sizes = np.array([0, 1, 511, 512, 513, 0, 2000, 7])
        ids = (r.random(int(sizes.sum())) ** 4 * n_ids).astype(np.uint16)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=n_ids))
        payload, offsets = huffman.encode_ids(ids, sizes, huffman.canonical_codes(lengths), lengths)
        assert huffman.decode_ids(payload, offsets, sizes, lengths.tobytes()).tolist() == ids.tolist()


def test_token_files(spark, library, tmp_path):
    docs = plain.documents(spark)
    huffman.write_ids(docs, vocabulary(), str(tmp_path / "f"), parts=3)
    rows = sorted(huffman.read_ids(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(i for i, _ in plain.HARD)
    start = 0
    for r in rows:
        assert r["start"] == start
        assert list(r["ids"]) in [library(t) + [0] for i, t in plain.HARD if i == r["doc_id"]]
        start += len(r["ids"])
    for r in huffman.read_digests(spark, str(tmp_path / "f")).collect():
        ids = [x["ids"] for x in rows if x["start"] == r["start"]][0]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    huffman.write_ids(plain.documents(spark, []), vocabulary(), str(tmp_path / "none"))
    assert huffman.read_digests(spark, str(tmp_path / "none")).count() == 0


def cheapest(at, penalties, size):
    """Least cost by trying every earlier cut."""
    cost = [0]
    for j in range(1, len(at)):
        cost.append(min(
            cost[i] + (0 if (n := at[j] - at[i]) & (n - 1) == 0 else size - n)
            for i in range(j) if at[j] - at[i] <= size
        ) + penalties[j])
    return cost[-1]


def test_cuts_are_the_cheapest():
    r = np.random.default_rng(4)
    for size in (8, 16, 64):
        for _ in range(40):
            at = np.concatenate([[0], np.cumsum(r.integers(1, size + 1, 40))])
            penalties = np.concatenate([[0], r.integers(0, 12, 40)])
            cuts = packing.best_cuts(at, penalties, size)
            known = dict(zip(at.tolist(), penalties.tolist()))
            cost = 0
            for a, b in zip(cuts, cuts[1:]):
                assert 0 < b - a <= size
                cost += known[b] + (0 if (b - a) & (b - a - 1) == 0 else size - (b - a))
            assert cost == cheapest(at.tolist(), penalties.tolist(), size)


def test_packing_holds_every_id_once_in_order(spark, library):
    rows = packing.pack_documents(plain.documents(spark), vocabulary(), size=64, long_sentence=16, parts=3).collect()
    rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert {r["sequence_id"] for r in rows} == set(range(rows[-1]["sequence_id"] + 1))
    upto = {}
    for r in rows:
        assert r["offset"] == upto.get(r["sequence_id"], 0)
        upto[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(upto.values()) <= 64
    total = sum(len(library(t)) + 1 for _, t in plain.HARD)
    assert sum(r["length"] for r in rows) == total
    for i, text in plain.HARD:
        ids = np.array(library(text) + [0], "<u4")
        for r in rows:
            if r["doc_id"] == i:
                part = ids[r["start"] : r["start"] + r["length"]]
                assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    assert packing.pack_documents(plain.documents(spark, []), vocabulary()).count() == 0


def thue_morse(size):
    """Two words of letters a and b that any polynomial hash modulo 2**64 confuses, if they are long."""
    bits = [bin(k).count("1") % 2 for k in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("kind", ["automaton", "library"])
def test_words_that_polynomials_confuse(library, kind):
    path = vocabulary()
    encoder = bpe.compiled(path)[1] if kind == "automaton" else tokens.library_encoder(path)
    one, two = thue_morse(1024)
    three, four = thue_morse(2048)
    texts = [one, two, three, four, f"{one} {two} {four}{three}", f"{two} {one}"]
    for text, ids in zip(texts, encoder.encode_many(texts)):
        assert np.frombuffer(ids, encoder.dtype).tolist() == library(text)


def test_words_are_compared_when_hashes_are_equal(library, monkeypatch):
    path = vocabulary()
    real = tokens.word_hashes
    # Four bits of hash: nearly all words share theirs with others.
    monkeypatch.setattr(tokens, "word_hashes", lambda *a: real(*a) << np.uint64(60))
    encoder = tokens.PieceEncoder(tokens.library_encoder(path)._words, tokens.library_splitter(path), {}, "<u2")
    texts = ["one two three four", "five six", "", "one two", "seven eight nine ten eleven twelve", "six", "a b c d e f g h"] * 2
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode_many(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == library(text)


def test_token_files_ascend(spark, tmp_path):
    docs = spark.range(0, 3000).selectExpr("(id * 7919) % 3000 AS doc_id", "repeat(concat('word ', id, ' '), 150) AS text")
    huffman.write_ids(docs, vocabulary(), str(tmp_path / "f"), parts=5)
    ids = []
    for part in sorted((tmp_path / "f" / "blocks").glob("part-*.parquet")):
        for row in spark.read.parquet(str(part)).select("doc_ids").toLocalIterator():
            ids += row["doc_ids"]
    assert ids == list(range(3000))


def test_new_words_cost_the_model_only(library):
    import time

    from tokenizers import Tokenizer

    path = vocabulary()
    r = random.Random(5)
    words = sorted({" " + "".join(r.choice("etaoinshrdlué") for _ in range(r.randint(3, 12))) for _ in range(30_000)})
    encode = tokens.library_encoder(path)._words
    whole = Tokenizer.from_file(path)

    def seconds(f, part):
        start = time.process_time()
        f(part)
        return time.process_time() - start

    # Words are new to both, as they are to a worker; the least of three thirds counts.
    parts = [words[k::3] for k in range(3)]
    own = min(seconds(encode, p) for p in parts)
    library_s = min(seconds(lambda p: whole.encode_batch_fast(p, add_special_tokens=False), p) for p in parts)
    assert own < 0.8 * library_s, (own, library_s)
    for word, ids in zip(words[::50], encode(words[::50])):
        assert np.frombuffer(ids, "<u2").tolist() == library(word)


def test_words_of_many_bytes_are_compared_when_hashes_are_equal(library, monkeypatch):
    path = vocabulary()
    real = tokens.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda *a: real(*a) << np.uint64(62))
    encoder = tokens.library_encoder.__wrapped__(path)
    texts = ["é", "e", "éé abcdefgh", "abcdefghé", "abcdefgh", "abcdefghi ſßđ", "Ãâ", "ã", "日本 é", "\x00", "a\x00", "a"] * 2
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode_many(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == library(text), repr(text)


def test_blocks_are_decoded_together():
    import pyarrow as pa

    r = np.random.default_rng(6)
    blocks, start = [], 0
    for n in (1, 3, 700, 2, 40):
        sizes = r.integers(1, 1200, n)
        blocks.append((start, (r.random(int(sizes.sum())) ** 3 * 300).astype("<u2"), sizes))
        start += int(sizes.sum())
    lengths = huffman.code_lengths(np.bincount(np.concatenate([ids for _, ids, _ in blocks]), minlength=300))
    coded = [huffman.encode_ids(ids, sizes, huffman.canonical_codes(lengths), lengths) for _, ids, sizes in blocks]
    names = [[None if k % 7 == 0 else k for k in range(len(sizes))] for _, _, sizes in blocks]
    batch = pa.RecordBatch.from_pydict({
        "doc_ids": pa.array(names, pa.list_(pa.int64())),
        "n_tokens": pa.array([x.tolist() for _, _, x in blocks], pa.list_(pa.int64())),
        "start": pa.array([s for s, _, _ in blocks], pa.int64()),
        "payload": pa.array([p for p, _ in coded], pa.binary()),
        "offsets": pa.array([o.tolist() for _, o in coded], pa.list_(pa.int64())),
    })
    expected = np.concatenate([ids for _, ids, _ in blocks])
    for group in (1, 1500, 1 << 20):
        for cut in (batch, batch.slice(1), batch.slice(0, 2)):
            done = list(huffman._decoded([batch.slice(0, 0), cut], lengths.tobytes(), group))
            ids, starts, sizes = (np.concatenate([d[k] for d in done]) for k in (0, 1, 3))
            first = int(starts[0])
            assert ids.tolist() == expected[first : first + len(ids)].tolist() and len(ids) == sizes.sum()
            assert (starts == first + np.cumsum(sizes) - sizes).all()
            assert [x for d in done for x in d[2].to_pylist()] == sum(cut.column("doc_ids").to_pylist(), [])
            assert len(ids) == sum(sum(x) for x in cut.column("n_tokens").to_pylist())
            assert len(done) == 1 if group == 1 << 20 else len(done) <= cut.num_rows


def test_a_full_table_keeps_words_met_again(library):
    path = vocabulary()
    asked = []

    def encode_words(words):
        asked.extend(words)
        return tokens.library_encoder(path)._words(words)

    small = tokens.PieceEncoder(encode_words, tokens.library_splitter(path), {}, "<u2", limit=40)
    for i in range(30):
        text = f"the common words once{i}x twice{i}y other{i}z of every text"
        assert np.frombuffer(small.encode(text), "<u2").tolist() == library(text)
        assert small._table.count <= 40 + len(text)
    assert asked.count(" common") == asked.count(" every") == 1


def test_words_that_occur_once_do_not_pile_up(library):
    """As many words as a worker once kept in 400 MB; they are encoded by their number alone."""
    number = iter(range(1 << 30))

    def encode_words(words):
        return [np.array([next(number) % 50_000], "<u2").tobytes() for _ in words]

    encoder = tokens.PieceEncoder(encode_words, tokens.library_splitter(vocabulary()), {}, "<u2")
    most = 0
    for i in range(30):
        encoder.encode_many([" ".join(f"q{chr(97 + i)}{a}x{b}" for b in range(1000)) for a in range(40)])
        table = encoder._table
        arrays = [table._keys, table._entry, table._again]
        arrays += [a for made in (table._ids, table._pieces) for a in (made.ends, made.values)]
        most = max(most, sum(a.nbytes for a in arrays))
    assert most < 100 << 20


def test_batches_are_read_in_runs():
    import pyarrow as pa

    texts = ["a" * 10, None, "", "é" * 40, "b" * 3, "c" * 3, None]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, kind)], ["doc_id", "text"]).slice(1)
        for size in (1, 8, 1000):
            runs = list(tokens.text_runs(batch, size=size))
            assert [x for r in runs for x in r.column("text").to_pylist()] == texts[1:]
            assert [x for r in runs for x in r.column("doc_id").to_pylist()] == list(range(1, 7))
            assert all(r.num_rows for r in runs)
        assert [r.num_rows for r in tokens.text_runs(batch, size=8)] == [2, 1, 3]
        assert list(tokens.text_runs(batch.slice(0, 0))) == []


def test_cuts_at_every_position_take_little_memory():
    import tracemalloc

    n = 200_000
    at = np.arange(n + 1)
    tracemalloc.start()
    cuts = packing.best_cuts(at, np.full(n + 1, packing.SENTENCE_CUT))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cuts[0] == 0 and cuts[-1] == n and max(np.diff(cuts)) <= packing.SEQUENCE
    assert peak < 80 * n
