"""How the terms of each source differ from those of the other sources and of its language.

Terms are counted per Arrow batch in numpy. A term of up to eight bytes is one uint64 word, of up to sixteen
two, most significant byte first; words are sorted by a radix sort and runs are counted. Longer terms
go to buckets by length, sorted as bytes. Spark adds up the counts of all batches and keeps a term's sources
side by side, so each pair of sources is compared term by term without a join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .hashing import text_bytes

MIN_DOCS, SCALE, TOP_TERMS = 3, 1_000_000_000, 200
# Bytes of text cut at once, and different (term, group) pairs held by a task before they are handed on.
SPAN, HELD = 1 << 22, 1 << 18
# Groups up to this number are sent to every task; more are joined by a shuffle.
SMALL_GROUPS = 1 << 18
# Sums of a task are handed on when they hold this many pairs of sources.
PAIRS_HELD = 1 << 22

COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
PAIRS = "lang string, a int, b int, value bigint"

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def radix_order(words: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Stable ascending order of unsigned 64-bit words, sixteen bits at a time from the lowest.

    ``order`` is an order to start from: equal words stay as they are there.
    """
    if order is None:
        order = np.arange(len(words))
    for shift in range(0, 64, 16):
        digits = (words >> np.uint64(shift)).astype(np.uint16)
        if len(digits) and (digits != digits[0]).any():
            # numpy sorts 16-bit numbers stably by radix.
            order = order[np.argsort(digits[order], kind="stable")]
    return order


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, document) of each term: a run of ASCII letters and bytes beyond ASCII in one document."""
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, stop - start, doc


def _words(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first eight bytes of each term (or fewer, zeros behind them) as one number."""
    at_all = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    rest = np.uint64(8) * (np.uint64(8) - np.clip(length, 0, 8).astype(np.uint64))
    kept = np.where(length > 0, ~np.uint64(0) << np.minimum(rest, np.uint64(63)), np.uint64(0))
    return at_all[start].astype(np.uint64) & kept


def _runs(order: np.ndarray, columns: list[np.ndarray], group: np.ndarray, doc: np.ndarray):
    """(index of a term, group, occurrences, documents) per run of equal columns and group.

    ``order`` sorts by the columns and, among equals, by document; documents ascend by group.
    """
    group, doc = group[order], doc[order]
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    new[1:] = group[1:] != group[:-1]
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    first = new.copy()
    first[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(order)))
    return order[at], group[at], sizes, np.add.reduceat(first.astype(np.int64), at)


def count_terms(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray):
    """[(terms, group, occurrences, documents)] of texts laid end to end, sorted by group."""
    data = _LOWER[data]
    start, length, doc = term_spans(data, offsets)
    group, out = groups[doc], []
    padded = np.concatenate([data, np.zeros(16, np.uint8)])

    def add(chosen, order, columns):
        own = chosen[order]
        picked, g, n, d = _runs(np.arange(len(own)), [c[order] for c in columns], group[own], doc[own])
        picked = own[picked]
        terms = [padded[a : a + k].tobytes() for a, k in zip(start[picked].tolist(), length[picked].tolist())]
        out.append((terms, g, n, d))

    one = np.flatnonzero(length <= 8)
    if len(one):
        words = _words(padded, start[one], length[one])
        add(one, radix_order(words), [words])
    two = np.flatnonzero((length > 8) & (length <= 16))
    if len(two):
        high, low = (_words(padded, start[two] + k, length[two] - k) for k in (0, 8))
        add(two, radix_order(high, radix_order(low)), [high, low])
    # Longer terms by the power of two that holds them, so a bucket is at most twice its terms' bytes.
    longer = np.flatnonzero(length > 16)
    if len(longer):
        width = 2 ** np.ceil(np.log2(length[longer])).astype(np.int64)
        for w in np.unique(width):
            chosen = longer[width == w]
            texts = np.array([padded[a : a + k].tobytes() for a, k in zip(start[chosen].tolist(), length[chosen].tolist())], f"S{w}")
            add(chosen, np.argsort(texts, kind="stable"), [texts])
    return out


class _Held:
    """Counts of a task by (group, term), handed on when there are many."""

    def __init__(self):
        self.names, self.number, self.counts = [], {}, {}

    def groups(self, langs, sources) -> np.ndarray:
        """Number of each row's group."""
        out = np.empty(len(langs), dtype=np.int64)
        for i, key in enumerate(zip(langs, sources)):
            if key not in self.number:
                self.number[key] = len(self.names)
                self.names.append(key)
            out[i] = self.number[key]
        return out

    def add(self, found) -> None:
        counts = self.counts
        for terms, group, n, docs in found:
            for key, a, b in zip(zip(group.tolist(), terms), n.tolist(), docs.tolist()):
                had = counts.get(key)
                counts[key] = (a, b) if had is None else (had[0] + a, had[1] + b)

    def handed(self):
        import pyarrow as pa

        keys, values = list(self.counts), list(self.counts.values())
        self.counts = {}
        langs, sources = zip(*[self.names[g] for g, _ in keys]) if keys else ((), ())
        arrays = [
            pa.array(langs, pa.string()), pa.array(sources, pa.string()),
            pa.array([t for _, t in keys], pa.binary()),
            pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])


def _counted(batches):
    """Term counts of a task's documents (lang, source, text)."""
    held = _Held()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        groups = held.groups(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        i, n = 0, len(groups)
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + SPAN, side="right")) - 1
            j = min(n, max(j, i + 1))
            # Documents of a group side by side: runs of a term then fall apart by group.
            held.add(_in_groups(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], groups[i:j]))
            i = j
            if len(held.counts) >= HELD:
                yield from held.handed()
    yield from held.handed()


def _in_groups(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray):
    order = np.argsort(groups, kind="stable")
    if (order[1:] > order[:-1]).all():
        return count_terms(data, offsets, groups)
    size = np.diff(offsets)[order]
    ends = np.cumsum(size)
    # Position of each byte before the documents were moved.
    source = np.repeat(offsets[:-1][order] - (ends - size), size) + np.arange(int(ends[-1]))
    return count_terms(data[source], np.append(0, ends), groups[order])


def _compared(batches):
    """Sums over a task's terms of (p - q) ** 2 // q for all pairs of sources of a language."""
    import pyarrow as pa

    sums: dict[str, np.ndarray] = {}

    def handed():
        for lang, total in sums.items():
            n = len(total)
            a, b = np.divmod(np.flatnonzero(~np.eye(n, dtype=bool)), n) if n else ([], [])
            arrays = [
                pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                pa.array(total[a, b], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "a", "b", "value"])
        sums.clear()

    for batch in batches:
        langs, shares = batch.column("lang"), batch.column("shares")
        for lang in langs.unique().to_pylist():
            chosen = shares.filter(pa.compute.equal(langs, lang))
            n = len(chosen[0])
            table = chosen.flatten().to_numpy().reshape(-1, n)
            if lang not in sums:
                if sum(s.size for s in sums.values()) + n * n > PAIRS_HELD:
                    yield from handed()
                sums[lang] = np.zeros((n, n), dtype=np.int64)
            for a in range(n):
                gap = table[:, a : a + 1] - table
                sums[lang][a] += (gap * gap // table).sum(axis=0)
    yield from handed()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n, docs, counts): each term's occurrences and documents in a language, and by source."""
    rows = docs.select("lang", "source", "text").mapInArrow(_counted, COUNTS)
    # One shuffle serves both sums: rows of a term are in one place.
    placed = rows.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "docs").repartition("lang", "term")
    by_source = placed.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"),
        F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"),
    )


def _share(count: str, size: str, terms: str) -> str:
    """1 + floor(SCALE * (count + 1) / (size + terms)) in exact decimals, for counts of any size."""
    return (
        f"1 + CAST(CAST({count} + 1 AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0)) "
        f"DIV CAST({size} + {terms} AS DECIMAL(20, 0)) AS BIGINT)"
    )


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; those in at least
    ``min_docs`` documents (rows) of a language are kept. A group gives a term the share p, scaled to
    SCALE and smoothed by one occurrence. Part ``pair`` has a row for each other source of the language:
    the sum over kept terms of (p - q) ** 2 // q, q being the other's share; 0 without terms. Part ``term`` has
    the terms the group uses more than its language does, up to ``top_terms``. Ranks go by value, then item.

    Null texts, languages and sources are empty strings; a language with one source has no pairs; repeated
    rows count each; an empty table gives no rows. Other columns are not read. Work and memory for pairs
    grow with the square of a language's sources, as the result does.
    """
    rows = docs.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in [(lang, "lang"), (source, "source"), (text, "text")]]
    )
    terms = stage(term_counts(rows).filter(F.col("docs") >= min_docs), "terms")
    sizes = terms.select("lang", F.explode("counts").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("total"))
    groups = stage(rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left"), "groups")
    listed = groups.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("size", F.lit(0)).alias("size")))).alias("groups")
    )
    beside = listed.join(langs, "lang").select(
        "lang", "terms", "total", F.col("groups.source").alias("sources"), F.col("groups.size").alias("sizes")
    )
    if groups.count() <= SMALL_GROUPS:
        beside = F.broadcast(beside)
    # Every source of the language, also those without the term.
    found = F.transform("sources", lambda s: F.coalesce(F.element_at("counts", s), F.lit(0)))
    shares = terms.join(beside, "lang").withColumn("found", found).select(
        "lang", "term", "sources", "found",
        F.expr(f"transform(found, (c, i) -> {_share('c', 'sizes[i]', 'terms')})").alias("shares"),
        F.expr(_share("n", "total", "terms")).alias("q"),
    )
    sums = shares.select("lang", "shares").mapInArrow(_compared, PAIRS)
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    named = groups.select(
        "lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    )
    one, other = named.toDF("lang", "source", "a"), named.toDF("lang", "item", "b")
    pairs = one.join(other, "lang").filter("a != b").join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    most = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(most))
    entries = shares.select(
        "lang", "q", F.col("term").alias("item"), F.explode(F.arrays_zip("sources", "found", "shares")).alias("e")
    ).select("lang", F.col("e.sources").alias("source"), "item", "q", F.col("e.found").alias("n"), F.col("e.shares").alias("p"))
    entries = entries.filter("n > 0 AND p > q").select(
        "lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) DIV q").alias("value")
    )
    entries = entries.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(entries)
