"""Plain versions of the operators for small inputs, and rows that are hard to handle."""

import re
from collections import Counter

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, key long, chunk string, part int, rule string, words string"

LOREM = " ".join(f"w{i % 37}x{i * i % 101}" for i in range(400))
SENTENCES = "The cat sat. The dog ran off! Is it late? Yes.\nNo.\n" * 12

#: Nulls, empty and long texts, repeats, odd blanks; the other columns clash with names in use inside.
HARD = [
    (1, LOREM), (2, LOREM), (3, None), (4, ""), (5, "   \n\t "), (6, "one two three"),
    (7, "One TWO three"), (8, LOREM + " and more words"), (9, LOREM[: len(LOREM) // 2]),
    (10, SENTENCES), (10, SENTENCES), (11, "a  b\u00a0c\x0bd\x1ce " * 40), (12, LOREM + "\n" + LOREM),
    (13, "x" * 50_000), (14, "you are an idiot. " * 30), (15, "# $ % & | < > " * 20),
    (16, "日本語 text, naïve café's <|endoftext|> it's\n\n  end "), (17, "one two three"),
]


def documents(spark, rows=None):
    """Documents with extra columns."""
    rows = HARD if rows is None else rows
    return spark.createDataFrame(
        [(i, t, 5, "c", None, "r", "w") for i, t in rows], SCHEMA
    )


def words(text):
    return BLANKS.findall(text or "")


def repeat_words(text, size=8):
    ws = words(text)
    spots = [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)]
    counts = Counter(spots)
    covered = set()
    for i, s in enumerate(spots):
        if counts[s] > 1:
            covered.update(range(i, i + size))
    return len(covered)


def dedup(rows, size=20):
    """{position in order of (id, text): (id, words, removed, kept text)}."""
    seen, out = set(), []
    for i, t in sorted(((i, t or "") for i, t in rows)):
        ws, gone = words(t), set()
        for k in range(len(ws) - size + 1):
            s = tuple(ws[k : k + size])
            if s in seen:
                gone.update(range(k, k + size))
            seen.add(s)
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def shingles(text, size=5):
    ws = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1)))


def similar(rows, percent=75):
    """[(id, shingles, component)], rows of equal id being one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in sets]
