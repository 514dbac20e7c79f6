"""Quality rules as a short-circuit cascade.

Each rule has a feature, a test of it, and the work the feature takes. Work and rejections are
estimated on a sample; rules then run in the order of rejections per unit of work, and a document
that one rule rejects is not looked at by the next ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 2000


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    return F.size(lines) - F.size(F.array_distinct(lines))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def window_hashes(words: Column, size: int = WINDOW) -> Column:
    """64-bit hash of every window of consecutive words."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - size + 1),
            lambda i: F.xxhash64(F.slice(words, i, size)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows that are found twice or more.

    Hashes are compared by sorting, so the work is n log n in a text's words. Only texts with a
    repeated hash are sorted.
    """
    def covered(at: Column) -> Column:
        # Each repeated window covers its words up to the next repeated window.
        steps = F.transform(
            at, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(at, j + 1) - p, F.lit(size)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        found = let(F.sort_array(pairs), lambda s: let(repeated(s), covered))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(0)

    return let(window_hashes(words, size), count)


@dataclass(frozen=True)
class Rule:
    """A feature of (text, words), when its value rejects, and the work it takes."""

    name: str
    feature: Callable[[Column, Column], Column]
    rejects: Callable[[Column, Column, Column], Column]
    work: Callable[[Column, Column], Column]

    def hit(self, text: Column, words: Column) -> Column:
        return let(self.feature(text, words), lambda v: self.rejects(v, text, words))


def _chars(passes: float) -> Callable[[Column, Column], Column]:
    return lambda t, w: F.length(t) * F.lit(passes)


def _per_word(steps: float) -> Callable[[Column, Column], Column]:
    return lambda t, w: F.size(w) * F.lit(steps)


# The work of a feature is in passes over the text's characters or steps per word, as measured
# once for the functions used here; the sample gives the number of characters and words.
RULES = [
    Rule(
        "n_words", lambda t, w: F.size(w), lambda v, t, w: v < 20, lambda t, w: F.lit(1.0)
    ),
    Rule(
        "n_symbols",
        lambda t, w: _count(t, SYMBOLS),
        lambda v, t, w: v * 10 > F.size(w),
        _chars(1.0),
    ),
    Rule(
        "n_exclamations",
        lambda t, w: _count(t, "!"),
        lambda v, t, w: v * 5 > F.size(w),
        _chars(1.0),
    ),
    Rule(
        "n_upper",
        lambda t, w: F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        lambda v, t, w: v * 2 > F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
        _chars(4.0),
    ),
    Rule(
        "n_dup_lines",
        lambda t, w: n_dup_lines(t),
        lambda v, t, w: v * 3 > F.size(F.split(t, "\n", -1)),
        _chars(2.0),
    ),
    Rule(
        "n_stutters",
        lambda t, w: F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))),
        lambda v, t, w: v * 10 > F.size(w) * 3,
        _per_word(2.0),
    ),
    Rule(
        "n_repeat_words",
        lambda t, w: n_repeat_words(w),
        lambda v, t, w: v * 100 > F.size(w) * 30,
        _per_word(16.0),
    ),
]
BASE = ("n_words", "n_repeat_words")


def _whole(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def measure_rules(
    docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> dict[str, tuple[float, float]]:
    """Rule name -> (work per document, share rejected), estimated on about ``sample_rows`` rows.

    The sample only sets the order of the rules, never a verdict.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))

    def figures(t: Column, w: Column) -> Column:
        return F.struct(
            *[r.work(t, w).cast("double").alias(f"w_{r.name}") for r in rules],
            *[r.hit(t, w).cast("double").alias(f"s_{r.name}") for r in rules],
        )

    seen = let(_whole(text), lambda t: let(word_array(t), lambda w: figures(t, w)))
    names = [f"{k}_{r.name}" for r in rules for k in "ws"]
    row = docs.sample(share, seed).select(seen.alias("f")).agg(
        *[F.avg(f"f.{n}").alias(n) for n in names]
    ).first()
    return {r.name: (row[f"w_{r.name}"] or 0.0, row[f"s_{r.name}"] or 0.0) for r in rules}


def cascade_order(rules: list[Rule], measured: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per unit of work, most first; ties by work, then name."""
    def key(rule: Rule):
        work, rejected = measured[rule.name]
        return (-rejected / max(work, 1e-9), work, rule.name)

    return sorted(rules, key=key)


def first_rejection(rules: list[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does.

    A rule's feature is computed only if all rules before it let the document pass.
    """
    out = None
    for rule in rules:
        hit = rule.hit(text, words)
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def filter_quality(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with ``rejected_by``, the rule of the cascade that rejects, or null.

    Rules run in the order that the sample suggests. Null and empty texts have no words. Input columns
    stay as they are; one named ``rejected_by`` is replaced.
    """
    order = cascade_order(rules, measure_rules(docs, rules, text))
    verdict = let(
        _whole(text), lambda t: let(word_array(t), lambda w: first_rejection(order, t, w))
    )
    return docs.withColumn("rejected_by", verdict)


def quality_report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: list[Rule] = RULES
) -> DataFrame:
    """One row per document: the base figures, whether they fail, and the cascade's verdict.

    Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    rejected_by. Null and empty texts have zeros throughout and fail. Repeated rows, and rows with
    a null doc_id, are each judged. The base figures are wanted for every document, so here only
    the other rules' work is saved: a document is rejected by the base first, and then by the rest
    of the cascade in its order.
    """
    rest = [r for r in cascade_order(rules, measure_rules(docs, rules, text)) if r.name not in BASE]

    def report(t: Column, w: Column, repeats: Column) -> Column:
        failed = (F.size(w) < 20) | (repeats * 100 > F.size(w) * 30)
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _count(t, SYMBOLS).cast("bigint").alias("n_symbols"),
            n_dup_lines(t).cast("bigint").alias("n_dup_lines"),
            repeats.cast("bigint").alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.when(failed, F.lit("base")).otherwise(first_rejection(rest, t, w)).alias("rejected_by"),
        )

    whole = let(
        _whole(text),
        lambda t: let(word_array(t), lambda w: let(n_repeat_words(w), lambda r: report(t, w, r))),
    )
    seen = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole.alias("_r"))
    return seen.select("doc_id", "_r.*").withColumn("kept", F.col("rejected_by").isNull())
