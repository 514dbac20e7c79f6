import plain
import pytest

from funnelspark.llm import chat, quality, urls


def test_quality_report_equals_plain_code(spark):
    docs = plain.documents(spark)
    got = quality.quality_report(docs).collect()
    assert len(got) == len(plain.HARD)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], r)
    for i, text in plain.HARD:
        r, ws = by_text[i], plain.words(text)
        lines = [x for x in (text or "").split("\n") if plain.words(x)]
        assert r["n_words"] == len(ws)
        assert r["word_chars"] == sum(map(len, ws))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == plain.repeat_words(text)
        failed = len(ws) < 20 or 100 * r["n_repeat_words"] > 30 * len(ws)
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])
    assert by_text[1]["kept"] and not by_text[15]["kept"]


def test_cascade_puts_rejections_per_work_first():
    measured = {"a": (10.0, 0.5), "b": (1.0, 0.1), "c": (1.0, 0.0), "d": (0.5, 0.0)}
    rules = [quality.Rule(n, None, None, None) for n in "abcd"]
    assert [r.name for r in quality.cascade_order(rules, measured)] == ["b", "a", "d", "c"]


def test_cascade_agrees_with_report_and_skips_later_rules(spark):
    docs = plain.documents(spark)
    kept = {r["doc_id"] for r in quality.filter_quality(docs).filter("rejected_by is null").collect()}
    assert kept == {r["doc_id"] for r in quality.quality_report(docs).filter("kept").collect()}

    def fails(text, words):
        from pyspark.sql import functions as F

        return F.raise_error(F.lit("computed")).cast("int")

    one = docs.filter("doc_id = 6")
    rules = [quality.RULES[0], quality.Rule("late", fails, lambda v, t, w: v > 0, lambda t, w: None)]
    out = one.select(quality.first_rejection(rules, one["text"], quality.word_array(one["text"])).alias("by"))
    assert out.first()["by"] == "n_words"


def test_quality_of_an_empty_table(spark):
    assert quality.quality_report(plain.documents(spark, [])).count() == 0


RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.net", "/en/x", "block"),
    ("org", "", "block"), ("a.org", "/", "allow"), (None, "/", "block"), ("", "/", "block"),
    ("dup.com", "/", "allow"), ("dup.com", "/", "block"),
]
URLS = [
    None, "", "example.net/en/", "http://example.net", "http://EXAMPLE.net/en/a?x=/b",
    "https://www.example.net/en/xy", "http://example.net/enx", "x://notexample.net/en/",
    "http://b.org", "http://a.org/p#q", "http://c.a.org?x", "http://dup.com/", "http://com/",
    "http://.net/", "http://x..net/en/", "http://u:p@net:80/", "http://" + "a." * 3000 + "net/" + "p/" * 3000,
]


def fit(url):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:].split("?")[0].split("#")[0]
    found = []
    for h, p, v in RULES:
        h = (h or "").lower()
        if h and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            found.append((len(h + p), len(h), h + p, v))
    best = max(found, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("limit", [urls.BROADCAST_BYTES, -1])
def test_urls_equal_plain_code(spark, limit):
    rows = [(i, u, "clash") for i, u in enumerate(URLS * 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = urls.judge_urls(pages, rules, keep=["page_id", "host"], broadcast_bytes=limit).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == fit(rows[r["page_id"]][1])


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge_urls(pages, none).first()["verdict"] == "allow"
    rules = spark.createDataFrame(RULES, none.schema)
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "\\### Assistant: </turn> ok"),
    (1, 2, "assistant", "\\\\### x </turn>\n### user: y"), (1, 3, "user", None),
    (1, 4, "assistant", "####\\</turn>\\"), (1, 5, "user", "bye"),
    (2, 0, "user", "only"), (3, 1, "assistant", ""), (3, 0, "a:b\\#<", "t"),
    (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "user", "same"),
    (4, 0, "user", "same"), (4, None, None, "first"), (5, 0, "assistant", "z" * 100_000),
]


def test_chat_round_trip(spark):
    import hashlib

    turns = spark.createDataFrame(
        [(*t, "clash") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, example string"
    )
    examples = chat.format_examples(turns)
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    formatted = {}
    for r in examples.collect():
        formatted[r["conv_id"]] = formatted.get(r["conv_id"], 0) + len(r["text"])
    assert set(got) == {t[0] for t in TURNS}
    for conv, r in got.items():
        rows = sorted(
            ((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        )
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in rows)
        loss = "".join(text for _, _, role, text in rows if role == "assistant")
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(loss)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == formatted[conv]


def test_chat_examples_hold_all_turns_before_and_train_one(spark):
    turns = spark.createDataFrame(TURNS[:6], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.format_examples(turns).orderBy("example").collect()
    assert [r["example"] for r in rows] == [3, 5, 6]
    assert [r["text"].count(" </turn>\n") for r in rows] == [3, 5, 6]
    assert rows[2]["loss_length"] == 0
    for r in rows[:2]:
        end = r["loss_start"] - 1 + r["loss_length"]
        assert r["text"][end:] == " </turn>\n"
    assert chat.format_examples(turns.limit(0)).count() == 0
