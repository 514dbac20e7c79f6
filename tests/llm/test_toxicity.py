import math

import plain
import pytest
from pyspark.sql import functions as F

from funnelspark.llm import toxicity as tox

LEXICON = {"=idiot": 4.0, "^moro": 3.0}


def score(text):
    return sum(tox.Scorer(LEXICON).clauses(text)[0])


def test_clauses_and_not_words_are_scored():
    assert score("the sky is blue.") == 0
    assert score("an idiot.") == pytest.approx(4.0)
    assert score("MORONS!") == pytest.approx(3.0)
    assert score("you idiot") == pytest.approx(6.0)
    assert score("not an idiot") == pytest.approx(0.8)
    assert score("not true. an idiot") == pytest.approx(4.0)
    assert score("he said idiot") < score("idiot")
    assert score('"idiot" idiot') == pytest.approx(0.4 * 4 + 4)


def test_threats_need_modal_and_target():
    assert score("kill") == score("kill you") == score("will kill") == score("you will") == 0
    assert score("i will kill you") == pytest.approx(tox.THREAT_WEIGHT)
    assert score("never will kill you") < tox.THREAT_WEIGHT
    assert score("will. kill you") == 0


def test_composition_runs_both_transducers():
    one, two = tox.negation(), tox.reported_speech()
    both = tox.compose(one, two)
    state, a, b, total = 0, 0, 0, 0.0
    for symbol in [tox.REPORT, tox.NEGATION, tox.INSULT, tox.BREAK, tox.INSULT, tox.QUOTE, tox.INSULT]:
        state, out, w = both.step(state, symbol)
        a, middle, x = one.step(a, symbol)
        b, last, y = two.step(b, middle)
        assert (out, w) == (last, x + y) and state == a * two.states + b
        total += w
    assert total == pytest.approx(math.log(0.2) + 2 * math.log(0.4))


def labelled(spark, n=600):
    """A toxic text has invented insults, of which no list is given."""
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = " ".join(f"word{(i * 7 + k * k) % 90}" for k in range(60))
        docs.append((i, body + (" zorgling fool zorglers blat." if bad else ".")))
        labels.append((i, int(bad), i % 2))
    labels += [(3, None, 1), (None, 1, 1)]
    return (
        plain.documents(spark, docs),
        spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int"),
    )


def test_learned_scores_hold_on_rows_never_learned_from(spark):
    docs, labels = labelled(spark)
    model = tox.learn(tox.training_rows(docs, labels))
    assert min(model.weights[1:]) >= 0
    scored = tox.score_toxicity(docs, model)
    rows = scored.withColumn("out", tox.held_out(scored["doc_id"])).collect()
    out = [r for r in rows if r["out"]]
    assert len(rows) == 600 and 150 < len(out) < 250
    assert all((r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in out)


def test_training_leaves_the_held_out_alone(spark):
    docs, labels = labelled(spark)
    wrong = labels.withColumn("toxic", (1 - labels["toxic"]).cast("int"))
    odd = labels.filter(~tox.held_out(labels["doc_id"])).unionByName(wrong.filter(tox.held_out(wrong["doc_id"])))
    assert tox.learn(tox.training_rows(docs, odd)) == tox.learn(tox.training_rows(docs, labels))


def test_hard_rows_and_no_labels(spark):
    docs = plain.documents(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = tox.learn(tox.training_rows(docs, none))
    assert model.weights == tox.DEFAULT_WEIGHTS
    got = tox.score_toxicity(docs, model).collect()
    assert len(got) == len(plain.HARD) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[14]["predicted"] == 1 and by_id[3]["predicted"] == by_id[1]["predicted"] == 0
    column = docs.select("doc_id", tox.score_column(model, docs["text"]).alias("s")).collect()
    assert {(r["doc_id"], round(r["s"], 9)) for r in column} == {(r["doc_id"], round(r["score"], 9)) for r in got}
    assert tox.score_toxicity(plain.documents(spark, []), model).count() == 0


def test_repeated_documents_are_one_training_row(spark):
    docs = spark.range(2000).selectExpr("CAST(id % 4 AS bigint) AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(4)], "doc_id bigint, toxic int, quality int")
    wanted = labels.filter(~tox.held_out(F.col("doc_id"))).count()
    assert tox.training_rows(docs, labels).count() == wanted <= 4
