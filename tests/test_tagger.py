"""The trained tagger: decoding against all paths, alignment, learning, odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kakusu.operators import ner, tagger
from kakusu.plans.queries import PLAIN, QUERIES, _trained

LABELS = ("IP", "KEY")
ROWS = "doc_id long, text string, entities array<struct<label:string,start:int,end:int>>"


def made(n, seed):
    """Texts of made-up words, some with an address of four numbers or ``key`` and two words of digits."""
    r, out = random.Random(seed), []
    for i in range(n):
        words, spans, at = [], [], 0
        for _ in range(r.randrange(5, 60)):
            word, label = "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))), None
            if r.random() < 0.02:
                word, label = ".".join(str(r.randrange(1, 256)) for _ in range(4)), "IP"
            elif r.random() < 0.02:
                word, label = f"K{r.randrange(10000, 99999)} {r.randrange(1000, 9999)}", "KEY"
            elif r.random() < 0.02:
                word = str(r.randrange(1000))
            if label:
                spans.append((label, at, at + len(word)))
            words.append(word)
            at += len(word) + 1
        out.append((i, " ".join(words), spans))
    return out


def test_tokens_are_the_text():
    text = "　 Ab12_c, 日本語 1.2.3.4\n\nx\x1c\U0001f600!"
    t = tagger.tokens(["", text, " "])
    inside = t.text >= 0
    assert [text[a:b] for a, b in zip(t.start[inside], t.end[inside])] == ["Ab", "12", "_", "c", ",", "日本語", "1", ".", "2", ".", "3", ".", "4", "x", "\U0001f600", "!"]
    assert set(t.text[inside]) == {1}


@pytest.mark.parametrize("seed", range(20))
def test_best_paths_are_the_best_of_all(seed):
    r = np.random.default_rng(seed)
    lengths, moves = np.array([3, 1, 5, 4]), r.normal(size=(3, 3))
    scores = r.normal(size=(13, 3))
    said, at = tagger.best_paths(scores, lengths, moves), 0
    value = lambda tags, s: sum(s[i, t] for i, t in enumerate(tags)) + sum(moves[a, b] for a, b in zip((0, *tags), (*tags, 0)))
    for n in lengths:
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda tags: value(tags, scores[at : at + n]))
        assert tuple(said[at : at + n]) == best
        at += n


@pytest.mark.parametrize("seed", range(10))
def test_certain_tokens_change_no_path(seed):
    """Decoded in parts or as one sequence: the same tags."""
    r = np.random.default_rng(seed)
    moves, scores = r.normal(size=(5, 5)), r.normal(size=(400, 5)) + np.where(r.random((400, 1)) < 0.8, [9, 0, 0, 0, 0], 0)
    assert (tagger._open(scores, tagger._gain(moves))).sum() < 300
    assert (tagger._decoded(scores, moves, np.array([0])) == tagger.best_paths(scores, np.array([400]), moves)).all()


def test_entities_are_widened_and_the_first_stays():
    text = "see abc12 and 10.0.0.1"
    t = tagger.tokens([text])
    spans = [("KEY", 5, 8), ("IP", 7, 9), ("OTHER", 0, 3), ("IP", 14, 22), ("KEY", 30, 31), ("KEY", 3, 3)]
    assert tagger.spans_of_tags(t, tagger.gold_tags(t, [spans], LABELS), LABELS) == [(0, "KEY", 4, 9), (0, "IP", 14, 22)]


def test_learns_and_says_the_same_again(spark):
    rows = spark.createDataFrame(made(400, 1), ROWS)
    model, again = (tagger.train(rows.repartition(n), LABELS, shard_bytes=20_000) for n in (2, 3))
    assert (model.weights == again.weights).all() and (model.moves == again.moves).all()
    assert model.weights.shape == (1 << tagger.BITS, 5)
    fresh = made(200, 2)
    found = model.backend()([t for _, t, _ in fresh])
    tp = sum(len({x[:3] for x in a} & set(g)) for a, (_, _, g) in zip(found, fresh))
    assert 2 * tp / (sum(map(len, found)) + sum(len(g) for *_, g in fresh)) > 0.95
    one_by_one = [model.backend()([t])[0] for _, t, _ in fresh]
    assert found == one_by_one


def test_odd_rows(spark):
    odd = [(None, None, None), (1, "", []), (1, "", []), (2, "some words", None), (3, "x " * 50_000 + "10.0.0.1", [("IP", 100_000, 100_008)]), (4, " \n", [("IP", 0, 1)])]
    rows = spark.createDataFrame(odd, ROWS).withColumn("tags", F.lit("mine")).withColumn("shard", F.lit(7)).withColumn("draw", F.lit(1))
    model = tagger.train(rows, LABELS, epochs=6)
    found = tagger.tag(rows.drop("entities"), model, out="spans").collect()
    assert len(found) == 6 and {r.tags for r in found} == {"mine"}
    assert [(s.start, s.end, s.text) for r in found if r.doc_id == 3 for s in r.spans] == [(100_000, 100_008, "10.0.0.1")]
    assert all(r.spans == [] for r in found if r.doc_id in (None, 1, 4))
    empty = tagger.train(rows.limit(0), LABELS)
    assert empty.backend()(["10.0.0.1 a"]) == [[]]
    assert tagger.tag(rows.limit(0), empty).count() == 0


def test_every_language_by_its_model_in_one_pass(spark):
    say = lambda label: lambda: lambda texts: [[(label, 0, len(t), 0.5)] if t else [] for t in texts]
    rows = spark.createDataFrame([(1, "ja", "a"), (2, "en", "b"), (3, "fr", "c"), (4, None, "d"), (5, "ja", None)], "id long, lang string, text string")
    out = ner.by_language(rows, {"ja": say("J"), "en": say("E")})
    assert {r.id: [(s.entity_type, s.text) for s in r.ner_spans] for r in out.collect()} == {1: [("J", "a")], 2: [("E", "b")], 3: [], 4: [], 5: []}
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_queries_score_what_they_find(spark, sf):
    """tagger_scores counted again from the spans of tagger_spans and of the patterns, with sets."""
    _, held = _trained(spark, sf)
    gold = set()
    for r in held.collect():
        t = tagger.tokens([r.text or ""])
        kept = tagger.gold_tags(t, [[tuple(e) for e in r.entities]], tuple(PLAIN))
        gold |= {(r.doc_id, label, a, b) for _, label, a, b in tagger.spans_of_tags(t, kept, tuple(PLAIN))}
    ids = {r.doc_id for r in held.select("doc_id").collect()}
    pred = {(r.doc_id, r.entity_type, r.start, r.end) for r in QUERIES["tagger_spans"](spark, sf).collect() if r.doc_id in ids}
    want = {(label, *(sum(x[1] == label for x in s) for s in (gold & pred, pred, gold))) for label in {x[1] for x in gold | pred}}
    assert {(r.label, r.tp, r.pred, r.gold) for r in QUERIES["tagger_scores"](spark, sf).collect()} == want
