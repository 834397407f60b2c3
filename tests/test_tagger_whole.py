"""The tagger learns from all documents, and its bounds change no tag."""

import random

import numpy as np
import pytest

from kakusu.operators import tagger

LABELS = ("IP", "KEY")
ROWS = "doc_id long, text string, entities array<struct<label:string,start:int,end:int>>"


def test_every_document_is_learned_from(spark):
    """Names that only their own document tells, beside a document of 64 MB: each is known afterwards."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    docs = [(i, " ".join(words := [word() for _ in range(8)]), [("KEY", 40, 49)]) for i in range(60)]
    rows = spark.createDataFrame(docs, ROWS).union(spark.range(1).selectExpr("99L", "repeat('x', 64 * 1024 * 1024)", f"cast(array() as {ROWS.split(' ')[-1]})"))
    model = tagger.train(rows, LABELS, epochs=30, shard_bytes=1 << 30)
    found = model.backend()([text for _, text, _ in docs])
    assert [[x[:3] for x in f] for f in found] == [spans for *_, spans in docs]


def test_what_one_of_many_shards_has_is_learned(spark):
    r = random.Random(6)
    docs = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)), []) for i in range(100)]
    docs.append((100, "abc K12345 6789 def", [("KEY", 4, 15)]))
    model = tagger.train(spark.createDataFrame(docs, ROWS), LABELS, shard_bytes=700)
    assert model.backend()(["abc K12345 6789 def", "abc defgh def"]) == [[("KEY", 4, 15, 1.0)], []]


@pytest.mark.parametrize("seed", range(5))
def test_bounds_change_no_tag(seed):
    """Tags by bounds and distinct looks, and by all scores of all tokens: the same."""
    r, words = np.random.default_rng(seed), random.Random(seed)
    texts = [" ".join(words.choice(["a", "Bc", "12", "1.2.3", "x@y.z", "日本", "word", "K9"]) for _ in range(words.randrange(60))) for _ in range(20)]
    weights, moves = np.round(r.normal(size=(1 << 8, 5)), 1), r.normal(size=(5, 5))
    weights[:, 0] += 0.3
    t = tagger.tokens(texts)
    at = np.arange(2, len(t.piece) - 2)
    scores = sum(weights[column] for column in tagger._features(t, at, tagger._FEATURES, 8).T)
    inside = t.text[at] >= 0
    heads = np.flatnonzero(np.diff(np.flatnonzero(inside), prepend=-2) > 1)
    want = tagger.best_paths(scores[inside], np.diff(np.append(heads, inside.sum())), moves)
    assert (tagger.Tagger(LABELS, weights, moves).tags(t)[2:-2][inside] == want).all() and (want > 0).any()
