"""Batches go through a model in parts."""

from kakusu.operators import ner


def test_no_call_gets_a_whole_batch(spark, monkeypatch):
    most, rows = ner.PART, [(i, "x" * 300_000 if i % 5 else None) for i in range(20)]

    def load():
        return lambda texts: [[("A", 0, len("".join(texts)), 1.0)] if t else [] for t in texts]

    got = ner.model_entities(spark.createDataFrame(rows, "id int, text string").coalesce(1), load).select("id", "ner_spans.end").collect()
    assert [r.id for r in got] == list(range(20))
    assert [len(r.end) for r in got] == [1 if t else 0 for _, t in rows]
    assert max(n for r in got for n in r.end) < most + 300_000
