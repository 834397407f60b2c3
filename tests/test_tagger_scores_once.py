"""Scores of a tagger: what is expensive to find is found once."""

from kakusu.operators import tagger


def test_spans_are_found_once(spark):
    kind = "doc_id long, start long, end long, label string"
    gold = spark.createDataFrame([(1, 0, 2, "A"), (1, 4, 6, "A"), (2, 0, 1, "B")], kind)
    pred = spark.createDataFrame([(1, 0, 2, "A"), (2, 0, 2, "B"), (2, 0, 2, "B")], kind)
    out = tagger.scores(gold, pred)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
    assert sorted(map(tuple, out.collect())) == [("A", 1, 1, 2, 1.0, 0.5, 2 / 3), ("B", 0, 1, 1, 0.0, 0.0, 0.0)]
    assert out.columns == ["label", "tp", "pred", "gold", "p", "r", "f"]
