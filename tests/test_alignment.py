"""Alignment to runs of characters straight from the text, and plans that find spans once."""

import random

import pytest
from pyspark.sql import functions as F

from kakusu.operators import corpus
from kakusu.plans.queries import QUERIES

BLANKS = " \t\n\x0b\f\r"


def ranges(text, start, end):
    runs, at = [], 0
    for i, c in enumerate(text + " "):
        if c in BLANKS:
            runs += [(at, i)] if i > at else []
            at = i + 1
    first = max((k for k, r in enumerate(runs) if r[0] <= start), default=None)
    last = min((k for k, r in enumerate(runs) if r[1] >= end), default=None)
    return first, last, None if first is None else runs[first][0], None if last is None else runs[last][1]


@pytest.mark.parametrize("walk", [1 << 24, 0])
def test_runs_are_found_from_the_text(spark, monkeypatch, walk):
    monkeypatch.setattr(corpus, "WALK", walk)
    dice = random.Random(7)
    texts = ["", " ", "\t\n", "a", " ab\x01c d  é𠀋 \x0b", "\x01\x01 x", *("".join(dice.choice("ab𠀋é\x01 \t\n\r") for _ in range(dice.randrange(40))) for _ in range(30))]
    rows = [(i, t, [(a, b, "PERSON", "") for a, b in ((dice.randrange(-1, len(t) + 3), dice.randrange(0, len(t) + 4)) for _ in range(5))]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"id int, text string, entities {corpus.ENTITIES}")
    got = df.select("id", corpus.run_ranges(F.col("text"), F.col("entities")).alias("r")).collect()
    for row in got:
        _, text, entities = rows[row.id]
        assert [tuple(r) for r in row.r] == [ranges(text, a, b) for a, b, *_ in entities], repr(text)
    both = (corpus.align_runs(df), corpus.align(df.withColumn("tokens", corpus.tokens(F.col("text"), r"[^\x20\x09-\x0D]+"))))
    a, b = ({r.id: (r.aligned, r.failed, r.total) for r in x.select("id", "aligned", "failed", "total").collect()} for x in both)
    assert a == b


def test_entities_of_null_texts(spark):
    df = spark.createDataFrame([(None, [(0, 1, "PERSON", "a")]), ("a", None), (None, [])], f"text string, entities {corpus.ENTITIES}")
    assert [r.r for r in df.select(corpus.run_ranges(F.col("text"), F.col("entities")).alias("r")).collect()] == [[(None, None, None, None)], None, []]


@pytest.mark.parametrize("name", ["token_alignment", "tagged_documents", "validated_documents"])
def test_patterns_stand_once_in_the_plan(spark, sf, name):
    """A filter on what is found, pushed below, would find everything again."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and not any("regexp_replace" in line.lower() for line in plan.splitlines() if "Filter" in line)
