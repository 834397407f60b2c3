"""Spans and what is made of them, on cases that the tables lack."""

import re

import pytest
from pyspark.sql import functions as F

from kakusu.functions import spans as S
from kakusu.functions.catalog import DEFAULT, Pattern, Recognizer
from kakusu.operators import anonymize, reversible

TEXTS = [
    "連絡先: 電話 090-1234-5678, メール user@example.co.jp",
    "クレジットカード: 4111-1111-1111-1111\nマイナンバー: 1234 5678 9012",
    "𠮷野さん📞090-1234-5678 と 03-1234-5678、〒150-0001",
    "法人番号: 1234567890123 https://example.com/a?b=1 10.0.0.1",
    "TEL: ０９０−１２３４−５６７８ 在留カード: ZZ99999999AA 保険証の記号 12345 番号 678901",
    "これは普通の文です。2024年1月15日",
    "a \x01 b 10.0.0.1 \x01 10.0.0.2",
    "",
    None,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_same_spans_as_python(spark, texts):
    rows = S.spans_of(F.col("text"), context=False)
    got = {r.doc_id: sorted((s.entity_type, s.start, s.end, s.score) for s in (r.spans or [])) for r in texts.select("doc_id", rows.alias("spans")).collect()}
    for i, text in enumerate(TEXTS):
        want = []
        for r in DEFAULT.recognizers:
            for p in r.patterns:
                want += [(r.entity, m.start(), m.end(), p.score) for m in re.finditer(p.regex, text or "", re.I | re.M | re.S)]
        assert got[i] == sorted(want), text


def test_text_of_a_span_is_the_text_at_its_place(texts):
    for r in S.explode_spans(S.detect(texts), "doc_id").collect():
        assert TEXTS[r.doc_id][r.start : r.end] == r.text


def test_kept_spans_are_disjoint_and_ordered(texts):
    for r in anonymize.redact(texts).collect():
        ends = [(s.start, s.end) for s in r.spans]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
        assert len(r.items) == len(r.spans)


def test_round_trip(texts):
    out = reversible.redact_with_mapping(texts)
    for r in out.select("text", reversible.restore(F.col("redacted"), F.col("mapping")).alias("back")).collect():
        assert r.back == r.text


def test_restore_does_not_replace_what_it_brought_back(spark):
    df = spark.createDataFrame([("<A_0> <B_2>", {"<A_0>": "<B_2>", "<B_2>": "x"})], "t string, m map<string,string>")
    assert df.select(reversible.restore(F.col("t"), F.col("m"))).first()[0] == "<B_2> x"
    assert df.select(reversible.restore_in_order(F.col("t"), F.col("m"))).first()[0] == "x x"


def test_empty_operator_means_the_default(spark, texts):
    got = anonymize.redact(texts, operators={"EMAIL_ADDRESS": {}}, entities=["EMAIL_ADDRESS"]).filter("doc_id = 0").first()
    assert got.redacted.endswith("メール <EMAIL_ADDRESS>") and got.items == ["replace"]


def test_custom_operator_and_recognizer(spark):
    mine = DEFAULT.register(Recognizer("TICKET", (Pattern("ticket", r"\bT-\d+\b", 0.9),)))
    df = spark.createDataFrame([("see T-12",)], "text string")
    got = anonymize.redact(df, operators={"TICKET": {"type": "custom", "function": F.reverse}}, catalog=mine).first()
    assert got.redacted == "see 21-T"
    with pytest.raises(ValueError):
        anonymize.redact(df, operators={"TICKET": {"type": "shred"}}, catalog=mine)


def test_other_languages_find_nothing(texts):
    assert S.explode_spans(S.detect(texts, lang="en"), "doc_id").count() == 0


def test_mask(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "text string")
    mask = lambda **k: anonymize.redact(df, operators={"IP_ADDRESS": {"type": "mask", **k}}).first().redacted
    assert mask(chars_to_mask=3) == "***0.0.1"
    assert mask(chars_to_mask=99, masking_char="x") == "xxxxxxxx"
    assert mask(chars_to_mask=2, from_end=True) == "10.0.0**"


def test_the_pattern_runs_once(texts):
    plan = S.explode_spans(S.detect(texts, entities=["EMAIL_ADDRESS"], context=False), "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_many_spans_in_one_text(spark):
    """Twice the addresses take about twice the time."""
    import time

    took = []
    for n in (10, 4000, 8000):
        df = spark.createDataFrame([("、".join(f"user{i}@mail.example.jp" for i in range(n)),)], "text string")
        began = time.time()
        got = anonymize.redact(df).first()
        took.append(time.time() - began)
        assert len(got.spans) == n and "@" not in got.redacted
    assert took[2] < 3 * took[1] + 2  # linear, whatever the machine
