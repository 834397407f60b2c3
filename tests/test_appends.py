"""Batches once, whatever is cut off or comes again; table functions; alignment and first-wins against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from kakusu.functions import extension
from kakusu.functions.spans import SPANS, first_wins
from kakusu.operators import corpus
from kakusu.streaming import appends
from kakusu.streaming.runner import shared_place


def test_batches_once(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (3, None)], "id long, text string")
    assert appends.records(spark, path).collect() == [] and appends.read_appended(spark, path, df.schema).collect() == []
    valid = F.col("text") != ""
    for _ in range(2):
        assert appends.append_once(df, path, 0, valid) == {"total": 4, "new": 1, "failed": 3}
    assert appends.append_once(df.limit(0), path, 1) == {"total": 0, "new": 0, "failed": 0}
    df.write.parquet(f"{path}/rows/append_batch=2")  # cut off before its record: not seen, and written anew
    assert [tuple(r) for r in appends.read_appended(spark, path, df.schema).collect()] == [(1, "a", 0)]
    assert appends.append_once(df.filter("id = 2"), path, 2)["new"] == 1
    assert sorted(tuple(r) for r in appends.read_appended(spark, path, df.schema).collect()) == [(1, "a", 0), (2, "", 2)]
    with pytest.raises(ValueError):
        appends.append_once(df.withColumn("Append_Batch", F.lit(1)), path, 3)


def test_a_stream_goes_on_where_it_was_cut(spark, monkeypatch):
    place = shared_place(spark)
    df = spark.range(40)
    df.repartition(4).write.parquet(f"{place}/in")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    whole = appends.append_once

    def lost(rows, path, batch, valid):
        whole(rows, path, batch, valid)
        if batch == 1:
            raise RuntimeError("lost after the record")

    monkeypatch.setattr(appends, "append_once", lost)
    with pytest.raises(Exception, match="lost"):
        appends.append_stream(stream(), f"{place}/out", f"{place}/c").awaitTermination()
    monkeypatch.setattr(appends, "append_once", whole)
    appends.append_stream(stream(), f"{place}/out", f"{place}/c").awaitTermination()
    rows = appends.read_appended(spark, f"{place}/out", df.schema)
    assert sorted(r["id"] for r in rows.collect()) == list(range(40))
    assert rows.select("append_batch").distinct().count() == 4


def test_check_digits(spark):
    good = {"CREDIT_CARD": "4111 1111 1111 1111", "MY_NUMBER": "123456789018", "MY_NUMBER_CORPORATE": "7000012050002"}
    rows = [(e, n[:-1] + str(d)) for e, n in good.items() for d in range(10)] + [("MY_NUMBER", "1"), ("CREDIT_CARD", None), ("URL", "4111111111111111")]
    df = spark.createDataFrame(rows, "e string, n string")
    by_column = {(r.e, r.n) for e in good for r in df.filter(F.col("e") == e).filter(extension.checked(e, F.col("n"))).collect()}
    assert by_column == {(e, n) for e, n in rows if n and e in good and any(f == e for f, *_ in extension.checked_numbers(n))}
    assert set(good.items()) <= by_column and sum(e == "CREDIT_CARD" for e, _ in by_column) == 1
    extension.register_finder(spark, "numbers_of", extension.checked_numbers)
    out = spark.sql("SELECT d.n, s.* FROM {d} AS d, LATERAL numbers_of(d.n) AS s", d=df.filter("e = 'MY_NUMBER' or n is null"))
    assert [tuple(r) for r in out.collect()] == [("123456789018", "MY_NUMBER", 0, 12, 1.0, "123456789018")]


def test_first_wins_and_ranges(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        tokens, at = [], 0
        for _ in range(rng.randrange(0, 90)):
            at += rng.randrange(1, 3)
            tokens.append(("t", at, at := at + rng.randrange(1, 5)))
        entities = [((a := rng.randrange(0, at + 5)), a + rng.randrange(0, 9), "PERSON", str(i)) for i in range(rng.randrange(0, 80))]
        rows.append((k, entities, tokens))
    df = spark.createDataFrame(rows, f"id long, entities {corpus.ENTITIES}, tokens array<struct<tok:string,start:int,end:int>>")
    got = {r.id: r for r in corpus.align(df.withColumn("ranges", corpus.token_ranges(F.col("entities"), F.col("tokens")))).collect()}
    for k, entities, tokens in rows:
        wide = []
        for a, b, *_ in entities:
            first = max((i for i, t in enumerate(tokens) if t[1] <= a), default=None)
            last = min((i for i, t in enumerate(tokens) if t[2] >= b), default=None)
            wide.append((first, last))
        assert [tuple(r) for r in got[k].ranges] == wide
        kept, taken, fine = [], set(), 0
        for (first, last), e in zip(wide, entities):
            if first is None or last is None or tokens[first][1] >= tokens[last][2]:
                continue
            fine += 1
            own = set(range(first, last + 1))
            if not own & taken:
                kept.append((tokens[first][1], tokens[last][2], e[3]))
                taken |= own
        assert [(e.start, e.end, e.text) for e in got[k].aligned] == kept
        assert (got[k].total, got[k].failed) == (len(entities), len(entities) - fine)
    spans = [[(rng.choice("AB"), (a := rng.randrange(50)), a + rng.randrange(1, 6), rng.random(), str(i)) for i in range(30)] for _ in range(20)]
    out = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], f"id long, spans {SPANS}").select("id", first_wins(F.col("spans")).alias("kept"))
    for r in out.collect():
        kept = []
        for s in spans[r.id]:
            if not any(k[1] < s[2] and s[1] < k[2] for k in kept):
                kept.append(s)
        assert [tuple(k) for k in r.kept] == kept


def test_quotes_and_signs_in_patterns(spark):
    from kakusu.functions.catalog import Catalog, Pattern, Recognizer
    from kakusu.functions.spans import detect

    odd = Catalog((Recognizer("ODD", (Pattern("odd", r"""'\$["\\]+'$""", 0.5, ("'", "\\"), False),), ("it's", "${x}"), "ja"),))
    rows = [("it's '$\"\\'",), ("'$'",), ("a\x01 '$\\'",), (None,)]
    got = [[(s.start, s.end, s.score, s.text) for s in r.spans] for r in detect(spark.createDataFrame(rows, "text string"), catalog=odd).collect()]
    assert got == [[(5, 10, 0.85, "'$\"\\'")], [], [(3, 7, 0.5, "'$\\'")], []]
