"""JSON bodies, corpora, images, sources and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kakusu import sources
from kakusu.operators import corpus, envelopes, images, ner
from kakusu.streaming import restore_chunks, windowed_counts

MAIL = "mail a@b.jp now"


def one(spark, body, **k):
    k = {"entities": ["EMAIL_ADDRESS"]} | k
    return envelopes.redact_requests(spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body),)], "body string"), **k).first()


def test_chat_parts_and_unknown_keys(spark):
    body = {"model": "m", "x": {"y": 1}, "messages": [{"role": "u", "content": MAIL}, {"role": "u", "content": [{"type": "text", "text": MAIL}, {"type": "image_url", "image_url": {"url": "u"}}, 3]}, {"role": "u"}]}
    got = one(spark, body)
    new = json.loads(got.redacted_body)
    assert got.kind == "chat" and new["x"] == {"y": 1} and new["messages"][2] == {"role": "u"}
    assert new["messages"][0]["content"] == "mail <EMAIL_ADDRESS_0_5> now" and new["messages"][1]["content"][0]["text"] == "mail <EMAIL_ADDRESS_1_5> now"
    assert new["messages"][1]["content"][1:] == body["messages"][1]["content"][1:]
    assert got.mapping == {"<EMAIL_ADDRESS_0_5>": "a@b.jp", "<EMAIL_ADDRESS_1_5>": "a@b.jp"}


def test_instructions_do_not_leak(spark):
    new = json.loads(one(spark, {"input": MAIL, "instructions": MAIL}).redacted_body)
    assert "a@b.jp" not in json.dumps(new)


def test_system_prompts(spark):
    assert "a@b.jp" not in one(spark, {"system": [{"type": "text", "text": MAIL}], "messages": []}).redacted_body
    got = json.loads(one(spark, {"contents": [{"parts": [{"text": MAIL}, {"inline_data": {}}]}], "system_instruction": {"role": "s", "parts": [{"text": MAIL}]}}).redacted_body)
    assert "a@b.jp" not in json.dumps(got) and got["system_instruction"]["role"] == "s"


@pytest.mark.parametrize("body", ["", "{", "[1]", "3", None])
def test_what_is_no_object_is_quarantined(spark, body):
    got = envelopes.redact_requests(spark.createDataFrame([(body,)], "body string"), entities=["URL"]).first()
    assert got.quarantined and got.redacted_body is None


def test_other_bodies_pass(spark):
    got = one(spark, {"prompt": MAIL})
    assert json.loads(got.redacted_body) == {"prompt": MAIL} and not got.mapping and not got.quarantined


@pytest.mark.parametrize(
    ("kind", "body"),
    [
        ("chat", {"choices": [{"delta": {"content": "<A_0_1>"}}, {"message": {"content": "x <A_0_1>"}}, {}]}),
        ("messages", {"content": [{"type": "text", "text": "<A_0_1>"}], "delta": {"type": "text_delta", "text": "<A_0_1>"}}),
        ("responses", {"output": [{"content": [{"type": "output_text", "text": "<A_0_1>"}]}], "output_text": "<A_0_1>"}),
        ("generate", {"candidates": [{"content": {"parts": [{"text": "<A_0_1>"}]}}]}),
    ],
)
def test_restore(spark, kind, body):
    rows = [(kind, json.dumps(body), {"<A_0_1>": "me"}, 200), (kind, json.dumps(body), {}, 200), (kind, json.dumps(body), {"<A_0_1>": "me"}, 500)]
    got = envelopes.restore_responses(spark.createDataFrame(rows, "kind string, response string, mapping map<string,string>, status int"), status_col="status").collect()
    assert sorted("<A_0_1>" in r.restored for r in got) == [False, True, True]


def test_messages_without_system_are_restored(spark):
    asked = envelopes.redact_requests(spark.createDataFrame([(json.dumps({"messages": [{"role": "user", "content": MAIL}]}),)], "body string"), entities=["EMAIL_ADDRESS"])
    answer = F.lit(json.dumps({"type": "message", "content": [{"type": "text", "text": "to <EMAIL_ADDRESS_0_5>"}]}))
    got = envelopes.restore_responses(asked.withColumn("response", answer)).first()
    assert got.kind == "chat" and json.loads(got.restored)["content"][0]["text"] == "to a@b.jp"


def test_split_cuts(spark):
    for n, want in ((1009, [101, 101, 807]), (1015, [101, 102, 812])):
        got = corpus.split(spark.range(n).withColumnRenamed("id", "doc_id")).groupBy("split").count().orderBy("split").collect()
        assert [r["count"] for r in got] == want


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1003).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.split for r in corpus.split(df).collect()}
    assert sorted(pd.Series(a).value_counts().to_dict().items()) == [("dev", 100), ("test", 101), ("train", 802)]
    assert a == {r.doc_id: r.split for r in corpus.split(df.repartition(7)).collect()}


def test_alignment_report(spark):
    df = spark.createDataFrame([(10, 1), (10, 0)], "total long, failed long")
    r = corpus.alignment_report(df).first()
    assert (r.documents, r.failure_rate, r.warn) == (2, 5.0, False)
    assert corpus.alignment_report(df.limit(0)).first().failure_rate == 0.0


def test_sources(spark, tmp_path):
    assert sources.read_annotated(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"text": "ab", "entities": [{"start": 0, "end": 1, "label": "PERSON", "text": "a"}]}]))
    docs = sources.read_annotated(spark, str(tmp_path / "a.json"))
    assert corpus.usable(docs).count() == 1
    sources.write_splits(docs.withColumn("split", F.lit("dev")), str(tmp_path / "s"))
    assert sources.read_split(spark, str(tmp_path / "s"), "dev").count() == 1 and sources.read_split(spark, str(tmp_path / "s"), "test").count() == 0
    (tmp_path / "mail.j2").write_text("write {{ num_docs }}")
    assert sources.render(sources.read_templates(spark, str(tmp_path / "*.j2")), 3).first()[:] == ("mail", "write 3")
    raw = spark.createDataFrame([("a\n---\n \n---\n b　",)], "raw string")
    assert [r.raw for r in sources.split_batches(raw).collect()] == ["a", "b"]
    (tmp_path / "scores.json").write_text(json.dumps({"ents_p": 1.0, "ents_r": 0.5, "ents_f": 0.6, "tag_acc": None, "ents_per_type": {"PERSON": {"p": 1.0, "r": 0.5, "f": 0.6}}}))
    assert {r.label for r in sources.read_scores(spark, str(tmp_path / "scores.json")).collect()} == {"PERSON", "overall"}


def test_images_fail_closed(spark):
    def redactor(content, fill):
        if content == b"bad":
            raise ValueError
        return content + bytes(fill)

    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad")), (3, None)], "id long, content binary")
    got = {r.id: (r.redacted, r.status) for r in images.redact_images(df, redactor).collect()}
    assert got == {1: (bytearray(b"ok\0\0\0"), "ok"), 2: (None, "failed: ValueError"), 3: (None, "no image")}


def test_model_plug_in(spark):
    load = lambda: lambda texts: [[("PERSON", 0, 1, 0.9)] if t else [] for t in texts]
    df = spark.createDataFrame([("ja", "あい"), ("ja", None), ("en", "x")], "lang string, text string")
    got = ner.by_language(df, {"ja": load}).collect()
    assert sorted(len(r.ner_spans) for r in got) == [0, 0, 1]


def test_windowed_counts_on_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'ip 10.0.0.1' text UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a@b.jp'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.entity_type, r.n) for r in spark.sql("SELECT entity_type, n FROM windowed").collect()} == {("IP_ADDRESS", 1), ("EMAIL_ADDRESS", 1)}


def test_placeholders_cut_by_chunks_are_restored(spark, tmp_path):
    schema = "conv_id long, seq long, chunk string, mapping map<string,string>"
    spark.createDataFrame([(1, 1, "hello <PER", {"<PERSON_0_1>": "me"}), (1, 2, "SON_0_1> and", None), (2, 1, "a < b", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = restore_chunks(stream).writeStream.outputMode("append").format("memory").queryName("chunks").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT * FROM chunks").toPandas().sort_values(["conv_id", "seq"])
    assert "".join(got[got.conv_id == 1].restored) == "hello me and"


def test_a_conversation_that_is_done_holds_nothing_back(spark, tmp_path):
    schema = "conv_id long, seq long, chunk string, mapping map<string,string>, done boolean"
    spark.createDataFrame([(1, 1, "by <PER", {"<PERSON_0_1>": "me"}, False), (1, 2, "SON_0_1> <A", None, True)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = restore_chunks(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("done").trigger(availableNow=True).start()
    q.awaitTermination()
    assert "".join(r.restored for r in spark.sql("SELECT * FROM done ORDER BY seq").collect()) == "by me <A"


def test_credit_unions_are_banks(spark, sf):
    rows = ["城南信用金庫 渋谷支店 普通 1234567", "城南信金 渋谷支店 普通 1234567", "みずほ銀行 渋谷支店 普通 1234567", "城南信用金庫 渋谷支店 普通 口座"]
    got = ner.rule_entities(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")).collect()
    assert {r.id for r in got if any(s.entity_type == "BANK_ACCOUNT" for s in r.ner_spans)} == {0, 1, 2}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = docs.unionByName(docs.select("doc_id", F.concat("text", F.lit("。城南信用金庫 渋谷支店 普通 1234567")).alias("text")))
    pattern = next(r for r in ner.RULES.recognizers if r.entity == "BANK_ACCOUNT").patterns[0]
    banks = F.size(F.filter("ner_spans", lambda s: s["entity_type"] == "BANK_ACCOUNT"))
    bad = ner.rule_entities(more).filter(banks != F.coalesce(F.regexp_count("text", F.lit(pattern.regex)), F.lit(0)))
    assert bad.count() == 0 and ner.rule_entities(more).filter(banks > 0).count() >= docs.filter("text is not null").count()


IMAGES = {
    "chat": lambda d: {"messages": [{"role": "u", "content": [{"type": "text", "text": MAIL}, {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{d}", "detail": "low"}}]}]},
    "messages": lambda d: {"system": "s", "messages": [{"role": "u", "content": [{"type": "tool_result", "content": [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": d}}]}, {"type": "text", "text": MAIL}]}]},
    "responses": lambda d: {"input": [{"role": "u", "content": [{"type": "input_image", "image_url": f"data:image/png;base64,{d}"}, {"type": "input_text", "text": MAIL}]}]},
    "generate": lambda d: {"contents": [{"parts": [{"text": MAIL}, {"inline_data": {"mime_type": "image/png", "data": d}}]}]},
}


@pytest.mark.parametrize("kind", list(IMAGES))
def test_images_in_bodies_fail_closed(spark, kind):
    def bad(content, fill):
        raise ValueError

    body = IMAGES[kind]("c2VjcmV0IGltYWdl")  # secret image
    for redactor, status in ((None, "withheld: no redactor"), (bad, "withheld: ValueError")):
        got = one(spark, body, redactor=redactor)
        assert (got.kind, got.image_status, got.quarantined) == (kind, status, False)
        assert "c2VjcmV0IGltYWdl" not in got.redacted_body and "<EMAIL_ADDRESS_0_5>" in got.redacted_body
    got = one(spark, body, redactor=lambda content, fill: content[:6] + bytes(fill))
    assert got.image_status == "ok" and json.loads(got.redacted_body.replace("<EMAIL_ADDRESS_0_5>", "a@b.jp")) == IMAGES[kind]("c2VjcmV0AAAA")


def test_images_elsewhere_are_withheld(spark):
    got = one(spark, {"messages": [{"role": "u", "content": [{"type": "image_url", "image_url": {"url": "https://a.jp/b.png"}}]}]}, redactor=lambda c, f: c)
    assert got.image_status == "withheld: not in the body" and "a.jp" not in got.redacted_body
    assert one(spark, {"input": "x"}).image_status == "no image"


def test_texts_of_tools(spark):
    """Results of tools, calls and their arguments, in all shapes; keys stay; nothing but texts changes."""
    deep = {"a": [MAIL, 7, {"b@c.jp": 'say "hi" to\n a@b.jp \\ '}], "n": None}
    bodies = [
        {"messages": [{"role": "a", "content": None, "tool_calls": [{"id": "a@b.jp", "function": {"name": "f", "arguments": json.dumps({"to": MAIL})}}]}, {"role": "tool", "content": MAIL}]},
        {"system": MAIL, "messages": [{"content": [{"type": "tool_result", "content": MAIL}, {"type": "tool_result", "content": [{"type": "text", "text": MAIL}, {"type": "x", "text": MAIL}]}, {"type": "tool_use", "input": deep}]}]},
        {"input": [{"type": "function_call", "arguments": MAIL}, {"type": "function_call_output", "output": MAIL}, {"content": [{"type": "input_text", "text": MAIL}]}, "x", None]},
        {"contents": [{"parts": [{"text": MAIL, "functionCall": {"args": deep}}, {"functionResponse": {"response": {"x": [MAIL]}}}]}], "systemInstruction": {"parts": [{"text": MAIL}]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(b), "kept", "kept") for i, b in enumerate(bodies)], "id long, body string, _done string, _left string")
    out = envelopes.redact_requests(df, entities=["EMAIL_ADDRESS"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "Python" not in plan and "InPandas" not in plan
    for r in out.collect():
        assert (r["_done"], r["_left"], r["quarantined"], r["image_status"]) == ("kept", "kept", False, "no image")
        back = r["redacted_body"]
        for name, original in r["mapping"].items():
            assert back.count(name) == 1
            back = back.replace(name, original)
        assert json.loads(back) == bodies[r["id"]]
        assert r["redacted_body"].count("a@b.jp") == {0: 1, 1: 1}.get(r["id"], 0)  # an id, and a part of no known type
    answers = out.withColumn("response", F.to_json(F.struct(F.array(F.struct(F.col("redacted_body").alias("text"))).alias("content"))))
    restored = envelopes.restore_responses(answers).collect()
    assert all(json.loads(json.loads(r["restored"])["content"][0]["text"]) == bodies[r["id"]] for r in restored)


def test_restored_originals_are_json(spark):
    """Originals with quotes and line ends, angle brackets that a server escaped, what is no placeholder."""
    rows = [("chat", '{"choices": [{"message": {"content": "\\u003cA_0_1\\u003E <A_0_2> <B_1> 1.0"}}], "n": 1.0}', {"<A_0_1>": 'x"\n\\', "<A_0_2>": "<A_0_1>"}), (None, '{"other": "<A_0_1>"}', {"<A_0_1>": "x"}), ("chat", None, {"<A_0_1>": "x"})]
    got = [r["restored"] for r in envelopes.restore_responses(spark.createDataFrame(rows, "kind string, response string, mapping map<string,string>")).collect()]
    assert json.loads(got[0])["choices"][0]["message"]["content"] == 'x"\n\\ <A_0_1> <B_1> 1.0' and got[0].endswith('"n": 1.0}')
    assert got[1:] == ['{"other": "<A_0_1>"}', None]


def test_images_at_odd_places_withhold_the_body(spark):
    image = {"type": "image", "source": {"type": "base64", "data": "c2VjcmV0IGltYWdl"}}
    got = one(spark, {"messages": [{"role": "u", "content": "x", "more": {"deep": [image]}}]})
    assert got.quarantined and got.redacted_body is None and got.image_status == "withheld: the body"
    got = one(spark, {"system": "s", "messages": [{"role": "u", "content": [{"type": "tool_result", "content": [image, {"type": "text", "text": MAIL}]}]}]})
    assert json.loads(got.redacted_body)["messages"][0]["content"][0]["content"] == [{"type": "text", "text": "mail <EMAIL_ADDRESS_0_5> now"}]
    assert got.image_status == "withheld: no redactor"
    assert one(spark, {"prompt": "x"}).image_status == "not known"
