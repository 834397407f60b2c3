"""Images are looked for only in bodies whose JSON text may have one; no way of writing an image gets around that."""

import json

from pyspark.sql import functions as F

from kakusu.operators import envelopes

DATA = "aGVsbG8gd29ybGQsIGhlbGxv"
WITH = [
    json.dumps({"messages": [{"role": "u", "content": [{"type": "image_url", "image_url": {"url": f"data:image/png;base64,{DATA}"}}]}]}),
    '{"messages":[{"role":"u","content":[{"type":"\\u0069mage","source":{"data":"' + DATA + '"}}]}]}',
    '{"contents":[{"parts":[{"\\u0069nline_data":{"data":"' + DATA + '"}}]}]}',
    json.dumps({"contents": [{"parts": [{"inlineData": {"data": DATA}}]}]}),
    json.dumps({"contents": [{"parts": [{"file_data": {"file_uri": "x", "mime_type": "IMAGE/png"}}]}]}),
    json.dumps({"input": [{"role": "u", "content": [{"type": "input_image", "file_id": "f"}]}]}),
    json.dumps({"messages": [{"role": "u", "content": [{"type": "tool_result", "content": [{"type": "image", "source": {"url": "http://a/b"}}]}]}]}),
]
WITHOUT = [json.dumps({"messages": [{"role": "u", "content": "an image of a file, inline: " + "é" * 9}]}, ensure_ascii=False), json.dumps({"contents": [{"parts": [{"text": "data:image/png"}]}]})]


def test_hints(spark):
    rows = spark.createDataFrame([(b,) for b in WITH + WITHOUT], "body string")
    out = envelopes.redact_requests(rows, entities=["EMAIL_ADDRESS"]).withColumn("asked", envelopes._may_have_image(F.col("body"))).collect()
    assert [r["asked"] for r in out] == [True] * len(WITH) + [False] * len(WITHOUT)
    assert all(r["image_status"].startswith("withheld: ") and (r["quarantined"] or DATA not in r["redacted_body"]) for r in out[: len(WITH)])
    assert [(r["image_status"], r["quarantined"]) for r in out[len(WITH) :]] == [("no image", False)] * len(WITHOUT)
