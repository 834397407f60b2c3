import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from kakusu.llm import bpe, mixing, neardup, quality
from kakusu.llm.queries import table, vocabulary_path


def test_pipeline(spark, sf):
    documents = table(spark, sf, "documents")
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == documents.columns, name
        docs = docs.cache()
        counts.append(docs.count())
    assert counts[0] < documents.count() and counts[1] == counts[0] and counts[2] <= counts[1]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == counts[3]
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


LINES = "the harbour was quiet that morning and the boats lay still\nnobody spoke of the storm"
ROWS = [
    (1, LINES, "en", "a", 85),
    (1, LINES, "en", "a", 85),  # a repeated row
    (2, LINES.replace("quiet", "silent"), "en", "a", 86),  # a near copy: its lines go, an empty text is left
    (3, "one two three four five six seven eight nine ten", "en", "b", 48),
    (4, "One two three four five six seven eight nine ten", "en", "b", 48),
    (5, None, None, None, 0),
    (6, "", "en", "b", 0),
    (7, " \n\t", "en", "b", 3),
    (8, "lone line of its own " + "pad " * 250_000, "en", "c", 1_000_021),
    (9, "another thing entirely, with other words in it", "de", None, 46),
    (9, "an id that comes twice with another text", "de", None, 40),
    (None, "a row without an id, but with a text", "fr", "c", 36),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(1, 10)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_odd_rows(spark, odd):
    """Each stage on its own input: nulls, empty and long texts, repeated rows and ids, ties."""
    docs = table(spark, odd, "documents")
    good = corpus_pipeline.good_documents(spark, docs, odd)
    want = quality.score_quality(docs, table(spark, odd, "labels")).filter("quality_score >= 0.3").count()
    assert good.columns == docs.columns and good.count() == want

    lines = corpus_pipeline.distinct_lines(spark, docs, odd).collect()
    left = {(r.doc_id, r.text) for r in lines}
    assert len(lines) == len(ROWS) and (2, "") in left and (4, "") in left and (1, LINES) in left and (5, None) in left
    assert all(r.n_chars == (len(r.text) if r.doc_id in (2, 4) else r.n_chars) for r in lines)

    one = corpus_pipeline.distinct_documents(spark, docs, odd).collect()
    assert len(one) == len({(r.doc_id, r.text) for r in one}) and {r.doc_id for r in one} == {1, 2, 3, 5, 6, 7, 8, 9, None}
    groups = {r.component_id for r in neardup.link_components(docs).filter("n_shingles > 0").collect()}
    assert {r.doc_id for r in one if (r.text or "").strip()} == groups

    mixed = corpus_pipeline.mixed_sources(spark, docs, odd)
    copies = mixing.mix_sources(docs).agg(F.sum("mix_copies")).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == copies and mixed.filter("text is null or trim(text) = ''").count() == 0

    coded = corpus_pipeline.encoded(spark, docs, odd).collect()
    assert sorted(r.decoded_sha256 for r in coded) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in ROWS)


def test_stages_on_nothing_and_odd_names(spark, odd):
    docs = table(spark, odd, "documents")
    more = docs.withColumns({c: F.lit("mine") for c in ("_source", "_removed_lines", "_kept_id", "quality_score", "mix_size", "_copy", "c0", "cls")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, odd)
        assert got.columns == more.columns and {r[0] for r in got.select("mix_size").distinct().collect()} <= {"mine"}, name
        assert stage(spark, docs.limit(0), odd).count() == 0, name
    assert bpe.encode_documents(docs.limit(0), vocabulary_path()).count() == 0
