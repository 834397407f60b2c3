import hashlib
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kakusu.llm import bpe
from kakusu.llm.queries import vocabulary_path

TEXTS = ["", None, "Hello world, it's 3 o'clock", "a<|endoftext|>b <|endoftext|>", "日本語 テキスト 𠮷野", "x" * 3000 + " " * 500, "\t\n mixed\x85 \x1c", "éàü ß œ", "the the the", "ab" * 5000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def test_same_ids_as_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x")], "doc_id long, text string, n_tokens string").drop("n_tokens")
    got = bpe.encode_documents(df, vocabulary_path(), with_text=True).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded == (TEXTS[r.doc_id] or "") == (library.decode(ids, skip_special_tokens=False) or "")
    back = {tuple(r.ids): r.decoded for r in bpe.decode_ids(bpe.encode_documents(df, vocabulary_path(), with_text=True).drop("decoded"), vocabulary_path()).collect()}
    assert set(back.values()) == {t or "" for t in TEXTS}


def test_whole_table(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.encode_documents(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary_path()).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text(library, vocabulary, text):
    encoder = bpe.Encoder(vocabulary, None, bpe._cutter())
    assert encoder.encode(text) == ",".join(map(str, library.encode(text, add_special_tokens=False).ids))


def test_lexicon_shares_suffixes_and_knows_its_words_only(tmp_path):
    words = {w.encode(): str(i) for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "a", "日本"])}
    (tmp_path / "lex").write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(tmp_path / "lex"))
    assert all(lexicon.get(w) == i for w, i in words.items())
    assert all(lexicon.get(w) is None for w in (b"", b"ta", b"tapss", b"b", b"sto"))
    assert lexicon.states < 1 + sum(map(len, words))
    (tmp_path / "none").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "none")).get(b"a") is None


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path()).count() == 0


def test_the_driver_holds_no_vocabulary(spark):
    """A task compiles the lexicon; with the vocabulary the driver took over 30 MB for it."""
    rows = spark.createDataFrame([(1, "one two two"), (2, None)], "doc_id long, text string")
    tracemalloc.start()
    try:
        out = bpe.encode_documents(rows, vocabulary_path())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15e6
    assert sorted((r.doc_id, r.n_tokens) for r in out.collect()) == [(1, 3), (2, 0)]
