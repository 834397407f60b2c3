"""Vector codes, exact deduplication and token alignment, against brute force and SQL."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kakusu.llm import gracededup, tokenalign, vectorcodes
from kakusu.llm.bpe import byte_letters
from kakusu.llm.queries import ORACLES, QUERIES, pieces_path, vocabulary_path


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    assert rows(QUERIES[name](spark, sf), *(d[0] for d in found.description)) == sorted(found.fetchall(), key=repr)


# --- vector codes


def lloyd(vectors, parts, entries, rounds):
    """By the definition; ``vectors``: (id, integers, label) of one length."""
    vectors = sorted(vectors, key=lambda v: (v[0] is None, v[0] or 0, np.array(v[1], "<i8").tobytes()))
    x = np.array([v[1] for v in vectors]).reshape(len(vectors), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for turn in range(rounds + 1):
        codes = np.stack([((x[:, p][:, None] - b[None]) ** 2).sum(2).argmin(1) for p, b in enumerate(books)], 1)
        for p, e in [(p, e) for p in range(parts) for e in range(len(books[p]))] if turn < rounds else []:
            mine = codes[:, p] == e
            if mine.any():
                books[p][e] = x[mine, p].sum(0) // mine.sum()
    errors = sum(((x[:, p] - b[codes[:, p]]) ** 2).sum(1) for p, b in enumerate(books))
    totals = Counter()
    for v, e in zip(vectors, errors):
        totals[v[2]] += int(e)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(v[0], "".join(f"{c:02x}" for c in codes[k]), int(errors[k]), totals[v[2]], digest) for k, v in enumerate(vectors)]


def test_codes_of_odd_vectors(spark):
    """Two lengths, repeated and null ids, null labels, what can't be coded, fewer vectors than entries, large components."""
    rng = np.random.default_rng(3)
    good = [(int(i), rng.normal(size=32).tolist(), int(i) % 3 or None, "x") for i in rng.permutation(90)]
    good += [(5, good[0][1], 1, "x"), (None, [0.5] * 32, 1, "x")] + [(200 + i, [float(i)] * 16, None, "x") for i in range(5)] + [(300, [-4e5, 1.0] * 8, 2, "x")]
    bad = [(400, None, 1, "x"), (401, [], 1, "x"), (402, [None] + [1.0] * 31, 1, "x"), (403, [float("nan")] * 32, 1, "x"), (404, [float("inf")] * 32, 1, "x"), (405, [1.0] * 31, 1, "x")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int, code string").repartition(5)
    want = [(v, np.floor(np.array(e) * 256).astype(np.int64).tolist(), n) for v, e, n, _ in good]
    by_dim = [lloyd([w for w in want if len(w[1]) == d], 16, 8, 2) for d in (16, 32)]
    totals = {}
    for found, d in zip(by_dim, (16, 32)):  # a label's total in one length; labels span both
        for n, total in {n: next(r[3] for r in found if r[0] == v) for v, ints, n in want if len(ints) == d and v not in (5, None)}.items():
            totals[d, n] = total
    got = vectorcodes.compress(df, entries=8)
    assert rows(got, "vec_id", "code", "error", "codebooks_sha256") == sorted(((a, b, c, e) for found in by_dim for a, b, c, _, e in found), key=repr)
    one = {r["vec_id"]: r["label_error"] for r in got.collect()}
    assert [one[204], one[300], one[1]] == [sum(totals.get((d, n), 0) for d in (16, 32)) for n in (None, 2, 1)]
    assert one[204] == one[3] == one[6]  # null labels are one label, over all lengths
    assert vectorcodes.compress(df.limit(0)).collect() == []


def test_only_what_moves_is_sent(spark, sf):
    """The second round's contributions cancel out: counts of all entries stay the number of vectors."""
    book = vectorcodes.Codebooks(np.arange(32).reshape(4, 8), 2)
    book.move([{"part": 0, "entry": 1, "sums": [-7, 3, 0, 1], "n": 2}])
    book.move([{"part": 0, "entry": 1, "sums": [4, 0, 0, 0], "n": -1}, {"part": 1, "entry": 0, "sums": [5, 5, 5, 5], "n": 1}])
    assert book.entries[0, 1].tolist() == [-3, 3, 0, 1] and book.entries[1, 0].tolist() == [5, 5, 5, 5]
    book.move([{"part": 1, "entry": 0, "sums": [-5, -5, -5, -5], "n": -1}])
    assert book.n[1, 0] == 0 and book.entries[1, 0].tolist() == [5, 5, 5, 5]  # unused: stays


# --- exact deduplication

COPIES = [(1, "Same", "a"), (2, "sAME", "b"), (3, "", "c"), (4, None, "d"), (None, "same", "e"), (2, "same", "f"), (5, "É", "g"), (6, "é", "h"), (7, "K", "i"), (8, "K", "j"), (9, " same", "k"), (None, "alone", "l"), (10, "long " * 50000, "m"), (11, "LONG " * 50000, "n")]


def definition(table):
    out = []
    for i, t, _ in table:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        mates = [j for j, u, _ in table if "".join(c.lower() if "A" <= c <= "Z" else c for c in u or "") == low]
        out.append((i, max((j for j in mates if j is not None), default=None), len(mates), hashlib.sha256(low.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"table_bytes": 300, "bucket_bytes": 1000}, {"table_bytes": 300, "bucket_bytes": 1000, "many": 0}, {"many": 1}])
def test_classes_at_any_table_size(spark, sizes):
    """Small tables make tasks flush, buckets overflow into further levels, and contents of many records be merged in shares."""
    table = COPIES + [(100 + i, f"hot{i % 3}", "z") for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string, keep_id string").repartition(7)
    got = gracededup.classes(df, **sizes)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == definition(table)
    assert sorted(Counter(r["text_sha256"] for r in got.filter("kept").collect()).values()) == [1] * len({d[3] for d in definition(table)})
    kept = gracededup.drop_copies(df, **sizes)
    assert kept.columns == df.columns and kept.count() == len({d[3] for d in definition(table)})
    assert {r["doc_id"] for r in kept.collect()} == {d[1] for d in definition(table)}


def test_ids_of_other_types_and_no_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "X"), ("b", "x")], "doc_id string, text string")
    assert {r["keep_id"] for r in gracededup.classes(df).collect()} == {"b"}
    assert gracededup.drop_copies(df).count() == 1
    assert gracededup.classes(df.limit(0)).collect() == [] and gracededup.drop_copies(df.limit(0)).collect() == []


@settings(deadline=None, max_examples=50)
@given(st.lists(st.tuples(st.integers(0, 3), st.binary(max_size=2)), max_size=60))
def test_open_table_compares_contents(entries):
    """Equal hashes of different contents are different entries; the table grows and still finds all."""
    table, want = gracededup.OpenTable(), {}
    for h, content in entries:
        entry, slot = table.find(h, content)
        assert (entry >= 0) == ((h, content) in want)
        if entry < 0:
            want[h, content] = table.add(h, content, slot)
    assert all(table.find(*key)[0] == entry for key, entry in want.items())


# --- token alignment

TEXTS = [None, "", "a  b   c ", " lead", "▁x ▁ y", "<|endoftext|> <s> it's </s>", "日本語 テキスト 𠮷野", "x" * 5000 + " " * 300, "\t\n mixed\x85 \x1c é", "the the", "　a b", "ﬁne Ⅳ", "é é", "\x00 \x01"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary_path())
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=pieces_path())
    letters = byte_letters()
    bytes_a = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab().items() if all(c in letters for c in t)}

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def one(text):
        """Groups and links of one text by walking along its tokens, None without tokens."""
        a, b = first.encode(" " + text, add_special_tokens=False).ids if text else [], second.encode(text) if text else []
        ab, bb = [bytes_a[i] for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            return None
        links, groups, mine, theirs = [], [], [a[0]], [b[0]]
        i, j, at_a, at_b = 0, 0, len(ab[0]), len(bb[0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = at_a <= at_b, at_b <= at_a
            if step_a and step_b:
                groups.append(",".join(map(str, mine)) + "|" + ",".join(map(str, theirs)))
                mine, theirs = [], []
            i, j = i + step_a, j + step_b
            if i == len(a):
                return len(a), len(b), ";".join(groups), links
            if step_a:
                at_a += len(ab[i])
                mine.append(a[i])
            if step_b:
                at_b += len(bb[j])
                theirs.append(b[j])

    return one


def alignment(one, table):
    found = [(i, one(t)) for i, t in table]
    counts, best = Counter(link for _, f in found if f for link in f[3]), {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    none = (0, 0, 0, 0, 0, 0, "")
    row = lambda f: (f[0], f[1], f[2].count(";") + 1, len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(f[2].encode()).hexdigest())
    return sorted(((i, *(row(f) if f else none)) for i, f in found), key=repr), counts, best


def test_alignment_of_odd_texts(spark, libraries):
    table = [(i, t) for i, t in enumerate(TEXTS)] + [(9, "the the"), (50, "the the"), (None, "the")]
    df = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, text string, n_a string").repartition(3)
    want, counts, best = alignment(libraries, table)
    got = tokenalign.align_documents(df, vocabulary_path(), pieces_path(), block_bytes=100, with_groups=True)
    assert rows(got.drop("groups")) == want
    assert {r["groups_sha256"] for r in got.collect() if r["groups"]} == {hashlib.sha256(r["groups"].encode()).hexdigest() for r in got.collect() if r["groups"]}
    pairs = tokenalign.link_counts(df, vocabulary_path(), pieces_path()).collect()
    assert {(r["a"], r["b"]): r["n"] for r in pairs} == counts and all(r["best"] == (r["n"] == best[r["b"]]) for r in pairs)
    assert tokenalign.align_documents(df.limit(0), vocabulary_path(), pieces_path()).collect() == []


def test_alignment_of_the_whole_table(spark, sf, libraries):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op13_token_alignment"](spark, sf)) == alignment(libraries, table)[0]


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("ab Z'1.　\n▁é語\x85"), max_size=30))
def test_chunks_have_the_tokens_of_the_whole(libraries, text):
    with open(vocabulary_path(), encoding="utf-8") as f, open(pieces_path(), "rb") as g:
        first, second = tokenalign._tokenizers(f.read(), g.read())
    chunks = tokenalign.cut_text(text)
    assert "".join(chunks) == " " + text
    whole = libraries(text)
    done = tokenalign.Chunks(chunks, first, second)
    assert done.good.all() == (whole is not None) or not text
    if whole:
        assert b"".join(done.text)[:-1].decode() == whole[2] and len(done.pairs) == len(whole[3])


@settings(deadline=None, max_examples=100)
@given(st.lists(st.booleans(), min_size=1, max_size=300))
def test_rank_and_select(flags):
    flags[-1] = True
    places = np.flatnonzero(flags)
    bits = tokenalign.Bits.at(places, len(flags))
    assert bits.select().tolist() == places.tolist()
    every = np.arange(len(flags))
    assert bits.rank(every).tolist() == [int((places < i).sum()) for i in every]
