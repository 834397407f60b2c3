"""Two tokenizers' tokens of one text, aligned by bitsets over its bytes.

Every byte of a text is a bit; a tokenizer's bitset has the bits on which its tokens end. AND of the two gives the cuts that both
share, and these close the groups; OR gives the ends of links: between two of its bits lies exactly one token of either kind, and
each pair that overlaps lies between two of them once. Popcounts before a bit (rank) say which tokens a cut or link belongs to.

A text is cut before single spaces between other characters first: both tokenizers always cut there (the loader checks that of
the second vocabulary), so equal chunks have equal tokens, groups and links wherever they stand. Texts are gathered in blocks of
``BLOCK_BYTES``; a block encodes each of its distinct chunks once, and aligns all of them in one bitset.

How often a pair of ids is linked in the corpus comes from the blocks' own counts, summed in Spark; the sums go back to the blocks by
a join on pairs, one row for a pair and block. No vocabulary-sized table is held in a task, and rows grow with the input.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import NEWER, PIECES, byte_letters
from .common import drop, fresh, keep, need

BLOCK_BYTES = 8 << 20
#: A single space between characters that are white space in no reading.
_CUT = re.compile(r"(?<=[^\s\x85▁]) (?=[^\s\x85▁])")
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class First:
    """The byte-level vocabulary (the content of its file): ids and bytes of tokens. Special tokens' strings are plain text."""

    def __init__(self, content: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(content)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i not in special}
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.whole = Tokenizer.from_str(content)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()
        order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        ranked = all(x < y for x, y in zip(order, order[1:]))  # then ids are ranks
        self.quick = tiktoken.Encoding("first", pat_str=PIECES.pattern, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={}) if ranked else None

    def encode(self, chunk: str) -> list[int]:
        if self.quick is None or NEWER.search(chunk):  # letters that libraries may class by different versions of Unicode
            return self.whole.encode(chunk, add_special_tokens=False).ids
        return self.quick.encode_ordinary(chunk)


class Second:
    """The vocabulary of pieces with byte fallback (its file's bytes); the library adds the space before a text itself."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece goes on after a space: texts can't be cut at spaces")
        self.bytes = [bytes([int(m[1], 16)]) if self.model.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks, num_threads=1)


@lru_cache(maxsize=1)
def _tokenizers(first: str, second: bytes) -> tuple[First, Second]:
    return First(first), Second(second)


def cut_text(text: str) -> list[str]:
    """A space and the text, in chunks that both tokenizers take one by one; each begins with a space."""
    first, *rest = _CUT.split(text)
    return [" " + first, *(" " + c for c in rest)]


class Bits:
    """A bitset in 64-bit words with the number of bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-max(1, size) // 64) * 64, dtype=np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all set bits, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def align(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``size`` bytes whose last bit is an end of both: the cuts; the tokens of either kind that end up to each; the links' two tokens."""
    a, b = Bits.at(ends_a, size), Bits.at(ends_b, size)
    cuts = Bits(a.words & b.words).select()
    links = Bits(a.words | b.words).select()
    return cuts, a.rank(cuts) + 1, b.rank(cuts) + 1, a.rank(links), b.rank(links)


def _digits(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal ids, each followed by its mark, as one string; and where each begins."""
    width = len(str(int(ids.max(initial=0))))
    powers = 10 ** np.arange(width - 1, -1, -1)
    grid = np.empty((len(ids), width + 1), dtype=np.uint8)
    grid[:, :width] = ids[:, None] // powers % 10 + 48
    grid[:, width] = marks
    show = np.ones(grid.shape, dtype=bool)
    show[:, : width - 1] = ids[:, None] >= powers[: width - 1]
    return grid[show].tobytes(), np.concatenate([[0], np.cumsum(show.sum(1))])


class Chunks:
    """Tokens, groups and links of distinct chunks; arrays of places have one entry more than there are chunks."""

    def __init__(self, chunks: list[str], first: First, second: Second):
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        tokens_a, tokens_b = [first.encode(c) for c in chunks], second.encode([c[1:] for c in chunks])
        whole = lambda tokens, bytes_: b"".join([bytes_[t] for t in tokens])
        self.good = np.array([whole(a, first.bytes) == r == whole(b, second.bytes) for r, a, b in zip(raw, tokens_a, tokens_b)], dtype=bool)
        for i in np.flatnonzero(~self.good).tolist():
            tokens_a[i], tokens_b[i], raw[i] = [], [], b""
        flat = lambda tokens: np.fromiter(chain.from_iterable(tokens), dtype=np.int64)
        places = lambda parts: np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))])
        ends = lambda tokens, bytes_: np.cumsum(np.array([len(t) for t in bytes_])[tokens]) - 1
        a, b, last = flat(tokens_a), flat(tokens_b), places(raw)
        self.at_a, self.at_b = places(tokens_a), places(tokens_b)
        cuts, to_a, to_b, link_a, link_b = align(ends(a, first.bytes), ends(b, second.bytes), int(last[-1]))
        self.groups = np.searchsorted(cuts, last - 1, side="right")
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        group_a, group_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
        ids, marks = np.empty(len(a) + len(b), dtype=np.int64), np.full(len(a) + len(b), ord(","), dtype=np.uint8)
        ids[np.arange(len(a)) + (to_b - n_b)[group_a]] = a  # each group: its tokens of A, a bar, its tokens of B, a semicolon
        ids[np.arange(len(b)) + to_a[group_b]] = b
        marks[to_a + to_b - n_b - 1], marks[to_a + to_b - 1] = ord("|"), ord(";")
        text, begins = _digits(ids, marks)
        at = begins[self.at_a + self.at_b].tolist()
        self.text = [text[i:j] for i, j in zip(at, at[1:])]
        self.links = link_a.searchsorted(self.at_a)  # a chunk's links begin with its first token's
        self.pairs = (a[link_a] << 32) | b[link_b]


_DOC, _BLOCK = 0, 1
_TABLE = "kind int, block long, ids array<string>, n_a long, n_b long, n_groups long, n_links long, sha string, groups string, chunks binary, pairs array<long>, ns array<long>, links binary, places binary"
_pack = lambda numbers: zlib.compress(np.asarray(numbers, dtype=np.int32).tobytes(), 1)
_unpack = lambda raw: np.frombuffer(zlib.decompress(raw), dtype=np.int32)


def _block(block: int, texts: dict[str, list], first: First, second: Second, with_groups: bool) -> pd.DataFrame:
    """A row for each distinct text of a block, and one of the block itself: its pairs, their counts, and each chunk's links."""
    known: dict[str, int] = {}
    deal = [np.array([known.setdefault(c, len(known)) for c in cut_text(t)] if t else [], dtype=np.int64) for t in texts]
    chunks = Chunks(list(known), first, second)
    sums = [np.diff(x) for x in (chunks.at_a, chunks.at_b, chunks.groups, chunks.links)]
    times, out = np.zeros(len(known), dtype=np.int64), []
    for own, ids in zip(deal, texts.values()):
        if len(own) and chunks.good[own].all():
            np.add.at(times, own, len(ids))
            groups = b"".join([chunks.text[i] for i in own.tolist()])[:-1]
            out.append((_DOC, block, ids, *(int(x[own].sum()) for x in sums), hashlib.sha256(groups).hexdigest(), groups.decode() if with_groups else None, _pack(own), None, None, None, None))
        else:
            out.append((_DOC, block, ids, 0, 0, 0, 0, "", "" if with_groups else None, None, None, None, None, None))
    pairs, link = np.unique(chunks.pairs, return_inverse=True)
    ns = np.zeros(len(pairs), dtype=np.int64)
    np.add.at(ns, link, np.repeat(times, sums[3]))
    out.append((_BLOCK, block, None, None, None, None, None, None, None, None, pairs.tolist(), ns.tolist(), _pack(link), _pack(chunks.links)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _TABLE.split(", ")]).astype({c: "Int64" for c in ("n_a", "n_b", "n_groups", "n_links")})


def _aligned(sent, block_bytes: int, with_groups: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = _tokenizers(*sent.value)
        block, size, texts = TaskContext.get().partitionId() << 32, 0, {}
        for batch in batches:
            for an_id, text in zip(batch["doc_id"], batch["text"]):
                if text not in texts:
                    texts[text] = []
                    size += 4 * len(text or "")  # bytes at most
                texts[text].append(an_id)
                size += 64
                if size >= 4 * block_bytes:
                    yield _block(block, texts, first, second, with_groups)
                    block, size, texts = block + 1, 0, {}
        if texts:
            yield _block(block, texts, first, second, with_groups)

    return run


def _blocks(docs: DataFrame, first_path: str, second_path: str, id_col: str, text_col: str, block_bytes: int, with_groups: bool = False) -> DataFrame:
    need(docs, id_col, text_col)
    with open(first_path, encoding="utf-8") as f, open(second_path, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return keep(rows.mapInPandas(_aligned(sent, block_bytes, with_groups), _TABLE))


def _asked(blocks: DataFrame) -> DataFrame:
    """A row for each pair of a block."""
    each = blocks.filter(F.col("kind") == _BLOCK).select("block", F.posexplode(F.arrays_zip("pairs", "ns")).alias("place", "of"))
    return each.select("block", "place", F.col("of.pairs").alias("pair"), F.col("of.ns").alias("n")).filter("n > 0")


def _rated(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: each pair's links in the corpus, and whether no other pair of its token of B has more."""
    counts = keep(_asked(blocks).groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each piece of the vocabulary at most
    rated = counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    rated._kept = counts
    return rated


def _sums(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Each text's links that are the best of their token of B, and the counts of all its links."""
    out = []
    if not pdf.empty:
        whole = pdf[pdf["kind"] == _BLOCK].iloc[0]
        link, places = _unpack(whole["links"]), _unpack(whole["places"])
        n, best = np.zeros(len(whole["pairs"]), dtype=np.int64), np.zeros(len(whole["pairs"]), dtype=np.int64)
        n[answers["place"]], best[answers["place"]] = answers["n"], answers["best"]
        run = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[link])])[places])
        best, n = run(best), run(n)
        for r in pdf[pdf["kind"] == _DOC].itertuples():
            own = _unpack(r.chunks) if r.chunks is not None else np.empty(0, dtype=np.int32)
            rest = (int(r.n_a), int(r.n_b), int(r.n_groups), int(r.n_links), int(best[own].sum()), int(n[own].sum()), r.sha, r.groups)
            out += [(i, *rest) for i in r.ids]
    return pd.DataFrame(out, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])


def align_documents(docs: DataFrame, first_path: str, second_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row, and ``groups`` on request.

    A: byte-level tokens of a space and the text; B: pieces of the text (whose library adds the space). Groups lie between bytes where
    tokens of both end: ``a1,a2|b1;a3|b2`` in decimal ids. Links: all pairs of a token of A and one of B whose bytes overlap; a pair's
    count is how many links of the corpus have its ids; ``n_best``: links whose count is the highest of their token of B (ties
    included); ``count_sum``: the sum of counts over the links. Null and empty texts, and texts that either side doesn't give back byte
    for byte, have no tokens: zeros, and an empty ``groups_sha256``. Repeated rows count each. Empty tables: no rows.
    """
    blocks = _blocks(docs, first_path, second_path, id_col, text_col, block_bytes, with_groups)
    rated = _rated(blocks)
    answers = _asked(blocks).select(F.col("block").alias("at"), "place", "pair").join(rated, "pair").select("at", "place", "n", "best")
    mine = blocks.select("kind", "block", "ids", "n_a", "n_b", "n_groups", "n_links", "sha", "groups", "chunks", "pairs", "links", "places")
    kind = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    out = keep(mine.groupBy("block").cogroup(answers.groupBy("at")).applyInPandas(_sums, kind))
    drop(rated._kept)
    drop(blocks)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType)).drop(*([] if with_groups else ["groups"]))


def link_counts(docs: DataFrame, first_path: str, second_path: str, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``a, b, n, best``: every pair of ids that is linked anywhere, how often, and whether it is its ``b``'s most frequent one."""
    (an_id,) = fresh(docs, "_id")
    rated = _rated(_blocks(docs.withColumn(an_id, F.lit(0)), first_path, second_path, an_id, text_col, block_bytes))
    return rated.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n", "best")
