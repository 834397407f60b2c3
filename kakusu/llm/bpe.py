"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

1. Every piece of every text is counted; the most frequent ones (a documented, fixed number) form the lexicon.
2. The lexicon is compiled into a minimal acyclic automaton that shares prefixes and suffixes. Each edge says how many
   entries precede it, so a walk yields the entry's number and with it the entry's token ids.
3. The automaton is one file that Spark ships to each executor once; its Python workers memory-map it.
4. Pieces that the lexicon lacks are merged exactly by rank. The lexicon only saves time: it never changes a result.

Decoding goes from ids back to bytes through the vocabulary, and from bytes to text.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, need
from .common import keep as kept

#: How a text is cut before merging: the rule of byte-level vocabularies. A fixed value.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Up to U+052F and within U+1E00-U+206E letters and digits are the same for all Unicode versions in use; other texts are cut by the library.
NEWER = re.compile("[^\u0000-ԯḀ-ỿ‐-⁤₠-€]")
LEXICON_SIZE = 131_072
_FLUSH = 600_000
_EDGE = struct.Struct("<BI")
#: The driver's folder of the files that it serves to executors.
_SERVED: list[tempfile.TemporaryDirectory] = []


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merge ranks and special tokens of a byte-level BPE file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.parts = {str(i): t for t, i in self.ids.items()} | {str(i): s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece: the pair of lowest rank is joined, leftmost first, until no pair has a rank."""
        if len(piece) > 200:
            return self._merge_long([piece[i : i + 1] for i in range(len(piece))])
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank, none = self.ranks.get, 1 << 60
        found = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while found and (best := min(found)) < none:
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i < len(found):
                found[i] = rank((parts[i], parts[i + 1]), none)
            if i:
                found[i - 1] = rank((parts[i - 1], parts[i]), none)
        return [self.ids[p] for p in parts]

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same for very long pieces, with a heap of pairs over a linked list: n log n steps."""
        import heapq

        n = len(parts)
        token: list[bytes | None] = list(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((token[x], token[y]))) is not None:
                    heapq.heappush(heap, (r, x, token[x], token[y]))
        return [self.ids[t] for t in token if t is not None]

    def decode(self, ids_text: str) -> bytes:
        """Bytes of comma-joined ids; special tokens stay as their text."""
        return b"".join(map(self.parts.__getitem__, ids_text.split(","))) if ids_text else b""


def compile_lexicon(entries: dict[bytes, str]) -> bytes:
    """Piece -> comma-joined ids, as the file that :class:`Lexicon` maps.

    States are made minimal as sorted words arrive: once a branch can't grow any more, it is replaced by an equal one
    made before. Layout: five counts, then the arrays first, final, label, target, skip, offsets, and the joined ids.
    """
    words = sorted(entries)
    made: dict[bytes, int] = {}  # a state as bytes: is it final, its edges; in the order in which they are made

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        return made.setdefault(bytes([final]) + b"".join(_EDGE.pack(*e) for e in edges), len(made))

    path: list[list] = [[False, []]]  # of the last word: is the state final, edges so far
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, edges)))

    for word in words:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        close(same)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(*path[0])

    count = array("I", bytes(4 * len(made)))  # entries that can be reached; children come before parents
    first, final, label, target, skip = array("I", [0]), array("I"), array("I"), array("I"), array("I")
    for k, state in enumerate(made):
        n = state[0]
        for byte, child in _EDGE.iter_unpack(state[1:]):
            label.append(byte)
            target.append(child)
            skip.append(n)
            n += count[child]
        count[k] = n
        final.append(state[0])
        first.append(len(label))
    ids = [entries[w].encode() for w in words]
    offsets = array("I", [0])
    for x in ids:
        offsets.append(offsets[-1] + len(x))
    pack = lambda v: struct.pack(f"<{len(v)}I", *v)
    return struct.pack("<3I", len(made), len(label), len(words)) + pack([root]) + pack(first) + pack(final) + pack(label) + pack(target) + pack(skip) + pack(offsets) + b"".join(ids)


class Lexicon:
    """The memory-mapped automaton."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        states, edges, words = struct.unpack_from("<3I", view)
        at = 12
        arrays = []
        for n in (1, states + 1, states, edges, edges, edges, words + 1):
            arrays.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        root, self.first, self.final, self.label, self.target, self.skip, self.offsets = arrays
        self.root, self.ids, self.states, self.words = root[0], view[at:], states, words

    def get(self, word: bytes) -> str | None:
        """Comma-joined ids of ``word``, or None if the lexicon lacks it."""
        state, number = self.root, 0
        for byte in word:
            end = self.first[state + 1]
            k = bisect_left(self.label, byte, self.first[state], end)
            if k == end or self.label[k] != byte:
                return None
            number += self.skip[k]
            state = self.target[k]
        if not self.final[state]:
            return None
        return bytes(self.ids[self.offsets[number] : self.offsets[number + 1]]).decode()


class Encoder(dict):
    """Piece -> comma-joined ids, remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, tokenizer=None):
        super().__init__()
        self.vocabulary, self.lexicon, self.cutter = vocabulary, lexicon, tokenizer

    def __missing__(self, piece: str) -> str:
        raw = piece.encode()
        found = self.lexicon.get(raw) if self.lexicon else None
        if found is None:
            found = ",".join(map(str, self.vocabulary.merge(raw)))
        if len(piece) <= 64:
            self[piece] = found
        return found

    def cut(self, text: str) -> list[str]:
        if text.isascii() or not NEWER.search(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def encode(self, text: str) -> str:
        """Comma-joined ids of a whole text; strings of special tokens become these tokens."""
        if len(self) > _FLUSH:
            self.clear()
        v = self.vocabulary
        if v.split_special is None or not any(s in text for s in v.special):
            return ",".join(map(self.__getitem__, self.cut(text)))
        out = []
        for part in v.split_special.split(text):
            if part in v.special:
                out.append(str(v.special[part]))
            elif part:
                out.extend(map(self.__getitem__, self.cut(part)))
        return ",".join(out)


def _cutter():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=True)


_WORKER: dict[str, Encoder] = {}


def _encoder(vocabulary_file: str, lexicon_file: str) -> Encoder:
    """One for each Python worker and lexicon."""
    if lexicon_file not in _WORKER:
        _WORKER.clear()
        with open(SparkFiles.get(vocabulary_file), encoding="utf-8") as f:
            _WORKER[lexicon_file] = Encoder(Vocabulary(f.read()), Lexicon(SparkFiles.get(lexicon_file)), _cutter())
    return _WORKER[lexicon_file]


def _count_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def out(chunks: Counter) -> pd.DataFrame:
        pieces: Counter = Counter()
        for chunk, n in chunks.items():
            if chunk.isalpha():
                pieces[" " + chunk] += n
            else:
                for p in PIECES.findall(" " + chunk):
                    pieces[p] += n
        return pd.DataFrame({"piece": list(pieces), "n": list(pieces.values())})

    chunks: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            if text:
                chunks.update(text.split())
            if len(chunks) > _FLUSH:
                yield out(chunks)
                chunks = Counter()
    if chunks:
        yield out(chunks)


def _compiled(vocabulary_file: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(SparkFiles.get(vocabulary_file), encoding="utf-8") as f:
            vocabulary = Vocabulary(f.read())
        yield pd.DataFrame({"lexicon": [compile_lexicon({(raw := p.encode()): ",".join(map(str, vocabulary.merge(raw))) for batch in batches for p in batch["piece"]})]})

    return run


def fit_lexicon(docs: DataFrame, vocabulary_file: str, text_col: str = "text", size: int = LEXICON_SIZE) -> bytes:
    """Counts the pieces of all texts and compiles the most frequent ones: all that occur often enough for ``size`` at most.

    The least count comes from a histogram of counts, so no more than ``size`` pieces are compiled, however many tasks there are. A task
    does that, with the vocabulary that Spark has served as ``vocabulary_file``; the driver gets the compiled file, a few MB.
    """
    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(_count_pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = kept(counts.filter(F.length("piece") <= 64))
    step = F.when(F.col("n") < 512, F.col("n")).otherwise(512 + F.floor(16 * F.log2(F.col("n") / 512)))
    room, least = size, 1 << 62
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("pieces"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():  # below 1400 steps
        room -= r["pieces"]
        if room < 0:
            break
        least = r["least"]
    top = counts.filter(F.col("n") >= least).select("piece").repartition(1)  # at most size
    row = top.mapInPandas(_compiled(vocabulary_file), "lexicon binary").first()
    drop(counts)
    return bytes(row["lexicon"]) if row else compile_lexicon({})


def encode_documents(docs: DataFrame, vocabulary_path: str, text_col: str = "text", lexicon_size: int = LEXICON_SIZE, with_text: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with ``n_tokens`` and digests of ids and decoded text.

    ``ids_sha256``: of the decimal ids joined by commas; ``decoded_sha256``: of the text decoded from these ids, as
    UTF-8. ``with_text`` adds ``ids`` (array<int>) and ``decoded`` (string). A null or empty text has no tokens. Repeated
    rows give repeated rows; no shuffle follows the counting pass.
    """
    need(docs, text_col, *keep)
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary_path)
    file = os.path.basename(vocabulary_path)
    lexicon = fit_lexicon(docs, file, text_col, lexicon_size)
    name = f"lexicon-{hashlib.sha256(lexicon).hexdigest()[:24]}.bin"
    if not _SERVED:
        _SERVED.append(tempfile.TemporaryDirectory(prefix="kakusu-lexicon-"))  # goes when the program ends
    if not os.path.exists(path := os.path.join(_SERVED[0].name, name)):
        with open(path, "wb") as f:
            f.write(lexicon)
    spark.sparkContext.addFile(path)  # Spark serves it to every executor, also to those that come later

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(file, name)
        sha = hashlib.sha256
        for batch in batches:
            n, ids_sha, text_sha, ids_out, text_out = [], [], [], [], []
            for text in batch.pop("_text_in"):
                ids = encoder.encode(text) if text else ""
                raw = encoder.vocabulary.decode(ids)
                if with_text:
                    ids_out.append([int(x) for x in ids.split(",")] if ids else [])
                    text_out.append(raw.decode("utf-8", "replace"))
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(sha(ids.encode()).hexdigest())
                try:
                    raw.decode("utf-8")
                except UnicodeDecodeError:  # not from a text; as the library does
                    raw = raw.decode("utf-8", "replace").encode()
                text_sha.append(sha(raw).hexdigest())
            batch["n_tokens"], batch["ids_sha256"], batch["decoded_sha256"] = n, ids_sha, text_sha
            if with_text:
                batch["ids"], batch["decoded"] = ids_out, text_out
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(*keep, F.col(text_col).alias("_text_in")).mapInPandas(run, schema + (", ids array<int>, decoded string" if with_text else ""))


def decode_ids(df: DataFrame, vocabulary_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with the column ``decoded``: the text of an array of ids (null: null, none: empty)."""
    spark = df.sparkSession
    spark.sparkContext.addFile(vocabulary_path)
    file = os.path.basename(vocabulary_path)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        with open(SparkFiles.get(file), encoding="utf-8") as f:
            v = Vocabulary(f.read())
        return ids.map(lambda x: None if x is None else v.decode(",".join(map(str, x))).decode("utf-8", "replace"))

    return df.withColumn("decoded", decode(F.col(ids_col)))
