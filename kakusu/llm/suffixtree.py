"""Language-model scores from a probabilistic suffix tree.

A text is the stream of its words' bytes, lower-cased, a space between words and one end symbol (byte 10, which no word
holds). The tree's states are variable-length contexts of preceding symbols, up to ``DEPTH``, which with the next symbol fit a
64-bit number. A context is considered if it occurs ``LEAST`` times - a constant, so that the tree grows with the input. Contexts
of up to ``CLOSE`` symbols are states; a longer one is retained if its next symbols diverge from those of its parent (the context
without its oldest symbol): count times relative entropy in nats must exceed the number of its kinds of next symbols by two.
Ancestors of retained contexts stay. Distributions are smoothed towards the parent's by the number of kinds seen (Witten-Bell).
A text is scored along its longest suffix states.

Rows are taken into blocks of about ``BLOCK_BYTES`` as the scan brings them, one packed row for each block. A block sends its distinct
runs of DEPTH + 1 symbols, with their counts in training rows, to buckets by the last CLOSE + 1 symbols of the context, and its distinct
words to buckets by hash. All longer states of a bucket's runs are in that bucket, so each bucket grows its part of the tree alone and
answers the blocks; only the levels up to CLOSE, at most 256 ** (CLOSE + 1) runs, are handed to every task. Nothing is held whole
anywhere: not the tree, not the words. Runs are several times as large as the texts, so the buckets take turns: in each of ``TURNS``
rounds the blocks ask a share of them, and only sums by text stay of the answers.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fold_of, keep, mix, need, word_hashes, words_of

DEPTH = 7
LEAST = 2
CLOSE = 2
BLOCK_BYTES = 8 << 20
#: Rounds of questions and answers: what is on disk at once is about 1 / TURNS of all runs.
TURNS = 2
#: The levels up to CLOSE are summed up in so many parts first.
PARTS = 64
_CHUNK = 1 << 20
PLACES = 64
_TABLE = mix(np.arange(1, 256 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_END = b"\n"
_SIZES = struct.Struct("<QB")
_U8 = np.uint64(8)
_NO_KEYS, _NO_COUNTS = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + _END


def runs(symbols: bytes, depth: int) -> np.ndarray:
    """For each symbol that follows the first ``depth`` ones: these and itself in one number, itself in the low byte."""
    n = max(0, len(symbols) - depth)
    padded = bytes(8) + symbols  # eight bytes end with each symbol
    return np.ndarray(n, ">u8", padded, depth + 1 if n else 0, (1,)).astype(np.uint64) & _low(depth + 1)


def tabulated(symbols: bytes) -> np.ndarray:
    """A hash of each word: the sum of a random number for each byte and its place. Words of more than ``PLACES`` bytes: xxh3."""
    raw = np.frombuffer(symbols, dtype=np.uint8)
    gap = (raw == 0x20) | (raw == _END[0])
    edges = np.flatnonzero(np.diff(~gap, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # about _CHUNK bytes at once
        till = max(at + 1, int(np.searchsorted(starts, starts[at] + _CHUNK)))
        a, b = starts[at], ends[till - 1]
        place = np.arange(a, b) - np.repeat(starts[at:till], np.diff(starts[at:till], append=b))
        part = np.where(gap[a:b], np.uint64(0), _TABLE[np.minimum(place, PLACES - 1) << 8 | raw[a:b]])
        out[at:till] = np.add.reduceat(part, starts[at:till] - a)
        at = till
    long = np.flatnonzero(ends - starts > PLACES)
    out[long] = word_hashes([symbols[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist())])
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """As a stable argsort, by the low and then the high half with places behind it: plain sorting, not by index, is what is fast."""
    place, low = np.arange(len(keys), dtype=np.uint64), np.uint64(0xFFFFFFFF)
    first = np.sort(keys << np.uint64(32) | place) & low
    return first[np.sort(keys[first] & ~low | place) & low]


def _tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often they come or the sums of their weights."""
    if (keys[1:] >= keys[:-1]).all():  # there already
        pass
    elif weights is None:
        keys = np.sort(keys)
    else:
        order = _order(keys)
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else _NO_COUNTS
    counts = np.diff(np.append(first, len(keys))) if weights is None else (np.add.reduceat(weights, first) if len(first) else weights)
    return keys[first], counts.astype(np.int64)


def _squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers byte plane by byte plane, without upper planes of zeros; ascending ones as their differences. Before them: how many, planes."""
    values = np.diff(values, prepend=values.dtype.type(0)) if ascending else np.ascontiguousarray(values)
    bits = values.view(f"<u{values.itemsize}")
    planes = (int(bits.max(initial=0)).bit_length() + 7) // 8
    raw = np.empty((planes, len(bits)), dtype=np.uint8)
    for k in range(planes):
        raw[k] = bits >> bits.dtype.type(8 * k)
    return _SIZES.pack(len(bits), planes) + pa.compress(raw.reshape(-1), codec="zstd", asbytes=True)


def _loosen(raw: bytes, kind, ascending: bool = False) -> np.ndarray:
    n, planes = _SIZES.unpack_from(raw)
    bits = np.zeros(n, dtype=f"<u{np.dtype(kind).itemsize}")
    if planes and n:
        rows = np.frombuffer(pa.decompress(memoryview(raw)[_SIZES.size :], n * planes, codec="zstd"), dtype=np.uint8).reshape(planes, n)
        for k in range(planes - 1, -1, -1):
            bits <<= bits.dtype.type(8)
            bits |= rows[k]
    values = bits.view(kind)
    return np.cumsum(values, dtype=kind, out=values) if ascending else values


def _low(k: int) -> np.uint64:
    """A mask of ``k`` symbols."""
    return np.uint64((1 << (8 * k)) - 1)


def _bucket(spread: np.ndarray, buckets: int) -> np.ndarray:
    return (((spread * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _dealt(spread: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that gets some of the numbers, and where these are, in their order."""
    bucket = _bucket(spread, buckets)
    bucket = bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket  # which sort by digits
    order = np.argsort(bucket, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order)) if len(order) else _NO_COUNTS
    start = 0
    for end in ends:
        yield int(bucket[order[start]]), order[start:end]
        start = end


class Levels:
    """States of ``low`` to ``high`` symbols among the runs ``keys``; the shorter ones are in ``above``."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: int, high: int, least: float, above: Levels | None = None):
        self.low, self.high, self.above, self.at = low, high, above, {}
        run, n = keys, counts
        for k in range(high, low - 1, -1):
            run, n = _tally(run & _low(k + 1), n)
            context, kinds = _tally(run >> _U8)
            c = _tally(run >> _U8, n)[1]
            good = (c >= least) | (k == 0)
            rows = np.repeat(good, kinds)
            self.at[k] = {"run": run[rows], "n": n[rows], "context": context[good], "c": c[good], "kinds": kinds[good]}
        for k in range(low, high + 1):
            x, up = self.at[k], self.at.get(k - 1) or (above.at[k - 1] if above else None)
            pp = up["p"][np.searchsorted(up["run"], x["run"] & _low(k))] if k else 1 / 256
            c, kinds = np.repeat(x["c"], x["kinds"]), np.repeat(x["kinds"], x["kinds"])
            x["p"] = (x["n"] + kinds * pp) / (c + kinds)
            first = np.cumsum(x["kinds"]) - x["kinds"]
            gain = np.add.reduceat(x["n"] * np.log(x["n"] / c / pp), first) if len(first) else np.empty(0)
            x["good"] = (gain > x["kinds"] + 2) if above else np.ones(len(x["c"]), dtype=bool)
        kept = _NO_KEYS
        for k in range(high, low - 1, -1):
            x = self.at[k]
            good = x["good"] | np.isin(x["context"], kept)
            rows = np.repeat(good, x["kinds"])
            x["edge"], x["log"] = x["run"][rows], np.log10(x["p"][rows])
            x["state"], x["rest"] = x["context"][good], np.log10((x["kinds"] / (x["c"] + x["kinds"]))[good])
            kept = _tally(x["state"] & _low(max(0, k - 1)))[0]

    def walk(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the low symbol of each run after the others, by its longest suffix state."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        level: Levels | None = self
        for k in range(self.high, -1, -1):
            level = level.above if level is not None and k < level.low else level
            if level is None or not len(left):
                break
            x, some = level.at[k], keys[left] & _low(k + 1)
            found, at = _find(x["edge"], some)
            out[left[found]] += x["log"][at[found]]
            left, some = left[~found], some[~found]
            known, at = _find(x["state"], some >> _U8)
            out[left[known]] += x["rest"][at[known]]  # no state: its suffix decides alone
        out[left] += np.log10(1 / 256)
        return out


def _find(where: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the ascending array, and at which place."""
    at = np.searchsorted(where, keys)
    found = at < len(where)
    found[found] = where[at[found]] == keys[found]
    return found, at


_TEXTS = "doc_id array<string>, held_out array<boolean>, times array<long>, sizes array<long>, n_words array<long>"
_PACKED = f"block long, {_TEXTS}, symbols binary, keys binary, counts binary"


def _pack(block_bytes: int, depth: int, close: int):
    """Rows as blocks: how often each is there, its symbols, and counts of the short runs in training rows."""

    def block(number: int, rows: Counter) -> tuple:
        words = [words_of(text) for _, _, text in rows]
        symbols = [stream(w) for w in words]
        sizes = np.array([len(x) for x in symbols])
        whole = _END * depth + b"".join(x + _END * max(0, depth - 1) for x in symbols)
        doc_id, held_out = [list(x) for x in zip(*((d, h) for d, h, _ in rows))]
        times = np.fromiter(rows.values(), dtype=np.int64, count=len(rows))
        found = [(k & _low(close + 1), owner) for k, owner in _runs_of(whole, sizes, depth)]
        weights = np.where(held_out, 0, times)
        top, counts = _counted(*(np.concatenate(x) for x in zip(*found)), weights)
        top, counts = top[counts > 0], counts[counts > 0]
        return number, doc_id, held_out, times, sizes, [len(w) for w in words], zlib.compress(whole, 1), _squeeze(top, True), _squeeze(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, size, rows = TaskContext.get().partitionId() << 32, 0, Counter()
        columns = [c.split()[0] for c in _PACKED.split(", ")]
        for batch in batches:
            for row in zip(batch["doc_id"], batch["held_out"], batch["text"]):
                rows[row] += 1
                size += len(row[2].encode("utf-8", "surrogatepass")) if rows[row] == 1 else 0
                if size >= block_bytes:
                    yield pd.DataFrame([block(number, rows)], columns=columns)
                    number, size, rows = number + 1, 0, Counter()
        if rows:
            yield pd.DataFrame([block(number, rows)], columns=columns)

    return run


def _runs_of(symbols: bytes, sizes: np.ndarray, depth: int, mine=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the texts of a block in their order, of those that ``mine`` takes, and the numbers of their texts; in chunks."""
    gap = max(0, depth - 1)
    edges = np.cumsum(np.stack([sizes, np.full(len(sizes), gap)], axis=1).reshape(-1))  # between texts are ends only
    texts, inside = np.arange(len(edges), dtype=np.int32) >> 1, np.arange(len(edges)) % 2 == 0
    for at in range(0, len(symbols) - depth, _CHUNK):
        keys = runs(symbols[at : at + _CHUNK + depth], depth)
        each = np.diff(np.clip(edges, at, at + len(keys)), prepend=at)
        owner, good = np.repeat(texts, each), np.repeat(inside, each)
        good = good & mine(keys[: len(owner)]) if mine else good
        yield keys[: len(owner)][good], owner[good]


def _counted(keys: np.ndarray, owner: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of the weights of the texts that they are in. Plain sorting, not by index, is what is fast."""
    each = [(*_tally(keys), 0)] if (weights == 0).all() else []
    if not each:
        of = weights[owner]
        each = [(*_tally(keys[of == t]), t) for t in set(weights.tolist())]
    return _tally(np.concatenate([k for k, _, _ in each]), np.concatenate([c * t for _, c, t in each])) if len(each) > 1 else (each[0][0], each[0][1] * each[0][2])


class _Turn:
    """What the buckets of one turn are asked: which runs and words of a block, in which order."""

    def __init__(self, depth: int, close: int, buckets: int, turn: int, turns: int):
        self.depth, self.close, self.buckets, self.turn, self.turns = depth, close, buckets, turn, turns

    def spread(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U8) & _low(self.close + 1)

    def runs(self, symbols: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = (lambda k: _bucket(self.spread(k), self.buckets) % self.turns == self.turn) if self.turns > 1 else None
        found = list(_runs_of(symbols, sizes, self.depth, mine))
        return np.concatenate([_NO_KEYS, *(k for k, _ in found)]), np.concatenate([np.empty(0, dtype=np.int32), *(o for _, o in found)])

    def words(self, symbols: bytes, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words of a block are the first turn's."""
        return tabulated(symbols), np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)


_ASKED = "kind int, bucket long, block long, keys binary, counts binary"
_WORD, _RUN = range(2)


def _ask(turn: _Turn):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What each block asks: its distinct words and runs, with counts in training rows."""
        for batch in batches:
            for r in batch.itertuples():
                symbols, weights = zlib.decompress(r.symbols), np.where(r.held_out, 0, r.times)
                out = []
                if turn.turn == 0:
                    keys, counts = _counted(*turn.words(symbols, r.n_words), weights)
                    out += [(_WORD, b, r.block, _squeeze(keys[at], True), _squeeze(counts[at])) for b, at in _dealt(keys, turn.buckets)]
                keys, counts = _counted(*turn.runs(symbols, r.sizes), weights)
                out += [(_RUN, b, r.block, _squeeze(keys[at], True), _squeeze(counts[at])) for b, at in _dealt(turn.spread(keys), turn.buckets)]
                yield pd.DataFrame(out, columns=["kind", "bucket", "block", "keys", "counts"])

    return run


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    each = [_loosen(k, np.uint64, True) for k in pdf["keys"]]
    return _tally(np.concatenate([_NO_KEYS, *each]), np.concatenate([_NO_COUNTS, *(_loosen(c, np.int64) for c in pdf["counts"])]))


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    keys, counts = _summed(pdf)
    return pd.DataFrame({"bucket": [0], "keys": [_squeeze(keys, True)], "counts": [_squeeze(counts)]})


def short_levels(packed: DataFrame, close: int, least: float) -> Levels:
    """The levels up to ``close``: at most 256 ** (close + 1) runs come to the driver."""
    added = packed.select((F.xxhash64("block") % PARTS).alias("bucket"), "keys", "counts").groupBy("bucket").applyInPandas(_add_up, "bucket long, keys binary, counts binary")
    row = added.groupBy("bucket").applyInPandas(_add_up, "bucket long, keys binary, counts binary").first()
    if row is None:
        return Levels(_NO_KEYS, _NO_COUNTS, 0, close, least)
    return Levels(_loosen(row["keys"], np.uint64, True), _loosen(row["counts"], np.int64), 0, close, least)


_ANSWERED = "kind int, bucket long, at long, found binary, tokens long, kinds long"


def _answer(depth: int, close: int, least: float, short):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket's answers to the blocks: counts of words, or log10 probabilities of runs by its part of the tree.

        The first answer of a bucket of words has the number of its words in training rows, and of its kinds of them.
        """
        each = [_loosen(k, np.uint64, True) for k in pdf["keys"]]
        starts = np.cumsum([0, *map(len, each)])
        every = np.concatenate([_NO_KEYS, *each])
        del each
        order = _order(every)
        every = every[order]
        first = np.concatenate([[True], every[1:] != every[:-1]])[: len(every)]
        keys = every[first]
        del every
        place = np.empty(len(order), dtype=np.int32)  # of each asked key among the different ones
        place[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
        counts = np.concatenate([_NO_COUNTS, *(_loosen(c, np.int64) for c in pdf["counts"])])[order]
        counts = np.add.reduceat(counts, np.flatnonzero(first)) if len(counts) else counts
        del order, first
        known = counts > 0
        if key[0] == _WORD:
            values, total = counts, (int(counts.sum()), int(known.sum()))
        else:
            tree = Levels(keys[known], counts[known], close + 1, depth, least, short.value)
            values, total = tree.walk(keys).astype(np.float32), (0, 0)
        out = [(key[0], key[1], block, _squeeze(values[place[a:b]]), *(total if i == 0 else (0, 0))) for i, (block, a, b) in enumerate(zip(pdf["block"], starts, starts[1:]))]
        return pd.DataFrame(out, columns=["kind", "bucket", "at", "found", "tokens", "kinds"])

    return run


_SCORED = "block long, i long, doc_id string, held_out boolean, times long, n_tokens long, n_known long, logs double, tokens long, kinds long, turn int, score double"


def _score(turn: _Turn):
    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Sums over each text of a block; the answers are in the order in which the block asked."""
        given = {(k, b): f for k, b, f in zip(answers["kind"], answers["bucket"], answers["found"])}

        def asked(kind: int, keys: np.ndarray, spread, type_) -> np.ndarray:
            values = np.empty(len(keys), dtype=type_)
            for bucket, at in _dealt(spread(keys), turn.buckets):
                values[at] = _loosen(given[kind, bucket], type_)
            return values

        out = []
        for r in pdf.itertuples():  # one row
            symbols, n = zlib.decompress(r.symbols), len(r.sizes)
            total = lambda owner, values: np.bincount(owner, values, n)
            known, logs = np.zeros(n, dtype=np.int64), np.zeros(n)
            if turn.turn == 0:
                hashes, owner = turn.words(symbols, r.n_words)
                keys = _tally(hashes)[0]
                at = np.searchsorted(keys, hashes)
                c = asked(_WORD, keys, lambda k: k, np.int64)
                known, logs = total(owner, (c > 0)[at]).astype(np.int64), total(owner, np.log10(c + 0.1)[at])
                del hashes, owner, at
            found, owner = turn.runs(symbols, r.sizes)
            order = _order(found)  # equal runs have equal values: each text adds its own up from the least run on
            found, owner = found[order], owner[order]
            del order
            first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])[: len(found)])
            values = asked(_RUN, found[first], turn.spread, np.float32)
            sums = total(owner, np.repeat(values, np.diff(first, append=len(found))))
            counted = [[int(answers[c].sum()), *[0] * (n - 1)] for c in ("tokens", "kinds")]
            out.append(pd.DataFrame({"block": r.block, "i": np.arange(n), "doc_id": r.doc_id, "held_out": r.held_out, "times": r.times, "n_tokens": r.n_words + 1, "n_known": known, "logs": logs, "tokens": counted[0], "kinds": counted[1], "turn": turn.turn, "score": sums}))
        return pd.concat(out) if out else pd.DataFrame([], columns=[c.split()[0] for c in _SCORED.split(", ")])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, depth: int = DEPTH, least: float = LEAST, block_bytes: int = BLOCK_BYTES, turns: int = TURNS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    Tokens are words and one end. ``base_score`` is the add-0.1 unigram score with counts over the rows outside fold 0.
    A null text is empty: one end token. Repeated rows count each and score alike. Without training rows the tree knows
    nothing and every symbol has probability 1/256. Texts of any length are scored as a whole. Empty tables: no rows.
    """
    need(docs, id_col, text_col)
    close = min(CLOSE, depth)
    held_out = fold_of(F.col(id_col), folds) == 0
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    buckets = turns * max(1, -(-whole["bytes"] // block_bytes))
    packed = keep(rows.mapInPandas(_pack(block_bytes, depth, close), _PACKED))
    short = docs.sparkSession.sparkContext.broadcast(short_levels(packed, close, least))
    blocks, parts = packed.drop("keys", "counts"), []
    for k in range(turns):
        turn = _Turn(depth, close, buckets, k, turns)
        asked = blocks.select("block", "held_out", "times", "sizes", "n_words", "symbols").mapInPandas(_ask(turn), _ASKED)
        answers = asked.groupBy("kind", "bucket").applyInPandas(_answer(depth, close, least, short), _ANSWERED)
        parts.append(keep(blocks.groupBy("block").cogroup(answers.groupBy("at")).applyInPandas(_score(turn), _SCORED)))
    drop(packed)
    total = parts[0].agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds")).first()
    tokens, kinds = total["tokens"] + whole["ends"], total["kinds"] + int(whole["ends"] > 0)
    every = parts[0].drop("turn")
    for k, part in enumerate(parts[1:], 1):  # joined, not added up, so that sums have one order
        every = every.join(part.select("block", "i", F.col("score").alias(f"score_{k}")), ["block", "i"])
    score = sum((F.col(f"score_{k}") for k in range(1, turns)), F.col("score"))
    base = F.col("logs") + F.log10(F.lit(whole["ends"] + 0.1)) - F.col("n_tokens") * F.log10(F.lit(tokens + 0.1 * (kinds + 1)))
    every = every.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    n_known = (F.col("n_known") + int(whole["ends"] > 0)).cast("long")
    return every.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "held_out", "n_tokens", n_known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
