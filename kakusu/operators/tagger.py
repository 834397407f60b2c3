"""A trained tagger: an averaged structured perceptron over hashed features, trained by iterative parameter mixing.

Texts are cut into runs of letters, runs of digits and single other characters; a tag says that a token begins an entity of a
label, goes on with it, or is outside. All documents are dealt into shards of about ``shard_bytes`` by a hash. Each epoch every shard goes
through its documents from the same weights and gives back only what it changed; Spark sums these changes, and their mean over the shards
that changed something is where the next epoch starts, so what a few of very many shards still have wrong is learned, too. Changes are whole numbers, so sums don't depend on their order and training again gives the same model. The result is the mean
of all weights on the way of the second half of the epochs. A model is a table of 2 ** bits x tags weights, whatever the corpus; training
and tagging read every text as a whole.

Texts are cut into tokens once: a shard is kept as numbers of what its tokens look like, each distinct look with its features, so an epoch
scores distinct looks and shuffles no text. An epoch that changes nothing is not run again: those after it would change nothing either.

Decoding is exact: where the outside tag leads by more than any neighbours could make up, it is certain, and what is between two
such tokens is decoded apart from the rest - all such runs of a batch at once, step by step. Most tokens are certain by a bound already: what
parts of their look can at most give any tag, summed; only the others are scored tag by tag.
"""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.runner import shared_place
from . import evaluate
from .ner import Backend, model_entities

BITS = 16
EPOCHS = 8
#: About so much text one shard has.
SHARD_BYTES = 1 << 20
_TOKEN = re.compile(r"(?:[^\W\d_]+|\d+|[^\w\s]|_)\s*")
_REACH = 2
#: Tokens that are learned from at once.
STRETCH = 32
#: Stretches that are scored ahead: after something was wrong, and at most, doubled while nothing is.
WINDOW, WIDEST = 16, 4096
#: What tag 0 is ahead by when nothing is learned: words that no entity is near need no learning.
AHEAD = 4.0
#: Which neighbours' words, shapes and heads (the first character and the shape) a feature joins: (offset, kind) each; by what they look at.
_OF_SHAPES = (
    ((0, "shape"),), ((-1, "shape"),), ((1, "shape"),), ((-2, "shape"),), ((2, "shape"),), ((-1, "shape"), (0, "shape")), ((0, "shape"), (1, "shape")),
    ((-1, "shape"), (0, "shape"), (1, "shape")), ((-2, "shape"), (-1, "shape"), (0, "shape")), ((0, "shape"), (1, "shape"), (2, "shape")), ((-2, "shape"), (-1, "shape"), (0, "shape"), (1, "shape"), (2, "shape")),
)
_OF_HEADS = (((0, "head"),), ((0, "head"), (-1, "shape")))
#: Of a word as the one before, as itself, as the one after.
_OF_WORDS = (((-1, "word"),), ((0, "word"),), ((1, "word"),))
_FEATURES = (*_OF_HEADS, _OF_WORDS[1], _OF_WORDS[0], _OF_WORDS[2], *_OF_SHAPES)
#: A bound is taken as so much higher than it was summed: sums in another order differ by less.
_SLACK = 1e-6


def _shape(first: str, size: int, spaced: bool, lower: bool, upper: bool, narrow: bool) -> str:
    """What a token looks like: digits by number, letters by case, script and (up to 4) number, others (``first``) as they are; what follows."""
    if first.isdecimal():
        kind = f"9{size}"
    elif first.isalpha():
        kind = ("a" if lower else "A" if upper else "Aa") + ("" if narrow else "~") + str(min(size, 4))
    else:
        kind = first
    return f"{kind} " if spaced else kind


#: Rows of a table of pieces: hashes of word, shape and head; numbers of shape and head; lengths with and without what follows.
_WORD, _SHAPE, _HEAD, _SHAPE_NO, _HEAD_NO, _CORE, _WIDE = range(7)
_KIND = {"word": _WORD, "shape": _SHAPE, "head": _HEAD}


@dataclass
class Tokens:
    """Tokens of several texts one after another, two blanks around each text; ``text`` is -1 at blanks. ``piece`` is a column of ``table``."""

    piece: np.ndarray
    table: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


class _Numbers(dict):
    """Numbers from 1 for whatever is asked for, in the order in which it was."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self) + 1
        return n


def _latest(numbers: _Numbers, known: int) -> list:
    """What is in ``numbers`` beyond the first ``known``."""
    return list(itertools.islice(reversed(numbers), len(numbers) - known))[::-1]


class _Seen:
    """Pieces of texts -> columns of ``table``, column 0 for blanks. Emptied when it has grown to ``most`` pieces."""

    most = 500_000

    def __init__(self):
        self._empty()

    def _empty(self) -> None:
        self.numbers, self.table = _Numbers(), np.zeros((7, 1024), dtype=np.int64)
        self.kinds, self.of_kinds, self.shapes, self.heads = _Numbers(), [(0, 0, 0, 0)], _Numbers(), _Numbers()

    def _of_kind(self, first: str, *rest) -> tuple[int, int, int, int]:
        shape = _shape(first, *rest)
        head = first[0] + shape
        return *(zlib.crc32(x.encode("utf-8", "surrogatepass")) + 1 for x in (shape, head)), self.shapes[shape], self.heads[head]

    def columns(self, pieces: list[str]) -> np.ndarray:
        if len(self.numbers) > self.most:
            self._empty()
        known = len(self.numbers)
        out = np.fromiter(map(self.numbers.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        new = _latest(self.numbers, known)
        if new:
            cores = [piece.rstrip() for piece in new]
            kinds = [
                (first if (first := core[0]).isalpha() or first.isdecimal() else core, size if (size := len(core)) < 20 else 20, size < len(piece), core.islower(), core.isupper(), core.isascii())
                for piece, core in zip(new, cores)
            ]
            kind = np.fromiter(map(self.kinds.__getitem__, kinds), dtype=np.int64, count=len(new))
            self.of_kinds += [self._of_kind(*k) for k in _latest(self.kinds, len(self.of_kinds) - 1)]
            if known + len(new) >= self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros((7, known + 2 * len(new)), dtype=np.int64)], axis=1)
            at = self.table[:, known + 1 : known + len(new) + 1]
            at[_WORD] = np.fromiter((zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) for core in cores), dtype=np.int64, count=len(new)) + 1
            at[[_SHAPE, _HEAD, _SHAPE_NO, _HEAD_NO]] = np.array(self.of_kinds, dtype=np.int64)[kind].T
            at[_CORE] = np.fromiter(map(len, cores), dtype=np.int64, count=len(new))
            at[_WIDE] = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        return out


def tokens(texts: Iterable[str], seen: _Seen | None = None) -> Tokens:
    """``seen`` remembers words between calls."""
    seen, pieces, many, which, before = _Seen() if seen is None else seen, [], [], [], []
    for i, text in enumerate(texts):
        cut = _TOKEN.findall(text)
        if cut:
            pieces += cut
            many.append(len(cut))
            which.append(i)
            before.append(len(text) - len(text.lstrip()))
    columns = seen.columns(pieces)
    many, which = np.array(many, dtype=np.int64), np.array(which, dtype=np.int64)
    at = np.arange(len(pieces)) + np.repeat(_REACH * np.arange(1, len(many) + 1), many)
    piece, text, start, end = np.zeros(len(pieces) + _REACH * (len(many) + 1), dtype=np.int64), *(np.full(len(pieces) + _REACH * (len(many) + 1), -1, dtype=np.int64) for _ in range(3))
    wide = seen.table[_WIDE][columns]
    starts = np.cumsum(wide) - wide
    starts += np.repeat(np.array(before, dtype=np.int64) - starts[np.cumsum(many) - many], many)
    piece[at], text[at], start[at], end[at] = columns, np.repeat(which, many), starts, starts + seen.table[_CORE][columns]
    return Tokens(piece, seen.table, text, start, end)


def _features(t: Tokens, at: np.ndarray, which: tuple, bits: int) -> np.ndarray:
    """Hashed features ``which`` of the tokens ``at``, a row each."""
    out = np.empty((len(at), len(which)), dtype=np.uint16 if bits <= 16 else np.uint32)
    for k, parts in enumerate(which):
        h = np.full(len(at), _FEATURES.index(parts) + 1, dtype=np.uint64)
        for by, kind in parts:
            h = (h ^ t.table[_KIND[kind]][t.piece[at + by]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, k] = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
    return out


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct row of numbers, and where each is first."""
    key, size = np.zeros(len(columns[0]), dtype=np.int64), 1
    for column in columns:
        n = int(column.max(initial=0)) + 1
        if size * n >= 1 << 62:
            key = pd.factorize(key)[0].astype(np.int64)
            size = int(key.max(initial=0)) + 1
        key, size = key * n + column, size * n
    if size > 1 << 22:
        key, size = pd.factorize(key)[0], len(key)
    where = np.full(size, -1, dtype=np.int64)
    where[key[::-1]] = np.arange(len(key))[::-1]
    found = np.flatnonzero(where >= 0)
    number = np.zeros(size, dtype=np.min_scalar_type(len(found)))
    number[found] = np.arange(len(found))
    return number[key], where[found]


@dataclass
class Looks:
    """Which of the distinct looks each token has: its shapes, its head, and its word (of one more token at each end); features of each look.

    The first and last blanks of the texts are left out.
    """

    shapes: np.ndarray
    head: np.ndarray
    word: np.ndarray
    of_shapes: np.ndarray
    of_head: np.ndarray
    of_word: np.ndarray


def looks_of(t: Tokens, bits: int) -> Looks:
    n = max(0, len(t.piece) - 2 * _REACH)
    shape = t.table[_SHAPE_NO][t.piece]
    near = lambda column, by: column[_REACH + by : _REACH + by + n]
    shapes, first = _numbered(*(near(shape, by) for by in range(-_REACH, _REACH + 1)))
    head, first_head = _numbered(t.table[_HEAD_NO][near(t.piece, 0)], near(shape, -1))
    word, first_word = _numbered(t.piece[_REACH - 1 : _REACH + n + 1])
    of_word = np.concatenate([_features(t, first_word + _REACH - 1 - parts[0][0], (parts,), bits) for parts in _OF_WORDS], axis=1)
    return Looks(shapes, head, word, _features(t, first + _REACH, _OF_SHAPES, bits), _features(t, first_head + _REACH, _OF_HEADS, bits), of_word)


def best_paths(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of runs that stand one after another in ``scores``; tag 0 is before and after each run. Ties: smaller tags."""
    tags = np.zeros(len(scores), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    if not len(lengths):
        return tags
    back, total = [], moves[0] + scores[first]
    ends = np.zeros((len(first), scores.shape[1]))
    for t in range(1, lengths[0]):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # runs that are longer than t
        ends[n : len(total)] = total[n:]
        through = total[:n, :, None] + moves
        back.append(through.argmax(axis=1))
        total = through.max(axis=1) + scores[first[:n] + t]
    ends[: len(total)] = total
    tag = (ends + moves[:, 0]).argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        tags[first[:n] + t] = tag[:n]
        if t:
            tag[:n] = back[t - 1][np.arange(n), tag[:n]]
    return tags


def _gain(moves: np.ndarray) -> np.ndarray:
    """What neighbours can at most give each tag over tag 0."""
    return (moves - moves[:, :1]).max(axis=0) + (moves - moves[:1]).max(axis=1)


def _open(scores: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Which tokens may have another tag than 0."""
    return (scores[:, 1:] + gain[1:] >= scores[:, :1]).any(axis=1)


def _decoded(scores: np.ndarray, moves: np.ndarray, edges: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Best tags of tokens one after another; each of ``edges`` begins a new sequence. With ``at``: of the tokens there, those between are certain."""
    at = np.arange(len(scores)) if at is None else at
    some, tags = np.flatnonzero(_open(scores, _gain(moves))), np.zeros(len(scores), dtype=np.int64)
    heads = np.flatnonzero((np.diff(at[some], prepend=-2) > 1) | np.isin(at[some], edges))
    tags[some] = best_paths(scores[some], np.diff(np.append(heads, len(some))), moves)
    return tags


class _Scorer:
    """Scores of the tokens of ``look`` by weights that may change. Sums of a look's features are made anew when it is met after a change.

    Most features have no weights; those that have are put together, row 0 stands for the others.
    """

    def __init__(self, look: Looks, model: Tagger):
        self.look, self.moves = look, model.moves.copy()
        used, self.row = model.used, np.zeros(len(model.weights), dtype=np.int32)
        self.row[used], self.rows = np.arange(1, len(used) + 1), len(used) + 1
        self.weights = np.zeros((2 * len(used) + 256, len(self.moves)))
        self.weights[1 : self.rows] = model.weights[used]
        self.lead = (self.weights[:, 1:] - self.weights[:, :1]).max(axis=1)  # of a feature: what it at most gives a tag over tag 0
        self.least = -_SLACK * (1 + np.abs(self.lead).max())
        self.top_words = [self.lead[self.row[column]] for column in look.of_word.T]
        self._gains()
        self.parts, self.now = [], 0
        for number, features, gains in ((look.shapes, look.of_shapes, True), (look.head, look.of_head, False)):
            sums, top = np.empty((len(features), len(self.moves))), np.empty((4 if gains else 1, len(features)))
            self.parts.append((number, features, gains, sums, top, np.zeros(len(features), dtype=np.int64)))
            self._sum(self.parts[-1], slice(None))

    def _gains(self) -> None:
        """What neighbours can at most give each tag over tag 0: if tag 0 is certain on both sides, after it, before it, or not at all."""
        before, after = self.moves[:, 1:] - self.moves[:, :1], (self.moves[1:] - self.moves[:1]).T
        self.gains = [a + b for b in (after[0], after.max(axis=0)) for a in (before[0], before.max(axis=0))]

    def _sum(self, part: tuple, some) -> None:
        _, features, gains, sums, top, when = part
        rows = self.row[features[some]]
        out = self.weights[rows[:, 0]]
        for column in rows.T[1:]:
            out += self.weights[column]
        sums[some], when[some] = out, self.now
        over = np.ascontiguousarray(out.T)
        over = over[1:] - over[0]
        for k, gain in enumerate(self.gains if gains else np.zeros((1, len(over)))):
            top[k, some] = (over + gain[:, None]).max(axis=0)

    def add(self, features: np.ndarray, tags: np.ndarray, by: int) -> None:
        """Changes the weights of a row of ``features`` for each of ``tags``."""
        new = np.unique(features[self.row[features] == 0])
        if len(new):
            if self.rows + len(new) > len(self.weights):
                self.weights = np.concatenate([self.weights, np.zeros((len(new) + len(self.weights), len(self.moves)))])
                self.lead = np.concatenate([self.lead, np.zeros(len(self.weights) - len(self.lead))])
            self.row[new] = np.arange(self.rows, self.rows + len(new))
            self.rows += len(new)
        np.add.at(self.weights, (self.row[features], tags[:, None]), by)

    def changed(self, features: np.ndarray) -> None:
        """Weights of ``features`` or moves have changed."""
        rows = self.row[features]
        self.lead[rows] = (self.weights[rows, 1:] - self.weights[rows, :1]).max(axis=-1)
        self.top_words, self.now = None, self.now + 1
        self._gains()

    def open(self, low: int, high: int) -> np.ndarray:
        """Which tokens from ``low`` to before ``high`` may have another tag than 0; some that may not are among them."""
        most = np.zeros(high - low)
        for part in self.parts:
            here, top, when = part[0][low:high], part[4], part[5]
            if self.now:
                old = here[when[here] < self.now]
                if len(old):
                    self._sum(part, np.unique(old))
            most += top[-1][here]
        for k in range(3):
            here = self.look.word[low + k : high + k]
            most += self.top_words[k][here] if self.top_words else self.lead[self.row[self.look.of_word[here, k]]]
        at = np.flatnonzero(most >= self.least)
        most, top, number = most[at], self.parts[0][4], self.look.shapes[low:high][at]
        most -= top[-1][number]
        for _ in range(3):  # beside a certain token: only what tag 0 gives there
            beside = np.diff(at) == 1
            still = most + top[np.append(False, beside) + 2 * np.append(beside, False), number] >= self.least if len(at) else np.empty(0, dtype=bool)
            if still.all():
                break
            at, most, number = at[still], most[still], number[still]
        return low + at

    def scores(self, at: np.ndarray) -> np.ndarray:
        """Of tokens that :meth:`open` has given since the last change."""
        out = self.parts[0][3][self.look.shapes[at]] + self.parts[1][3][self.look.head[at]]
        for k in range(3):
            out += self.weights[self.row[self.look.of_word[self.look.word[at + k], k]]]
        return out

    def features(self, at: np.ndarray) -> np.ndarray:
        look = self.look
        return np.concatenate([look.of_shapes[look.shapes[at]], look.of_head[look.head[at]], *(look.of_word[look.word[at + k], k : k + 1] for k in range(3))], axis=1).astype(np.int64)


@dataclass
class Tagger:
    """Labels, weights of features x tags, and of moves from tag to tag. Tag 0 is outside; label i begins by 2i + 1, goes on by 2i + 2."""

    labels: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    @cached_property
    def used(self) -> np.ndarray:
        """Which features have weights."""
        return np.flatnonzero(self.weights.any(axis=1))

    def tags(self, t: Tokens) -> np.ndarray:
        """The best tag of each token; exact, see the module."""
        tags, n = np.zeros(len(t.piece), dtype=np.int64), len(t.piece) - 2 * _REACH
        if n > 0:
            scorer = _Scorer(looks_of(t, self.bits), self)
            at = scorer.open(0, n)
            at = at[t.text[at + _REACH] >= 0]
            tags[at + _REACH] = _decoded(scorer.scores(at), self.moves, np.empty(0, dtype=np.int64), at)
        return tags

    def entities(self, t: Tokens, texts: int) -> list[list[tuple[str, int, int, float]]]:
        """For each text ``(label, start, end, 1.0)``."""
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in range(texts)]
        for i, *entity in spans_of_tags(t, self.tags(t), self.labels):
            out[i].append((*entity, 1.0))
        return out

    def backend(self) -> Backend:
        """For :func:`kakusu.operators.ner.model_entities`: texts are taken together, about a million characters at once."""
        seen = _Seen()

        def run(texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
            out, some, size = [], [], 0
            for text in texts:
                some.append(text)
                size += len(text)
                if size >= 1 << 20:
                    out += self.entities(tokens(some, seen), len(some))
                    some, size = [], 0
            return out + (self.entities(tokens(some, seen), len(some)) if some else [])

        return run


def spans_of_tags(t: Tokens, tags: np.ndarray, labels: tuple[str, ...]) -> list[tuple[int, str, int, int]]:
    """``(text, label, start, end)``; going on with what has not begun begins it. Blanks have tag 0, so that no entity leaves its text."""
    label = (tags + 1) // 2
    same = (tags > 0) & (tags % 2 == 0) & (label == np.roll(label, 1))
    heads, after = np.flatnonzero((tags > 0) & ~same), np.flatnonzero(~same)
    ends = after[np.searchsorted(after, heads, side="right")] - 1
    return [(int(t.text[h]), labels[label[h] - 1], int(t.start[h]), int(t.end[e])) for h, e in zip(heads, ends)]


def gold_tags(t: Tokens, entities: list[list[tuple[str, int, int]]], labels: tuple[str, ...]) -> np.ndarray:
    """Tags of the entities (label, start, end) of each text, widened to token edges; of those that share a token the first stays."""
    tags, inside = np.zeros(len(t.piece), dtype=np.int64), np.flatnonzero(t.text >= 0)
    text = t.text[inside]
    for i, spans in enumerate(entities):
        if not spans:
            continue
        lo, hi = np.searchsorted(text, [i, i + 1])
        at = inside[lo:hi]
        for label, start, end in spans:
            a, b = int(np.searchsorted(t.start[at], start, side="right")) - 1, int(np.searchsorted(t.end[at], end, side="left"))
            if label in labels and 0 <= a <= b < len(at) and start < end and not tags[at[a : b + 1]].any():
                tags[at[a : b + 1]] = 2 * labels.index(label) + 2
                tags[at[a]] -= 1
    return tags


@dataclass
class Shard:
    """Documents of a shard: looks of their tokens, true tags that are not 0 and where, and where stretches begin and end."""

    look: Looks
    true_at: np.ndarray
    true: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def shard_of(texts: list[str], entities: list[list[tuple[str, int, int]]], labels: tuple[str, ...], bits: int, seen: _Seen | None = None) -> Shard:
    t = tokens(texts, seen)
    gold = gold_tags(t, entities, labels)
    inside = np.flatnonzero(t.text >= 0)
    heads = inside[np.flatnonzero(np.diff(t.text[inside], prepend=-1))]
    ends = np.append(heads[1:] - _REACH, len(gold) - _REACH)[: len(heads)]
    parts = [_stretches(gold, *x) for x in zip(heads.tolist(), ends.tolist())]
    edges = np.concatenate([np.empty((0, 2), dtype=np.int64), *parts]) - _REACH
    at = np.flatnonzero(gold)
    return Shard(looks_of(t, bits), at - _REACH, gold[at], edges[:, 0], edges[:, 1])


def _learn(model: Tagger, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """One pass over a shard: which weights changed (moves are behind the features), by how much, how much summed over all steps, steps."""
    n_tags, size = len(model.moves), model.weights.size
    scorer, (begin, end), steps = _Scorer(shard.look, model), (shard.begin, shard.end), len(shard.begin)
    moves = scorer.moves
    places, signs, times = [], [], []
    step, ahead = 0, WINDOW
    while step < steps:
        stop = min(step + ahead, steps)
        low, high = begin[step], end[stop - 1]
        at = scorer.open(low, high)
        at = at[at < end[np.searchsorted(begin, at, side="right") - 1]]  # no blanks
        said, true = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=np.int64)
        said[at - low] = _decoded(scorer.scores(at), moves, begin[step:stop], at)
        some = slice(*np.searchsorted(shard.true_at, [low, high]))
        true[shard.true_at[some] - low] = shard.true[some]
        wrong = low + np.flatnonzero(true != said)
        if not len(wrong):
            step, ahead = stop, min(2 * ahead, WIDEST)
            continue
        k = int(np.searchsorted(begin, wrong[0], side="right")) - 1  # what follows this stretch is scored anew
        wrong = wrong[wrong < end[k]]
        rows = scorer.features(wrong)
        for tags, by in ((true, 1), (said, -1)):
            way = np.concatenate([[0], tags[begin[k] - low : end[k] - low], [0]])
            place = np.concatenate([(rows * n_tags + tags[wrong - low][:, None]).ravel(), size + way[:-1] * n_tags + way[1:]])
            scorer.add(rows, tags[wrong - low], by)
            np.add.at(moves, (way[:-1], way[1:]), by)
            places.append(place)
            signs.append(np.full(len(place), by))
            times.append(np.full(len(place), k))
        scorer.changed(np.unique(rows))
        step, ahead = k + 1, WINDOW
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), steps
    some, which = np.unique(np.concatenate(places), return_inverse=True)
    change, area = np.zeros(len(some), dtype=np.int64), np.zeros(len(some), dtype=np.int64)
    sign = np.concatenate(signs)
    np.add.at(change, which, sign)
    np.add.at(area, which, sign * (steps - np.concatenate(times)))
    return some, change, area, steps


def _stretches(gold: np.ndarray, first: int, end: int) -> np.ndarray:
    """Stretches of about STRETCH tokens that cut no entity: a step of learning each, so that a long document is no huge step."""
    if not gold[first:end].any():
        begin = np.arange(first, end, STRETCH)
        return np.stack([begin, np.minimum(begin + STRETCH, end)], axis=1)
    out = []
    while first < end:
        last = min(first + STRETCH, end)
        while last < end and gold[last]:
            last += 1
        out.append((first, last))
        first = last
    return np.array(out)


_SIZE = 8


def _packed(shard: Shard) -> bytes:
    raw = pickle.dumps(shard, protocol=5)
    return len(raw).to_bytes(_SIZE, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> Shard:
    return pickle.loads(pa.decompress(memoryview(packed)[_SIZE:], int.from_bytes(packed[:_SIZE], "little"), codec="zstd"))


def _prepare(labels: tuple[str, ...], bits: int):
    seen = _Seen()  # a task's own, for all its shards

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "id", "text"])
        shard = shard_of(list(pdf["text"]), [[(e["label"], e["start"], e["end"]) for e in es] for es in pdf["entities"]], labels, bits, seen)
        return pd.DataFrame({"shard": [_packed(shard)]})

    return run


def _epoch(model):
    def run(batches):
        """What the shards of a task change, summed; in row -1 how many of them change something, and the steps of all."""
        start = model.value
        change, area = (np.zeros(start.weights.size + start.moves.size, dtype=np.int64) for _ in range(2))
        shards = steps = 0
        for pdf in batches:
            for packed in pdf["shard"]:
                at, by, summed, n = _learn(start, _unpacked(packed))
                change[at] += by
                area[at] += summed
                shards, steps = shards + (len(at) > 0), steps + n
        some = np.flatnonzero((change != 0) | (area != 0))
        if steps:
            yield pd.DataFrame({"at": np.append(some, -1), "change": np.append(change[some], shards), "area": np.append(area[some], steps)})

    return run


def train(df: DataFrame, labels: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", entities_col: str = "entities", epochs: int = EPOCHS, shard_bytes: int = SHARD_BYTES, bits: int = BITS) -> Tagger:
    """A tagger from texts and arrays of entities with ``label, start, end``: from all of them, in each epoch.

    Documents are dealt by a hash of id and text into shards of about ``shard_bytes``. Null texts and null arrays are empty; other labels are
    ignored; without documents every token is outside. What comes to the driver are 2 ** bits x tags weights at most for each epoch.
    """
    text, place = F.coalesce(text_col, F.lit("")), shared_place(df.sparkSession)
    spans = F.transform(F.coalesce(entities_col, F.array()), lambda e: F.struct(e["label"].alias("label"), e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end")))
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("draw"), spans.alias("entities"))
    whole = max(1, df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"])
    dealt = rows.withColumn("shard", F.pmod(F.shiftright("draw", 20), F.lit(-(-whole // shard_bytes))))
    # A row is about 2 MB, so row groups are closed by their size, not by 100 rows.
    kept = dealt.groupBy("shard").applyInPandas(_prepare(labels, bits), "shard binary").write.option("parquet.block.size", str(16 << 20))
    kept.option("parquet.block.size.row.check.min", "1").option("parquet.page.size.row.check.min", "1").parquet(f"{place}/train")
    shards = df.sparkSession.read.schema("shard binary").parquet(f"{place}/train")

    n_tags = 2 * len(labels) + 1
    start = np.zeros((1 << bits) * n_tags + n_tags * n_tags)
    start[(1 << bits) * n_tags :: n_tags] = AHEAD
    mean, more = np.zeros_like(start), True
    split = lambda flat: Tagger(labels, flat[: (1 << bits) * n_tags].reshape(-1, n_tags), flat[(1 << bits) * n_tags :].reshape(n_tags, n_tags))
    for epoch in range(epochs):
        here = start.copy()
        if more:
            model = df.sparkSession.sparkContext.broadcast(split(start))
            rows_ = shards.mapInPandas(_epoch(model), "at long, change long, area long").groupBy("at").agg(F.sum("change").alias("change"), F.sum("area").alias("area")).toPandas()
            model.destroy()
            sums = rows_[rows_["at"] < 0]
            if not len(sums):
                return split(start)
            rows_ = rows_[rows_["at"] >= 0]
            at, more = rows_["at"].to_numpy(), len(rows_) > 0
            here[at] += rows_["area"].to_numpy() / sums["area"].iloc[0]
            start[at] += rows_["change"].to_numpy() / max(1, sums["change"].iloc[0])
        if epoch >= epochs // 2:
            mean += here / (epochs - epochs // 2)
    return split(mean)


def tag(df: DataFrame, model: Tagger, text_col: str = "text", out: str = "ner_spans") -> DataFrame:
    """``df`` with the spans that the tagger finds, as :func:`kakusu.operators.ner.model_entities`; the model is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return model_entities(df, lambda: shared.value.backend(), text_col, out)


def widened(df: DataFrame, id_col: str, text_col: str, entities_col: str, labels: tuple[str, ...]) -> DataFrame:
    """``doc_id, start, end, label`` of the entities as a tagger can say them: widened to its tokens, the first of those that share one."""

    def run(batches):
        for f in batches:
            out = []
            for doc_id, text, es in zip(f["id"], f["text"], f["entities"]):
                t = tokens([text])
                kept = gold_tags(t, [[(e["label"], e["start"], e["end"]) for e in es]], labels)
                out += [(doc_id, a, b, label) for _, label, a, b in spans_of_tags(t, kept, labels)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "label"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(entities_col).alias("entities")).filter(F.size("entities") > 0)
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, start long, end long, label string")


def scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``label, tp, pred, gold, p, r, f`` of exact matches, by label."""
    return evaluate.ratios(evaluate.match_counts(gold, pred)).select("label", "tp", "pred", "gold", "p", "r", "f")
