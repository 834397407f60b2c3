"""State that belongs to a conversation: deltas whose placeholders are cut, and one placeholder for one original over all turns.

Both take rows in the order of their sequence numbers, whatever the order of arrival: a row that is early waits in the state until
those before it are there; one that was there already (a replay) is ignored. All state of a key is removed when its last row has been
taken, or when a timer ends that each row of the key winds up again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.catalog import DEFAULT, Catalog
from ..operators.anonymize import splice, with_disjoint
from ..operators.reversible import SHAPE

_SHAPE = re.compile(SHAPE)


class InOrder(StatefulProcessor):
    """Hands rows (seq, value, done) of a key to ``take`` by seq, from 0 on; ``value`` is JSON.

    Each question to the state is a round trip, so what a key always needs is one value: where it is, which rows wait, and ``OWN``.
    Rows that are early are written only if they are so at the end of a micro-batch, or where there are more than ``HELD`` of them.
    """

    #: What a subclass adds to that value, a SQL type, and what a new key has there.
    OWN, NEW = "string", None
    HELD = 1000

    def __init__(self, timeout_ms: int | None, columns: list[str]):
        self.timeout_ms, self.columns = timeout_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.columns)
        self.place = handle.getValueState("place", f"next long, last long, waiting array<long>, own {self.OWN}")
        self.early = handle.getMapState("early", "seq long", "value string")
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        """Makes the further state that ``take`` needs."""

    def load(self, known: bool) -> None:
        """Begins with a key, with its ``own``; one that is not known has no further state, and is asked nothing."""

    def save(self) -> None:
        """Writes that state back."""

    def take(self, seq: int, value: dict, end: bool) -> Iterator[tuple]:
        """Rows without the key."""
        raise NotImplementedError

    def rest(self, seq: int) -> Iterator[tuple]:
        """Rows of what is still held back when the timer ends."""
        return iter(())

    def clear(self) -> None:
        """Removes that state."""

    def _forget(self) -> None:
        self.place.clear()
        self.early.clear()
        self.clear()
        self._unwind()

    def _unwind(self) -> None:
        for timer in list(self.handle.listTimers()) if self.timeout_ms is not None else ():
            self.handle.deleteTimer(timer)

    def _write(self, held: dict[int, str], waiting: set[int]) -> None:
        for seq, value in held.items():
            self.early.updateValue((seq,), (value,))
        waiting.update(held)
        held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        place = self.place.get()
        kept = place is not None
        at, last, waiting, self.own = place if kept else (0, -1, (), self.NEW)
        waiting, held = set(waiting), {}
        self.load(kept)
        for row in rows:
            seq, value = row["seq"], row["value"]
            last = seq if row["done"] else last
            if seq < at:
                continue
            if seq > at:
                held[seq] = value
                if len(held) > self.HELD:
                    self._write(held, waiting)
                    kept = True
                continue
            while value is not None:
                yield from (self.row(*key, *r) for r in self.take(at, json.loads(value), at == last))
                at, value = at + 1, None
                if at in waiting:
                    (value,) = self.early.getValue((at,))
                    self.early.removeKey((at,))
                    waiting.remove(at)
                value = held.pop(at, value)
        if 0 <= last < at:
            if kept:
                self._forget()
        else:
            self._write(held, waiting)
            self.save()
            self.place.update((at, last, sorted(waiting), self.own))
            if self.timeout_ms is not None:
                self._unwind()
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (place := self.place.get()) is not None:
            at, last, _, self.own = place
            self.load(True)
            for seq, value in sorted((k[0], v[0]) for k, v in self.early.iterator()):  # those before it never came
                yield from (self.row(*key, *r) for r in self.take(seq, json.loads(value), seq == last))
                at = seq + 1
            yield from (self.row(*key, *r) for r in self.rest(at - 1))
            self._forget()


class _Restore(InOrder):
    """Its own value is the text that is held back."""

    NEW = ""

    def begin(self, handle):
        self.originals = handle.getMapState("originals", "placeholder string", "original string")

    def load(self, known):
        self.known, self.new, self.more = {}, {}, known

    def _known(self) -> dict[str, str]:
        if self.more:  # asked for only if a text has what may be a placeholder
            self.known = {k[0]: v[0] for k, v in self.originals.iterator()} | self.known
            self.more = False
        return self.known

    def save(self):
        for placeholder, original in self.new.items():
            self.originals.updateValue((placeholder,), (original,))

    def clear(self):
        self.originals.clear()

    def _back(self, text: str) -> str:
        return _SHAPE.sub(lambda m: self._known().get(m[0], m[0]), text) if "<" in text else text

    def take(self, seq, value, end):
        more = value.get("mapping") or {}
        self.known |= more
        self.new |= more
        text, self.own = self.own + (value.get("chunk") or ""), ""
        tail = text[i:] if (i := text.rfind("<")) >= 0 else ""
        if tail and not end and any(len(p) > len(tail) and p.startswith(tail) for p in self._known()):
            text, self.own = text[:i], tail
        yield seq, self._back(text)

    def rest(self, seq):
        if self.own:
            yield seq, self.own


def _keyed(rows: DataFrame, keys: tuple[str, ...], seq_col: str, value, done):
    return rows.select(*keys, F.col(seq_col).cast("long").alias("seq"), F.to_json(value).alias("value"), F.coalesce(done, F.lit(False)).alias("done")).groupBy(*keys)


def _schema(rows: DataFrame, keys: tuple[str, ...], more: str) -> StructType:
    return StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(more).fields])


def restore_deltas(chunks: DataFrame, *keys: str, timeout_ms: int | None = None) -> DataFrame:
    """``keys``, ``seq``, ``restored`` for each streamed chunk (keys, seq from 0 on, chunk, mapping, done) of a response.

    A placeholder may be cut anywhere: an end of a chunk that a known placeholder begins with waits in the state for the next chunk.
    ``mapping`` (map of strings) counts from its chunk on; ``done`` marks the last chunk, after which all state of the response
    is removed. Where ``timeout_ms`` is given, a response that stops without a last chunk gives what it holds after that time, and its
    state goes too. Null chunks are empty; chunks of equal keys and seq count once.
    """
    value = F.struct("chunk", "mapping")
    out = _schema(chunks, keys, "seq long, restored string")
    return _keyed(chunks, keys, "seq", value, F.col("done")).transformWithState(_Restore(timeout_ms, out.names), out, "append", "none" if timeout_ms is None else "processingTime")


class _Carry(InOrder):
    """Its own value is how many originals have a number."""

    OWN, NEW = "long", 0

    def begin(self, handle):
        self.numbers = handle.getMapState("numbers", "entity_type string, original string", "number long")

    def load(self, known):
        self.known = known
        self.cache: dict[tuple[str, str], int] = {}
        self.new: list[tuple[str, str]] = []

    def save(self):
        for key in self.new:
            self.numbers.updateValue(key, (self.cache[key],))

    def clear(self):
        self.numbers.clear()

    def take(self, seq, value, end):
        text, at, pieces, mapping = value.get("text"), 0, [], {}
        for s in value.get("spans") or []:
            key = (s["entity_type"], s["text"])
            if key not in self.cache:
                if self.known and (number := self.numbers.getValue(key)) is not None:
                    self.cache[key] = number[0]
                else:
                    self.own += 1
                    self.cache[key] = self.own
                    self.new.append(key)
            name = f"<{key[0]}_{self.cache[key]}>"
            pieces += [text[at : s["start"]], name]
            at = s["end"]
            mapping[name] = key[1]
        yield seq, None if text is None else "".join([*pieces, text[at:]]), list(mapping.items())


def carry_mapping_stream(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", done_col: str | None = None, timeout_ms: int | None = None, entities: list[str] | None = None, lang: str | None = "ja", catalog: Catalog = DEFAULT) -> DataFrame:
    """:func:`carry_mapping` on a stream: the same columns, as turns come; the dictionary of a conversation is keyed state.

    Spans are found before the state is touched. Turns are numbered from 0 without gaps; ``done_col`` marks a conversation's last one.
    """
    found = with_disjoint(turns.select(conv_col, turn_col, F.col(text_col).alias("text"), (F.col(done_col) if done_col else F.lit(False)).alias("done")), "text", entities, lang, catalog, True, 0.0)
    out = _schema(turns, (conv_col,), "turn long, redacted string, mapping map<string,string>")
    return _keyed(found, (conv_col,), turn_col, F.struct("text", "spans"), F.col("done")).transformWithState(_Carry(timeout_ms, out.names), out, "append", "none" if timeout_ms is None else "processingTime")


def carry_mapping(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", entities: list[str] | None = None, lang: str | None = "ja", catalog: Catalog = DEFAULT, block: int = 64) -> DataFrame:
    """``conv_col``, ``turn``, ``redacted``, ``mapping`` of each turn: an original has one placeholder <TYPE_n> in all its conversation.

    n counts the distinct originals (type and text) of a conversation by first occurrence, from 1. Numbers come from counts of
    blocks of ``block`` turns and from places within a block, so a conversation of any length is no one task's work. Turns of
    equal number are taken as one turn whose rows are in no order (of equal starts the smaller type and text comes first). Null texts stay
    null, with an empty mapping.
    """
    rows = with_disjoint(turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).alias("text")), "text", entities, lang, catalog, True, 0.0)
    spans = rows.select("conv", "turn", F.inline_outer("spans").alias("entity_type", "start", "end", "score", "original")).filter(F.col("start").isNotNull())
    first = spans.groupBy("conv", "entity_type", "original").agg(F.min(F.struct("turn", "start")).alias("first")).withColumn("block", F.floor(F.col("first.turn") / block))
    order = Window.partitionBy("conv", "block").orderBy("first", "entity_type", "original")
    counts = first.groupBy(F.col("conv").alias("c"), F.col("block").alias("b")).agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("c").orderBy("b")) - F.col("n"))
    numbered = first.withColumn("place", F.row_number().over(order)).join(before, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    names = numbered.select("conv", "entity_type", "original", F.format_string("<%s_%d>", "entity_type", (F.col("place") + F.col("before")).cast("long")).alias("name"))
    named = spans.select("conv", "turn", "entity_type", "original").distinct().withColumnsRenamed({"conv": "c", "entity_type": "e", "original": "o"})
    named = named.join(names, F.col("c").eqNullSafe(F.col("conv")) & (F.col("e") == F.col("entity_type")) & (F.col("o") == F.col("original")))
    of_turn = named.groupBy("c", F.col("turn").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("e", "o"), "name"))).alias("names"))
    whole = rows.join(of_turn, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    name = lambda s: F.element_at("names", F.struct(s["entity_type"].alias("e"), s["text"].alias("o")))
    mapping = F.coalesce(F.map_from_entries(F.array_distinct(F.transform("spans", lambda s: F.struct(name(s), s["text"])))), F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    return whole.select(F.col("conv").alias(conv_col), "turn", splice(F.col("text"), F.col("spans"), name).alias("redacted"), mapping.alias("mapping"))
