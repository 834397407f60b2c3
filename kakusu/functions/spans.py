"""Spans: where patterns match, in code points, with built-in expressions only.

A pattern's matches are wrapped in a sentinel and the text is split at it: every second piece is a match, and running lengths
give its place. Running lengths are sums of chunks and within chunks, and no fold carries an array along (each step would copy
it), so many matches cost about linear time. Overlaps are resolved within clusters of spans that touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import DEFAULT, Catalog, Pattern

SPAN = "struct<entity_type:string,start:int,end:int,score:double,text:string>"
SPANS = f"array<{SPAN}>"
#: Case-insensitive, multi-line, dot matches all; Unicode classes and boundaries.
FLAGS = "(?imsU)"
_MARK = "\x01"
_CHUNK = 64
_DIGITS = r"\d+"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each element the total of those before it: of whole chunks before its own, joined with its chunk's so far."""
    chunks = lambda v: F.sequence(F.lit(0), F.floor(F.size(v) / _CHUNK).cast("int"))
    at = lambda i: F.floor(i / _CHUNK).cast("int")
    each = lambda v, heads: F.transform(v, lambda _, i: join(F.get(heads, at(i)), total(F.slice(v, at(i) * _CHUNK + 1, i % _CHUNK))))
    heads = lambda v, sums: F.transform(chunks(v), lambda c: total(F.slice(sums, F.lit(1), c)))
    return bind(values, lambda v: bind(F.transform(chunks(v), lambda c: total(F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK)))), lambda sums: bind(heads(v, sums), lambda h: each(v, h))))


def find(text: Column, pattern: Pattern, entity: str, context: tuple[str, ...] = (), window: int = 16) -> Column:
    """Array of spans of all non-overlapping matches, left to right; empty if there are none.

    Scores are raised by 0.35 (to 0.4 at least, 1 at most) where a context term stands in the ``window`` characters before.
    """
    return _of(text, _found(pattern, entity, context, window, "t rlike '(?U)\\\\d'"))


def _of(text: Column, body: str) -> Column:
    """``body``, SQL over ``t``, of a text. Patterns are put together as SQL text: so many calls for each would cost seconds."""
    return F.get(F.call_function("transform", F.array(text), F.expr(f"t -> {body}")), 0)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sums(v: str) -> str:
    """For each number of the array ``v`` the sum of those before it; as in :func:`running`."""
    added = lambda a: f"aggregate({a}, 0, (x, y) -> x + y)"
    chunks = f"sequence(0, CAST(size({v}) div {_CHUNK} AS INT))"
    sums = f"transform({chunks}, c -> {added(f'slice({v}, c * {_CHUNK} + 1, {_CHUNK})')})"
    heads = f"transform({chunks}, c -> {added('slice(sums, 1, c)')})"
    at = f"CAST(i div {_CHUNK} AS INT)"
    each = f"transform({v}, (z, i) -> get(heads, {at}) + {added(f'slice({v}, {at} * {_CHUNK} + 1, i % {_CHUNK})')})"
    return _bound("sums", sums, _bound("heads", heads, each))


def _found(pattern: Pattern, entity: str, context: tuple[str, ...], window: int, digits: str) -> str:
    """SQL of the spans of a pattern in ``t``; ``digits`` says whether the text's digits may match."""
    regex, mark, other = _quoted(FLAGS + pattern.regex), _quoted(_MARK), _quoted("\x02")
    safe = f"CASE WHEN m THEN translate(t, {mark}, {other}) ELSE t END"
    pieces = f"split(regexp_replace({safe}, {regex}, {_quoted(f'{_MARK}$0{_MARK}')}), {mark}, -1)"
    score = f"{float(pattern.score)!r}D"
    if context:
        few = f"array_join(slice(p, greatest(1, i - {2 * window - 1}), least(i, {2 * window})), '')"  # a match has a character at least
        before = f"lower(right(CASE WHEN char_length(get(p, i - 1)) >= {window} THEN get(p, i - 1) ELSE {few} END, {window}))"
        raised = repr(round(min(1.0, max(pattern.score + 0.35, 0.4)), 4))
        score = f"CASE WHEN {_bound('b', before, _near(context))} THEN {raised}D ELSE {score} END"
    own = "CASE WHEN m THEN substring(t, get(at, i) + 1, char_length(get(p, i))) ELSE get(p, i) END"
    span = f"named_struct('entity_type', {_quoted(entity)}, 'start', get(at, i), 'end', get(at, i) + char_length(get(p, i)), 'score', {score}, 'text', {own})"
    odd = "CASE WHEN size(p) > 2 THEN sequence(1, size(p) - 2, 2) ELSE CAST(array() AS array<int>) END"
    spans = _bound("p", pieces, _bound("v", "transform(p, x -> char_length(x))", _bound("at", _sums("v"), f"filter(transform({odd}, i -> {span}), s -> s.`end` > s.start)")))
    spans = _bound("m", f"contains(t, {mark})", spans)  # asked once: for each match it would be a walk over the text
    likely = ["t IS NOT NULL", *(f"contains(t, {_quoted(piece)})" for piece in pattern.needs)]
    if pattern.digits and (digits == "n" or not pattern.needs):
        likely.append(f"n >= {pattern.run}" if digits == "n" else digits)
    return f"CASE WHEN {' AND '.join(likely)} AND t rlike {regex} THEN {spans} ELSE CAST(array() AS {SPANS}) END"


def _near(context: tuple[str, ...]) -> str:
    """SQL: whether a context term stands in ``b``, lower-cased text: other than ASCII anywhere, ASCII as a whole word."""
    words = sorted({t.lower() for t in context})
    ascii_ = "|".join(f"\\Q{t}\\E" for t in words if t.isascii())
    any_ = [f"contains(b, {_quoted(t)})" for t in words if not t.isascii()]
    if ascii_:
        any_.append(f"b rlike {_quoted(f'(?<![a-z0-9])(?:{ascii_})(?![a-z0-9])')}")
    return f"({' OR '.join(any_)})"


#: SQL: how many decimal digits stand in a row at most in ``t``; one pass over the text, for all patterns.
_LONGEST = f"coalesce(array_max(transform(regexp_extract_all(t, {_quoted('(?U)' + _DIGITS)}, 0), x -> char_length(x))), 0)"


def spans_of(text: Column, entities: list[str] | None = None, lang: str | None = "ja", catalog: Catalog = DEFAULT, context: bool = True, threshold: float = 0.0) -> Column:
    """All spans of all recognizers in catalogue order; nested and overlapping ones included."""
    wanted = [(p, r) for r in catalog.prune(entities, lang).recognizers for p in r.patterns]
    if not wanted:
        return no_spans()
    shared = sum(p.digits for p, _ in wanted) > 1  # what is asked once only needs no answer ahead
    digits = "n" if shared else "t rlike '(?U)\\\\d'"
    every = f"flatten(array({', '.join(_found(p, r.entity, r.context if context else (), 16, digits) for p, r in wanted)}))"
    out = _of(text, _bound("n", _LONGEST, every) if shared else every)
    return F.filter(out, lambda s: s["score"] >= threshold) if threshold > 0 else out


def rank(spans: Column) -> Column:
    """Spans by score (high first), start, length (long first), type."""
    keyed = F.transform(spans, lambda s: F.struct((-s["score"]).alias("a"), s["start"].alias("b"), (s["start"] - s["end"]).alias("c"), s["entity_type"].alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("b"), (-s["end"]).alias("c"), s["entity_type"].alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _fold(ranked: Column, clash) -> Column:
    """Keeps each span that ``clash`` doesn't bar because of one kept before."""
    return F.aggregate(ranked, no_spans(), lambda kept, s: F.when(F.exists(kept, lambda k: clash(k, s)), kept).otherwise(F.array_append(kept, s)))


def _resolved(spans: Column, clash) -> Column:
    """By start: the spans that stay when ``clash`` decides in the order of :func:`rank`, one cluster of touching spans at a time."""
    settle = lambda cluster: F.when(F.size(cluster) > 1, _fold(rank(cluster), clash)).otherwise(cluster)
    reach = lambda v: running(F.transform(v, lambda s: s["end"]), lambda a: F.coalesce(F.array_max(a), F.lit(0)), F.greatest)
    firsts = lambda v, r: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.get(v, i)["start"] >= F.get(r, i))
    ends = lambda v, f, i: F.coalesce(F.get(f, i + 1), F.size(v))
    clusters = lambda v, f: F.transform(f, lambda k, i: settle(F.slice(v, k + 1, ends(v, f, i) - k)))
    kept = bind(by_start(spans), lambda v: bind(reach(v), lambda r: bind(firsts(v, r), lambda f: F.flatten(clusters(v, f)))))
    return F.when(F.size(spans) > 1, by_start(kept)).otherwise(spans)


def distinct_spans(spans: Column) -> Column:
    """Without spans that lie inside a span of the same type and no lower score; by start."""
    return _resolved(spans, lambda k, s: (k["entity_type"] == s["entity_type"]) & (k["start"] <= s["start"]) & (k["end"] >= s["end"]))


def disjoint_spans(spans: Column) -> Column:
    """The spans that stay when overlaps go to the higher score, earlier start, greater length, smaller type; by start."""
    return _resolved(spans, lambda k, s: (k["start"] < s["end"]) & (s["start"] < k["end"]))


def first_wins(spans: Column) -> Column:
    """The spans that stay when each overlap goes to the span that comes first in the array, in their order; by clusters, too."""
    numbered = F.transform(spans, lambda s, i: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), (-i).cast("double").alias("score"), F.lit("").alias("text")))
    return F.transform(F.array_sort(F.transform(disjoint_spans(numbered), lambda s: (-s["score"]).cast("int"))), lambda i: F.get(spans, i))


def segments(text: Column, spans: Column) -> Column:
    """The text cut at disjoint, sorted spans: ``array<struct<text, entity_type, score>>``, type null in the gaps."""
    kind = "array<struct<text:string,entity_type:string,score:double>>"
    piece = lambda t, e, s: F.struct(t.alias("text"), e.alias("entity_type"), s.alias("score"))
    none, zero = F.lit(None).cast("string"), F.lit(None).cast("double")

    filled = lambda gap: F.when(F.char_length(gap) > 0, F.array(piece(gap, none, zero))).otherwise(F.array().cast(kind))

    def part(s: Column, i: Column) -> Column:
        at = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
        return F.concat(filled(F.substring(text, at + 1, s["start"] - at)), F.array(piece(s["text"], s["entity_type"], s["score"])))

    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    rest = F.substring(text, last + 1, F.char_length(text) - last)
    return F.concat(F.flatten(F.transform(spans, part)), filled(rest))


def detect(df: DataFrame, text_col: str = "text", entities: list[str] | None = None, lang: str | None = "ja", catalog: Catalog = DEFAULT, context: bool = True, threshold: float = 0.0, out: str = "spans") -> DataFrame:
    """``df`` with an array of spans; those of one type inside another one are gone, types may overlap. Null text: none."""
    spans = spans_of(F.col(text_col), entities, lang, catalog, context, threshold)
    return df.withColumn("_found", F.coalesce(spans, no_spans())).withColumn(out, distinct_spans(F.col("_found"))).drop("_found")


def explode_spans(df: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
    """One row for each span. inline_outer keeps the optimizer from repeating the patterns in a filter below."""
    return df.select(*keep, F.inline_outer(spans)).filter(F.col("start").isNotNull())
