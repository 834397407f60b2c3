"""JSON bodies of LLM requests and responses: redacted before a call, restored after it.

Four shapes: ``chat`` (messages of text or text parts), ``messages`` (the same with a system prompt), ``responses`` (input and
instructions) and ``generate`` (contents of parts). A body is parsed once, into a VARIANT. What holds texts - messages, items, the
system prompt - is a list of holders; each gives its texts, all texts of a body are redacted as elements of one array by the same
column expressions as any text (so patterns are evaluated once), and holders are built anew around the new ones. Keys that are not
known stay as they are. Tool calls and tool results are texts too: strings as they are, objects string by string. A response is
restored in its JSON text, so whatever a model says a placeholder in, comes back. All of it are built-in expressions: no Python
worker, no shuffle.

Images in a request go through an optional redactor (the one step that needs Python); without one, or where it fails, the image's
part is taken out.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.catalog import DEFAULT, Catalog
from ..functions.spans import bind, disjoint_spans, no_spans, running, spans_of
from .anonymize import splice
from .reversible import MAPPING, mapping_of, placeholder

KINDS = ("chat", "messages", "responses", "generate")
#: What an image is given by (base64, url or name of a file elsewhere) and which of these it is: what replaces it, or None.
See = Callable[[str, str], str | None]
Redactor = Callable[[bytes, tuple[int, int, int]], bytes]
_SCHEME = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)")
_SHORT = 16  # no image has so few characters
_TEXTS = "array<string>"


# --- values of a VARIANT


def _at(v: Column, *keys: str) -> Column:
    """What an object has at a path of keys; null if it is no object or has no such key."""
    return F.try_variant_get(v, "$." + ".".join(keys), "variant")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _string(v: Column) -> Column:
    """The text of a string that is not empty; null for anything else."""
    text = F.try_variant_get(v, "$", "string")
    return F.when((F.schema_of_variant(v) == "STRING") & (text != ""), text)


def _variant(text: Column) -> Column:
    return text.cast("variant")


def _with(v: Column, **changes: Column) -> Column:
    """An object with other values at keys that it has; a null change leaves the value. Other values come back as they are."""
    new = F.create_map(*(x for key, value in changes.items() for x in (F.lit(key), value)))
    built = lambda m: F.to_variant_object(F.transform_values(_object(v), lambda k, x: F.coalesce(F.try_element_at(m, k), x)))
    return F.coalesce(bind(new, built), v)


def _none() -> Column:
    return F.array().cast(_TEXTS)


def _texts(*texts: Column) -> Column:
    return F.array(*(t.cast("string") for t in texts)).cast(_TEXTS)


# --- objects of any depth, string by string


def _literals(v: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the pieces between string literals of ``v`` as JSON and of the literals; escaped quotes and backslashes are marks."""
    plain = F.replace(F.replace(F.to_json(v), F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    return bind(plain, lambda j: body(F.split(j, '"[^"]*"', -1), F.regexp_extract_all(j, F.lit('"[^"]*"'), F.lit(0))))


def _unmark(literal: Column) -> Column:
    return F.replace(F.replace(literal, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def _values(v: Column) -> Column:
    """A text for each string literal of ``v``: the string, or null for keys."""
    text = lambda x: F.try_variant_get(F.try_parse_json(_unmark(x)), "$", "string")
    return _literals(v, lambda gaps, found: F.transform(found, lambda x, i: F.when(~F.startswith(F.get(gaps, i + 1), F.lit(":")), text(x))))


def _with_values(v: Column, new: Column) -> Column:
    """``v`` with the strings of :func:`_values` replaced where ``new`` has one."""
    piece = lambda gaps, x, i: F.concat(F.get(gaps, i), F.coalesce(F.to_json(_variant(F.get(new, i))), _unmark(x)))
    whole = lambda gaps, found: F.concat(F.array_join(F.transform(found, lambda x, i: piece(gaps, x, i)), ""), F.get(gaps, F.size(found)))
    return F.try_parse_json(_literals(v, whole))


def _any_texts(v: Column) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", _texts(_string(v))), _values(v), _none())


def _any_with(v: Column, new: Column) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", _variant(F.get(new, 0))).otherwise(_with_values(v, new)), v)


# --- parts and holders

#: Where a part of ``generate`` has what a tool is called with or gives back.
_TOOLS = (("functionCall", "args"), ("function_call", "args"), ("functionResponse", "response"), ("function_response", "response"))


def _is_text(part: Column, kind: Column) -> Column:
    of = _string(_at(part, "type"))
    return F.coalesce((kind == "generate") | ((kind == "responses") & (of == "input_text")) | (kind.isin("chat", "messages") & (of == "text")), F.lit(False))


def _is(part: Column, of: str) -> Column:
    return F.coalesce(_string(_at(part, "type")) == of, F.lit(False))


def _sub_text(sub: Column) -> Column:
    return F.when(_is(sub, "text"), _string(_at(sub, "text")))


def _part_texts(part: Column, kind: Column) -> Column:
    own = _texts(_string(_at(part, "text")))
    result = F.coalesce(F.transform(_list(_at(part, "content")), _sub_text), _texts(_string(_at(part, "content"))))
    given = F.concat(own, *(_any_texts(_at(part, *path)) for path in _TOOLS))
    tool = F.when(_is(part, "tool_result"), result).when(_is(part, "tool_use"), _any_texts(_at(part, "input")))
    return F.when(kind == "generate", given).otherwise(F.coalesce(tool, F.when(_is_text(part, kind), own), _none()))


def _part_with(part: Column, kind: Column, new: Column, keep: Column) -> Column:
    """The part around its new texts; null if it is an image that is withheld. ``keep``: images stay, or the body has none."""
    own = _variant(F.get(new, 0))

    def result() -> Column:
        held = _list(_at(part, "content"))
        subs = F.transform(held, lambda s, k: F.when(keep | _image_reason(s).isNull(), _with(s, text=_variant(F.get(new, k)))))
        return _with(part, content=F.coalesce(F.to_variant_object(F.filter(subs, lambda s: s.isNotNull())), own))

    def called() -> Column:
        at, changes = F.lit(2), {}
        for key, inner in _TOOLS:
            size = F.size(_any_texts(_at(part, key, inner)))
            changes[key] = F.when(_at(part, key).isNotNull(), _with(_at(part, key), **{inner: _any_with(_at(part, key, inner), F.slice(new, at, size))}))
            at = at + size
        return _with(part, text=F.when(_string(_at(part, "text")).isNotNull(), own), **changes)

    whole = F.when(kind == "generate", called()).when(_is(part, "tool_result"), result()).when(_is(part, "tool_use"), _with(part, input=_any_with(_at(part, "input"), new)))
    whole = whole.when(_is_text(part, kind), _with(part, text=own)).otherwise(part)
    return F.when(keep | _image_reason(part).isNull(), whole)


def _content(holder: Column, kind: Column) -> Column:
    return F.when(kind == "generate", _at(holder, "parts")).otherwise(_at(holder, "content"))


def _parts(holder: Column, kind: Column) -> Column:
    return F.coalesce(_list(_content(holder, kind)), F.array().cast("array<variant>"))


def _calls(holder: Column, kind: Column) -> Column:
    return F.coalesce(F.when(kind == "chat", _list(_at(holder, "tool_calls"))), F.array().cast("array<variant>"))


def _item(holder: Column, kind: Column, of: str, key: str) -> Column:
    return F.when((kind == "responses") & _is(holder, of), _any_texts(_at(holder, key))).otherwise(_none())


def _holder_texts(holder: Column, kind: Column, parts: Column) -> Column:
    """All texts of a message or item, null where a place has none: its content; its parts' texts; calls of tools; what these gave back."""
    calls = F.transform(_calls(holder, kind), lambda c: _string(_at(c, "function", "arguments")))
    whole = F.when(kind != "generate", _string(_content(holder, kind)))
    return F.concat(_texts(whole), F.flatten(parts), calls, _item(holder, kind, "function_call", "arguments"), _item(holder, kind, "function_call_output", "output"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _offsets(sizes: Column) -> Column:
    return running(sizes, _sum, lambda x, y: x + y)


def _holder_with(holder: Column, kind: Column, new: Column, parts: Column, after: Column) -> Column:
    """A holder around its new texts, in the order of :func:`_holder_texts`; ``after``: the place behind those of its parts."""
    listed = F.when(_list(_content(holder, kind)).isNotNull(), F.to_variant_object(parts))
    call = lambda c, j: _with(c, function=_with(_at(c, "function"), arguments=_variant(F.get(new, after + j))))
    called = F.transform(F.when(kind == "chat", _list(_at(holder, "tool_calls"))), call)
    rest = F.slice(new, after + F.size(_calls(holder, kind)) + 1, F.size(new))
    item = lambda of, key: F.when((kind == "responses") & _is(holder, of), _any_with(_at(holder, key), rest))
    items = {"arguments": item("function_call", "arguments"), "output": item("function_call_output", "output"), "tool_calls": F.to_variant_object(called)}
    whole = _with(holder, content=F.coalesce(listed, _variant(F.get(new, 0))), **items)
    return F.when(kind == "generate", _with(holder, parts=listed)).otherwise(whole)


# --- bodies

_MAIN = {"chat": "messages", "messages": "messages", "responses": "input", "generate": "contents"}
_SYSTEM = ("system_instruction", "systemInstruction")


def _main(v: Column, kind: Column) -> Column:
    out = F.lit(None).cast("variant")
    for of, key in _MAIN.items():
        out = F.when(kind == of, _at(v, key)).otherwise(out)
    return out


def _pseudo(content: Column) -> Column:
    """A holder for a text or parts that stand by themselves, or null."""
    return F.when(content.isNotNull(), F.to_variant_object(F.create_map(F.lit("content"), content)))


def _extra(v: Column, kind: Column) -> Column:
    """The system prompt or instructions of a body, as a holder; null without."""
    instructions = F.when(_string(_at(v, "instructions")).isNotNull(), _at(v, "instructions"))
    return F.when(kind == "messages", _pseudo(_at(v, "system"))).when(kind == "responses", _pseudo(instructions)).when(kind == "generate", F.coalesce(*(_at(v, k) for k in _SYSTEM)))


def _holders(v: Column, kind: Column) -> Column:
    """All holders of a body: the main list (or its one text), then the system prompt."""
    main = _main(v, kind)
    one = F.when((kind == "responses") & _string(main).isNotNull(), F.array(_pseudo(main)))
    some = F.coalesce(_list(main), one, F.array().cast("array<variant>"))
    extra = F.when(_extra(v, kind).isNotNull(), F.array(_extra(v, kind))).otherwise(F.array().cast("array<variant>"))
    return F.when(main.isNotNull(), F.concat(some, extra)).otherwise(F.array().cast("array<variant>"))


def _body_with(v: Column, kind: Column, new: Column) -> Column:
    """The body around its new holders (a bound value)."""
    main, last = _main(v, kind), F.get(new, F.size(new) - 1)
    only = lambda of, x: F.when(kind.isin(of), x)

    def around(whole: Column) -> Column:
        system = {k: only("generate", last) for k in _SYSTEM}
        return _with(v, messages=only(["chat", "messages"], whole), input=only("responses", whole), contents=only("generate", whole), system=only("messages", _at(last, "content")), instructions=F.when((kind == "responses") & _extra(v, kind).isNotNull(), _at(last, "content")), **system)

    listed = F.to_variant_object(F.slice(new, F.lit(1), F.size(_list(main))))
    one = F.when(_string(main).isNotNull(), _at(F.get(new, 0), "content"))
    return F.when(F.size(new) > 0, bind(F.coalesce(listed, one), around)).otherwise(v)


# --- images


def _withheld(value: Column, form: str) -> Column:
    """Why an image is withheld where no redactor is given; null if ``value`` is none."""
    if form == "name":
        return F.when(value.isNotNull(), "withheld: not in the body")
    if form == "base64":
        return F.when(value.isNotNull(), "withheld: no redactor")
    scheme = value.rlike("^" + _SCHEME.pattern)
    inside = F.lower(F.substring(F.ltrim(value), 1, 5)) == "data:"
    return F.when(inside, "withheld: no redactor").when(scheme, "withheld: not in the body").when(F.char_length(value) >= _SHORT, "withheld: no redactor")


def _image_reason(part: Column) -> Column:
    """Why an image part is withheld; null for other parts."""
    found = []
    for keys, fields, form in ((("inline_data", "inlineData"), ("data",), "base64"), (("file_data", "fileData"), ("file_uri", "fileUri"), "name")):
        for key in keys:
            mime = F.lower(F.coalesce(*(_string(_at(part, key, m)) for m in ("mime_type", "mimeType")), F.lit("image/png")))
            found.append(F.when(F.startswith(mime, F.lit("image/")), _withheld(F.coalesce(*(_string(_at(part, key, f)) for f in fields)), form)))
    source = F.coalesce(_withheld(_string(_at(part, "source", "data")), "base64"), _withheld(_string(_at(part, "source", "url")), "url"), _withheld(_string(_at(part, "source", "file_id")), "name"))
    found.append(F.when(_is(part, "image"), source))
    url = F.coalesce(_string(_at(part, "image_url", "url")), _string(_at(part, "image_url")))
    found.append(F.when(_is(part, "image_url") | _is(part, "input_image"), F.coalesce(_withheld(url, "url"), _withheld(_string(_at(part, "file_id")), "name"))))
    return F.coalesce(*found)


def _reasons(holder: Column, kind: Column) -> Column:
    of = lambda p: F.concat(_texts(_image_reason(p)), F.transform(F.coalesce(F.when(_is(p, "tool_result"), _list(_at(p, "content"))), F.array().cast("array<variant>")), _image_reason))
    return F.flatten(F.transform(_parts(holder, kind), of))


def _left(holder: Column, kind: Column) -> Column:
    """How many parts look like images but have none (no data, or an address that is too short for one), and stay."""
    mark = lambda p: F.when(_image_reason(p).isNull() & F.coalesce(F.to_json(p).rlike(_ANY_IMAGE), F.lit(False)) & ~_is(p, "tool_result"), 1).otherwise(0)
    inside = lambda p: F.transform(F.coalesce(F.when(_is(p, "tool_result"), _list(_at(p, "content"))), F.array().cast("array<variant>")), mark)
    return _sum(F.flatten(F.transform(_parts(holder, kind), lambda p: F.concat(F.array(mark(p)), inside(p)))))


#: A JSON text without any of these has no image, wherever it might stand (of an escaped letter it is not known).
_HINTS = ('"image', '"input_image', "inline_data", "inlineData", "file_data", "fileData", "\\u00")


def _may_have_image(body: Column) -> Column:
    """Whether images need be looked for: that takes many questions and patterns for each part, and most bodies have none."""
    hits = [F.contains(body, F.lit(h)) for h in _HINTS]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(True))


#: An image that stands elsewhere than in a list of parts: the whole body is withheld.
_ANY_IMAGE = r'"type":"(?:image|input_image|image_url)"|"(?:inline_data|inlineData|file_data|fileData)":\{[^{}]*"(?:mime_type|mimeType)":"image/'


def _filled(value) -> bool:
    return isinstance(value, str) and bool(value)


def _image(part: dict, see: See) -> dict | None:
    """``part`` with its image, if it is one, seen; None if the image is withheld."""
    new = lambda holder, key, form: None if (v := see(holder[key], form)) is None else holder | {key: v}
    put = lambda key, held: None if held is None else part | {key: held}
    for keys, at, form in ((("inline_data", "inlineData"), ("data",), "base64"), (("file_data", "fileData"), ("file_uri", "fileUri"), "name")):
        for key in keys:
            held = part.get(key)
            field = next((f for f in at if _filled(held.get(f))), None) if isinstance(held, dict) else None
            if field and str(held.get("mime_type", held.get("mimeType", "image/png"))).lower().startswith("image/"):
                return put(key, new(held, field, form))
    if part.get("type") == "image" and isinstance(source := part.get("source"), dict):
        field, form = next(((f, k) for f, k in (("data", "base64"), ("url", "url"), ("file_id", "name")) if _filled(source.get(f))), (None, None))
        return put("source", new(source, field, form)) if field else part
    if part.get("type") in ("image_url", "input_image"):
        url = part.get("image_url")
        if isinstance(url, dict) and _filled(url.get("url")):
            return put("image_url", new(url, "url", "url"))
        if _filled(url):
            return new(part, "image_url", "url")
        return new(part, "file_id", "name") if _filled(part.get("file_id")) else part
    return part


def walk_images(node, see: See):
    """``node`` with all image parts seen, at any depth; what is withheld is taken out of its list or object."""
    if isinstance(node, list):
        return [x for x in (walk_images(x, see) for x in node) if x is not _GONE]
    if isinstance(node, dict):
        found = _image(node, see)
        return _GONE if found is None else node | found if found is not node else {k: x for k, x in ((k, walk_images(v, see)) for k, v in node.items()) if x is not _GONE}
    return node


_GONE = object()


def _see(redactor: Redactor | None, fill: tuple[int, int, int], said: list[str]) -> See:
    def see(value: str, form: str) -> str | None:
        head = ""
        if form == "url":
            if len(value) < _SHORT and not _SCHEME.match(value):
                return value
            if value.lstrip()[:5].lower() == "data:":
                head, comma, value = value.partition(",")
                head += comma
            elif _SCHEME.match(value):
                form = "name"
        try:
            if form == "name" or redactor is None:
                said.append("withheld: not in the body" if form == "name" else "withheld: no redactor")
                return None
            new = head + base64.b64encode(redactor(base64.b64decode(value, validate=True), fill)).decode()
        except Exception as e:  # fail closed: the row says so, the image is withheld
            said.append(f"withheld: {type(e).__name__}")
            return None
        said.append("ok")
        return new

    return see


def _load(body: str | None) -> dict | None:
    try:
        found = json.loads(body) if body else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _seen(df: DataFrame, body_col: str, status_col: str, redactor: Redactor, fill: tuple[int, int, int]) -> DataFrame:
    """Adds ``status_col`` and replaces ``body_col`` by bodies whose images have gone through ``redactor``."""

    def body(raw):
        if (loaded := _load(raw)) is None:
            return raw, None
        said: list[str] = []
        whole = walk_images([loaded], _see(redactor, fill, said))
        return json.dumps(whole[0], ensure_ascii=False) if whole else None, next((s for s in said if s != "ok"), "ok") if said else "no image"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [body(b) for b in batch[body_col]]
            yield batch.assign(**{body_col: [d[0] for d in done], status_col: [d[1] for d in done]})

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField(status_col, StringType())]))


def _kind_of(v: Column) -> Column:
    has = lambda key: F.coalesce(F.schema_of_variant(_at(v, key)) != "VOID", F.lit(False))
    return F.when(has("messages"), F.when(has("system"), "messages").otherwise("chat")).when(has("input"), "responses").when(has("contents"), "generate")


def envelope_kind(body: Column) -> Column:
    """Which shape a request has by its keys: messages, input or contents; null for anything else, also for bad JSON.

    Keys can't tell ``messages`` without a system prompt from ``chat``: where the endpoint is known, hand its kind to
    :func:`redact_requests`.
    """
    return _kind_of(F.try_parse_json(body))


def _own(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in names]


def redact_requests(df: DataFrame, body_col: str = "body", kind_col: str | None = None, lang: str | None = "ja", entities: list[str] | None = None, catalog: Catalog = DEFAULT, redactor: Redactor | None = None, fill: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Adds (or replaces) ``kind``, ``redacted_body``, ``mapping``, ``quarantined`` and ``image_status``; other columns stay.

    Placeholders are <TYPE_part_start>, so parts never collide. A body that is no JSON object (or has a key twice) is quarantined: its
    redacted body is null. A body of no known shape stays as it is, with an empty mapping and the status ``not known``. Bodies are
    written anew by the JSON writer: keys in order, numbers in their shortest form.

    Texts: contents and text parts, system prompts and instructions, results of tools, arguments of calls (of objects every string at
    any depth, but no key). Images go through ``redactor`` (as in :func:`.images.redact_images`). Without it, where it fails, and
    where the image lies elsewhere (a web address, a file's name; nothing is fetched) its part is taken out; a body with an image
    outside of lists of parts is quarantined. ``image_status``: ``no image``, ``ok``, ``not known`` or ``withheld: `` and why.
    """
    v, holders, parts, places, texts, flat, number, done, at, new, built, json_, why, left, maybe = names = _own(df, *(f"_{k}" for k in ("v", "holders", "parts", "places", "texts", "flat", "number", "done", "at", "new", "built", "json", "why", "left", "maybe")))
    kind = F.col("kind")
    out = df.withColumn(v, F.try_parse_json(body_col)).withColumn(maybe, _may_have_image(F.col(body_col)))
    out = out.withColumn("kind", F.col(kind_col) if kind_col else _kind_of(F.col(v)))
    out = out.withColumn(v, F.when(_object(F.col(v)).isNotNull(), F.col(v))).withColumn(holders, F.when(kind.isin(*KINDS), _holders(F.col(v), kind)))
    reasons = F.filter(F.flatten(F.transform(holders, lambda h: _reasons(h, kind))), lambda r: r.isNotNull())
    out = out.withColumn(why, F.when(F.col(maybe), F.get(reasons, 0))).withColumn(left, F.when(F.col(maybe), _sum(F.transform(holders, lambda h: _left(h, kind)))))

    # all texts of a body, in one array; where those of each holder and part begin
    out = out.withColumn(parts, F.transform(holders, lambda h: F.transform(_parts(h, kind), lambda p: _part_texts(p, kind))))
    out = out.withColumn(texts, F.transform(holders, lambda h, i: _holder_texts(h, kind, F.get(parts, i))))
    out = out.withColumn(flat, F.flatten(texts)).withColumn(at, _offsets(F.transform(texts, lambda t: F.size(t))))
    out = out.withColumn(number, _offsets(F.transform(flat, lambda t: F.when(F.coalesce(t, F.lit("")) != "", 1).otherwise(0))))
    out = out.withColumn(parts, F.transform(parts, lambda p: F.transform(p, lambda t: F.size(t)))).withColumn(places, F.transform(parts, _offsets))

    def redacted(t: Column, part: Column) -> Column:
        done_ = lambda s: F.struct(F.when(F.size(s) > 0, splice(t, s, lambda x: placeholder(x, part))).alias("text"), F.map_entries(mapping_of(s, part)).alias("entries"))
        return bind(F.coalesce(spans_of(t, entities, lang, catalog), no_spans()), lambda s: bind(disjoint_spans(s), done_))

    out = out.withColumn(done, F.transform(flat, lambda t, i: redacted(t, F.get(number, i))))

    # the body around its new texts, from the inside out
    out = out.withColumn(new, F.transform(texts, lambda t, i: F.slice(F.col(f"{done}.text"), F.get(at, i) + 1, F.size(t))))
    own = lambda i, j: F.slice(F.get(new, i), F.get(F.get(places, i), j) + 2, F.get(F.get(parts, i), j))
    out = out.withColumn(built, F.transform(holders, lambda h, i: F.transform(_parts(h, kind), lambda p, j: _part_with(p, kind, own(i, j), F.lit(True) if redactor is not None else ~F.col(maybe)))))
    there = lambda i: F.filter(F.get(built, i), lambda p: p.isNotNull())
    out = out.withColumn(built, F.transform(holders, lambda h, i: _holder_with(h, kind, F.get(new, i), there(i), 1 + _sum(F.get(parts, i)))))
    whole = F.coalesce(_body_with(F.col(v), kind, F.col(built)), F.col(v))
    out = out.withColumn(json_, F.when(kind.isin(*KINDS), F.to_json(whole)).otherwise(F.when(F.col(v).isNotNull(), F.col(body_col))))
    out = out.withColumn("mapping", F.coalesce(F.map_from_entries(F.flatten(f"{done}.entries")).cast(MAPPING), F.map_from_arrays(F.array(), F.array()).cast(MAPPING)))
    out = out.withColumn("quarantined", F.col(v).isNull()).drop(*names[:-4])
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    if redactor is not None:
        out = _seen(out.drop(why, left, maybe), json_, why, redactor, fill)
        status = F.col(why)
    else:
        hidden = known & F.col(maybe) & (F.regexp_count(F.col(json_), F.lit(_ANY_IMAGE)) > F.col(left))
        out = out.withColumn("quarantined", F.col("quarantined") | F.coalesce(hidden, F.lit(False)))
        status = F.when(hidden, "withheld: the body").otherwise(F.coalesce(F.col(why), F.lit("no image")))
    out = out.withColumn("image_status", F.when(known & F.col(json_).isNotNull(), status).when(F.col(json_).isNotNull(), "not known"))
    return out.withColumn("redacted_body", F.when(~F.col("quarantined"), F.col(json_))).drop(json_, why, left, maybe)


#: A placeholder in JSON text; its angle brackets may be escaped.
_SAID = r"(?:<|(?<!\\)\\u003[cC])([A-Z_]+(?:_\d+)+)(?:>|\\u003[eE])"


def restore_responses(df: DataFrame, body_col: str = "response", kind_col: str = "kind", mapping_col: str = "mapping", status_col: str | None = None) -> DataFrame:
    """Adds ``restored``: the response with originals, where there is a mapping, the status is 200 and the body is a JSON object of a known shape.

    Placeholders are replaced wherever they stand in the body's text, by their originals as JSON strings hold them; nothing else of the
    body changes. The response's own keys, or else ``kind_col``, say whether its shape is known.
    """
    (v,) = _own(df, "_v")
    out = df.withColumn(v, F.try_parse_json(body_col))
    shape = F.coalesce(*(_at(F.col(v), k) for k in ("choices", "content", "delta", "output", "output_text", "candidates"))).isNotNull() | F.coalesce(F.col(kind_col).isin(*KINDS), F.lit(False))
    go = (F.coalesce(F.size(mapping_col), F.lit(0)) > 0) & _object(F.col(v)).isNotNull() & shape
    go = go & F.coalesce(F.col(status_col) == 200, F.lit(False)) if status_col else go
    quoted = F.transform_values(mapping_col, lambda _, x: F.to_json(_variant(x)))
    inner = F.transform_values(quoted, lambda _, x: F.substring(x, F.lit(2), F.char_length(x) - 2))
    pieces = F.split(F.regexp_replace(body_col, _SAID, "\x01$0\x01"), "\x01", -1)  # JSON text has no such character
    name = lambda p: F.when(p.rlike(f"^{_SAID}$"), F.regexp_replace(p, f"^{_SAID}$", "<$1>"))
    back = lambda m: F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(m, name(p)), p)).otherwise(p)), "")
    return out.withColumn("restored", F.when(go, bind(inner, back)).otherwise(F.col(body_col))).drop(v)


def forwarded_headers(headers: Column) -> Column:
    """Request headers without those that a changed body makes wrong."""
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin("host", "content-length"))
