"""The queries in DuckDB SQL, where SQL can say them."""

from __future__ import annotations

from ..functions.catalog import DEFAULT, ENTITY_TYPES, Pattern
from ..functions.extension import CORPORATE_WEIGHTS, MY_NUMBER_WEIGHTS
from ..operators.evaluate import CRITERIA
from . import fixtures
from .queries import PAIR

#: Look-around has no counterpart in that engine; these patterns are left out (they need a leading 0 and have no hit in the tables).
_NO = {"ja_phone_mobile", "ja_phone_freephone", "ja_phone_fixed"}


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return repr(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") AS v({columns})"


def _regex(p: Pattern) -> str:
    return "(?ims)" + p.regex


def spans(entity: str, p: Pattern, source: str = "documents", key: str = "doc_id", text: str = "text", more: str = "") -> str:
    keys = ", ".join([key, *([more] if more else [])])
    return f"""SELECT {keys}, {q(entity)} AS entity_type, start, start + length(piece) AS "end", CAST({p.score} AS DOUBLE) AS score, piece AS text FROM (
      SELECT {keys}, s[i] AS piece, CAST(coalesce(list_sum(list_transform(s[1:i-1], lambda z: length(z))), 0) AS BIGINT) AS start FROM (
        SELECT {keys}, s, unnest(range(2, len(s) + 1, 2)) AS i FROM (
          SELECT {keys}, string_split(regexp_replace({text}, {q(_regex(p))}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS s FROM {source})))"""


def every(entities: list[str] | None = None, threshold: float = 0.0, **options) -> str:
    parts = []
    for r in DEFAULT.prune(entities).recognizers:
        parts += [spans(r.entity, p, **options) for p in r.patterns if p.name not in _NO and p.score >= threshold]
    return "\nUNION ALL\n".join(parts)


def only(entity: str, **options) -> str:
    return every([entity], **options)


_REGEX = {r.entity: _regex(r.patterns[0]) for r in DEFAULT.recognizers}


def replaced(values_: dict[str, str], text: str = "text") -> str:
    """Both types replaced; mail first, as it scores higher."""
    for entity, value in values_.items():
        text = f"regexp_replace({text}, {q(_REGEX[entity])}, {q(value)}, 'g')"
    return text


def _redacted(mail: str, ip: str) -> str:
    return f"SELECT doc_id, {replaced({'EMAIL_ADDRESS': mail, 'IP_ADDRESS': ip})} AS redacted FROM documents"


def free_of_mail(sql: str, keys: tuple[str, ...]) -> str:
    """Spans without those that a mail address overlaps."""
    on = " AND ".join(f"m.{k} = s.{k}" for k in keys)
    return f"""WITH s AS ({sql}) SELECT * FROM s WHERE entity_type = 'EMAIL_ADDRESS' OR NOT EXISTS (
      SELECT 1 FROM s m WHERE {on} AND m.entity_type = 'EMAIL_ADDRESS' AND m.start < s."end" AND s.start < m."end")"""


_PAIRS = free_of_mail(every(PAIR), ("doc_id",))
_TURNS = free_of_mail(every(PAIR, source="(SELECT doc_id // 5 AS conv_id, doc_id % 5 AS turn, text FROM documents)", key="conv_id, turn"), ("conv_id", "turn"))
_BODIES = "(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1 - doc_id, doc_id % 5, text FROM documents)"
_CLEAN = replaced({"EMAIL_ADDRESS": "<EMAIL_ADDRESS>", "IP_ADDRESS": "<IP_ADDRESS>"})
_F = "coalesce(2 * p * r / nullif(p + r, 0), 0)"
_COUNTS = f"SELECT label, tp * 1.0::DOUBLE / pred AS p, tp * 1.0::DOUBLE / gold AS r FROM {values(fixtures.COUNTS, 'label, tp, pred, gold')}"
_SCORES = f"(SELECT label, p, r, {_F} AS f FROM ({_COUNTS}))"
_CRITERIA = values(CRITERIA, "label, f1_min, recall_min")

ORACLES: dict[str, str] = {
    "detect_email": only("EMAIL_ADDRESS"),
    "detect_ipv4": only("IP_ADDRESS"),
    "detect_credit_card": every(["CREDIT_CARD"]),
    "detect_postal_code": every(["POSTAL_CODE"]),
    "detect_url": only("URL", source="pages", key="page_id", text="url"),
    "detect_all_documents": every(),
    "entity_filter": every(PAIR),
    "score_threshold": every(threshold=0.55),
    "context_boost": "SELECT case_id, entity_type, CAST(score AS DOUBLE) AS score FROM " + values([(c, e, s) for c, _, e, s in fixtures.CONTEXT_CASES], "case_id, entity_type, score"),
    "dedupe_same_type": "SELECT * FROM " + values([(c, k) for c, _, k, _ in fixtures.SPAN_CASES], "case_id, kept"),
    "resolve_conflicts": "SELECT * FROM " + values([(c, k) for c, _, _, k in fixtures.SPAN_CASES], "case_id, kept"),
    "redact_default": _redacted("<EMAIL_ADDRESS>", "<IP_ADDRESS>"),
    "redact_new_value": _redacted("[hidden]", "[hidden]"),
    "redact_remove": f"SELECT doc_id, string_agg(CASE WHEN i % 2 = 1 THEN s[i] ELSE '' END, '' ORDER BY i) AS redacted FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split({replaced({'EMAIL_ADDRESS': chr(1) + chr(92) + '0' + chr(1), 'IP_ADDRESS': chr(1) + chr(92) + '0' + chr(1)})}, chr(1)) AS s FROM documents)) GROUP BY doc_id",
    "redact_keep": "SELECT doc_id, text AS redacted FROM documents",
    "redact_mask": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS k, left(text, length(text) - 4) || '####' AS masked FROM ({only('IP_ADDRESS')})",
    "redact_hash": f"SELECT doc_id, start, sha256(text) AS digest FROM ({_PAIRS})",
    "redact_encrypt_roundtrip": f"SELECT doc_id, start, text FROM ({_PAIRS})",
    "redact_items": f"SELECT doc_id, CASE entity_type WHEN 'IP_ADDRESS' THEN 'redact' ELSE 'replace' END AS item, count(*) AS n FROM ({_PAIRS}) GROUP BY 1, 2",
    "reversible_mapping": f"SELECT doc_id, '<' || entity_type || '_' || start || '>' AS placeholder, text AS original FROM ({_PAIRS})",
    "restore_roundtrip": "SELECT doc_id, text FROM documents",
    "mapping_merge_last_wins": f"SELECT conv_id, '<' || entity_type || '_' || start || '>' AS placeholder, max_by(text, turn) AS original FROM ({_TURNS}) GROUP BY 1, 2",
    "mapping_namespaced": f"SELECT conv_id, '<' || entity_type || '_' || turn || '_' || start || '>' AS placeholder, text AS original FROM ({_TURNS})",
    "envelope_router": "SELECT * FROM " + values([(c, k) for c, _, k in fixtures.BODIES], "case_id, kind"),
    "header_drop": "SELECT CAST(1 AS BIGINT) AS id, 'x-key' AS name, 'k' AS value",
    "data_url_decode": "SELECT CAST(id AS BIGINT) AS id, mime, hex(from_base64(b)) AS bytes, \"real\" FROM (VALUES (1, 'image/gif', 'R0lGODlh', 'image/gif'), (2, 'image/png', 'aGVsbG8=', NULL)) AS v(id, mime, b, \"real\")",
    "input_guard": "SELECT CAST(id AS BIGINT) AS id, refused FROM (VALUES (1, FALSE), (2, TRUE), (3, FALSE)) AS v(id, refused)",
    "entity_counts": f"SELECT lang, entity_type, count(*) AS n FROM ({every(more='lang')}) GROUP BY 1, 2",
    "entity_counts_per_doc": f"SELECT doc_id, entity_type, count(*) AS n FROM ({every()}) GROUP BY 1, 2",
    "entity_texts_by_type": f"SELECT doc_id, entity_type, string_agg(text, '|' ORDER BY text) AS texts FROM ({every(PAIR)}) GROUP BY 1, 2",
    "residue_check": f"SELECT entity_type, count(*) AS n FROM ({every(threshold=0.5)}) WHERE entity_type NOT IN ('EMAIL_ADDRESS', 'IP_ADDRESS') GROUP BY 1",
    "entity_taxonomy": "SELECT * FROM " + values([(e.label, e.family) for e in ENTITY_TYPES], "label, family"),
    "parse_annotations": "SELECT * FROM " + values([(r, t, e) for r, t, e, _ in fixtures.TAG_CASES], "raw, text, entities"),
    "validate_annotations": "SELECT CAST(id AS BIGINT) AS id, valid FROM (VALUES (0, TRUE), (1, FALSE), (2, FALSE), (3, FALSE), (4, TRUE)) AS v(id, valid)",
    "align_expand": "SELECT CAST(id AS BIGINT) AS id, CAST(total AS BIGINT) AS total, CAST(failed AS BIGINT) AS failed, aligned FROM (VALUES (1, 3, 0, 'PERSON:0-6,PERSON:7-9'), (2, 1, 1, '')) AS v(id, total, failed, aligned)",
    "split_exact": "SELECT doc_id, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)",
    "prf_per_type": f"""WITH g AS (SELECT * FROM {values(fixtures.GOLD, 'd, s, e, label')}), p AS (SELECT * FROM {values(fixtures.PRED, 'd, s, e, label')}),
      c AS (SELECT coalesce(g.label, p.label) AS label, count(g.d) AS gold, count(p.d) AS pred, count(CASE WHEN g.d IS NOT NULL AND p.d IS NOT NULL THEN 1 END) AS tp
        FROM g FULL JOIN p ON g.d = p.d AND g.s = p.s AND g.e = p.e AND g.label = p.label GROUP BY 1),
      x AS (SELECT label, coalesce(tp * 1.0::DOUBLE / nullif(pred, 0), 0) AS p, coalesce(tp * 1.0::DOUBLE / nullif(gold, 0), 0) AS r FROM c)
      SELECT label, p, r, {_F} AS f FROM x""",
    "prf_overall": f"SELECT round(p, 9) AS p, round(r, 9) AS r, round({_F}, 9) AS f FROM (SELECT sum(tp) * 1.0::DOUBLE / sum(pred) AS p, sum(tp) * 1.0::DOUBLE / sum(gold) AS r FROM {values(fixtures.COUNTS, 'label, tp, pred, gold')})",
    "acceptance": f"""SELECT label, f >= f1_min AND r >= recall_min AS accepted, CASE WHEN r < recall_min THEN 'R_LOW' WHEN f < f1_min THEN 'FAIL' ELSE 'OK' END AS status FROM (
      SELECT c.label, f1_min, recall_min, coalesce(s.f, 0) AS f, coalesce(CASE WHEN s.label = 'PERSON' THEN 0.5 ELSE s.r END, 0) AS r FROM {_CRITERIA.replace(' AS v(', ' AS c(')} LEFT JOIN (SELECT * FROM {_SCORES} WHERE label <> 'BANK_ACCOUNT') s ON s.label = c.label)""",
    "leakage_warnings": "SELECT 'ADDRESS' AS label, CAST(0.3 AS DOUBLE) AS shortfall",
    "fp_rate": f"SELECT label, round(CASE WHEN p > 0 THEN 1 - p ELSE 1 END, 9) AS fp_rate FROM (SELECT label, p FROM {_SCORES} UNION ALL SELECT 'ZERO', 0 UNION ALL SELECT 'NONE', NULL)",
    "model_comparison": f"SELECT v.label, CAST(bert AS DOUBLE) AS bert, CAST(lg AS DOUBLE) AS lg, CAST(md AS DOUBLE) AS md, CAST(sm AS DOUBLE) AS sm, round(coalesce(s.f, 0), 9) AS own FROM {values(fixtures.EXTERNAL, 'label, bert, lg, md, sm')} LEFT JOIN (SELECT * FROM {_SCORES} WHERE label <> 'ADDRESS') s ON s.label = v.label",
    "max_normalised": "SELECT model, round(CAST(mb / max(mb) OVER () AS DOUBLE), 9) AS height FROM (SELECT model, CAST(mb AS DOUBLE) AS mb FROM (VALUES ('own', 6.3), ('bert', 440.0), ('lg', 583.8), ('md', 56.0), ('sm', 13.8)) AS v(model, mb))",
    "rule_entities": "SELECT CAST(id AS BIGINT) AS id, entity_type FROM (VALUES (1, 'PERSON'), (1, 'ADDRESS'), (2, 'DATE_OF_BIRTH'), (4, 'BANK_ACCOUNT')) AS v(id, entity_type)",
    "stream_detect_available_now": f"SELECT doc_id, entity_type, start, text FROM ({every(PAIR)})",
}
for _kind in ("chat", "messages", "responses", "generate"):
    _shape = "CASE WHEN turn % 2 = 0 AND text IS NOT NULL THEN 'messages' ELSE 'chat' END" if _kind == "messages" else "CASE WHEN text IS NULL THEN NULL ELSE 'responses' END" if _kind == "responses" else q(_kind)
    ORACLES[f"{_kind}_request_redact"] = f"SELECT conv_id, turn, {_shape} AS kind, {_CLEAN} AS redacted FROM {_BODIES}"
    ORACLES[f"{_kind}_response_restore"] = f"SELECT conv_id, turn, text FROM {_BODIES}"
ORACLES["detect_cases"] = "SELECT case_id, entity_type, CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\", CAST(score AS DOUBLE) AS score FROM " + values([(c, e, a, b, s) for c, _, e, found in fixtures.DETECT_CASES for a, b, s in found], "case_id, entity_type, start, \"end\", score")
ORACLES["segments"] = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS k, entity_type, n_chars FROM (
  WITH s AS ({_PAIRS}), e AS (SELECT doc_id, entity_type, start, "end", lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM s)
  SELECT doc_id, entity_type, start, "end" - start AS n_chars FROM e
  UNION ALL SELECT doc_id, NULL, before, start - before FROM e WHERE start > before
  UNION ALL SELECT d.doc_id, NULL, coalesce(m.last, 0), length(d.text) - coalesce(m.last, 0) FROM documents d LEFT JOIN (SELECT doc_id, max("end") AS last FROM s GROUP BY 1) m ON m.doc_id = d.doc_id WHERE length(d.text) > coalesce(m.last, 0))"""

_ANSWERS = free_of_mail(every(PAIR, source=_BODIES, key="conv_id, turn"), ("conv_id", "turn"))
ORACLES["delta_restore_stream"] = f"SELECT b.conv_id, b.turn, 1 + coalesce(s.n, 0) AS chunks, coalesce(b.text, '') AS text FROM {_BODIES} b LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM ({_ANSWERS}) GROUP BY 1, 2) s ON s.conv_id = b.conv_id AND s.turn = b.turn"
_CARRIED = f"""s AS ({_TURNS}), f AS (SELECT conv_id, entity_type, text, min(turn * 1000000000 + start) AS first FROM s GROUP BY ALL),
  k AS (SELECT conv_id, entity_type, text, '<' || entity_type || '_' || dense_rank() OVER (PARTITION BY conv_id ORDER BY first) || '>' AS name FROM f),
  p AS (SELECT s.*, k.name FROM s JOIN k ON k.conv_id = s.conv_id AND k.entity_type = s.entity_type AND k.text = s.text)"""
ORACLES["carried_mapping_stream"] = f"WITH {_CARRIED} SELECT DISTINCT conv_id, turn, name AS placeholder, text AS original FROM p"
ORACLES["carried_redaction"] = f"""WITH {_CARRIED}, t AS (SELECT doc_id // 5 AS conv_id, doc_id % 5 AS turn, text FROM documents),
  e AS (SELECT p.*, t.text AS whole, lag("end", 1, 0) OVER (PARTITION BY p.conv_id, p.turn ORDER BY start) AS before FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn),
  g AS (SELECT conv_id, turn, string_agg(substr(whole, CAST(before AS BIGINT) + 1, CAST(start - before AS BIGINT)) || name, '' ORDER BY start) || substr(any_value(whole), CAST(max("end") AS BIGINT) + 1) AS redacted FROM e GROUP BY 1, 2)
  SELECT t.conv_id, t.turn, coalesce(g.redacted, t.text) AS redacted FROM t LEFT JOIN g ON g.conv_id = t.conv_id AND g.turn = t.turn"""
ORACLES["overlapping_types"] = f"""WITH s AS ({every()}) SELECT a.doc_id, a.entity_type AS entity_type_a, a.start AS start_a, a."end" AS end_a, b.entity_type AS entity_type_b, b.start AS start_b, b."end" AS end_b
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end" AND (a.start, a."end", a.entity_type) < (b.start, b."end", b.entity_type)"""

_LATE = 7200
ORACLES["late_window_counts"] = f"""WITH m AS (SELECT max(doc_id * 600) FILTER (WHERE doc_id % 10 <> 7) - {_LATE} AS first, max(doc_id * 600) - {_LATE} AS last FROM documents),
  s AS (SELECT doc_id, doc_id * 600 // 3600 * 3600 AS window_start, entity_type FROM ({every()}))
  SELECT window_start, entity_type, count(*) AS n FROM s, m WHERE window_start + 3600 <= m.last AND (doc_id % 10 <> 7 OR window_start + 3600 > m.first) GROUP BY 1, 2"""
ORACLES["append_exactly_once"] = f"SELECT doc_id, CAST(1 AS BIGINT) AS copies, count(*) AS entities FROM ({every(PAIR)}) GROUP BY 1"
ORACLES["append_counters"] = f"WITH n AS (SELECT count(*) AS total, (SELECT count(DISTINCT doc_id) FROM ({every(PAIR)})) AS new FROM documents) SELECT total, new, total - new AS failed FROM n"


def _digit(i: int | str) -> str:
    return f"CAST(substr(d, {i}, 1) AS BIGINT)"


_WEIGHED = lambda weights, at: " + ".join(f"{w} * {_digit(i + at)}" for i, w in enumerate(weights))
_REST = f"(({_WEIGHED(MY_NUMBER_WEIGHTS, 1)}) % 11)"
_LUHN = " + ".join(f"(CASE WHEN {_digit(i)} > 4 THEN 2 * {_digit(i)} - 9 ELSE 2 * {_digit(i)} END)" if i % 2 else _digit(i) for i in range(1, 17))
_RIGHT = f"""CASE WHEN entity_type = 'CREDIT_CARD' AND length(d) = 16 THEN ({_LUHN}) % 10 = 0
  WHEN entity_type = 'MY_NUMBER' AND length(d) = 12 THEN {_digit(12)} = (CASE WHEN {_REST} <= 1 THEN 0 ELSE 11 - {_REST} END)
  WHEN entity_type = 'MY_NUMBER_CORPORATE' AND length(d) = 13 THEN {_digit(1)} = 9 - ({_WEIGHED(CORPORATE_WEIGHTS, 2)}) % 9 END"""
_CHECKED = f"""SELECT *, {_RIGHT} AS "right" FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM ({every(["MY_NUMBER", "CREDIT_CARD", "MY_NUMBER_CORPORATE"])}))"""
ORACLES["checked_number_spans"] = f'SELECT doc_id, entity_type, start, "end", "right" FROM ({_CHECKED})'
#: Any number of 12, 13 or 16 digits, whatever it begins with.
_LONG = Pattern("long", r"\b(?:\d{1,4}(?:[ \-]?\d{4}){2,3}|\d{12,16})\b", 1.0)
_LONG_RIGHT = _RIGHT.replace("entity_type = 'CREDIT_CARD' AND ", "").replace("entity_type = 'MY_NUMBER' AND ", "").replace("entity_type = 'MY_NUMBER_CORPORATE' AND ", "")
ORACLES["lateral_checked_numbers"] = f"""SELECT doc_id, CASE length(d) WHEN 16 THEN 'CREDIT_CARD' WHEN 12 THEN 'MY_NUMBER' ELSE 'MY_NUMBER_CORPORATE' END AS entity_type, start, "end", text
  FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM ({spans("NUMBER", _LONG)})) WHERE {_LONG_RIGHT}"""
_TAGGED = f"SELECT doc_id, start, \"end\", CASE entity_type WHEN 'IP_ADDRESS' THEN 'ADDRESS' ELSE 'PERSON' END AS label, text FROM ({_PAIRS})"
ORACLES["tagged_documents"] = _TAGGED
ORACLES["validated_documents"] = f"SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS valid FROM ({_TAGGED}) GROUP BY 1"
_TOKENS = spans("TOKEN", Pattern("token", r"[^\x20\x09-\x0D]+", 1.0))
_WIDE = f"""k AS (SELECT doc_id, start, "end", row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS no FROM ({_TOKENS})),
  w AS (SELECT e.doc_id, e.label, e.start, e."end", max(k.no) FILTER (WHERE k.start <= e.start) AS "first", min(k.no) FILTER (WHERE k."end" >= e."end") AS "last",
    max(k.start) FILTER (WHERE k.start <= e.start) AS wide_start, min(k."end") FILTER (WHERE k."end" >= e."end") AS wide_end FROM e LEFT JOIN k ON k.doc_id = e.doc_id GROUP BY ALL)"""
ORACLES["token_alignment"] = f"WITH e AS (SELECT doc_id, entity_type AS label, start, \"end\" FROM ({every()})), {_WIDE} SELECT doc_id, label, start, \"end\", \"first\", \"last\" FROM w"
ORACLES["aligned_corpus"] = f"""WITH RECURSIVE e AS (SELECT doc_id, label, start, "end" FROM ({_TAGGED})), {_WIDE},
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM w WHERE "first" IS NOT NULL AND "last" IS NOT NULL),
  r AS (SELECT doc_id, i, "last" AS reach, label || ':' || wide_start || '-' || wide_end AS kept FROM o WHERE i = 1
    UNION ALL SELECT o.doc_id, o.i, CASE WHEN o."first" > r.reach THEN o."last" ELSE r.reach END, r.kept || CASE WHEN o."first" > r.reach THEN ',' || o.label || ':' || o.wide_start || '-' || o.wide_end ELSE '' END
      FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1)
  SELECT d.doc_id, CAST(coalesce(c.total, 0) AS BIGINT) AS total, CAST(coalesce(c.failed, 0) AS BIGINT) AS failed, coalesce(x.kept, '') AS aligned FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE "first" IS NULL OR "last" IS NULL) AS failed FROM w GROUP BY 1) c ON c.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, max_by(kept, i) AS kept FROM r GROUP BY 1) x ON x.doc_id = d.doc_id"""
_MATCHED = f"""g AS (SELECT DISTINCT doc_id, start, "end", entity_type AS label FROM ({every()})),
  p AS (SELECT DISTINCT doc_id, start + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS start, "end", entity_type AS label FROM ({every(threshold=0.3)})),
  c AS (SELECT coalesce(g.label, p.label) AS label, count(g.doc_id) AS gold, count(p.doc_id) AS pred, count(CASE WHEN g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL THEN 1 END) AS tp
    FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.start = p.start AND g."end" = p."end" AND g.label = p.label GROUP BY 1)"""
_MATCH_SCORES = f"x AS (SELECT label, coalesce(tp * 1.0::DOUBLE / nullif(pred, 0), 0) AS p, coalesce(tp * 1.0::DOUBLE / nullif(gold, 0), 0) AS r FROM c), y AS (SELECT label, p, r, {_F} AS f FROM x)"
ORACLES["prf_documents"] = f"WITH {_MATCHED}, {_MATCH_SCORES} SELECT label, p, r, f FROM y"
ORACLES["prf_documents_overall"] = f"WITH {_MATCHED}, z AS (SELECT coalesce(sum(tp) * 1.0::DOUBLE / nullif(sum(pred), 0), 0) AS p, coalesce(sum(tp) * 1.0::DOUBLE / nullif(sum(gold), 0), 0) AS r FROM c) SELECT p, r, {_F} AS f FROM z"
ORACLES["acceptance_documents"] = f"""WITH {_MATCHED}, {_MATCH_SCORES} SELECT label, f >= 0.6 AND r >= 0.7 AS accepted, CASE WHEN r < 0.7 THEN 'R_LOW' WHEN f < 0.6 THEN 'FAIL' ELSE 'OK' END AS status,
  CASE WHEN p > 0 THEN 1 - p ELSE 1 END AS fp_rate, CASE WHEN r < 0.7 THEN CAST(0.7 AS DOUBLE) - r END AS shortfall FROM y"""
