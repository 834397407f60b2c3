"""Named entities: a plug-in for models, and rules that stand in where no model is given.

The rules know surface cues of Japanese texts (honorifics, legal forms, prefectures, birth cues, bank words). They are no
model: their quality is what the tests show, not a trained model's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.catalog import Catalog, Pattern, Recognizer
from ..functions.spans import SPANS, distinct_spans, no_spans, spans_of

_NAME = "(?:[\\p{IsHan}々ヶ]{1,4}(?:[ 　]?[\\p{IsHan}々\\p{IsHiragana}]{1,3})?|[\\p{IsKatakana}ー]{2,}(?:[・ 　][\\p{IsKatakana}ー]{2,})*)"
_YMD = "(?:(?:明治|大正|昭和|平成|令和)[ 　]?(?:元|\\d{1,2})|[MTSHR]\\d{1,2}|(?:19|20)\\d{2})(?:年\\d{1,2}月\\d{1,2}日|[./\\-]\\d{1,2}[./\\-]\\d{1,2})"
_PREFECTURE = "(?:北海道|東京都|(?:大阪|京都)府|(?:神奈川|和歌山|鹿児島|[\\p{IsHan}]{2})県)"
RULES = Catalog(
    (
        Recognizer("PERSON", (Pattern("honorific", f"{_NAME}(?=さん|さま|様|氏|先生|殿|くん|君|ちゃん)", 0.6, (), False), Pattern("name_label", f"(?<=(?:氏名|名前|担当|患者|代表者)[:：は][ 　]?){_NAME}", 0.6, (), False))),
        Recognizer("ADDRESS", (Pattern("prefecture", f"{_PREFECTURE}[^\\s、。,，()（）]{{2,40}}", 0.6, (), False),)),
        Recognizer("ORGANIZATION", (Pattern("legal_form", "(?:(?:株式|有限|合同|合資)会社|(?:一般|公益)(?:社団|財団)法人|(?:医療|学校|宗教)法人|独立行政法人)[\\p{L}\\p{N}ー・&]{1,20}?(?=[のはがをにでと、。\\s)）]|$)", 0.6, (), False), Pattern("legal_suffix", "[\\p{IsHan}\\p{IsKatakana}ー・A-Za-z0-9]{1,20}(?:株式会社|有限会社|合同会社|大学|省|庁)", 0.6, (), False))),
        Recognizer("DATE_OF_BIRTH", (Pattern("born_before", f"(?<=(?:生年月日|誕生日|生まれ)[:：はが]?[ 　]?){_YMD}", 0.8), Pattern("born_after", f"{_YMD}(?=[ 　]?(?:生まれ|生(?!産|活)|誕生))", 0.8))),
        Recognizer("BANK_ACCOUNT", (Pattern("bank_branch", "[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ーA-Za-zＡ-Ｚ]{1,12}(?:銀行|信用金庫|信金)[ 　]?[\\p{IsHan}\\p{IsKatakana}ー]{1,10}(?:支店|本店|営業部)?[ 　]?(?:普通|当座|貯蓄)(?:預金)?[ 　]?(?:口座)?(?:番号)?[:： 　]?\\d{6,8}", 0.8),)),
    )
)
#: A backend: texts in, for each a list of (entity_type, start, end, score).
Backend = Callable[[list[str]], list[list[tuple[str, int, int, float]]]]


def rule_entities(df: DataFrame, text_col: str = "text", out: str = "ner_spans") -> DataFrame:
    found = F.coalesce(spans_of(F.col(text_col), catalog=RULES, context=False), no_spans())
    return df.withColumn("_found", found).withColumn(out, distinct_spans(F.col("_found"))).drop("_found")


#: Models that this worker has loaded, by the call that asked for them; the oldest ones go.
_LOADED: dict[str, Backend] = {}
_MOST_LOADED = 4


def _once(key: str, load: Callable[[], Backend]) -> Backend:
    """The model of a call: loaded by the first task that a worker runs for it, and kept for the next ones."""
    if key not in _LOADED:
        while len(_LOADED) >= _MOST_LOADED:
            _LOADED.pop(next(iter(_LOADED)))
        _LOADED[key] = load()
    return _LOADED[key]


def _spans(texts: list[str], backend: Backend) -> list[list[dict]]:
    return [[{"entity_type": e, "start": a, "end": b, "score": s, "text": t[a:b]} for e, a, b, s in found] for t, found in zip(texts, backend(texts))]


#: A batch goes through a model in parts of about so many characters, so what a worker holds depends on no batch's size.
PART = 1 << 20


def _parts(batch: pd.DataFrame, text_col: str) -> Iterator[pd.DataFrame]:
    first = size = 0
    for i, text in enumerate(batch[text_col]):
        size += len(text or "")
        if size >= PART:
            yield batch.iloc[first : i + 1]
            first, size = i + 1, 0
    if first < len(batch):
        yield batch.iloc[first:]


def model_entities(df: DataFrame, load: Callable[[], Backend], text_col: str = "text", out: str = "ner_spans") -> DataFrame:
    """Spans of a model: ``load`` is called once in each worker; texts go through it in Arrow batches. Null texts: no spans."""
    schema, key = StructType([*df.schema.fields, *StructType.fromDDL(f"{out} {SPANS}").fields]), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, text_col):
                yield part.assign(**{out: _spans([t or "" for t in part[text_col]], _once(key, load))})

    return df.mapInPandas(run, schema)


def by_language(df: DataFrame, loaders: dict[str, Callable[[], Backend]], lang_col: str = "lang", text_col: str = "text", out: str = "ner_spans") -> DataFrame:
    """Each language by its own model, in one pass over the rows; rows of other languages get no spans."""
    schema, key = StructType([*df.schema.fields, *StructType.fromDDL(f"{out} {SPANS}").fields]), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            langs = list(batch[lang_col])
            for lang in {x for x in langs if x in loaders}:
                at = [i for i, x in enumerate(langs) if x == lang]
                for i, spans in zip(at, _spans([batch[text_col].iloc[i] or "" for i in at], _once(f"{key} {lang}", loaders[lang]))):
                    found[i] = spans
            yield batch.assign(**{out: found})

    return df.mapInPandas(run, schema)
