"""Small inputs with known answers, for queries whose cases the tables lack."""

from __future__ import annotations

#: case, text, entity, and the spans found without context: (start, end, score).
DETECT_CASES = [
    ("mobile", "夜間は080-3345-6612までお願いします", "PHONE_NUMBER", [(3, 16, 0.7)]),
    ("fixed", "代表 052-731-4408 受付", "PHONE_NUMBER", [(3, 15, 0.5)]),
    ("freephone", "窓口 0120-774-905 無料", "PHONE_NUMBER", [(3, 15, 0.7)]),
    ("fullwidth", "直通 ０７０−３３４５−６６１２ 昼", "PHONE_NUMBER", [(3, 16, 0.7)]),
    ("no phone in a long number", "伝票 0803345661278", "PHONE_NUMBER", []),
    ("astral", "🏥𠀋村📱080-3345-6612", "PHONE_NUMBER", [(4, 17, 0.7)]),
    ("my number", "番号欄 7301 4482 9956 を確認", "MY_NUMBER", [(4, 18, 0.5)]),
    ("my number run", "番号欄 730144829956 を確認", "MY_NUMBER", [(4, 16, 0.3)]),
    ("my number full width", "番号欄 ７３０１ ４４８２ ９９５６", "MY_NUMBER", [(4, 18, 0.5)]),
    ("card", "決済に 5204-7300-1188-2046 を使用", "CREDIT_CARD", [(4, 23, 0.6)]),
    ("card run", "決済 5204730011882046 済", "CREDIT_CARD", [(3, 19, 0.5)]),
    ("amex groups", "決済 3714 496353 98431", "CREDIT_CARD", []),
    ("passport", "査証欄 QX4410098 有効", "PASSPORT", [(4, 13, 0.4)]),
    ("passport too long", "部品 QX4410098Z", "PASSPORT", []),
    ("licence", "更新済 508812340076", "DRIVER_LICENSE", [(4, 16, 0.2)]),
    ("ip", "送信元 203.0.113.77 を遮断", "IP_ADDRESS", [(4, 16, 0.6)]),
    ("no ip", "版 300.400.500.600", "IP_ADDRESS", []),
    ("mail", "返信は h.kudo-2@mail.example.ne.jp まで", "EMAIL_ADDRESS", [(4, 31, 0.9)]),
    ("no mail", "宛先 kudo@example", "EMAIL_ADDRESS", []),
    ("corporate", "登記 7 0104 0109 9912", "MY_NUMBER_CORPORATE", [(3, 19, 0.5)]),
    ("corporate run", "登記 7010401099912", "MY_NUMBER_CORPORATE", [(3, 16, 0.3)]),
    ("insurer", "欄 06139876", "HEALTH_INSURANCE", [(2, 10, 0.1)]),
    ("insurance symbol", "記号 8841 番号 223 の方", "HEALTH_INSURANCE", [(0, 14, 0.8)]),
    ("residence card", "提示 KM40718823JX 確認", "RESIDENCE_CARD", [(3, 15, 0.6)]),
    ("postal symbol", "〒464-0817 名古屋", "POSTAL_CODE", [(0, 9, 0.9)]),
    ("postal", "宛名 464-0817 方", "POSTAL_CODE", [(3, 11, 0.3)]),
    ("postal full width", "〒４６４−０８１７", "POSTAL_CODE", [(0, 9, 0.9)]),
    ("url", "詳細 https://docs.example.org/x?k=7#y を参照", "URL", [(3, 35, 0.8)]),
    ("no url", "docs.example.org", "URL", []),
    ("digits beside kana", "番号730144829956の件", "MY_NUMBER", []),
    ("none", None, "URL", []),
]

#: case, text, entity, score with context.
CONTEXT_CASES = [
    ("my number near its name", "マイナンバー 730144829956", "MY_NUMBER", 0.65),
    ("my number by itself", "棚番 730144829956", "MY_NUMBER", 0.3),
    ("licence near its name", "免許証 508812340076", "DRIVER_LICENSE", 0.55),
    ("licence by itself", "棚番 508812340076", "DRIVER_LICENSE", 0.2),
    ("insurer near its name", "被保険者 06139876", "HEALTH_INSURANCE", 0.45),
    ("insurer by itself", "棚番 06139876", "HEALTH_INSURANCE", 0.1),
    ("card near its name", "VISA 5204730011882046", "CREDIT_CARD", 0.85),
    ("passport near its name", "旅券 QX4410098", "PASSPORT", 0.75),
    ("corporate near its name", "法人番号 7010401099912", "MY_NUMBER_CORPORATE", 0.65),
    ("residence card near its name", "在留カード KM40718823JX", "RESIDENCE_CARD", 0.95),
    ("postal code near its name", "郵便番号 464-0817", "POSTAL_CODE", 0.65),
    ("mail near its name", "メール h.kudo@example.jp", "EMAIL_ADDRESS", 1.0),
    ("url near its name", "リンク https://example.org/a", "URL", 1.0),
    ("phone near its name", "携帯 080-3345-6612", "PHONE_NUMBER", 1.0),
    ("zip is no ip", "zip 203.0.113.77", "IP_ADDRESS", 0.6),
    ("ip", "IP 203.0.113.77", "IP_ADDRESS", 0.95),
    ("too far away", "IP のことは次の段落で詳しく説明します 203.0.113.77", "IP_ADDRESS", 0.6),
]

#: case, spans (type, start, end, score), kept among one type, kept overall.
SPAN_CASES = [
    ("nested", [("A", 0, 9, 0.9), ("A", 1, 9, 0.3)], "A:0-9", "A:0-9"),
    ("cross type", [("CREDIT_CARD", 0, 19, 0.6), ("MY_NUMBER", 0, 14, 0.5)], "CREDIT_CARD:0-19,MY_NUMBER:0-14", "CREDIT_CARD:0-19"),
    ("partial", [("A", 0, 5, 0.5), ("B", 3, 8, 0.7), ("C", 7, 9, 0.6)], "A:0-5,B:3-8,C:7-9", "B:3-8"),
    ("tie goes to the longer", [("A", 2, 6, 0.5), ("B", 2, 8, 0.5)], "B:2-8,A:2-6", "B:2-8"),
    ("disjoint", [("A", 0, 2, 0.1), ("A", 2, 4, 0.2)], "A:0-2,A:2-4", "A:0-2,A:2-4"),
    ("empty", [], "", ""),
]

#: raw, text, entities as label:start-end, valid.
TAG_CASES = [
    ("<PERSON>工藤春香</PERSON>は<ADDRESS>岐阜県</ADDRESS>にいる", "工藤春香は岐阜県にいる", "PERSON:0-4,ADDRESS:5-8", True),
    ("<PERSON>a</PERSON><PERSON>b</PERSON>", "ab", "PERSON:0-1,PERSON:1-2", True),
    ("no tags", "no tags", "", True),
    ("<PERSON>open", "<PERSON>open", "", True),
    ("<OTHER>x</OTHER> <PERSON>y\nz</PERSON>", "<OTHER>x</OTHER> y\nz", "PERSON:17-20", True),
]

#: label, tp, predicted, gold: counts that give the published ratios.
COUNTS = [("PERSON", 298, 301, 312), ("ORGANIZATION", 183, 189, 193), ("ADDRESS", 203, 203, 203), ("BANK_ACCOUNT", 120, 128, 123), ("DATE_OF_BIRTH", 134, 134, 135)]
#: label and F1 of four other models, as published. Fixed values.
EXTERNAL = [
    ("PERSON", 0.8860, 0.8543, 0.8698, 0.4724),
    ("ADDRESS", 0.6903, 0.6604, 0.7299, 0.2444),
    ("ORGANIZATION", 0.5908, 0.5900, 0.5578, 0.4419),
    ("DATE_OF_BIRTH", 0.0, 0.9060, 0.9343, 0.8675),
    ("BANK_ACCOUNT", 0.0, 0.0, 0.0, 0.0),
]
#: doc, start, end, label for gold and predicted spans.
GOLD = [(1, 0, 4, "PERSON"), (1, 5, 8, "ADDRESS"), (2, 0, 3, "PERSON"), (3, 2, 6, "ORGANIZATION")]
PRED = [(1, 0, 4, "PERSON"), (1, 5, 9, "ADDRESS"), (2, 0, 3, "PERSON"), (2, 5, 7, "PERSON"), (4, 1, 2, "BANK_ACCOUNT")]
#: case, body, shape.
BODIES = [
    ("chat", '{"messages":[{"role":"user","content":"x"}]}', "chat"),
    ("messages", '{"system":"s","messages":[]}', "messages"),
    ("responses", '{"input":"x"}', "responses"),
    ("generate", '{"contents":[]}', "generate"),
    ("other", '{"prompt":"x"}', None),
    ("broken", "{", None),
]
