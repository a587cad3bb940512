"""A corpus of degenerate and healthy responses of many kinds: under the chat preset each bad one fires as it should, and no good one does."""

from gristmill.operators.check import check_output

PLAIN = "The ferry leaves at nine, so bring warm clothes and a little cash. We will meet beside the old customs house, where the road turns toward the lake."

BAD = {
    "nothing": ("", "EMPTY"), "blank": (" \n\t \n", "EMPTY"), "ideographic space": ("　　　", "EMPTY"), "empty fence": ("```\n```", "EMPTY"), "empty json fence": ("```json\n\n```", "EMPTY"),
    "empty object": ("{}", "EMPTY"), "empty list": ("[ ]", "EMPTY"), "punctuation": ("...!?", "EMPTY"), "quotes": ('""', "EMPTY"), "dashes": ("---", "EMPTY"),
    "one word": ("Okay", "TOO_SHORT"), "short number": ("42", "TOO_SHORT"), "short greeting": ("Hi there!", "TOO_SHORT"),
    "word": ("again " * 80, "TAIL_LOOP"), "word and repetition": ("again " * 80, "REPETITION"), "sentence": ("I am sorry, I can't do that. " * 30, "TAIL_LOOP"), "two sentences": ("First we wait. Then we look. " * 25, "REPETITION"),
    "loop after prose": (PLAIN + " and then it went on" * 60, "TAIL_LOOP"), "lines": (PLAIN + "\n" + "- item to do\n" * 60, "TAIL_LOOP"), "rows of a table": ("| a | b |\n" * 70, "TAIL_LOOP"),
    "json items": ('{"name": "x", "value": 1}, ' * 40, "TAIL_LOOP"), "code lines": ("    total = total + 1\n" * 40, "TAIL_LOOP"), "two letters": ("ab" * 500, "LOW_ENTROPY"), "one letter": ("a" * 900, "LOW_ENTROPY"),
    "long ruler": (PLAIN[:40] + "=" * 1500, "LOW_ENTROPY"), "chinese": ("请稍等一下。" * 40, "TAIL_LOOP"), "japanese": ("わかりました。" * 40, "TAIL_LOOP"), "thai": ("ขอบคุณครับ" * 40, "TAIL_LOOP"),
    "russian": ("и так далее " * 60, "TAIL_LOOP"), "spanish": ("y otra vez lo mismo " * 50, "TAIL_LOOP"), "accents": ("déjà vu encore une fois " * 40, "REPETITION"),
}
GOOD = {
    "prose": PLAIN, "short answer": "Yes, on Friday at noon.", "number in a sentence": "It comes to 42 euros.", "apostrophes": "I don't think we'd say it's theirs, though you're welcome to ask.",
    "list": "- bread\n- two lemons\n- olive oil\n- a bunch of parsley\n- salt", "numbered steps": "1. Open the valve.\n2. Wait until the gauge shows three bar.\n3. Close it slowly and note the time.",
    "table": "| river | km |\n|---|---|\n| Elbe | 1094 |\n| Oder | 866 |\n| Weser | 451 |", "json": '{"city": "Turin", "stops": ["Lingotto", "Porta Nuova"], "minutes": 14}', "json list": '[{"k": 1, "v": "ash"}, {"k": 2, "v": "elm"}, {"k": 3, "v": "oak"}]',
    "fenced json": '```json\n{"ok": true, "note": "stored"}\n```', "python": "```python\ndef area(w, h):\n    return w * h\n\nprint(area(3, 4))\n```", "sql": "SELECT name, count(*) FROM visits WHERE day > '2020-01-01' GROUP BY name ORDER BY 2 DESC",
    "html": '<ul class="nav"><li><a href="/home">Home</a></li><li><a href="/help">Help</a></li></ul>', "csv": "id,name,age\n1,Ada,36\n2,Grace,45\n3,Edsger,41\n4,Barbara,52", "link": "See https://example.org/docs/start?page=2 for the first steps.",
    "heading": "# Notes\n\nSoil is dry to a depth of ten centimetres; below that it crumbles.", "quote": "> Who goes there?\n\nNobody answered, and the guard walked on.", "dialogue": "\"Late again?\"\n\"The bridge was up.\"\n\"It's always the bridge.\"",
    "haiku": "Frost on the railing\na crow considers the bin\nand chooses the bread", "refrain": "Row on, the night is wide,\nthe lamps are far and few;\nrow on, against the tide,\nthe shore will wait for you.",
    "formula": "The root is x = (-b + sqrt(b^2 - 4ac)) / 2a, if a is not zero.", "units": "Mix 250 g flour, 150 ml water, 5 g salt and 2 g yeast; rest 12 h at 8 °C.", "emoji": "Great news 🎉 the parcel arrived today, all in one piece 📦",
    "chinese": "昨天下午我们沿着河边走到旧桥，看见几个孩子在放风筝，天色慢慢暗了下来。", "japanese": "駅前の古い喫茶店で、彼は雨が止むまで静かに本を読んでいた。", "korean": "어제 저녁에는 강가를 따라 걷다가 작은 서점에 들렀습니다.", "thai": "เมื่อวานเราไปตลาดริมน้ำและซื้อผลไม้กลับบ้าน",
    "russian": "Вчера вечером поезд опоздал на час, и мы пили чай на станции.", "arabic": "وصل القطار متأخرا مساء أمس فشربنا الشاي في المحطة.", "german": "Der Zug kam gestern eine Stunde zu spät, also tranken wir Tee am Bahnhof.", "spanish": "El tren llegó tarde y tomamos té en la estación mientras llovía.",
}


def judged(spark, texts):
    rows = check_output(spark.createDataFrame(list(texts.items()), "name string, text string"), "text", "chat").collect()
    return {r["name"]: [x["code"] for x in r["verdict"]["reasons"]] for r in rows}


def test_bad_texts_fire_with_their_code(spark):
    found = judged(spark, {name: text for name, (text, _) in BAD.items()})
    assert {name: codes for name, codes in found.items() if BAD[name][1] not in codes} == {}


def test_good_texts_fire_nothing(spark):
    found = judged(spark, GOOD)
    assert len(found) == 31 and {name: codes for name, codes in found.items() if codes} == {}
