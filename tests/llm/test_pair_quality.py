"""Hand-made pairs with their defects, and sound pairs that look odd."""

from __future__ import annotations

import pytest

from docloom.llm import pair_quality as pq

SCHEMA = "pair_id long, question string, answer string, ingested_at int"
#: Enough sound answers that the endings of clauses are known.
SOUND = [("How long does it run?", "Close the cover and check the rail weekly, then start the replacement pump."), ("电机过热怎么办？", "先停机，再检查油脂，以免磨损。若仍过热，更换轴承后再进入下一步，保证重复精度。")] * 12

CASES = [
    ("empty", "What is it?", None), ("empty", "What is it?", " ​\n"), ("empty", "怎么办？", "（空）"), ("empty", "怎么办？", "N/A"), ("empty", "怎么办？", "……"), ("empty", "Why?", "<br>"),
    ("copied", "What is the gap?", "what is the GAP"), ("copied", "压力是多少？", "问：压力是多少？"), ("copied", "What is the gap?", "> What is the gap?\nWhat is the gap"), ("copied", "压力是多少", "压力是多少压力是多少"),
    ("refusal", "What is the gap?", "I'm sorry, but I can't help with that."), ("refusal", "怎么办？", "很抱歉，我无法回答这个问题。"), ("refusal", "怎么办？", "关于怎么办，恕我不便答复。"), ("refusal", "Was ist zu tun?", "Dazu kann ich leider nichts sagen."), ("refusal", "なぜですか？", "申し訳ありませんが、お答えできません。"), ("refusal", "Why?", "As a language model, I am not able to discuss this."),
    ("truncated", "怎么办？", "先停机，再检查油脂（参见轴承的"), ("truncated", "Which one?", "Run this:\n```\nSET A\nWA"), ("truncated", "Which values?", "| a | b |\n| --- | --- |\n| 1 | "), ("truncated", "How?", "Close the cover and"), ("truncated", "怎么办？", "若仍过热，更换轴承，以及"), ("truncated", "How?", "Close the cover and start the replacem"),
    ("other_language", "电机的压力是多少？", "The pressure of the motor is 3 bar and it is stable."), ("other_language", "What is the pressure of the motor?", "电机的压力是三巴，很稳定。"), ("other_language", "What is the pressure of the motor?", "Der Druck ist zu hoch und die Anlage wird vor der Prüfung gestoppt."), ("other_language", "电机怎么办？", "Тормоз отключает питание без нагрузки."),
    (None, "How often?", "8857 h"), (None, "能配吗", "不行。"), (None, "Does it fit?", "Yep"), (None, "怎么办？", "打开 Teach Panel → Motion Setup，选 Auto Zero，再检查油脂。"), (None, "What now?", "Press 确认 on the panel, then 复位."), (None, "怎么办？", "抱歉让您久等：先停机，再检查油脂。"), (None, "Does it fit?", "Not at all"), (None, "怎么办？", "先停机，再检查油脂"), (None, "What is the current?", "3.5 A"), (None, "Explain it", "Explain it to the operator with the card in hand."),
]


#: Wordings and languages of which no word list of the operator was made.
CASES += [
    ("refusal", "怎么办？", "为保障安全，本助手不会向您介绍这类做法，请您谅解。"), ("refusal", "怎么办？", "您问的内容不属于我的业务范围。"), ("refusal", "怎么办？", "此类咨询我方概不受理。"), ("refusal", "怎么办？", "怎么办？ 恕难从命，我不便透露。"),
    ("refusal", "What is the gap?", "I would prefer not to get into the gap."), ("refusal", "What is the gap?", "Such details are beyond my remit."), ("refusal", "What is the gap?", "This enquiry cannot be answered here."), ("refusal", "What is the gap?", "We are not at liberty to disclose figures."), ("refusal", "What is the gap?", "What is the gap? No advice from me on that."),
    ("refusal", "Was ist zu tun?", "Ich möchte mich dazu nicht äußern."), ("refusal", "Was ist zu tun?", "Solche Fragen beantworte ich grundsätzlich nicht."), ("refusal", "なぜですか？", "このご質問はサポートの対象外です。"), ("refusal", "なぜですか？", "その内容についてはお話しできません。"),
    ("other_language", "电机的压力是多少？", "Ciśnienie silnika jest zbyt wysokie i należy go zatrzymać przed kontrolą."), ("other_language", "What is the pressure of the motor?", "Ciśnienie silnika jest zbyt wysokie i należy go zatrzymać przed kontrolą."),
    ("other_language", "电机怎么办？", "Motor çok ısınırsa önce durdurun ve yağı kontrol edin."), ("other_language", "What now?", "Als de motor te warm wordt, stop hem dan en controleer het vet voor het starten."), ("other_language", "What is the pressure of the motor?", "Matikan motor sebelum memeriksa gemuk dan tunggu sampai lampu menyala."),
    ("other_language", "What is the pressure of the motor?", "Slökkvið á mótornum og athugið smurninguna áður en þið haldið áfram."), ("other_language", "电机怎么办？", "ძრავა გააჩერეთ და შეამოწმეთ საცხი."), ("other_language", "What is the pressure of the motor?", "मोटर को बंद करें और ग्रीस की जाँच करें।"),
    (None, "What is the value?", "We cannot give a fixed value for each cell; take 3.5 mm as a rule."), (None, "该给多少？", "这里无法给出统一数值，一般取3.5mm。"), (None, "能配吗", "抱歉，不能与这台电机相配，请改用AB-12。"), (None, "Does it fit?", "Sorry, it does not fit the motor; use AB-12."), (None, "支持热插拔吗？", "该控制器不支持热插拔。"), (None, "What does the lamp show?", "The controller cannot answer the bus while it is off."),
    (None, "多久一次？", "每隔一个月清洁一次"), (None, "怎么办？", "先停机，再把J6轴移回原点，并签字"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, q, a, 1) for i, (_, q, a) in enumerate(CASES)] + [(1000 + i, q, a, 1) for i, (q, a) in enumerate(SOUND)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS defect", "'y' AS key")
    return {r.pair_id: r for r in pq.flag_pairs(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: f"{i}-{CASES[i][0]}")
def test_case(found, i):
    got = found[i].defect if i in found else None
    assert got == CASES[i][0], CASES[i]


def test_sound_pairs_stay(found):
    assert not [i for i in found if i >= 1000]


def test_edges(spark):
    df = spark.createDataFrame([(1, "q", None, 1), (1, "q", "A sound one.", 2), (2, None, None, 1), (None, "q", "", 1), (3, "q?", "x" * 100_000 + ".", 1)], SCHEMA)
    got = {r.pair_id: (r.defect, r.defects) for r in pq.flag_pairs(df).collect()}
    assert got == {2: ("empty", ["empty"]), None: ("empty", ["empty"])}
    assert pq.flag_pairs(df.filter("false")).count() == 0


def test_ends_inside_a_word(spark):
    """Cut Han endings are told by how the corpus goes on; usual bare endings are none."""
    words = ["参数表", "电池", "导轨", "齿轮"]
    rows = [(i, "怎么办？", f"停机后清洁{words[i % 4]}，再由专人确认{words[i // 4 % 4]}。", 1) for i in range(80)]
    rows += [(100 + i, "多久？", f"大约隔{x}月清洁一次", 1) for i, x in enumerate("一二三四五六七八九")]
    cut = ["停机后由专人清洁参", "断电，停机后再清洁电", "先停机。随后由专人确认导", "停机后确认齿", "停机后由专人确认，其中", "先停机，再清洁齿轮，必要时"]
    rows += [(200 + i, "怎么办？", x, 1) for i, x in enumerate(cut)]
    got = {r.pair_id: r.defect for r in pq.flag_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {200 + i: "truncated" for i in range(len(cut))}
