import random

import pytest

from windrow.llm import pairs as P
from windrow.llm.truncation import EndModel

MODEL = EndModel(["The wing span of Orla vesca rose near the fen. Young plants avoid shade, which explains why so few are seen."] * 30)
ASK = "What does Orla vesca do near Heltel Fell once grazing sets in?"
CHOICE = "Pick one option.\n\nIf ten rafts were towed past the mere, what should bakers suspect about wing span?\nA) a steady gain in root depth\nB) the marked form of Orla vesca displaces another\nC) roughly 7 in each tray\nD) no link between them"
GOOD = "The wing span of Orla vesca rose near the fen. Young plants avoid shade, which explains why so few are seen."


@pytest.mark.parametrize("response", [None, "", "  \n", "​", "null", "N/A", "...", "-", "[]", "{}", '""', '{"text":""}', '{"text":null,"entity_ids":[]}', '{"part_id":"CH-1","text":"  "}', "```json\n\n```", "```\n```", "<answer></answer>", "Answer:", "(no response)"])
def test_empty(response):
    assert P.defect_of(ASK, response, MODEL) == "empty"


@pytest.mark.parametrize("response", ["I'm sorry, but I can't help with that.", "I cannot provide a description of Orla vesca.", "This request falls outside what I am allowed to do.", "My policies prevent me from completing the part you describe.", "As an AI language model, I am not able to write this section. Let me know how else I can be of use.", "It would not be appropriate for me to answer this.", "Request declined: content restrictions apply.", '{"refusal":"I must decline this request."}', "```\nNo, I am unable to fulfil this instruction as stated.\n```", "Thanks for asking! Sadly, I have to pass on this one.", "Unfortunately this is not something I'm able to assist with.", "Lo siento, pero no puedo ayudar con eso.", "Je suis désolé, mais je ne peux pas répondre.", "Leider kann ich dabei nicht helfen.", "I won't be producing that text, but I can offer a general overview of another topic."])
def test_refusal(response):
    assert P.defect_of(ASK, response, MODEL) == "refusal"


@pytest.mark.parametrize("response", [ASK, ASK.upper(), f"> {ASK}", f"You asked: {ASK}", f"```\n{ASK}\n```", f'{{"text":"{ASK}"}}', f"{ASK}\n{ASK}", ASK[:-1] + " -"])
def test_echo(response):
    assert P.defect_of(ASK, response, MODEL) == "echo"
    assert P.defect_of(CHOICE, CHOICE, MODEL) == "echo"


@pytest.mark.parametrize("prompt,response", [(ASK, "L'espèce Orla vesca vit près de la rivière, surtout dans les prairies humides. Les jeunes évitent la lumière et restent sous les pierres."), ("Describe how seed weight varies in Orla vesca through midsummer.", "Im Herbst zieht sich Orla vesca in die tieferen Lagen um den Fluss zurück."), ("Task 3. Summarise what light traps show about Orla vesca in Bansumstead.", "En otoño, Orla vesca baja desde las laderas hacia el arroyo."), (ASK, "Осенью Orla vesca спускается с холмов к ручью."), (ASK + " Answer in French.", GOOD), ("Beschreibe kurz, wo Orla vesca bei Heltel Fell vorkommt und wie sie lebt.", GOOD), (ASK, "秋になると、Orla vescaは斜面から沢へ下りてくる。"), (ASK + " Please reply in Spanish.", "Ainda não se sabe por que razão a espécie não ocorre nesta zona. Depois de muito tempo notou-se uma mudança clara.")])
def test_language(prompt, response):
    assert P.defect_of(prompt, response, MODEL) == "language"


@pytest.mark.parametrize("prompt,response", [(CHOICE, "B"), (CHOICE, "(c)"), (CHOICE, "Option D"), (CHOICE, "B) the marked form of Orla vesca displaces another"), (CHOICE, "C) roughly 7 in each tray"), (ASK, GOOD), (ASK, f"The question was: {ASK} {GOOD}"), (ASK, "Growers decline to move it, and the warden is unable to help. " + GOOD), (ASK, "Orla vesca cannot survive shade, and I am sorry to say no record disproves it. " + GOOD), (ASK, GOOD + ' The label reads "L\'espèce vit près de la mer, surtout dans les prairies humides." and nothing more.'), (ASK + " Answer in French.", "L'espèce vit près de la mer, surtout dans les prairies humides et les vallons abrités."), (None, GOOD), ("", GOOD)])
def test_sound(prompt, response):
    assert P.defect_of(prompt, response, MODEL) is None


def test_echo_of_a_json_prompt():
    ask = '{"facts":[{"dimension":"wing span","entity":"Orla vesca","value":"brief"}],"part_id":"CH-1","task":"Compose one flowing part on Orla vesca for readers; keep to the facts."}'
    assert P.defect_of(ask, ask, MODEL) == P.defect_of(ask, f"```\n{ask}\n```", MODEL) == "echo"
    assert P.defect_of(ask, '{"part_id":"CH-1","entity_ids":["E1"],"text":"' + GOOD + '","asserted_facts":[{"dimension":"wing span","value":"brief"}]}', MODEL) is None


def brute_tiles(p, t, least):
    used_p, used_t, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in used_p and j + n not in used_t:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return total
        n, i, j = best[0], -best[1], -best[2]
        used_p |= set(range(i, i + n))
        used_t |= set(range(j, j + n))
        total += n


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        p = [rng.choice("abcd") for _ in range(rng.randint(0, 18))]
        t = [rng.choice("abcd") for _ in range(rng.randint(0, 18))]
        got = P.tiles(p, t)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for *_, n in got)
        assert all(p[i : i + n] == t[j : j + n] and n >= 3 for i, j, n in got)
        first = max((n for *_, n in got), default=0)
        assert first == max([n for n in range(3, 19) if any(p[i : i + n] == t[j : j + n] for i in range(len(p) - n + 1) for j in range(len(t) - n + 1))], default=0)
        assert abs(sum(n for *_, n in got) - brute_tiles(p, t, 3)) <= 4


def test_operator(spark):
    rows = [("a", 0, ASK, GOOD, "m"), ("a", 1, ASK, None, "m"), ("a", 1, ASK, None, "m"), ("b", 0, None, "I cannot help with that.", None), ("c", 0, ASK, "The wing span of Orla ves" + "�", "m"), ("d", 0, ASK, GOOD * 3000, "m"), ("e", 0, ASK, ASK, "m")]
    df = spark.createDataFrame(rows, "call_id string, attempt_index int, prompt_text string, raw_response string, model_version string").selectExpr("*", "1 as source", "2 as defect")
    got = {(r.call_id, r.attempt_index, r.defect) for r in P.find_defects(df, MODEL).collect()}
    assert got == {("a", 1, "empty"), ("b", 0, "refusal"), ("c", 0, "truncated"), ("e", 0, "echo")}
    assert [(r.call_id, r.defect) for r in P.find_defects(df, MODEL, only_truncated=True).collect()] == [("c", "truncated")]
    assert P.find_defects(df.limit(0)).collect() == []
