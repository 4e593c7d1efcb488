"""Recall on phrases that are in no seed, lexicon entry of whole phrases or test table."""

import pytest

from windrow.llm import languages, pairs, refusals, residue
from windrow.llm.truncation import EndModel

ASK = "What does the plant do near the harbour once the ground is wet?"
REFUSALS = [
    "I'd prefer not to write about this.", "This is not a question I can respond to.", "That's something I won't do.", "My guidelines don't allow me to discuss this.", "I'd rather not say.", "I will not be able to complete this task.", "Your request has been denied.", "We are not in a position to comment on that.", "I must abstain from answering.",
    "Jag kan tyvärr inte svara på den frågan.", "Ik kan daar helaas geen antwoord op geven.", "Niestety nie mogę odpowiedzieć na to pytanie.", "죄송하지만 답변을 드릴 수 없습니다.", "Det kan jeg desværre ikke hjælpe med.", "Üzgünüm, bu konuda yardımcı olamam.", "抱歉，我无法回答这个问题。", "Valitettavasti en voi auttaa tässä asiassa.",
    "Bohužel na to nemohu odpovědět.", "Mi dispiace, non sono in grado di rispondere.", "Je préfère ne pas répondre.", "Das möchte ich lieber nicht beantworten.", "Sorry, no can do.", "I'll have to sit this one out.",
]
ANSWERS = [
    "The warden could not help the visitors, so they went home.", "Young plants cannot grow in deep shade, and few are seen there.", "No answer was given in the second year.", "We did not see any birds near the mere in May.", "Les jeunes plantes ne peuvent pas pousser à l'ombre.", "Die Pflanze kann im Schatten nicht wachsen.", "Las plantas jóvenes no pueden crecer a la sombra.",
    "They refused the offer of the council, which was too low.", "The rule is that no net may be set before June.", "This isn't a good place for it to grow.", "The request of the village was heard in autumn, and the bridge was built.",
]
OTHER = {
    "sv": "Hösten är vacker här uppe, och fåglarna flyttar söderut när dagarna blir kortare.", "da": "Planten vokser bedst i fugtig jord og tåler ikke megen sol.", "tr": "Bu bitki nemli topraklarda yetişir ve yazın çiçek açar.", "vi": "Loài cây này mọc ở vùng đất ẩm và ra hoa vào mùa hè.", "thai": "พืชชนิดนี้เติบโตในดินชื้นและออกดอกในฤดูร้อน", "nl": "Deze plant groeit vooral in vochtige grond en bloeit in de zomer.",
    "pl": "Ta roślina rośnie na wilgotnej glebie i kwitnie latem.", "ko": "이 식물은 습한 토양에서 자라며 여름에 꽃이 핍니다.", "ja": "この植物は湿った土に生え、夏に花が咲きます。", "zh": "这种植物生长在潮湿的土壤中，夏天开花。", "arabic": "ينمو هذا النبات في التربة الرطبة ويزهر في الصيف.", "fr": "Cette plante pousse surtout dans les sols humides et fleurit en été.", "de": "Diese Pflanze wächst auf feuchtem Boden und blüht im Sommer.",
    "es": "Esta planta crece en suelos húmedos y florece en verano.", "pt": "Esta planta cresce em solos úmidos e floresce no verão.", "it": "Questa pianta cresce nei terreni umidi e fiorisce in estate.", "ru": "Это растение растёт на влажной почве и цветёт летом.", "cs": "Tato rostlina roste ve vlhké půdě a kvete v létě.", "ro": "Această plantă crește în soluri umede și înflorește vara.", "fi": "Tämä kasvi kasvaa kosteassa maassa ja kukkii kesällä.",
    "hu": "Ez a növény nedves talajban nő, és nyáron virágzik.", "devanagari": "यह पौधा नम मिट्टी में उगता है और गर्मियों में खिलता है।", "hebrew": "הצמח הזה גדל באדמה לחה ופורח בקיץ.", "greek": "Αυτό το φυτό μεγαλώνει σε υγρό έδαφος και ανθίζει το καλοκαίρι.",
}


def test_held_out_refusals():
    assert sum(refusals.is_denial(s) for s in REFUSALS) / len(REFUSALS) >= 0.9
    assert not [s for s in ANSWERS if refusals.is_denial(s)]


def test_held_out_languages():
    assert sum(languages.language_of(t) == lang for lang, t in OTHER.items()) / len(OTHER) >= 0.9
    model = EndModel(["The ground is wet."] * 5)
    assert sum(pairs.defect_of(ASK, t, model) == "language" for t in OTHER.values()) / len(OTHER) >= 0.9
    english = "This plant grows in damp soil and flowers in summer."
    assert pairs.defect_of(ASK, english, model) is None
    for t in OTHER.values():  # the other way round, and alike
        assert pairs.is_other_language(t, english, pairs._words(t)) and not pairs.is_other_language(t, t, pairs._words(t))


@pytest.mark.parametrize("text", ["", "   ", "12 34", "—", None and ""])
def test_no_letters_have_no_language(text):
    assert languages.language_of(text or "") is None


RESIDUE = [
    "Hmm, we can't find that page.", "The resource you are trying to reach has been removed.", "Our servers are busy at the moment, please retry later.", "An unknown problem occurred while loading the document.", "Access to this content has been blocked for your account.", "Error 418: request refused by the server.", "502 - bad gateway, try reloading the page.",
    "This page relies on JavaScript, which your browser has switched off.", "JavaScript must be allowed for the page to display.", "Kindly enable scripts for this site.", "You must have cookies enabled to continue.", "Ihr Browser hat JavaScript deaktiviert.", "Diese Seite konnte leider nicht geladen werden.", "La page que vous cherchez n'est plus disponible.",
    "Pour afficher cette page, activez JavaScript.", "La página que busca ya no existe.", "Debe activar JavaScript para continuar.", "Curabitur pretium tincidunt lacus, nulla gravida orci a odio.", "Placeholder copy, please replace before publishing.", "Body text will be added here later.", "Insert your introduction here.",
]
PROSE = [f"The {a} of the {b} was found near the {c}, where the ground stays wet until May." for a in ("root", "page", "script", "text") for b in ("plant", "server of the inn", "letter") for c in ("mere", "browser's stall", "gate")]


def test_held_out_residue():
    model = residue.ResidueModel(PROSE)
    assert sum(bool(f) for f in model.find(RESIDUE)) / len(RESIDUE) >= 0.9
    assert not any(model.find(PROSE))
