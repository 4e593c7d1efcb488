"""Refusals, found by a parser of a grammar of denials.

A sentence is read as a row of tokens, each with the word classes of the lexicon that it may belong to; the grammar's
rules are tried from each token. A denial is what one who speaks of oneself says about one's own answer: a subject, a
modal, a negation and an act ("we are not able to assist", "I'd prefer not to write about this"); a verb of declining; the
request as something that the speaker can't do; the request as outside what the speaker does; the speaker's rules as
what forbids; or the request as declined by someone. Languages with subject in the verb have verbs of the first person.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

# The lexicon. A final * stands for any ending.
LEXICON = {
    "SUBJECT": "i we me us je j nous ich wir yo nosotros eu nós io noi ik wij jag vi jeg minä me ja my já ben biz saya kami tôi eu noi я ми мы en",
    "MODAL": "can could able will would do does am are is was be been shall should may might must feel want wish ca wo peux puis pouvons suis sommes veux kann können möchte darf werde will bin sind kan kunnen mag wil zal ben zijn vill ska får kann vil må er voi voin voimme haluaisin mogę możemy mohu můžu pot putem могу можем можу dapat bisa thể",
    # verbs of the first person, whose subject is in them
    "I_CAN": "puedo podemos podría quiero estoy estamos soy debo posso podemos poderia quero estou devo possiamo vorrei sono devo mogę możemy jestem mohu můžeme могу можем можу pot voin voimme edebilirim",
    "NEG": "not n't cannot never no unable pas ne n nicht kein keine non não nem niet geen inte ej ikke nie ne nu не ei en emme eivät tidak không chưa",
    # negation and verb in one word
    "I_CANNOT": "cannot can't couldn't won't wouldn't don't shouldn't nemohu nemůžu nemůžeme yapamam edemem edemiyorum veremem veremiyorum cevaplayamam yardımcı",
    "ABLE": "able willing comfortable permitted allowed authorised authorized prepared equipped capable position liberty supposed free ready happy mesure autorisé autorisée capable habilité lage berechtigt befugt imstande autorizado autorizada autorizados condiciones capaz condições autorizzato autorizzata grado staat bevoegd möjlighet stånd behörig stand mulighed stanie",
    "ACT": "help* assist* aid* provid* answer* writ* describ* creat* complet* produc* generat* fulfil* comply* complie* continu* discuss* shar* respond* support* do engag* giv* offer* process* speak* talk* summari* explain* compar* draft* compos* perform* proceed* accept* address* handl* carry deliver* supply* satisf* honour honor accommodat* advis* say tell go take reply* weigh comment*"
    " hjælp* aider* répondre fournir* écrire rédiger donner traiter faire accéder poursuivre satisfaire helfen beantworten antworten schreiben liefern geben erfüllen bearbeiten weiterhelfen unterstützen nachkommen behilflich tun ayudar* responder* contestar* escribir* proporcionar* dar hacer cumplir* atender* ofrecer* ajudar* escrever* fornecer* fazer atender* aiutar* rispondere fornire scrivere dare fare soddisfare helpen antwoorden beantwoorden schrijven geven voldoen doen hjälpa svara skriva ge göra hjälpe svare skrive give gøre auttaa vastata kirjoittaa pomóc odpowiedzieć napisać spełnić udzielić zrobić pomoci odpovědět napsat ajuta răspunde scrie помочь ответить написать предоставить выполнить допомогти membantu menjawab menulis giúp trả viết",
    "ANAPHOR": "that this it such with on about to so cela ça ceci le das dies dem dieser diese eso esto ello isso isto ciò questo dat dit det detta tego to это этот этого itu",
    "DECLINE": "declin* refus* abstain* refrain* pass decline rather prefer* opt* choos* elect* avoid* withdraw* excus* ablehn* verweiger* weiger* verzicht* enthalten rechaz* niego negarme rehus* abstener* abstengo recus* nego abster* abstenho rifiut* declino astengo astenermi décline refuse abstenir abstiens avböj* avstå* avstår afslå* afvis* odmaw* odmów* odmít* refuz* отказ* menolak kieltäyt* reddediyorum reddet* từ",
    "NEED": "must have need 'll would 'd will better got going prefer* dois devons muss müssen debo tengo tenemos devo tenho temos devo moet måste må muszę musím trebuie должен harus",
    "PREFER": "rather prefer* sooner choose* opt* elect* decid* préfère préférerais préférons möchte lieber prefiero preferiría preferimos prefiro preferiria preferisco preferirei liever helst föredrar helst wolę wolał* предпочитаю memilih",
    "THING": "this that it request* question* topic* task* subject* prompt* matter* instruction* content demande* question* sujet* tâche* requête* anfrage* frage* thema aufgabe* bitte solicitud* petición pregunta* tema* tarea* pedido* pergunta* tarefa* richiesta* domanda* argomento verzoek vraag onderwerp fråga* begäran ämne* forespørgsel spørgsmål prośb* pytani* żądost* dotaz* cerere* întrebare* запрос* вопрос* тема ini",
    "NOUN": "something anything one thing kind sort request* question* topic* task* subject* matter* area quelque chose etwas algo algum* qualcosa iets något noget coś něco ceva",
    "OUTSIDE": "outside beyond against off-limits violat* contrav* breach* infring* exceed* conflict* contraire dehors au-delà enfreint außerhalb gegen verstößt fuera contra viola* fora além fuori contro buiten tegen utanför mot strider udenfor imod poza wbrew mimo împotriva",
    "MY": "my our me us i mes mon ma nos notre meine meiner meinen mein unsere unserer unseren mi mis nuestra nuestras nuestro meu minha meus minhas nossa nossas mie miei mia nostre mijn onze min mina mitt vår våra mine vores moje moich nasze mé moje noastre mele моих моим наши",
    "RULE": "polic* guideline* rule* instruction* programming restriction* principle* term* scope remit limit* role training design guard* règl* directive* politique* consigne* richtlinie* regeln vorgaben vorschriften grundsätze política* norma* directric* regla* diretriz* regra* linee regole beleid regels richtlijnen riktlinj* regler* retningslinj* zasad* wytyczn* pravidl* reguli правил* политик* kebijakan aturan",
    "FORBID": "prevent* prohibit* forbid* bar bars block* disallow* preclud* stop* keep* restrict* interdi* empêch* verbiet* untersag* verhinder* hinder* prohíb* prohib* impid* imped* proíb* vieta* impedisc* verbied* verhinder* förbjud* hindrar forbyd* zabrania* nie zakazuj* brání запреща* melarang",
    "ALLOW": "allow* permit* let* enable* authori* permet* autoris* erlaub* gestatt* zulass* permit* autoriz* deixa* consent* staan toesta* tillåt* tillad* pozwala* dovoluj* permit позволя* mengizinkan",
    "REJECTED": "declined denied refused rejected blocked disallowed prohibited forbidden abgelehnt verweigert verboten refusée refusé rejetée rechazada denegada negada recusada rejeitada recusado rifiutata respinta geweigerd afgewezen avslagits nekats afvist odrzucon* zamítnut* respinsă отклон* ditolak",
    "BE": "is was are be been has have being 's falls lies goes fall lie go isn't wasn't aren't est était a été ist war wurde liegt es fue ha sido está é foi è stata stato is werd är var er blev jest został* je byl* este byla был* adalah telah",
    "FIT": "appropriate possible right proper permissible ethical safe acceptable suitable approprié possible angebracht möglich apropiado posible apropriado possível opportuno possibile gepast mogelijk lämpligt möjligt passende muligt możliwe możné posibil возможно mungkin",
    "FOR": "for pour für para per voor för for dla pro pentru для untuk",
    "SORRY": "sorry apolog* regret* unfortunately afraid sadly désolé* regrette* malheureusement hélas leider tut siento lamento lamentablemente desafortunadamente desculp* infelizmente sinto dispiace purtroppo spiacente helaas spijt tyvärr ledsen beklagar desværre beklager niestety przykro przepraszam bohužel omlouv* îmi păcate извините сожалению простите üzgünüm maalesef maaf xin valitettavasti pahoillani sajnos sajnálom",
}
# Denials of scripts without spaces, each an act of answering with a negated possibility, in either order.
UNSPACED = re.compile(
    r"(?:お?答え|お?応え|回答|お?手伝い|対応|提供|お?力に|説明|作成|応じ)[^。！？]{0,14}(?:できません|できない|出来ません|致しかねます|いたしかねます|かねます|なれません|ありません|控え)|(?:申し訳|すみません|恐れ入り)[^。！？]{0,30}(?:できません|ません|かねます)"
    r"|(?:不能|无法|無法|不便|不可以|没办法|不会|拒绝|拒絕)[^。！？]{0,10}(?:回答|提供|帮助|幫助|协助|協助|满足|完成|撰写|讨论|处理|执行)|(?:抱歉|对不起|對不起|很遗憾)[^。！？]{0,12}(?:不能|无法|無法|不便|拒绝)"
    r"|(?:도와|도움|답변|대답|제공|작성|응답|설명|응하|처리)[^.。!?]{0,16}(?:없습니다|없어요|못합니다|않습니다|어렵습니다|불가|거절|드릴 수 없)|(?:죄송|유감)[^.。!?]{0,40}(?:없습니다|않습니다|못합니다|어렵습니다)"
    r"|ไม่(?:สามารถ|อาจ|ได้รับอนุญาต)[^\n]{0,24}(?:ช่วย|ตอบ|ให้|เขียน|ทำ)|(?:لا|لن)\s*(?:أستطيع|يمكنني|نستطيع|يمكننا|أقدر)|(?:मैं|हम)[^।]{0,40}(?:नहीं कर सक|नहीं दे सक|असमर्थ)|(?:אני|איני)[^.]{0,12}לא\s*(?:יכול|יכולה|אוכל)|δεν\s+(?:μπορώ|μπορούμε|είμαι σε θέση)",
)

_TOKEN = re.compile(r"n['’]t\b|[^\W\d_]+(?:-[^\W\d_]+)*(?=n['’]t\b)|['’][^\W\d_]+|[^\W\d_]+(?:-[^\W\d_]+)*|[,;:]")
_EXACT: dict[str, set[str]] = {}
_STEMS: dict[str, list[tuple[str, str]]] = {}
for _class, _words in LEXICON.items():
    for _w in _words.split():
        if _w.endswith("*"):
            _STEMS.setdefault(_w[:2], []).append((_w[:-1], _class))
        else:
            _EXACT.setdefault(_w, set()).add(_class)


@lru_cache(1 << 15)
def classes_of(token: str) -> frozenset[str]:
    """The word classes of a token."""
    out = set(_EXACT.get(token, ()))
    for stem, c in _STEMS.get(token[:2], ()):
        if token.startswith(stem):
            out.add(c)
    return frozenset(out)


Parser = Callable[[list[frozenset[str]], int], Iterator[int]]


def word(*names: str) -> Parser:
    """A token of one of the classes."""
    wanted = frozenset(names)

    def parse(ts: list[frozenset[str]], i: int) -> Iterator[int]:
        if i < len(ts) and not wanted.isdisjoint(ts[i]):
            yield i + 1

    parse.first = wanted  # classes with which a part can begin
    return parse


def fill(most: int) -> Parser:
    """Up to ``most`` tokens of any class."""
    return lambda ts, i: iter(range(i, min(len(ts), i + most) + 1))


def seq(*parts: Parser) -> Parser:
    def parse(ts: list[frozenset[str]], i: int) -> Iterator[int]:
        ends = {i}
        for p in parts:
            ends = {e for s in ends for e in p(ts, s)}
            if not ends:
                return
        yield from ends

    parse.first = parts[0].first
    return parse


def either(*parts: Parser) -> Parser:
    def parse(ts: list[frozenset[str]], i: int) -> Iterator[int]:
        for p in parts:
            yield from p(ts, i)

    parse.first = frozenset().union(*(getattr(p, "first", ()) for p in parts))
    parse.parts = parts
    return parse


def maybe(part: Parser) -> Parser:
    return either(part, lambda ts, i: iter((i,)))


# The grammar, from its smallest parts to the denial.
_ACT = either(word("ACT"), seq(word("ANAPHOR"), fill(1), word("ACT")))
_NEGATED = either(word("I_CANNOT"), seq(word("MODAL", "I_CAN"), fill(2), word("NEG")), seq(word("NEG"), fill(2), word("MODAL", "I_CAN")))
_ABLE = seq(word("MODAL", "BE", "I_CAN"), fill(2), word("NEG"), fill(3), word("ABLE"))
DENIAL = either(
    # I cannot help; je ne peux pas répondre; ich kann dazu nicht antworten; I can't do that
    seq(word("SUBJECT"), fill(2), _NEGATED, fill(5), _ACT),
    seq(_NEGATED, fill(3), word("SUBJECT"), fill(5), _ACT),
    # kan jeg desværre ikke hjælpe; kann ich leider nicht beantworten
    seq(word("MODAL"), word("SUBJECT"), fill(3), word("NEG"), fill(3), _ACT),
    # verbs of the first person: no puedo ayudar, nie mogę odpowiedzieć
    seq(word("NEG"), fill(2), word("I_CAN"), fill(5), _ACT),
    # I am not able, permitted, in a position, comfortable
    seq(word("SUBJECT"), fill(1), _ABLE),
    seq(word("NEG"), word("I_CAN"), fill(2), word("ABLE")),
    seq(word("SUBJECT"), fill(2), word("NEG"), fill(1), word("ACT")),  # I'm unable to answer
    seq(word("SORRY"), fill(2), word("NEG"), fill(1), word("MODAL", "I_CAN"), fill(2), word("ACT")),  # sorry, no can do
)
DECLINED = either(
    seq(word("SUBJECT"), fill(1), maybe(word("NEED", "MODAL")), fill(2), word("DECLINE")),
    seq(word("SUBJECT"), fill(2), word("PREFER"), fill(2), word("NEG")),
    seq(word("I_CAN"), fill(2), word("DECLINE")),
)
_DECLINE_ALONE = frozenset(w for w in "declino niego rehúso recuso nego rechazo rifiuto décline refuse odmawiam отказываюсь weigere avböjer afslår".split())
IMPOSSIBLE = either(
    # This is not a question (that) I can respond to; that isn't something we do
    seq(word("THING"), fill(3), word("BE"), fill(1), word("NEG"), fill(3), word("NOUN", "THING"), fill(2), word("SUBJECT"), fill(2), word("MODAL", "ACT")),
    # it would not be appropriate for me
    seq(word("THING"), fill(3), word("NEG"), fill(2), word("FIT"), fill(1), word("FOR"), word("MY")),
    # the request is outside what I am allowed to do; this goes against my rules
    seq(word("THING"), fill(3), word("BE"), fill(2), word("OUTSIDE"), fill(3), word("MY", "RULE")),
    seq(word("THING"), fill(2), word("OUTSIDE"), fill(3), word("MY", "RULE")),
    # writing about it would go against my rules
    seq(word("ACT"), fill(6), word("MODAL", "BE"), fill(2), word("OUTSIDE"), fill(1), word("MY"), fill(1), word("RULE")),
)
BARRED = either(seq(word("MY"), fill(2), word("RULE"), fill(3), word("FORBID")), seq(word("MY"), fill(2), word("RULE"), fill(3), word("NEG"), fill(2), word("ALLOW")), seq(word("RULE"), fill(2), word("FORBID"), fill(1), word("MY")))
REJECTED = either(seq(word("THING"), fill(2), word("BE"), fill(2), word("REJECTED")), seq(word("THING"), word("REJECTED")), seq(word("RULE"), fill(1), word("REJECTED")))
SORRY = seq(word("SORRY"), fill(6), either(word("I_CANNOT"), seq(word("SUBJECT"), fill(3), word("NEG", "DECLINE")), seq(word("NEG"), fill(1), word("I_CAN")), seq(word("MODAL"), fill(3), word("NEG"))))
#: Classes of which every denial has one.
_SOME = frozenset(["NEG", "I_CANNOT", "DECLINE", "OUTSIDE", "FORBID", "REJECTED"])
_WHO = frozenset(["SUBJECT", "I_CAN", "I_CANNOT", "THING", "MY", "RULE", "SORRY"])
#: The alternatives of all rules by the class with which they begin.
_BY_FIRST: dict[str, list[Parser]] = {}
for _rule in (DENIAL, DECLINED, IMPOSSIBLE, BARRED, REJECTED, SORRY):
    for _part in getattr(_rule, "parts", (_rule,)):
        for _class in sorted(_part.first):
            _BY_FIRST.setdefault(_class, []).append(_part)
#: Words that something said of others has before a denial: someone else is its subject.
_REPORTED = re.compile(r"\b(?:he|she|they|who|warden|authors?|growers?|keepers?)\b", re.IGNORECASE)


@lru_cache(1 << 15)
def _flags_of(token: str) -> int:
    """1 for a class of which every denial has one, 2 for one of who or what denies, 3 for both."""
    c = classes_of(token)
    return (not _SOME.isdisjoint(c)) + 2 * (not _WHO.isdisjoint(c))


def tokens_of(sentence: str) -> list[str]:
    out: list[str] = []
    for t in _TOKEN.findall(sentence.lower().replace("’", "'")):
        if t in ("can't", "won't"):
            out += [t]
        elif t == "cannot":
            out += ["can", "not"]
        else:
            out.append(t)
    return out


def is_denial(sentence: str) -> bool:
    """Whether the grammar finds a denial in one sentence."""
    if UNSPACED.search(sentence):
        return True
    tokens = tokens_of(sentence)
    have = 0
    for t in tokens:
        have |= _flags_of(t)
    if have != 3:
        return False
    ts = [classes_of(t) for t in tokens]
    if not _DECLINE_ALONE.isdisjoint(tokens[:3]):
        return True
    for i, t in enumerate(ts):
        if not t:
            continue
        if i and "SUBJECT" not in t and _REPORTED.fullmatch(tokens[i - 1]):
            continue
        for c in t:
            for rule in _BY_FIRST.get(c, ()):
                if next(rule(ts, i), None) is not None:
                    return True
    return False
