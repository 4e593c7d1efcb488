"""The language of a text, from the scripts of its letters and character n-gram profiles of languages.

Scripts come from the names that Unicode gives its letters, so every script is told apart. Languages that share a
script have interpolated character trigram models, fitted on the seeds below; a word counts against a language by what
its log-probability there lacks to the best language's, bounded, so that no single word (a name, a term) decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

#: Nats that one word can count at most; nats by which a language must lead.
BOUND, LEAD = 3.0, 3.0
#: Words, and trigrams, whose evidence a process keeps, at most.
WORDS = 200_000

# Seeds of the profiles, running text of each language on everyday matters.
SEEDS = {
    "en": "All people are born free and have the same rights and the same dignity. No one shall be held without a reason, and everyone has the right to be heard when they are in need. In the morning we went down to the river, where the water was still cold, and talked about what had been done during the year. There are few places in which such things can be seen as they were before. How does it work, why is it so, and what can be said about the others? They were not able to come because the road had been closed for more than two weeks. Please write a short text that shows which of these is better, give an example and explain your answer in a few sentences. Most of them live near the edge of the wood, under stones or between roots, and they are seen only at night. Describe, compare, summarise or explain what is known, and mention how size, colour and number vary through the seasons once the ground is wet.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Chacun a le droit d'être entendu lorsqu'il en a besoin, et nul ne peut être retenu sans raison. Le matin nous sommes descendus vers la rivière, où l'eau était encore froide, et nous avons parlé de ce qui avait été fait pendant l'année. Il y a peu d'endroits dans lesquels on peut voir ces choses comme elles étaient auparavant. Comment cela fonctionne-t-il, pourquoi est-ce ainsi, et que peut-on dire des autres ? Ils n'ont pas pu venir parce que la route était fermée depuis plus de deux semaines. Veuillez écrire un court texte qui montre lequel est le meilleur, donnez un exemple et expliquez votre réponse en quelques phrases. La plupart vivent près du bord de la forêt, sous les pierres ou entre les racines, et ne sont vus que la nuit.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Jeder hat das Recht, gehört zu werden, wenn er es braucht, und niemand darf ohne Grund festgehalten werden. Am Morgen gingen wir zum Fluss hinunter, wo das Wasser noch kalt war, und sprachen darüber, was im Laufe des Jahres getan worden war. Es gibt nur wenige Orte, an denen man solche Dinge noch so sehen kann, wie sie früher waren. Wie funktioniert das, warum ist es so, und was lässt sich über die anderen sagen? Sie konnten nicht kommen, weil die Straße seit mehr als zwei Wochen gesperrt war. Bitte schreiben Sie einen kurzen Text, der zeigt, was davon besser ist, nennen Sie ein Beispiel und erklären Sie Ihre Antwort in einigen Sätzen. Die meisten leben nahe am Rand des Waldes, unter Steinen oder zwischen Wurzeln, und werden nur in der Nacht gesehen.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos. Cada uno tiene derecho a ser oído cuando lo necesita, y nadie puede ser retenido sin razón. Por la mañana bajamos hasta el río, donde el agua estaba todavía fría, y hablamos de lo que se había hecho durante el año. Hay pocos lugares en los que se pueden ver estas cosas como eran antes. ¿Cómo funciona, por qué es así y qué se puede decir de los demás? No pudieron venir porque el camino estaba cerrado desde hacía más de dos semanas. Por favor, escriba un texto breve que muestre cuál es mejor, dé un ejemplo y explique su respuesta en unas pocas frases. La mayoría vive cerca del borde del bosque, debajo de las piedras o entre las raíces, y solo se ven de noche.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Cada um tem o direito de ser ouvido quando precisa, e ninguém pode ser detido sem razão. De manhã descemos até o rio, onde a água ainda estava fria, e falamos sobre o que tinha sido feito durante o ano. Há poucos lugares em que se podem ver estas coisas como eram antes. Como funciona, por que é assim e o que se pode dizer dos outros? Não puderam vir porque a estrada estava fechada há mais de duas semanas. Por favor, escreva um texto curto que mostre qual é o melhor, dê um exemplo e explique a sua resposta em poucas frases. A maioria vive perto da beira da floresta, debaixo das pedras ou entre as raízes, e só é vista à noite.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Ognuno ha il diritto di essere ascoltato quando ne ha bisogno, e nessuno può essere trattenuto senza motivo. La mattina siamo scesi fino al fiume, dove l'acqua era ancora fredda, e abbiamo parlato di quello che era stato fatto durante l'anno. Ci sono pochi luoghi in cui si possono vedere queste cose come erano prima. Come funziona, perché è così, e che cosa si può dire degli altri? Non sono potuti venire perché la strada era chiusa da più di due settimane. Per favore scrivete un breve testo che mostri quale sia il migliore, date un esempio e spiegate la vostra risposta in poche frasi. La maggior parte vive vicino al bordo del bosco, sotto le pietre o tra le radici, e si vede soltanto di notte.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Iedereen heeft het recht om gehoord te worden wanneer hij dat nodig heeft, en niemand mag zonder reden worden vastgehouden. In de ochtend liepen we naar de rivier, waar het water nog koud was, en spraken we over wat er in het jaar was gedaan. Er zijn maar weinig plaatsen waar je zulke dingen nog kunt zien zoals ze vroeger waren. Hoe werkt het, waarom is het zo, en wat kan er over de anderen worden gezegd? Ze konden niet komen omdat de weg al meer dan twee weken gesloten was. Schrijf alstublieft een korte tekst die laat zien welke beter is, geef een voorbeeld en leg uw antwoord uit in enkele zinnen. De meeste leven dicht bij de rand van het bos, onder stenen of tussen wortels, en worden alleen in de nacht gezien.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. Var och en har rätt att bli hörd när det behövs, och ingen får hållas kvar utan skäl. På morgonen gick vi ner till ån, där vattnet ännu var kallt, och talade om vad som hade gjorts under året. Det finns få ställen där man kan se sådana saker som de var förut. Hur fungerar det, varför är det så, och vad kan man säga om de andra? De kunde inte komma eftersom vägen hade varit stängd i mer än två veckor. Skriv en kort text som visar vilken som är bättre, ge ett exempel och förklara ditt svar med några meningar. De flesta lever nära skogens kant, under stenar eller mellan rötter, och syns bara på natten.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. Enhver har ret til at blive hørt, når der er brug for det, og ingen må holdes tilbage uden grund. Om morgenen gik vi ned til åen, hvor vandet stadig var koldt, og talte om, hvad der var blevet gjort i løbet af året. Der findes kun få steder, hvor man kan se den slags ting, som de var før. Hvordan virker det, hvorfor er det sådan, og hvad kan man sige om de andre? De kunne ikke komme, fordi vejen havde været lukket i mere end to uger. Skriv en kort tekst, der viser, hvilken der er bedst, giv et eksempel og forklar dit svar med nogle få sætninger. De fleste lever tæt ved skovens kant, under sten eller mellem rødder, og ses kun om natten.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Jokaisella on oikeus tulla kuulluksi, kun siihen on tarvetta, eikä ketään saa pitää kiinni ilman syytä. Aamulla menimme alas joelle, jossa vesi oli vielä kylmää, ja puhuimme siitä, mitä vuoden aikana oli tehty. On vain vähän paikkoja, joissa tällaisia asioita voi nähdä sellaisina kuin ne ennen olivat. Miten se toimii, miksi se on niin, ja mitä muista voidaan sanoa? He eivät voineet tulla, koska tie oli ollut suljettuna yli kaksi viikkoa. Kirjoita lyhyt teksti, joka osoittaa, kumpi on parempi, anna esimerkki ja selitä vastauksesi muutamalla lauseella. Useimmat elävät metsän reunan lähellä, kivien alla tai juurien välissä, ja ne nähdään vain yöllä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Każdy ma prawo być wysłuchany, kiedy tego potrzebuje, i nikt nie może być zatrzymany bez powodu. Rano zeszliśmy nad rzekę, gdzie woda była jeszcze zimna, i rozmawialiśmy o tym, co zostało zrobione w ciągu roku. Niewiele jest miejsc, w których można zobaczyć takie rzeczy, jakimi były wcześniej. Jak to działa, dlaczego tak jest i co można powiedzieć o innych? Nie mogli przyjść, ponieważ droga była zamknięta od ponad dwóch tygodni. Proszę napisać krótki tekst, który pokazuje, co jest lepsze, podać przykład i wyjaśnić odpowiedź w kilku zdaniach. Większość żyje w pobliżu skraju lasu, pod kamieniami lub między korzeniami, i widać je tylko nocą.",
    "cs": "Všichni lidé se rodí svobodní a sobě rovní co do důstojnosti a práv. Každý má právo být vyslyšen, když to potřebuje, a nikdo nesmí být zadržován bez důvodu. Ráno jsme šli dolů k řece, kde byla voda ještě studená, a mluvili jsme o tom, co se během roku udělalo. Je jen málo míst, kde lze takové věci vidět tak, jak byly dříve. Jak to funguje, proč je to tak a co se dá říci o ostatních? Nemohli přijít, protože cesta byla zavřená více než dva týdny. Napište prosím krátký text, který ukazuje, co je lepší, uveďte příklad a vysvětlete svou odpověď několika větami. Většina žije blízko okraje lesa, pod kameny nebo mezi kořeny, a je vidět jen v noci.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Mindenkinek joga van ahhoz, hogy meghallgassák, amikor szüksége van rá, és senkit sem szabad ok nélkül fogva tartani. Reggel lementünk a folyóhoz, ahol a víz még hideg volt, és arról beszélgettünk, hogy mi történt az év során. Kevés olyan hely van, ahol az ilyen dolgok úgy láthatók, ahogyan korábban voltak. Hogyan működik, miért van így, és mit lehet mondani a többiekről? Nem tudtak eljönni, mert az út több mint két hétig le volt zárva. Kérem, írjon egy rövid szöveget, amely megmutatja, melyik a jobb, mondjon egy példát, és magyarázza meg a válaszát néhány mondatban. A legtöbb az erdő szélének közelében él, kövek alatt vagy gyökerek között, és csak éjszaka látható.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Fiecare are dreptul să fie ascultat atunci când are nevoie, și nimeni nu poate fi reținut fără motiv. Dimineața am coborât la râu, unde apa era încă rece, și am vorbit despre ceea ce fusese făcut în timpul anului. Sunt puține locuri în care se pot vedea astfel de lucruri așa cum erau înainte. Cum funcționează, de ce este așa și ce se poate spune despre ceilalți? Nu au putut veni pentru că drumul era închis de mai mult de două săptămâni. Vă rog să scrieți un text scurt care arată care este mai bun, dați un exemplu și explicați răspunsul în câteva propoziții. Cei mai mulți trăiesc aproape de marginea pădurii, sub pietre sau între rădăcini, și se văd numai noaptea.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Herkesin ihtiyaç duyduğunda dinlenme hakkı vardır ve hiç kimse sebepsiz yere tutulamaz. Sabahleyin suyun hâlâ soğuk olduğu nehre indik ve yıl boyunca neler yapıldığı hakkında konuştuk. Böyle şeylerin eskiden olduğu gibi görülebildiği çok az yer vardır. Bu nasıl çalışır, neden böyledir ve diğerleri hakkında ne söylenebilir? Yol iki haftadan uzun süredir kapalı olduğu için gelemediler. Lütfen hangisinin daha iyi olduğunu gösteren kısa bir metin yazın, bir örnek verin ve cevabınızı birkaç cümleyle açıklayın. Çoğu ormanın kenarına yakın, taşların altında ya da köklerin arasında yaşar ve yalnızca geceleri görülür.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi người đều có quyền được lắng nghe khi họ cần, và không ai bị giữ lại mà không có lý do. Buổi sáng chúng tôi đi xuống con sông, nơi nước vẫn còn lạnh, và nói về những gì đã được làm trong năm. Có rất ít nơi mà người ta có thể thấy những điều như vậy giống như trước đây. Nó hoạt động như thế nào, tại sao lại như vậy, và có thể nói gì về những người khác? Họ không thể đến vì con đường đã bị đóng hơn hai tuần. Xin hãy viết một đoạn văn ngắn cho thấy cái nào tốt hơn, đưa ra một ví dụ và giải thích câu trả lời của bạn trong vài câu. Hầu hết sống gần bìa rừng, dưới đá hoặc giữa các rễ cây, và chỉ được nhìn thấy vào ban đêm.",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak yang sama. Setiap orang berhak untuk didengar ketika mereka membutuhkannya, dan tidak seorang pun boleh ditahan tanpa alasan. Pada pagi hari kami turun ke sungai, di mana airnya masih dingin, dan berbicara tentang apa yang telah dilakukan selama tahun itu. Hanya ada sedikit tempat di mana hal seperti itu dapat dilihat seperti dahulu. Bagaimana cara kerjanya, mengapa demikian, dan apa yang dapat dikatakan tentang yang lain? Mereka tidak dapat datang karena jalan telah ditutup selama lebih dari dua minggu. Tolong tuliskan teks pendek yang menunjukkan mana yang lebih baik, berikan contoh dan jelaskan jawaban Anda dalam beberapa kalimat. Kebanyakan hidup di dekat tepi hutan, di bawah batu atau di antara akar, dan hanya terlihat pada malam hari.",
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Каждый имеет право быть услышанным, когда ему это нужно, и никто не может быть задержан без причины. Утром мы спустились к реке, где вода была ещё холодной, и говорили о том, что было сделано в течение года. Есть мало мест, где такие вещи можно увидеть такими, какими они были раньше. Как это работает, почему это так и что можно сказать о других? Они не смогли прийти, потому что дорога была закрыта больше двух недель. Напишите короткий текст, который показывает, что лучше, приведите пример и объясните свой ответ несколькими предложениями. Большинство живёт у края леса, под камнями или между корнями, и видно их только ночью.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Кожен має право бути почутим, коли йому це потрібно, і нікого не можна затримувати без причини. Вранці ми спустилися до річки, де вода була ще холодною, і говорили про те, що було зроблено протягом року. Є мало місць, де такі речі можна побачити такими, якими вони були раніше. Як це працює, чому це так і що можна сказати про інших? Вони не змогли прийти, тому що дорога була закрита більше двох тижнів. Напишіть короткий текст, який показує, що краще, наведіть приклад і поясніть свою відповідь кількома реченнями.",
}
#: Languages of scripts that have one, or one beside which others are rare in such corpora.
SCRIPT_LANGUAGE = {"HIRAGANA": "ja", "KATAKANA": "ja", "CJK": "zh", "HANGUL": "ko"}

_WORD = re.compile(r"[^\W\d_]+")
_SPACE_OR_SIGN = re.compile(r"[^A-Za-z]+")


@lru_cache(1 << 14)
def script_of(c: str) -> str:
    """The script of a letter, the first word of its Unicode name; '' for other signs."""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0] if c.isalpha() else ""


def scripts_of(text: str) -> Counter:
    """How many letters of each script ``text`` has."""
    if text.isascii():
        return Counter({"LATIN": len(_SPACE_OR_SIGN.sub("", text))})
    out: Counter = Counter()
    for c, n in Counter(text).items():
        if s := script_of(c):
            out[s] += n
    return out


class Profiles:
    """Interpolated character trigram models of the languages of one script."""

    def __init__(self, seeds: dict[str, str]) -> None:
        self.languages = sorted(seeds)
        counts: list[list[Counter]] = []
        alphabet: set[str] = set()
        for lang in self.languages:
            c = [Counter(), Counter(), Counter()]
            for w in _WORD.findall(seeds[lang].lower()):
                s = f"^{w}$"
                alphabet.update(s)
                for k in range(3):
                    c[k].update(s[max(0, i - k) : i + 1] for i in range(1, len(s)))
            counts.append(c)
        self.counts, self.n_letters = counts, len(alphabet) + 1
        context: list[list[Counter]] = []
        for c in counts:
            of: list[Counter] = [Counter(), Counter(), Counter()]
            for k in range(3):
                for g, n in c[k].items():
                    of[k][g[:-1]] += n
            context.append(of)
        self.context = context
        self.row: dict[str, int] = {}
        self.grams: dict[str, np.ndarray] = {}
        self.table = np.zeros((1 << 12, len(self.languages)), np.float32)

    def _gram(self, g: str) -> np.ndarray:
        """Log-probability of the last sign of ``g`` after those before it, in each language."""
        out = self.grams.get(g)
        if out is None:
            p = np.full(len(self.languages), 1 / self.n_letters)
            for k, strength in zip(range(len(g)), (30.0, 6.0, 3.0)):
                part = g[len(g) - 1 - k :]
                n = np.array([c[k].get(part, 0) for c in self.counts], float)
                of = np.array([c[k].get(part[:-1], 0) for c in self.context], float)
                p = (n + strength * p) / (of + strength)
            out = np.log(p)
            if len(self.grams) < WORDS:
                self.grams[g] = out
        return out

    def _word(self, w: str) -> np.ndarray:
        s = f"^{w}$"
        out = self._gram(s[:2]).copy()
        for i in range(2, len(s)):
            out += self._gram(s[i - 2 : i + 1])
        return np.maximum(out - out.max(), -BOUND)

    def evidence(self, words: list[str]) -> np.ndarray:
        """Sum over ``words`` of the bounded evidence for each language."""
        if len(self.row) + len(words) >= WORDS:
            self.row.clear()  # begins anew, so that memory is bounded
        get = self.row.get
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            for w in words:
                if w not in self.row:
                    k = self.row[w] = len(self.row)
                    if k >= len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[k] = self._word(w)
            ids = [self.row[w] for w in words]
        return self.table[ids].sum(0, dtype=np.float64)


def _by_script() -> dict[str, Profiles]:
    groups: dict[str, dict[str, str]] = defaultdict(dict)
    for lang, text in SEEDS.items():
        groups[scripts_of(text).most_common(1)[0][0]][lang] = text
    return {s: Profiles(g) for s, g in groups.items()}


@lru_cache(1)
def profiles() -> dict[str, Profiles]:
    """The profiles of all scripts, made once a process."""
    return _by_script()


_NAME = re.compile(r"(?<=[^\W\d_] )[A-Z][a-z]+(?: [a-z]{6,})?")


def running_words(text: str) -> list[str]:
    """The words of ``text`` in small letters, without names: words with a capital amid a sentence, with a long one after it."""
    return _WORD.findall(_NAME.sub(" ", text).lower())


class Evidence:
    """Evidence for the languages of a text: by script, then by profile."""

    __slots__ = ("script", "share", "languages", "scores", "n", "n_words")

    def __init__(self, text: str) -> None:
        if text.isascii():
            words = running_words(text)
            self.script, self.share, self.n, self.n_words = "LATIN" if words else "", 1.0 if words else 0.0, sum(map(len, words)), len(words)
            p = profiles()["LATIN"]
            self.languages, self.scores = p.languages, p.evidence(words)
            return
        found = scripts_of(text)
        if len(found) > 1 and found["LATIN"]:
            found["LATIN"] = scripts_of(_NAME.sub(" ", text))["LATIN"]  # names stay Latin in any language
        whole = sum(found.values())
        japanese = found["HIRAGANA"] + found["KATAKANA"]
        if japanese and japanese * 10 >= found["CJK"]:
            found["HIRAGANA"] += found.pop("CJK", 0) + found.pop("KATAKANA", 0)
        # a sign of a script without spaces says as much as several letters
        weight = {s: n * (3 if s in SCRIPT_LANGUAGE and s != "HANGUL" else 1) for s, n in found.items()}
        self.script = max(weight, key=lambda s: (weight[s], s), default="")
        self.share = weight.get(self.script, 0) / max(1, sum(weight.values()))
        p = profiles().get(self.script)
        self.n, self.n_words = whole, whole
        if p is None:
            self.languages, self.scores = [SCRIPT_LANGUAGE.get(self.script, self.script.lower())], np.array([10.0 if whole else 0.0])
        else:
            words = running_words(text) if self.script == "LATIN" else [w.lower() for w in _WORD.findall(text)]
            words = [w for w in words if script_of(w[0]) == self.script]
            self.languages, self.scores, self.n_words = p.languages, p.evidence(words), len(words)

    def best(self, lead: float = LEAD) -> str | None:
        """The language that leads all others by ``lead`` nats, or None."""
        near = self.near(lead)
        return near[0] if len(near) == 1 else None

    def near(self, lead: float = LEAD) -> list[str]:
        """The languages less than ``lead`` nats behind the best; none where there are no letters."""
        if not self.n or not len(self.scores):
            return []
        scores = self.scores.tolist()
        least = max(scores) - lead
        return [x for x, s in zip(self.languages, scores) if s > least]

    def behind(self, language: str) -> float:
        """Nats by which ``language`` is behind the best; infinite where it has another script."""
        return float(self.scores.max() - self.scores[self.languages.index(language)]) if language in self.languages else math.inf


def language_of(text: str, lead: float = LEAD) -> str | None:
    """The language of ``text``; None for no letters, or too few to tell languages of its script apart."""
    return Evidence(text).best(lead)
