"""Template residue, filler, error pages and script notices, found by character n-gram models.

Models of filler and notices, of missing data filled into a sentence, and of unfilled slots are fitted on the seeds
below; the model of natural prose on the whole corpus itself, cleaned once by the first fit. Each
character gets the log-likelihood ratio of its 4-gram; the best window of each sentence or line localises residue.
A segment is residue if such a window has enough evidence and covers enough of it, so that a text which quotes or
speaks of these things amid real content isn't. Slots and missing data stand within sentences: there the window is a
candidate, whose syntax an exact check confirms.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.session import widened

#: Weight of the corpus in the model of prose, in rows, at most: beyond, the counts of all rows are scaled to it, so that a few texts
#: of residue in a hundred don't outgrow the smoothing, and look like prose, just because the corpus is large.
FIT_ROWS = 1500
#: Evidence of a window in nats, share of the segment that it covers, evidence a character.
EVIDENCE, COVERAGE, RATE = 12.0, 0.7, 0.45

# Seeds of the models, in natural order.
HTTP = ["400 Bad Request", "401 Unauthorized", "403 Forbidden", "404 Not Found", "405 Method Not Allowed", "408 Request Timeout", "410 Gone", "429 Too Many Requests", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout"]
HTTP_FORMS = ["{0}", "HTTP {0}", "HTTP {1} - {2}", "Error {1}: {2}.", "Error {1} ({2})", "{2}.", '{{"error":{{"code":{1},"message":"{3}"}}}}', '{{"status":{1},"error":"{2}"}}', "<html><head><title>{0}</title></head><body><h1>{2}</h1><hr>nginx</body></html>", "<html><head><title>{0}</title></head><body><center><h1>{0}</h1></center><hr><center>server</center></body></html>"]
NOTICES = """
The requested page could not be found.
The requested URL was not found on this server.
The page you requested does not exist.
We looked for that page and could not find it.
Page not found.
Oops! Something went wrong.
An unexpected error occurred. Please try again later.
An error has occurred while processing your request.
Internal error. Please contact the administrator.
This service is temporarily unavailable. Please try again later.
The site is offline for planned maintenance.
We are currently undergoing maintenance and will be back soon.
The server is temporarily unable to service your request.
The connection has timed out. The server took too long to respond.
Upstream connect error or disconnect before headers: connection reset.
Rate limit exceeded, please wait and try again.
upstream connect error or disconnect/reset before headers. reset reason: connection failure
API rate limit exceeded. You exceeded your current quota, please check your plan and billing details.
Quota exceeded, please retry after 60 seconds. Rate limit reached. Please try again in 20 seconds. Retry after one minute.
net::ERR_CONNECTION_RESET The connection was reset. Connection closed before the headers were received. Connection reset by peer.
Too many requests. Slow down and retry after a while.
You lack the rights that this page asks for.
You are not authorized to view this page.
Please log in to continue. You must be logged in to view this content.
Your browser is being checked.
Please stand by while we check your browser.
Verify that you are human. Complete the security check to continue.
The content failed to load. Refresh the page to try again.
Unable to load the requested record. Reload and try again.
Please enable JavaScript in your browser and reload the page.
JavaScript is required to view this site.
As JavaScript is off, the page cannot be displayed.
This site requires JavaScript.
Scripts have to run here, so please allow them for this address.
Scripts are disabled.
Please enable cookies and scripts in your browser.
Your browser does not support JavaScript.
<noscript>The app runs with JavaScript only, so please enable it.</noscript>
Die Seite konnte nicht geladen werden.
Zugriff verweigert. Interner Serverfehler.
Der Dienst ist vorübergehend nicht verfügbar. Bitte versuchen Sie es später erneut.
La page n'a pas pu être chargée.
Accès refusé. Erreur interne du serveur.
Le service est temporairement indisponible. Veuillez réessayer plus tard.
La página solicitada no existe.
Acceso denegado. Error interno del servidor.
El servicio no está disponible en este momento. Inténtelo de nuevo más tarde.
A página solicitada não foi encontrada. Não foi possível carregar a página solicitada.
Ative o JavaScript no seu navegador para continuar. Acesso negado. Erro interno do servidor.
O serviço está temporariamente indisponível. Tente novamente mais tarde.
La pagina richiesta non è stata trovata. Attiva JavaScript nel browser per continuare.
This request failed and no result was returned. The operation was aborted before it was finished.
We couldn't load this page right now. This page isn't available any more, it may have been deleted or renamed.
The link you followed is broken or out of date. Nothing was found at this address. Check the address and go back to the home page.
Something broke on our end and our team has been told. Please wait a moment and then refresh. Try again later or contact support.
You need permission to see this. Entry refused. Your account can't open this document. Log in with another account.
You have been signed out because you were inactive for too long. Your login is no longer valid, please sign in once more.
The gateway did not receive a timely response. Connection refused by the remote host. Host unreachable, network error, timed out.
This website is being updated and will return shortly. We'll be right back after some maintenance work.
Please turn JavaScript on to see this content. To use this site, JavaScript must be enabled. This application needs JavaScript.
Without JavaScript this page can't be shown. Your browser has JavaScript turned off. Change the settings of your browser and load the page again.
Scripting is switched off in your browser. Scripts have been blocked by an extension. Allow scripts and cookies for this site to go on.
Your browser can't run scripts. It is too old or scripting has been disabled. Cookies are required, please allow them.
We are verifying your connection before you proceed. One moment please, you will be redirected. Prove that you are not a robot.
Diese Seite existiert nicht oder wurde verschoben. Leider ist ein Fehler aufgetreten. Seite nicht gefunden.
Für diese Anwendung muss JavaScript eingeschaltet sein. Ihr Browser unterstützt kein JavaScript. Bitte laden Sie die Seite neu und melden Sie sich an.
Cette page n'existe pas ou a été déplacée. Une erreur s'est produite. Page introuvable.
JavaScript doit être activé pour utiliser ce site. Votre navigateur ne prend pas en charge JavaScript. Merci de recharger la page et de vous connecter.
Esta página no existe o se ha movido. Se ha producido un error. Página no encontrada. La página no se ha podido abrir.
Es necesario habilitar JavaScript para ver este sitio. Su navegador no admite JavaScript. Vuelva a cargar la página e inicie sesión.
Esta página não existe ou foi movida. Ocorreu um erro. Página não encontrada.
É necessário ativar o JavaScript para ver este site. O seu navegador não suporta JavaScript. Recarregue a página e inicie sessão.
Страница не найдена. Произошла ошибка. Пожалуйста, включите JavaScript в браузере, чтобы увидеть страницу. Доступ запрещён. Сервис временно недоступен.
ページが見つかりません。エラーが発生しました。このページを表示するには JavaScript を有効にしてください。アクセスが拒否されました。しばらくしてからもう一度お試しください。
"""
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Text goes here. Content to follow. Content goes here. More text to come. Details to follow.
TBD - write this section before release. TBD. To be determined. To be completed. TODO: write this part. TODO - add text.
Left blank on purpose. Dummy text, dummy copy.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas, vestibulum tortor quam, feugiat vitae, ultricies eget.
Donec eu libero sit amet quam egestas semper. Aenean ultricies mi vitae est, mauris placerat eleifend leo, quisque sit amet sapien ullamcorper pharetra.
Aenean fermentum elit eget tincidunt condimentum, eros ipsum rutrum orci, sagittis tempus lacus enim ac dui. Donec non enim in turpis pulvinar facilisis.
This text is a placeholder. Placeholder text, used to test the layout. Sample text, used to test the layout. Replace this text.
Your text here. Click here to edit this text. Add your content here.
Stub - replace before publication. Insert description here. Coming soon. Under construction.
xxx xxxx xxxxxx xxxxx xxx xxxxx xxxx xxx xxxxxx xxxx xxxxx xxx xxx xxxx xxxxxx xxxxx.
xxxxx xxxxx xxxx xxxxxx xxx xxx xxxxx xxxxxx xxxx xxx xxxxx xxx xxxx xxxx xxxxxx.
blah blah blah blah blah. asdf asdf asdf asdf. qwerty qwerty qwerty. foo bar baz foo bar baz. test test test test.
Add text here. Your content goes here. Enter your text. Write something here. Start typing your story. Insert paragraph text.
This block holds sample copy until the real copy is ready. The final text will be added later. To be written. To be supplied by the author.
This is filler text and will be replaced. Replace with real content before going live. Temporary text, not final. Draft only, wording to be confirmed.
Edit this section. Tap to edit. Double click to change this paragraph. Type your heading here. Section title goes here. Description to be added.
"""
# Parts of notices, joined by ``notices_of`` in every way.
NOTICE_PARTS = [
    (
        "The page|This page|The document|The file|The site|This content|The resource|The record|The link|The address".split("|"),
        "could not be found|can't be found|does not exist|no longer exists|is not available|is no longer available|has been removed|has been moved|has been deleted|could not be loaded|failed to load|can't be displayed|is blocked|has expired|is restricted|is busy".split("|"),
        "|you are looking for|you requested|at the moment|at this time|for your account|on this server".split("|"),
    ),
    (
        "Please|Kindly|You can|Try to|You may".split("|"),
        "try again|retry|reload the page|refresh the page|come back|go back|check the address|return to the home page|contact support|contact the administrator|sign in|log in|wait".split("|"),
        "|later|in a few moments|shortly|to continue|if the problem persists|and try again".split("|"),
    ),
    (
        "JavaScript|Scripts|Cookies|Scripting".split("|"),
        "must be enabled|must be allowed|must be turned on|is required|are required|is disabled|are disabled|is switched off|are blocked|is not supported|needs to be enabled|has been turned off".split("|"),
        "|to view this page|for this page to display|to continue|to use this site|in your browser|to see the content|for the site to work".split("|"),
    ),
    (
        "Please enable|Enable|Turn on|Allow|Activate|Switch on|You need to enable|You must enable|You have to allow".split("|"),
        "JavaScript|scripts|cookies|scripting|JavaScript and cookies".split("|"),
        "|to view this page|to continue|to use this site|in your browser settings|and reload|for this site|to see the content".split("|"),
    ),
    (
        "An error|An unexpected error|A problem|An internal error|An unknown error".split("|"),
        "occurred|has occurred|was encountered|happened".split("|"),
        "|while loading the page|while processing your request|on the server|during the operation".split("|"),
    ),
    ("Our servers|The server|The service|Our system|The system".split("|"), "is down|are busy|is overloaded|is unavailable|is not responding|returned an error|refused the request|took too long".split("|"), "|at the moment|for maintenance|right now|please retry later|please try later".split("|")),
    ("Access|Your access|Entry".split("|"), "denied|is denied|has been denied|was refused|is restricted|has been blocked".split("|"), "|to this page|to this content|for your account".split("|")),
    ("We can't|We cannot|We couldn't|We could not".split("|"), "find|load|open|show|display|process".split("|"), "that page|this page|the page|your request|the file".split("|")),
    ("Diese Seite|Die Seite|Der Inhalt|Das angeforderte Dokument|Die angeforderte Datei|Die gesuchte Seite|Die angeforderte Ressource".split("|"), "wurde nicht gefunden|existiert nicht|ist nicht verfügbar|konnte nicht geladen werden|ist nicht mehr vorhanden|wurde verschoben".split("|"), "|leider|zurzeit|(Fehler 404)|(Fehler 500)".split("|")),
    ("JavaScript ist|Cookies sind|Ihr Browser hat JavaScript|Skripte sind".split("|"), "deaktiviert|ausgeschaltet|erforderlich|blockiert|abgeschaltet".split("|"), "|in Ihrem Browser|für diese Seite".split("|")),
    ("Bitte aktivieren Sie|Schalten Sie|Bitte erlauben Sie".split("|"), "JavaScript|Cookies|Skripte".split("|"), "in Ihrem Browser|um fortzufahren|um diese Seite zu sehen".split("|")),
    ("Cette page|La page|Le document|Ce contenu|L'adresse demandée|La ressource demandée".split("|"), "n'existe pas|n'existe plus|n'est plus disponible|est introuvable|n'a pas été trouvé|a été déplacé|a été supprimé".split("|"), "|que vous cherchez|pour le moment|(erreur 404)|(erreur 500)".split("|")),
    ("Activez|Veuillez activer|Vous devez activer|Autorisez".split("|"), "JavaScript|les cookies|les scripts".split("|"), "pour continuer|pour voir cette page|pour afficher le contenu|dans votre navigateur".split("|")),
    ("Esta página|La página|El documento|La dirección solicitada".split("|"), "no existe|ya no existe|no está disponible|no se encuentra|no se pudo cargar|ha sido eliminado".split("|"), "|que busca|en este momento|(error 404)".split("|")),
    ("Active|Debe activar|Habilite|Es necesario activar".split("|"), "JavaScript|las cookies|los scripts".split("|"), "para continuar|para ver esta página|en su navegador".split("|")),
    ("Esta página|A página|O documento|O endereço solicitado".split("|"), "não existe|já não existe|não está disponível|não foi encontrada|não pôde ser carregada|foi removido".split("|"), "|que procura|neste momento|(erro 404)".split("|")),
    ("Ative|Deve ativar|Habilite|É necessário ativar".split("|"), "JavaScript|os cookies|os scripts".split("|"), "para continuar|para ver esta página|no seu navegador".split("|")),
]
FILLER_PARTS = [
    ("Text|Your text|Content|The content|Body text|Copy|Description|Details|Summary|Paragraph|Title|Heading".split("|"), "goes here|to come|to follow later|will be added|will be supplied|is to be written|to be added|to be completed".split("|"), "|later|soon|here|before publication|by the author".split("|")),
    ("Insert|Add|Enter|Type|Write|Replace|Edit".split("|"), "your text|the text|your title|a description|your content|this paragraph|the summary|some words".split("|"), "|here|below|before publishing|before release".split("|")),
    ("Insert|Add|Enter|Put|Type".split("|"), "introduction|outline|preface|summary|abstract|conclusion|background|description|details|title|name|text|methods|heading|quote|caption".split("|"), "here|text here|below".split("|")),
    ("This section|This paragraph|This part|This block|This chapter|This page".split("|"), "is intentionally|is deliberately|is purposely|was".split("|"), "left blank|left empty|filled with sample text|filled with placeholder text|filled with filler|filled with dummy words|written in mock copy".split("|")),
    ("Draft|Stub|Working draft|Rough draft|Placeholder|Temporary wording|First draft|Section stub".split("|"), ", replace with|, to be replaced by|- replace with|, swap for|, update with".split("|"), "the final text|final copy|the real text|approved wording|the finished version|real content|the final version".split("|")),
]
PROSE = """
The set of plots was sampled twelve times, and the first two rows of the table were left out of the mean.
Entries in brackets keep the spelling of the first hand; the labels followed one pattern and were checked in the field.
We thank the keepers who found the missing sheets and the readers who wrote to us about errors in the older pages.
A page of the ledger was torn, so the count for that week could not be used; the server of the inn remembered the storm.
Access to the shore is closed in spring. The road was under repair, and visitors had to ask the warden for permission.
The script of the play was found in the library, together with a note on how the text was to be filled in later.
In the evening the children walked home along the river, and their mother told them what she had seen in the town.
Methods differ between authors; results are given as medians with ranges, and values below the limit count as zero.
She opened the letter slowly, read it twice, and put it back into the drawer without saying a word to anyone.
The committee met on Monday to discuss the budget, the new bridge and the request of two villages for a school.
Das Haus am Fluss war seit Jahren leer, und niemand wusste, wem der Garten gehörte. Die Werte sind im Mittel gestiegen.
La maison au bord de la rivière était vide depuis des années, et personne ne savait à qui appartenait le jardin.
La casa junto al río estaba vacía desde hacía años, y nadie sabía de quién era el jardín. Los valores subieron poco a poco.
A casa à beira do rio estava vazia há anos, e ninguém sabia de quem era o jardim. Os valores subiram pouco a pouco.
name | site | count
Notes: see the second sheet. Question. Answer. Figure 3. Table 2. Chapter 4. First part. Least likely.
"""
SLOT_NAMES = ["name", "title", "summary", "display_name", "value", "section", "season", "first name", "company", "date", "part_title", "trait_list", "USER_NAME", "CITY", "item.title"]
SLOT_FORMS = ["{{{{{0}}}}}", "{{{{ {0} }}}}", "{{{0}}}", "${{{0}}}", "<%= {0} %>", "<% {0} %>", "{{% if {0} %}}", "%({0})s", "@@{0}@@", "__{1}__", "[[{0}]]", "[[{0}: to be supplied]]", "[INSERT {1}]", "[insert {0} here]", "[{0} goes here]", "[Name of {0}]", "[Your {0}]", "<{1}>", "<<{0}>>", "#{{{0}}}", "%%{1}%%"]
MISSING_FRAMES = ["near {0} in {0}.", "counted {0} individuals", "Compared with {0}, {0} prefers {0} ground.", "The name is {0} and its place is {0}.", "known from {0}; its usual size is {0} mm.", "Dear {0},", "by {0} on {0}", "{0} was seen at {0} with {0}", "of {0} and {0}"]
MISSING = ["undefined", "NaN", "None", "null", "[object Object]", "N/A", "nil"]

SLOT = re.compile(
    r"\{\{\s*[\w.\- |]{1,40}?\s*\}\}|\{%-?\s*\w[^%{}\n]{0,40}%\}|[$#]\{\s*[\w.\- ]{1,40}\}|<%[=-]?[^%<>\n]{1,40}%>|%\(\w{1,40}\)[sdrf]|@@\w[\w ]{0,40}@@|__[A-Z][A-Z0-9_]{1,40}?__"
    r"|%%[A-Z_]{2,40}%%|\[\[\s*\w[\w \-]{0,30}:?[\w \-]{0,40}\]\]|\[\s*(?:insert|enter|add|your|name of|title of|date of|type)\s[^\[\]\n]{1,40}\]|\[[^\[\]\n]{1,40}\s(?:goes here|to follow|to be (?:supplied|added|completed|inserted))\s*\]|<<\s*[a-z]\w*(?:[ .]\w+)*\s*>>|(?<!<)<[A-Z][A-Z0-9_ ]{2,40}>(?!>)|(?<![\w{$#%])\{[a-z]\w*(?:[._][a-z]\w*)*\}(?!\})",
    re.IGNORECASE,
)
_CASED = re.compile(r"__[A-Z]|<[A-Z]|%%[A-Z]")
MISSING_VALUE = re.compile(r"\[object Object\]|(?<![\w\"'`“«-])NaN(?![\w\"'`”»-])|(?<![\w\"'`“«-])(?:undefined|null|None|nil|N/A)(?![\w\"'`”»-])")
_QUOTES = re.compile(r"[\"`“”«»]")
_BEFORE = re.compile(r"(?:^|[\s(])(?:with|near|in|at|from|to|by|of|is|was|are|were|for|on|counted|and|than|:|=|Dear|Hello|Hi|between|about)\s*[,:]?\s*$", re.IGNORECASE)

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _literal_table() -> np.ndarray:
    """Symbol of each code point below 2^16: letters without case and accent, digit, space, line end, punctuation."""
    import unicodedata

    out = np.full(1 << 16, 39, np.uint8)
    for cp in range(0x250):
        base = unicodedata.normalize("NFKD", chr(cp))[0].lower()
        if base in _LETTERS:
            out[cp] = _LETTERS.index(base)
    for k, group in enumerate(["0123456789", " \t\r\xa0　", "\n", ".", ",", "'’", "-–—", ":;", "()", "!?", "<>/", "{}[]", '"“”„«»', "=_#*|%$@&"]):
        for c in group:
            out[ord(c)] = 26 + k if k < 13 else 38
    return out


_SHAPES = "{}[]<>%$@#_=:;,.()/|\"'-*!?&"


def _shape_table() -> np.ndarray:
    """Symbol of each code point below 2^16 by kind: lower, upper, digit, space, line end, each punctuation sign."""
    out = np.full(1 << 16, 5, np.uint8)
    for cp in range(0x250):
        c = chr(cp)
        out[cp] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\r\xa0" else 4 if c == "\n" else 5
    for k, c in enumerate(_SHAPES):
        out[ord(c)] = 6 + k
    return out


#: Shapes with which a slot can begin.
_OPENS = np.isin(np.arange(6 + len(_SHAPES)), [6 + _SHAPES.index(c) for c in "{[<%@_$#"])
LITERAL, N_LITERAL = _literal_table(), 40
SHAPE, N_SHAPE = _shape_table(), 6 + len(_SHAPES)


def _codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < (1 << 16), cp, 0xFFFF)


def _grams(symbols: np.ndarray, base: int) -> np.ndarray:
    """Index of the 4-gram that ends at each symbol; the text begins as if after line ends."""
    s = symbols.astype(np.int32)
    out = s.copy()
    for k, scale in ((1, base), (2, base * base), (3, base**3)):
        out[k:] += s[:-k] * scale
        out[:k] += (28 if base == N_LITERAL else 4) * scale
    return out


def _blocks(texts: Iterable[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of ``most`` characters, and those of the last one more."""
    block: list[str] = []
    size = 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size > most:
            yield block
            block, size = [], 0
    if block:
        yield block


class ProseCounts:
    """Of texts: their number, and in how many each 4-gram stands, by characters and by shapes. Of fixed size whatever the corpus."""

    def __init__(self, texts: Iterable[str] = ()) -> None:
        self.rows = 0
        self.literal, self.shape = np.zeros(N_LITERAL**4, np.int64), np.zeros(N_SHAPE**4, np.int64)
        self.add(texts)

    def add(self, texts: Iterable[str]) -> None:
        for block in _blocks(texts):
            self.rows += len(block)
            # parted as in ``ResidueModel.find``; of the line ends after a text the first is its own
            sizes = np.array([len(t) + 3 for t in block], np.int64)
            cp = _codes("\n\n\n".join(block) + "\n\n\n")
            own = np.ones(len(cp), bool)
            for k in (1, 2):
                own[np.cumsum(sizes) - k] = False
            text = np.repeat(np.arange(len(block), dtype=np.int64) << 22, sizes)[own]  # a 4-gram's index is below 2^22
            for counts, table, base in ((self.literal, LITERAL, N_LITERAL), (self.shape, SHAPE, N_SHAPE)):
                grams = text + _grams(table[cp], base)[own]
                grams.sort()
                grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])] & ((1 << 22) - 1)
                counts += np.bincount(grams, minlength=len(counts))

    def without(self, other: ProseCounts) -> ProseCounts:
        out = ProseCounts()
        out.rows, out.literal, out.shape = self.rows - other.rows, self.literal - other.literal, self.shape - other.shape
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([self.literal, self.shape, [self.rows]])

    @staticmethod
    def of_flat(flat: np.ndarray) -> ProseCounts:
        out = ProseCounts()
        out.literal, out.shape, (out.rows,) = flat[: len(out.literal)], flat[len(out.literal) : -1], flat[-1:].tolist()
        return out


class _Gram:
    """Interpolated character 4-gram probabilities."""

    def __init__(self, texts: list[str], table: np.ndarray, base: int, once: bool = False, more: np.ndarray | None = None) -> None:
        """once: a text counts each of its 4-grams once, so that no long text of filler outweighs the others. more: further counts."""
        c4 = np.zeros(base**4, np.float32) if more is None else more.astype(np.float32)
        for t in texts:
            grams = _grams(table[_codes(t + "\n")], base)
            np.add.at(c4, np.unique(grams) if once else grams, np.float32(1))
        c4 = c4.reshape((base,) * 4)
        p = np.full(base, 1 / base, np.float32)
        for order, strength in ((1, 20), (2, 8), (3, 5), (4, 3)):
            c = c4.sum(axis=tuple(range(4 - order)), dtype=np.float32) if order < 4 else c4
            p = (c + strength * p) / (c.sum(axis=-1, keepdims=True) + strength)
        self.log = np.log(p).reshape(-1)


def notices_of(parts: list[tuple[list[str], ...]]) -> list[str]:
    """All sentences that the parts of each table give, one part of each column."""
    return [" ".join(x for x in (*row, tail) if x).replace(" ,", ",") + "." for *heads, tails in parts for row in product(*heads) for tail in tails]


def mock_latin() -> list[str]:
    """Lorem ipsum with other endings, as generators of dummy text make it: each line has all its words with one ending."""
    words = [w for w in re.findall(r"[a-z]+", FILLER.lower().split("excepteur")[0]) if len(w) >= 4]
    return [" ".join(w[: min(len(w) - 1, k)] + e for w in words) + "." for k in (3, 4, 5) for e in ("", "al", "at", "ar", "en", "is", "um")]


def seeds() -> dict[str, list[str]]:
    """The seed texts of each model."""
    notices = [s.strip() for s in NOTICES.strip().splitlines()]
    for h in HTTP:
        code, _, words = h.partition(" ")
        notices += [f.format(h, code, words, words.lower()) for f in HTTP_FORMS]
    notices = notices * 10 + notices_of(NOTICE_PARTS)
    filler = [s.strip() for s in FILLER.strip().splitlines()] * 30 + notices_of(FILLER_PARTS) + mock_latin() * 8
    slots = [f"the {f.format(n, n.upper().replace(' ', '_'))} of" for f in SLOT_FORMS for n in SLOT_NAMES]
    missing = [f.format(m) for f in MISSING_FRAMES for m in MISSING]
    return {"residue": notices + filler, "slot": slots, "missing": missing}


def _ratio(model: _Gram, prose: _Gram) -> np.ndarray:
    """Log-likelihood ratios in twentieths of a nat, bounded, so that no single character decides."""
    return np.clip((model.log - prose.log) * 20, -60, 50).astype(np.int8)


class ResidueModel:
    """Ratio tables of the three models against prose, of fixed size whatever the corpus."""

    def __init__(self, prose: list[str] | ProseCounts, rows: int = FIT_ROWS) -> None:
        """``prose`` weighs as ``rows`` rows at most. Of texts, those that the first fit calls residue are left out; counts are taken as they are."""
        s = seeds()
        base = [x.strip() for x in PROSE.strip().splitlines()]  # so that a small corpus has a model of prose too
        fitted = {"residue": _Gram(s["residue"], LITERAL, N_LITERAL), "missing": _Gram(s["missing"], LITERAL, N_LITERAL), "slot": _Gram(s["slot"], SHAPE, N_SHAPE)}
        counts = prose if isinstance(prose, ProseCounts) else ProseCounts(prose)
        for last in (isinstance(prose, ProseCounts), True):
            weight = min(1.0, rows / max(1, counts.rows))
            literal, shape = _Gram(base, LITERAL, N_LITERAL, True, counts.literal * weight), _Gram(base, SHAPE, N_SHAPE, True, counts.shape * weight)
            self.tables = {k: _ratio(m, shape if k == "slot" else literal) for k, m in fitted.items()}
            if last:
                break
            counts = ProseCounts([t for t, f in zip(prose, self.find(prose)) if not f])

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each text the residue in it: (first char, end char, kind of notice_or_filler, slot or missing)."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not texts:
            return out
        lengths = np.array([len(t) for t in texts], np.int64)
        # texts are parted by as many line ends as a 4-gram looks back, so each is scored as if alone
        first = np.concatenate([[0], np.cumsum(lengths + 3)])
        whole = "\n\n\n".join(texts) + "\n\n\n"
        cp = _codes(whole)
        literal, shape = LITERAL[cp], SHAPE[cp]
        # segments: lines, and sentences that end before white space
        stop = np.isin(cp, [0x2E, 0x21, 0x3F, 0x2026, 0x3002])
        space = (literal == 27) | (literal == 28)
        after = np.concatenate([shape[1:], [4]])
        # a line that goes on with a small letter was only wrapped
        ends = stop & np.concatenate([space[1:], [True]]) | (literal == 28) & (after != 0)
        for k in (1, 2, 3):
            ends[first[1:] - k] = True
        cuts = np.concatenate([[0], np.flatnonzero(ends) + 1])
        cuts = cuts[cuts < len(cp)]
        sizes = np.diff(np.concatenate([cuts, [len(cp)]]))
        grams = _grams(literal, N_LITERAL)
        for kind, index, need in (("residue", grams, EVIDENCE), ("missing", grams, 6.0), ("slot", _grams(shape, N_SHAPE), 2.5)):
            llr = self.tables[kind][index].astype(np.int64)
            llr[(literal == 28) | space & (kind == "residue")] = 0
            if kind != "slot":  # signs that are rare anywhere are no evidence
                llr[(literal >= 38) & (llr > 0)] = 0
                llr[1:][(literal[1:] >= 29) & (literal[1:] == literal[:-1]) & (llr[1:] > 0)] = 0  # nor are runs of one
            total = np.cumsum(llr)
            # the best window of each segment: running minimum of the prefix sums, restarted by a fall at each segment
            fall = np.repeat(np.arange(len(cuts), dtype=np.int64) * (1 << 24), sizes)
            before = np.concatenate([[0], total[:-1]]) - fall
            gain = total - fall - np.minimum.accumulate(before)
            best = np.maximum.reduceat(gain, cuts)
            if kind == "slot":
                best[~np.logical_or.reduceat(_OPENS[shape], cuts)] = 0
            for k in np.flatnonzero(best >= need * 20).tolist():
                a, b = int(cuts[k]), int(cuts[k] + sizes[k])
                s, e = a, b
                if kind == "residue":
                    e = a + int(np.argmax(gain[a:b])) + 1
                    s = a + int(np.argmin(np.concatenate([[0], np.cumsum(llr[a : e - 1])]))) if e - a > 1 else a
                t = int(np.searchsorted(first, a, "right")) - 1
                self._judge(kind, whole, a, b, s, e, int(best[k]) / 20, out[t], int(first[t]))
        return out

    def _judge(self, kind: str, whole: str, a: int, b: int, s: int, e: int, evidence: float, found: list, at: int) -> None:
        if kind == "residue":
            segment = whole[a:b].strip()
            visible = len(segment.replace(" ", ""))
            covered = len("".join(whole[s:e].split()))
            longest = max((len(w) for w in segment.split()), default=0)
            if longest > 60 and 2 * longest > visible and not any(c in segment for c in "<{"):
                return  # a long unbroken run
            if visible and covered >= COVERAGE * visible and evidence >= RATE * covered:
                found.append((a - at, b - at, "notice_or_filler"))
        elif kind == "slot":
            for m in SLOT.finditer(whole, a, b):
                if len(_QUOTES.findall(whole, a, m.start())) % 2:
                    continue  # quoted, so spoken of
                if not (_CASED.match(m.group()) and m.group() != m.group().upper()) and not (m.group()[0] == "<" and m.group()[1].isalpha() and m.group().upper() != m.group()):
                    found.append((m.start() - at, m.end() - at, "slot"))
        else:
            marks = [m for m in MISSING_VALUE.finditer(whole, a, b) if self._stands_for_value(whole, a, b, m)]
            if marks:
                found.append((marks[0].start() - at, marks[-1].end() - at, "missing"))

    @staticmethod
    def _stands_for_value(whole: str, a: int, b: int, m: re.Match) -> bool:
        if m.group() in ("NaN", "[object Object]"):
            return True
        before, after = whole[a : m.start()], whole[m.end() : b]
        if m.group() in ("None", "N/A", "nil") and not before.strip():
            return False  # begins a sentence, as the pronoun may
        return bool(_BEFORE.search(before)) and (m.group() != "None" or not after.startswith(" of "))


def fit(prose: DataFrame, key: str, text: str, rows: int = FIT_ROWS) -> ResidueModel:
    """The model with prose counted in all rows, that weigh as ``rows`` rows at most; the second time without what the first calls residue.

    Null and empty texts don't count; repeated rows repeat. Two passes; each task gives its counts, and only their sums, of a number
    that the corpus doesn't change, come to the driver. ``key`` isn't read.
    """
    texts = widened(prose.select(F.col(text).alias("_text")))
    everything = _prose_counts(texts, None)
    return ResidueModel(everything.without(_prose_counts(texts, ResidueModel(everything, rows))), rows)


def _prose_counts(texts: DataFrame, model: ResidueModel | None) -> ProseCounts:
    """The counts of the column of texts; with ``model`` of those in which it finds residue."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, m = ProseCounts(), shared.value
        block: list[str] = []
        size = 0

        def flush() -> None:
            counts.add(block if m is None else [t for t, f in zip(block, m.find(block)) if f])
            block.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    block.append(t)
                    size += len(t)
                    if size > 1 << 20:
                        flush()
                        size = 0
        flush()
        flat = counts.flat()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], names=["gram", "n"])

    got = texts.mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    flat = ProseCounts().flat()
    flat[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return ProseCounts.of_flat(flat)


def find_residue(df: DataFrame, model: ResidueModel, id_columns: list[str], text_column: str) -> DataFrame:
    """``id_columns``, kinds (array of string), n_spans and coverage of every text with residue, one row a text.

    coverage is the share of its characters within residue. Null, empty and blank texts, unusual characters and long
    unbroken runs are no residue. Repeated rows give repeated rows. One pass, no shuffle; the tables sent are 7 MB.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            take: list[int] = []
            cols: tuple[list, list, list] = ([], [], [])
            block: list[int] = []
            size = 0
            for i, t in enumerate(texts):
                if t and not t.isspace():
                    block.append(i)
                    size += len(t)
                if block and (size > 1 << 20 or i == len(texts) - 1):
                    for r, spans in zip(block, m.find([texts[j] for j in block])):
                        if spans:
                            take.append(r)
                            cols[0].append(sorted({k for *_, k in spans}))
                            cols[1].append(len(spans))
                            inside = np.zeros(len(texts[r]), bool)
                            for s, e, _ in spans:
                                inside[max(0, s) : e] = True
                            cols[2].append(float(inside.mean()))
                    block, size = [], 0
            if block:
                raise AssertionError("a block was left")
            rows = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[1:]), pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64())], names=[*batch.schema.names[1:], "kinds", "n_spans", "coverage"])

    ids = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_columns)
    return widened(df.select(text_column, *id_columns)).mapInArrow(scan, f"{ids}, kinds array<string>, n_spans int, coverage double")
