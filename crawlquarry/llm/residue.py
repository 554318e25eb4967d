"""Template residue, filler copy, error and refusal messages, and script notices in place of real content.

Detectors look at a whole body.  (a) Placeholders: one grammar for each kind of delimiter, and notes that something is
still to be filled in.  Delimiters in pairs are scanned over the whole text, across lines and at any length; signs
around one word by patterns.  A hit counts 1; in a comment or prose that explains or quotes it, or inside a code block,
it counts a quarter, unless such hits make up most of the body.  (b) Filler copy: known filler words, keyboard mash and
sentences repeated for length, outside directives; a comment counts if it consists of filler, not if it mentions,
explains or quotes some.  (c) Messages of servers, programs, guards and script checks, outside directives and comments:
phrases of several languages, and sentences in which words of failure (or of switching on) and words of what failed (or
of scripts) make up the density DENSE of all words.  A path or comment that mentions them is no message.

(a) is the method named for the problem; filler and messages have no delimiters, so (b) and (c) are rules of their own.

Defined results: a null or empty body is no case; status and flags are never read, so they can't decide; texts of any
length are looked at whole; rows delivered twice come out once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELD = r"(?:user[-_ ]?agent|dis[-_ ]?allow|allow|site[-_ ]?map|crawl[-_ ]?delay|request[-_ ]?rate|visit[-_ ]?time|host|clean[-_ ]?param|noindex|nofollow|content[-_ ]?signal|cache[-_ ]?delay|indexpage|comment)"
_DIRECTIVE = re.compile(rf"^[\s\W]{{0,6}}{_FIELD}\s*[:：=]", re.I)
_ANY_FIELD = re.compile(r"^\s*[^\W\d][\w -]{2,24}\s*:\s*(?:/|https?://|\*|$)")
_REMARK = re.compile(r"\s#.*")
_UNSEEN = re.compile("[\u00ad\u180e\u200b-\u200f\u2060-\u2064\ufeff]")

#: paired delimiters: opening, closing, what an unfilled placeholder begins with, signs it can't hold
PAIRED: dict[str, tuple[str, str, re.Pattern[str], str]] = {
    "double brace": ("{{", "}}", re.compile(r"[#/^&>!~]?\s*[A-Za-z_$]"), "{}"),
    "brace percent": ("{%", "%}", re.compile(r"-?\s*[A-Za-z_]"), ""),
    "brace hash": ("{#", "#}", re.compile(r"\s*[A-Za-z_][^#]*\s\Z"), ""),
    "dollar brace": ("${", "}", re.compile(r"[A-Za-z_][\w.:\-]*\Z"), "{\n"),
    "dollar paren": ("$(", ")", re.compile(r"[A-Z_][A-Z0-9_]{2,}\Z"), "(\n"),
    "hash brace": ("#{", "}", re.compile(r"[A-Za-z_@][\w.\[\]'\"]*\Z"), "{\n"),
    "server tag": ("<%", "%>", re.compile(r"[=#@!-]?\s*\S"), ""),
    "program tag": ("<?php", "?>", re.compile(r"\s"), ""),
    "echo tag": ("<?=", "?>", re.compile(r"\s*\S"), ""),
    "double bracket": ("[[", "]]", re.compile(r"\s*[A-Za-z_][\w .:\-]+\s*\Z"), "[]\n"),
}
#: delimiters around one word, and spellings of a whole placeholder: the sign that must be there, and the grammar
SINGLE: dict[str, tuple[str, str]] = {
    "open program tag": ("<?php", r"<\?php\b(?![\s\S]*\?>)"),
    "cold tag": ("<cf", r"<cf[a-z]+ "),
    "double percent": ("%%", r"%%[A-Za-z_][\w.\-]+%%"),
    "percent": ("%", r"(?<![\w%])%(?=[A-Z_]*[G-Z_])[A-Z][A-Z_]{3,}%(?![0-9A-Fa-f]{2})"),
    "percent paren": ("%(", r"%\([A-Za-z_]\w*\)[sdif]"),
    "percent letter": ("%", r"(?<=[/=:@. -])%[sd](?=[/?&.\s]|$)(?![^\n]*\b(?:log|print|format)s?\b)"),
    "double at": ("@@", r"@@[A-Za-z_][\w.\-]+@@"),
    "at": ("@", r"(?<![\w.@])@[A-Z][A-Z_]{3,}@"),
    "bracket": ("[", r"(?i:\[(?:your|insert|enter|add|put|type|replace|site|domain|company|website|name of|url of|todo)\b[\w '\-./]*\])"),
    "angle": ("<", r"(?i:<(?:your|insert|enter|add|put|type|replace|site|domain|company|website|name of|url of|the|todo)(?:[ _-][\w'./-]+){1,8}>)"),
    "underscores": ("__", r"(?<![\w])__[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+__(?!\w)|(?<!\w)__[A-Z][A-Z0-9]{2,}__(?!\w)"),
    "numbered brace": ("{", r"(?<=[/=:?&.\- ])\{[0-9]{1,2}\}"),
    "x run": ("XXX", r"\bX{3,}(?:[-_][A-Z0-9]+)*[-_]X{3,}\b|\bX{5,}\b"),
}
_SINGLE = {k: (sign, re.compile(g, re.M)) for k, (sign, g) in SINGLE.items()}
#: single braces around one word: in the value of a directive, or in prose after a word that asks for a name
_SINGLE_BRACE = re.compile(r"(?<=[/=?&.: \-])\{[A-Za-z_][\w.-]*\}")
_PROSE_BRACE = re.compile(r"(?<=[\w,.] )\{[A-Za-z_][\w.-]*\}(?=[\s.,!?;]|$)|(?<=@)\{[A-Za-z_][\w.-]*\}")
_NOTES = re.compile(
    r"replace[-_ ]me\b|change[-_ ]?me\b|\bfill[- ]?(?:me[- ])?in\b(?! the (?:gap|form))|\bto be (?:filled|completed|replaced|added|defined|written)\b|\bTB[DA]\b|\bFIXME\b"
    r"|\b(?:TODO|XXX|HACK)\b\s*[:\-(]?\s*(?:insert|add|fill|replace|write|put|set|update|complete|define|change|enter|provide|remove|check|edit)\b|\bTODO\s*:"
    r"|\binsert\b[^\n]{0,60}\b(?:here|before (?:going live|launch|release|deploy\w*))\b|\byour[-_ ][\w \-]{1,30}[-_ ](?:goes[-_ ])?here\b"
    r"|\b(?:goes|go) here\b|\breplace (?:this|it|the above|with)\b[^\n]{0,40}\b(?:before|with your|launch)\b|\b(?:noch|bitte) (?:auszufüllen|ausfüllen|ersetzen|eintragen)\b|\bà (?:compléter|remplacer|remplir)\b|\bpor (?:completar|rellenar)\b|\b(?:da completare|do uzupełnienia)\b",
    re.I,
)
_NOTE_HINT = re.compile(r"XXX|(?i:todo|fixme|fill|replac|chang|insert|your|\btb[ad]\b|here\b|to be|ausf|ersetz|eintrag|auszu|compl|rempl|rellen|uzupe)")
_EXPLAINS = re.compile(r"`|\"[^\"\n]*\"|'[^'\n]*'|\b(?:e\.g|i\.e|for example|for instance|such as|syntax|placeholders?|templates?|tutorial|documentation|docs|manual|means|stands? for|is replaced|are replaced|replaced by|matches|variables?|escape[ds]?|never|don't|do not|instead of|zum Beispiel|par exemple|por ejemplo)\b", re.I)

# -- filler --------------------------------------------------------------------------------------------------------

_FILLER = re.compile(
    r"\blorem\b[^\n]{0,200}\b(?:ipsum|lorem|dolor)\b|\bipsum\b[^\n]{0,200}\b(?:lorem|dolor|ipsum)\b|\bdolor sit amet\b|\bconsectetu?r adipisc"
    r"|\b(?:sample|dummy|filler|placeholder|test) (?:text|copy|content)\b|\byour text here\b|\bthis is (?:a |some |just |only )?(?:dummy|sample|placeholder|filler|test)\b"
    r"|\b(?:blindtext|beispieltext|platzhalter(?:text)?|faux[- ]texte|texte d'exemple|texto de (?:ejemplo|relleno|prueba)|texto de exemplo|testo segnaposto)\b"
    r"|(?:\b(?:asdf\w*|qwert?y?\w*|zxcv\w*|hjkl|foo|bar|baz|test|blah?|bla)\b[\s,.;]*){4,}",
    re.I,
)
_CLASSIC = re.compile(r"\bdolor sit amet\b|\bconsectetu?r adipisc", re.I)
_KNOWN_FILLER = re.compile(r"\b(?:lorem|ipsum)\b", re.I)
_MASH = re.compile(r"(?:\b(?:asdf\w*|qwert?y?\w*|zxcv\w*|hjkl|foo|bar|baz|test|blah?|bla)\b[\s,.;]*){4,}$", re.I)
_LATIN_END = re.compile(r"(?:[aeiou][smrt]|[aeio])$")
_WORDS = re.compile(r"[^\W\d_]+")

# -- messages ------------------------------------------------------------------------------------------------------

_HTTP = r"(?:not found|gone|forbidden|bad gateway|bad request|unauthori[sz]ed|internal server error|server error|service (?:temporarily )?unavailable|gateway time-?out|request time-?out|too many requests|method not allowed|moved permanently|origin (?:is )?unreachable|server fault)"
_MESSAGES = re.compile(
    r"\b[45]\d\d\b\W{0,12}(?:-\s*)?(?:the [\w ]{0,30})?" + _HTTP + r"|\berror\b\W{0,6}(?:code\W{0,4})?[45]\d\d\b|\b(?:http|status)(?:[ _-]?(?:code|error))?\W{1,4}[45]\d\d\b"
    r"|<(?:title|h[1-6])[^>]*>[^<]{0,60}(?:" + _HTTP + r"|error|oops|maintenance|denied|blocked|just a moment|one moment|attention required|wartung|fehler|erreur|introuvable|nicht gefunden|mantenimiento)"
    r"|\bpage (?:you (?:asked|were looking|requested)|cannot be|can(?:no|')t be|could not be|not found|does ?n.t exist|is missing)\b|\bcould not be (?:shown|displayed|found|reached|loaded)\b"
    r"|\b(?:access|permission|request) (?:was |has been |is )?(?:denied|refused|blocked|rejected|forbidden)\b|\b(?:stopped|blocked|rejected|refused) by (?:the |our |a )?[\w -]{0,30}(?:guard|firewall|filter|security|waf|protection|policy|admin\w*)\b|\brefused (?:this|your|the) (?:address|request|connection|ip)\b|\byou (?:have been|are) (?:blocked|banned|rate[- ]limited)\b|\byour (?:ip|address|request)\b[^\n]{0,60}\b(?:blocked|banned|denied|stopped|rejected|refused)\b"
    r"|\b(?:down|closed|offline|unavailable) for (?:scheduled |planned )?maintenance\b|\bunder (?:scheduled |planned )?maintenance\b|\bmaintenance (?:mode|work|window|in progress)\b|\b(?:is being|are being) (?:upgraded|updated|migrated)\b|\b(?:will )?(?:return|be back) (?:shortly|soon)\b|\btemporarily (?:unavailable|offline|closed|down)\b|\b(?:please )?try (?:again|it again|once more)\b[^\n]{0,20}\b(?:later|minutes?|shortly|soon)\b"
    r"|\bsomething (?:broke|went wrong|is wrong)\b|\b(?:oops|whoops)\b|\b(?:could not|couldn't|unable to|failed to|cannot|can't) (?:connect|establish|reach|open|read|load|allocate|resolve|select)\b|\bconnection (?:refused|timed out|reset|failed)\b|\bupstream (?:timed out|prematurely|connect|sent)\b|\b(?:timed out|timeout) while\b|\bfailed to open stream\b|\bno such file or directory\b"
    r"|\b(?:fatal|parse|syntax|uncaught|unhandled|internal|runtime|database|db|sql) (?:error|exception)\b|\b(?:fatal|warning|notice|deprecated)\b: [\w\\]+(?:\(|:)|\bout of memory\b|\btraceback \(most recent|^\s*File \"[^\"\n]+\", line \d+|^\s*at [\w$.<>]+\([\w.]+(?::\d+)?\)|\bstack ?trace\b|\b(?:exception|error) in thread\b|^\s*[A-Z]\w+(?:Error|Exception)\b\s*:|\b\w+\.\w*(?:Error|Exception)\b"
    r"|[{,]\s*\"(?:error|errors|err|error_?code|exception|fault)\"\s*:|\"(?:status|code|statusCode)\"\s*:\s*\"?[45]\d\d\b|<error\b|<fault\b|<exception\b|<(?:code|message)>[^<]{0,60}(?:" + _HTTP + r"|denied|nosuch|server_?fault|unavailable|forbidden|gone|bad_?gateway|not_?found)"
    r"|seite (?:wurde )?nicht gefunden|\bgibt es (?:auf [^\n]{1,80} )?nicht mehr\b|zugriff (?:verweigert|gesperrt)|wartungsarbeiten|\bwegen wartung\b|vor.{1,4}bergehend nicht (?:erreichbar|verf)|sp.{1,4}ter (?:noch einmal|erneut|nochmals?)|interner (?:server)?fehler|ein fehler ist aufgetreten"
    r"|page introuvable|page non trouv|a .{1,4}t.{1,4} d.{1,4}plac.{1,4}(?!\w)|acc.{1,4}s (?:refus|interdit)|en cours de maintenance|pour maintenance|erreur (?:interne|\d{3})|r.{1,4}essayez|momentan.{1,4}ment indisponible|temporairement indisponible|n'existe (?:plus|pas)"
    r"|p.{1,4}gina (?:ya )?no (?:existe|encontrad|disponible)|acceso (?:denegado|prohibido)|en mantenimiento|error interno|no (?:se )?(?:encontr|pudo)|int.{1,4}ntelo|temporalmente (?:no disponible|fuera)"
    r"|p.{1,4}gina n.{1,4}o (?:encontrada|existe)|acesso (?:negado|proibido)|em manuten|tente (?:novamente|mais tarde)|pagina (?:non trovata|inesistente)|accesso negato|in manutenzione|riprova (?:pi|tra)|pagina niet gevonden|toegang geweigerd|wegens onderhoud|probeer het later"
    r"|strona (?:chwilowo |tymczasowo )?(?:niedost|nie (?:istnieje|zosta))|nie znaleziono|dost.{1,4}p (?:zabroniony|zablokowany)|spr.{1,4}buj p.{1,4}niej|przerwa techniczna|str.{1,4}nka (?:nebyla )?nenalezena|p.{1,5}stup (?:odep|zam)|zkuste to (?:pros.{1,4}m )?pozd|sidan (?:hittades inte|kunde inte|finns inte)|.{1,4}tkomst nekad|siden (?:blev ikke fundet|finnes ikke)"
    r"|страница не (?:найдена|существует)|доступ (?:запрещ|закрыт|огранич)|технические работы|попробуйте (?:позже|ещё|еще)|временно недоступ|ошибка (?:сервера|\d{3})|η σελίδα δεν|ページが見つかり|アクセスが拒否|メンテナンス|页面不存在|访问被拒绝|維護|维护",
    re.I | re.M,
)
_SCRIPTS = re.compile(
    r"<noscript\b|\b(?:enable|activate|allow|turn on|switch on|need|needs|requires?|without|disabled?|unsupported)\b[^\n<]{0,40}\b(?:javascript|scripts?|scripting|js|cookies)\b|\b(?:javascript|scripts?|scripting|js|cookies)\b[^\n<]{0,40}\b(?:enabled?|activated?|required|needed|disabled?|turned o[nf]+|switched o[nf]+|switched off|must be|blocked|is off)\b"
    r"|\bbrowser (?:can|to|must|cannot|should|does not|doesn't)\b[^\n<]{0,40}\b(?:javascript|scripts?)\b|\b(?:checking|verifying)\b[^\n<]{0,30}\b(?:browser|human|robot|connection)\b|\b(?:one|just a) moment\b|\b(?:verify|prove|confirm)\b[^\n<]{0,20}\byou(?:'re| are) (?:a )?(?:human|not a (?:robot|bot))\b|\bcomplete the captcha\b"
    r"|\b(?:aktivieren|ben.{1,4}tigt?|erforder\w+|ohne|einschalten)\b[^\n<]{0,40}\bjavascript\b|\bjavascript\b[^\n<]{0,40}\b(?:aktivier|erforderlich|ben.{1,4}tigt|einschalten|deaktiviert)\w*|\b(?:activez|activer|sans|n.{1,4}cessite|requiert|d.{1,4}sactiv)\w*[^\n<]{0,40}\bjavascript\b|\b(?:requiere|habilite|active|activar|ejecute|sin|necesita)\b[^\n<]{0,50}\b(?:javascript|scripts?)\b"
    r"|\b(?:ative|habilite|precisa|requer|sem)\b[^\n<]{0,40}\bjavascript\b|\b(?:abilita|attiva|richiede|senza)\w*[^\n<]{0,40}\bjavascript\b|\b(?:w.{1,4}cz|wymaga|bez)\w*[^\n<]{0,40}\bjavascript\w*|\b(?:zapn|povol|vy.{1,4}aduje)\w*[^\n<]{0,40}\bjavascript\w*|\b(?:aktivera|kr.{1,4}ver)\b[^\n<]{0,40}\bjavascript\b|включите\s+javascript|javascript\s*を有効|启用\s*javascript",
    re.I,
)
# beginnings of words (fixed values): of failure or refusal, of what fails; of switching on, of scripts; of robots rules
_FAILS = re.compile(r"\b(?:error|errno|fail|den(?:ied|y)|refus|reject|forbid|block|unavailable|unreachable|invalid|missing|broken|crash|abort|expired|exceed|timeout|timed|sorry|oops|nothing|no|not|cannot|can't|couldn't|unable|never|gone|lost|down|closed|offline|fehl|verweiger|gesperrt|nicht|kein\w*|leider|tut uns leid|erreur|échec|refusé|introuvable|désolé|impossible|aucun\w*|rien|no|error|fallo|denegad|lo sentimos|imposible|ning\w+|nada|erro|negad|desculp|errore|negat|spiacent|nessun\w*|błąd|nie|brak|przepraszamy|ошибк|нет|извините|невозможно|запрещ)", re.I)
_THINGS = re.compile(r"\b(?:server|page|site|website|request|address|connection|database|access|resource|host|service|document|gateway|session|permission|memory|disk|process|file|url|seite|adresse|anfrage|verbindung|datenbank|zugriff|dienst|dokument|serveur|adresse|requête|connexion|base de données|accès|ressource|fichier|página|pagina|sitio|servidor|solicitud|dirección|conexión|acceso|recurso|servizio|richiesta|strona|serwer|adres|połączenie|страниц|сервер|сайт|доступ|запрос|адрес)", re.I)
_SWITCHES = re.compile(r"\b(?:enabl|activat|allow|turn|switch|need|requir|disabl|support|run|aktivier|einschalt|schalten|zulassen|erlaub|benötig|brauch|activ|autoris|nécessit|requier|habilit|permit|necesit|ativ|precis|abilit|attiv|richied|włącz|wymag|zapn|povol|aktiver|включ|разреш)", re.I)
_SCRIPTING = re.compile(r"\b(?:javascript|scripts?|scripting|skript\w*|js|cookies?|скрипт\w*)\b", re.I)
_OF_ROBOTS = re.compile(r"\b(?:crawl\w*|robots?|bots?|spiders?|index\w*|disallow\w*|sitemaps?|user-?agents?|rules?|allow)\b", re.I)
#: part of a sentence's words that cues have to make up
DENSE = 0.3
_TAG = re.compile(r"<[^>]*>")
_SENTENCE = re.compile(r"[.!?;]+(?:\s|$)|\n")


def dense_kind(body: str) -> str | None:
    """`message` or `script notice` if a sentence of the body is dense in both kinds of cues, and none of robots rules."""
    for part in _SENTENCE.split(_TAG.sub("\n", body)):
        words = len(_WORDS.findall(part))
        if not 3 <= words <= 40 or _OF_ROBOTS.search(part):
            continue
        scripts, things = len(_SCRIPTING.findall(part)), len(_THINGS.findall(part))
        if scripts and (n := len(_SWITCHES.findall(part))) and n + scripts >= DENSE * words:
            return "script notice"
        if things and (n := len(_FAILS.findall(part))) and n + things >= DENSE * words:
            return "message"
    return None


KINDS = ("placeholder", "filler", "message", "script notice")


def _is_filler(line: str) -> bool:
    if _FILLER.search(line):
        return True
    words = _WORDS.findall(re.sub(r"\b\w*\d\w*\b|\b[a-z]{3,7}$", "", line.lower()))  # without a trailing reference
    if len(words) < 6 or "<" in line or ":" in line or not line.isascii() or any(w in _COMMON for w in words):
        return False
    if len(words) >= 10 and len(set(words)) <= 0.72 * len(words):
        return True
    return all(len(w) > 3 for w in words) and sum(bool(_LATIN_END.search(w)) for w in words) >= 0.8 * len(words)


def _is_filler_comment(text: str) -> bool:
    """Does a comment consist of filler?  One with ordinary words, a path or quotes only mentions it."""
    if _EXPLAINS.search(text):
        return False
    if _CLASSIC.search(text):
        return True
    words = _WORDS.findall(text.lower())
    if len(words) < 4 or "/" in text or any(w in _COMMON for w in words):
        return False
    if _MASH.match(text):
        return True
    return len(words) >= (4 if _KNOWN_FILLER.search(text) else 8) and _is_made_up(words)


def _is_made_up(words: list[str]) -> bool:
    body = words[:-1] if len(words) > 4 and len(words[-1]) <= 7 else words  # without a trailing reference
    return all(len(w) > 3 for w in body) and sum(bool(_LATIN_END.search(w)) for w in body) >= 0.8 * len(body)


#: words of ordinary prose: made-up filler has none of them
_COMMON = frozenset("the and of to in is are was for on with that this not you your we our it be as at by or an from if der die das und ist nicht für mit von zu auf le la les des est pas pour dans une un et el los las que del una con para por es o a do na nie jest się".split())


def placeholders(text: str) -> list[tuple[int, str]]:
    """(place, grammar) of the unfilled placeholders of a text, whatever stands around them."""
    out: list[tuple[int, str]] = []
    for name, (opening, closing, begins, banned) in PAIRED.items():
        at = text.find(opening)
        while at >= 0:
            start = at + len(opening)
            end = text.find(closing, start)
            if end < 0:
                break
            again = text.rfind(opening, start, end)  # the innermost opening counts
            if again >= 0:
                at, start = again, again + len(opening)
            inner = text[start:end]
            if begins.match(inner) and not any(c in inner for c in banned):
                out.append((at, name))
            at = text.find(opening, end + len(closing) if not banned else start)
    for name, (sign, grammar) in _SINGLE.items():
        if sign in text:
            out.extend((m.start(), name) for m in grammar.finditer(text))
    return out


def marked_lines(text: str) -> list[tuple[str, str, bool, int, bool]]:
    """(line, kind, fenced, hits, note) of the non-blank lines: kind is comment, directive or foreign; hits are
    placeholders that begin in the line, note tells that something is still to be filled in."""
    out = []
    hits = sorted(p for p, _ in placeholders(text))
    fenced, nth, at = False, 0, 0
    for line in _LINE.findall(text):
        end = at + len(line)
        found = nth
        while nth < len(hits) and hits[nth] < end:
            nth += 1
        found = nth - found
        at = end
        bare = line.strip("\ufeff\ufffd \t\r\n")
        if not bare:
            continue
        comment = bare[0] == "#" and not bare.startswith("#{")
        directive = not comment and bool(_DIRECTIVE.match(bare) or _ANY_FIELD.match(bare))
        if bare.startswith("```") or bare.startswith("~~~"):
            fenced = not fenced
            continue
        if not found and "{" in bare:
            found = len((_SINGLE_BRACE if directive else _PROSE_BRACE).findall(bare))
        note = False
        if _NOTE_HINT.search(bare):
            value = bare.split("#", 1)[0] if directive else bare
            note = bool(_NOTES.search(value if directive and value.strip() else bare))
            if directive and note and not found and value.split(":", 1)[-1].strip().startswith(("/", "*")):
                note = False  # a path that happens to be called so
        out.append((bare, "comment" if comment else "directive" if directive else "foreign", fenced, found, note))
    return out


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")


def readable(text: str) -> str:
    """A body without NUL and invisible characters, compatibility forms folded."""
    if "\x00" in text:
        text = text.replace("\x00", "")
    return text if text.isascii() else _UNSEEN.sub("", unicodedata.normalize("NFKC", text))


def placeholder_weight(lines: list[tuple[str, str, bool, int, bool]]) -> tuple[int, int, float]:
    """(counted in full, discounted, weight): discounted hits count only if they make up most of the body."""
    full = discounted = 0
    for bare, kind, fenced, hits, note in lines:
        if hits or note:
            if fenced or kind == "comment" and hits and _EXPLAINS.search(bare):
                discounted += 1
            else:
                full += 1
    weight = float(full)
    if discounted >= 4 and discounted > len(lines) / 2:
        weight += discounted / 4
    return full, discounted, weight


def residue_kinds(text: str | None) -> list[str]:
    """The kinds of residue in a body, in the order of KINDS; none for a null or empty body."""
    if not text:
        return []
    lines = marked_lines(readable(text))
    found: set[str] = set()
    if placeholder_weight(lines)[2] >= 1:
        found.add("placeholder")
    foreign: list[str] = []
    for bare, kind, fenced, _, _ in lines:
        if fenced:
            continue
        if kind == "foreign":
            foreign.append(bare)
        elif "#" in bare:
            remark = bare if kind == "comment" else (_REMARK.search(bare) or [""])[0]
            if _is_filler_comment(remark.strip("# \t")):
                found.add("filler")
    if foreign:
        body = "\n".join(foreign)
        if any(_is_filler(x) for x in foreign):
            found.add("filler")
        if _MESSAGES.search(body):
            found.add("message")
        if _SCRIPTS.search(body):
            found.add("script notice")
        if not found:
            found.update(filter(None, [dense_kind(body)]))
    return [k for k in KINDS if k in found]


_SCHEMA = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("kinds", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for src, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            kinds = residue_kinds(text)
            if kinds:
                for c, v in zip(out, (src, row, ",".join(kinds))):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _SCHEMA)], schema=_SCHEMA)


_WEIGHTS = pa.schema([("src", pa.string()), ("row_id", pa.int64()), ("n_full", pa.int32()), ("n_discounted", pa.int32()), ("weight", pa.float64()), ("grammars", pa.list_(pa.string()))])


def placeholder_rows(bodies: DataFrame) -> DataFrame:
    """src, row_id, n_full, n_discounted, weight, grammars: the method alone, for every body with a placeholder or note."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for src, row, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = readable(text)
                full, discounted, weight = placeholder_weight(marked_lines(text))
                if full or discounted:
                    out.append((src, row, full, discounted, weight, sorted({name for _, name in placeholders(text)})))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(_WEIGHTS)], schema=_WEIGHTS)

    return bodies.where("body is not null and body <> ''").mapInArrow(work, "src string, row_id long, n_full int, n_discounted int, weight double, grammars array<string>").distinct()


def bodies_of(fetches: DataFrame, snapshots: DataFrame) -> DataFrame:
    return fetches.select(F.lit("fetches").alias("src"), F.col("fetch_id").cast("long").alias("row_id"), F.col("text").alias("body")).unionByName(
        snapshots.select(F.lit("site_snapshots").alias("src"), F.col("snap_id").cast("long").alias("row_id"), F.col("robots_txt").alias("body"))
    )


def residue_rows(bodies: DataFrame) -> DataFrame:
    """src, row_id, kinds of the bodies (src, row_id, body) that are or hold residue, each row once."""
    return bodies.where("body is not null and body <> ''").mapInArrow(_scan, "src string, row_id long, kinds string").distinct()


def without_residue(bodies: DataFrame) -> DataFrame:
    """The bodies that remain: every row (null and empty ones too) that isn't residue."""
    return bodies.join(residue_rows(bodies).select("src", "row_id"), ["src", "row_id"], "left_anti")
