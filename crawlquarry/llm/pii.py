"""Personal information inside free text, by information-theoretic sanitisation.

Protected entities with a grammar of their own (mailboxes, telephone numbers, identity numbers, street addresses) are
found first.  Names have no grammar: which terms are names is estimated from the whole corpus.

1. Co-occurrence with mailboxes: a term discloses a person if it stands in the same texts as mailboxes that carry it,
   far more often than chance: pointwise mutual information log2(n_both x N / (n_term x n_mailbox)), at least
   MAIL_BITS over at least MIN_TEXTS texts.  A pair of terms whose mailbox in the same text is built of both (or of
   one and the initial of the other) needs no second text: two terms don't meet in a mailbox by chance.
2. Co-occurrence with contexts: each context of a pair of capitalised words (or of an initial and one) gets the odds
   that a pair in it consists of disclosing terms, against the overall odds.  Contexts of a class (after a title, a
   closing formula, a label for persons, a preposition of authorship; before a verb of persons or a mailbox) start
   from PRIOR_BITS of evidence, all others from none; what the corpus shows outweighs the start from PRIOR_WEIGHT
   places on.  A pair takes the overall odds plus the evidence on its two sides, averaged over its places; from
   CONTEXT_ODDS bits on its terms disclose, if two different contexts or one of a class say so clearly (STRONG_ODDS).
   A pair that mostly continues an earlier one teaches nothing, nor does a term of which
   less than TERM_SHARE of all places look like a person; terms that the corpus writes in small letters more often than as part of a pair are ordinary words.
   CONTEXT_ROUNDS rounds.
3. A name is a given name or an initial with a family name, in any order: two disclosing terms side by side (particles,
   a middle initial or a comma between them), or an initial and a disclosing term.
4. Entities become typed placeholders; lone terms above the threshold are generalised too, the rest stays as it is.

All counts run over all texts.  A bit table of fixed size (TABLE_BITS) tells the words of a text that may disclose; the
runs of such words are confirmed by a join with the terms, at every size, and names are formed of confirmed terms only.

Defined results: null and empty texts hold nothing; without mailboxes and classed contexts there are no names; ties and
repeated texts count as they come (a text under two ids counts twice); texts of any length are read whole; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
MAIL_BITS = 1.0
MIN_TEXTS = 2
CONTEXT_ODDS = 3.5
#: so clearly has a context to speak; of contexts without a class two have to
STRONG_ODDS = 6.0
CLASS_ODDS = 2.0
STRONG_CONTEXTS = 2
CONTEXT_ROUNDS = 3
#: part of a term's places that has to look like a person, on average
TERM_SHARE = 0.25
#: a context counts as if seen so often at the overall rate (of its class), too
PRIOR_WEIGHT = 4.0
#: log odds of a pair of capitalised words before anything is known of the corpus
BASE_BITS = -6.0
TABLE_BITS = 1 << 24

#: full-width signs and odd spaces, each to one ordinary character: positions stay
_FLAT = {o: o - 0xFEE0 for o in range(0xFF01, 0xFF5F)} | {0xA0: 32, 0x2007: 32, 0x2009: 32, 0x202F: 32, 0x3000: 32, 0x2010: 45, 0x2011: 45, 0x2012: 45, 0x2013: 45, 0x2212: 45}

_ODD = re.compile("[" + "".join(map(chr, _FLAT)) + "]")

# -- entities with a grammar ---------------------------------------------------------------------------------------

_LABEL = r"[A-Za-z0-9\u00c0-\u024f](?:[A-Za-z0-9\u00c0-\u024f-]*[A-Za-z0-9\u00c0-\u024f])?"
_AT = r"(?:\s*[(\[{<]\s*(?:at|AT|At|@|ät|arroba|chez)\s*[)\]}>]\s*|\s+(?:AT|at|arroba|\(a\))\s+|_AT_|_at_|\s+@\s+|&#64;|&commat;|%40(?=[a-z]))"
_DOT = r"(?:\s*[(\[{<]\s*(?:dot|DOT|Dot|punkt|punto|point|\.)\s*[)\]}>]\s*|\s+(?:DOT|dot|punkt|punto)\s+|_DOT_|_dot_)"
_TLD = r"[A-Za-z\u00c0-\u024f]{2,24}"
EMAIL = re.compile(
    rf"(?<![\w.+%@-])(?P<local>[A-Za-z0-9\u00c0-\u024f](?>[\w.+'-]*))(?<=[\w+])"
    rf"(?:@(?:{_LABEL}(?:\.|{_DOT}))+{_TLD}|{_AT}(?:{_LABEL}(?:\.|{_DOT}))+{_TLD})(?![\w@])"
)

_PHONE_CALLED = r"(?:tel(?:\.|efon|éfono|efono|efoon|ephone)?|tél(?:\.|éphone)?|phone|call|ring|rang|mobile?|mob\.|fax|cell|handy|llame al|appeler le|reach (?:me|us) (?:at|on)|dial)"
PHONE = re.compile(
    r"(?<![\w+./-])(?:tel:)?(?:"
    r"\+\d{1,3}(?:[ .\-/]?\(0?\d{0,4}\)|[ .\-/]?\d){7,16}"
    r"|00[ -]?[1-9]\d{0,2}(?:[ .\-/]\(?\d{1,5}\)?){2,7}(?!\d)"
    r"|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}"
    r"|\(0\d{2,5}\)[ /-]?\d{3,4}[ -]?\d{2,5}(?:[ -]\d{2,4})?"
    r"|0\d(?:[ .]\d{2}){4}"
    r"|0\d{3,4}[ -]\d{3}[ -]\d{3,4}|0\d{4}[ -]\d{5,6}|0\d{2}[ -]\d{4}[ -]\d{4}"
    r"|0\d{2,4}[/-]\d{4,8}(?:-\d{1,4})?"
    r")(?:\s?(?:ext|extension|x|Durchwahl|poste)\.? ?\d{1,5})?(?![\w/]|[.-]\d)",
    re.I,
)
#: any number behind a word for calling
_LOOSE_NUMBER = re.compile(r"(?<![\w.])\+?\(?\d[\d ().\-/]{6,20}\d(?![\w/])")
_CALLED = re.compile(rf"\b{_PHONE_CALLED}\s*[:.]?\s+$", re.I)
_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}")

_ID_WORDS = re.compile(
    r"\b(?:SSN|social security|national insurance|NINO?|passport|Reisepass|Pass(?:nummer|-Nr)|Ausweis|DNI|NIE|NIF|PESEL|Steuer-?(?:ID|nummer)|tax (?:id|number)|TIN|sécurité sociale|NIR|pièce d.identité|documento de identidad|identity|identité|identidad|ID (?:number|no|card)|personal number|personnummer|codice fiscale|BSN|SIN|Sozialversicherung\w*|rodné číslo|паспорт|ИНН|СНИЛС)\b",
    re.I,
)
#: a label behind the number, in the same sentence
_ID_AFTER = re.compile(r"[^.\n]{0,24}\b(?:proof of identity|identity|Ausweis|identité|identidad)\b(?![^.\n]{0,24}[:#\d])", re.I)
_NOT_ID = re.compile(r"\b(?:serial|export(?:ación)?|counters?|hash|ticket|build|version|order|invoice|tracking|isbn|ean|sku|part|batch|request|session)\b[\s:#.]*$", re.I)
ID_NUMBER = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?P<ssn>\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4})"
    r"|(?P<nino>[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])"
    r"|(?P<dni>(?:\d{8}|[XYZ]-?\d{7})-?[A-Z])"
    r"|(?P<nir>[12] \d{2} \d{2} \d[\dAB] \d{3} \d{3}(?: \d{2})?|[12]\d{4}\d[\dAB]\d{8})"
    r"|(?P<steuer>\d{2} \d{3} \d{3} \d{3})"
    r"|(?P<eleven>\d{11})"
    r"|(?P<pass>[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{7}\d)"
    r"|(?P<any>[A-Z]{0,3}\d{6,12}[A-Z]?)"
    r")(?![\w/]|[.-]\w)"
)


def _digits_ok(kind: str, s: str) -> bool:
    """Check digits, where the kind has some."""
    d = re.sub(r"\D", "", s)
    if kind == "dni":
        number = d if s[0].isdigit() else "XYZ".index(s[0]).__str__() + d
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == s[-1]
    if kind == "eleven":
        pesel = (10 - sum(int(a) * b for a, b in zip(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) % 10) % 10 == int(d[10])
        return pesel or _iso7064(d)
    if kind == "nir" and len(d) == 15:
        return True if " " in s else 97 - int(d[:13]) % 97 == int(d[13:])
    return True


def _iso7064(d: str) -> bool:
    p = 10
    for c in d[:10]:
        q = (int(c) + p) % 10 or 10
        p = q * 2 % 11
    return (11 - p) % 10 == int(d[10])


#: fixed words for kinds of streets
_TYPE_EN = r"(?:Road|Rd|Street|St|Avenue|Ave|Boulevard|Blvd|Court|Ct|Close|Lane|Ln|Drive|Dr|Way|Terrace|Place|Pl|Square|Sq|Gardens|Crescent|Row|Walk|Mews|Hill|Parade|Parkway|Pkwy|Highway|Hwy|Quay|Grove|Circle|Trail|Alley)"
_ENDINGS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig", "pfad", "chaussee", "straat", "laan", "gracht", "plein", "gatan", "vägen", "gade", "vej", "gata", "veien")
_APART = frozenset("straße strasse str. weg gasse platz allee ring damm ufer straat laan utca út tér caddesi sokak cad. sok.".split())
_BEFORE = frozenset("calle avda. avda avenida plaza pza. pza paseo p.º camino ronda travesía rua praça via viale piazza corso largo ul. al. pl. os. ulica aleja jl. jalan ул. пр. просп. пер. бул. наб. улица проспект".split())
_LINKS = frozenset("del de la las los el da do dos di della dello degli der den van".split())
_W = r"[^\W\d_][\w'\u2019.-]*"
_NUMBER_FIRST = re.compile(
    rf"\d{{1,5}}(?:[a-z]|-\d{{1,4}})?\s(?:(?:[NSEW]|North|South|East|West)\.?\s)?(?-i:(?:[^\W\d_a-z](?:\w{{0,2}}\.|[\w'\u2019-]*)\s){{1,4}}){_TYPE_EN}\b\.?(?!\s+(?:edition|\d))(?:,?\s(?:Apt|Suite|Unit|Flat|#)\.?\s?\w{{1,5}})?"
    rf"|\d{{1,4}}\s?(?:bis|ter|quater|[a-d]\b)?,?\s(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|impasse|allée|quai|cours|route|passage|square)\s(?:(?:de|du|des|la|le|les|l'|d')\s?){{0,3}}{_W}(?:\s(?-i:[^\W\d_a-z]){_W}){{0,3}}",
    re.I,
)
_BEHIND = re.compile(r"\d{1,4}(?:[a-z]|\s[a-h])?\b(?!\s*(?:Sekunden|seconds|%|times))(?:\s?[/m.]+\s?\d{1,4}\b)?(?:,?\s\d{1,2}[ºª°]\s?[A-Z]?)?", re.I)
_HOUSE = re.compile(r"(?<!\w)\d{1,5}(?!\d)")
_NOT_HOUSE = re.compile(r"\b(?:section|chapter|page|line|lane|hall|row|rack|run|week|version|build|figure|table|no\.?)\s$", re.I)


def _street_before(flat: str, at: int) -> int | None:
    """Where the street of a house number at a place begins, if its name stands before the number."""
    line = flat.rfind("\n", 0, at) + 1
    end = at - 1 if flat[at - 1] == " " else at
    start = flat.rfind(" ", line, end) + 1 or line
    word = flat[start:end]
    if word.lower() in ("nº", "n.º", "nº.", "д.", "no.", "nr.", "nr"):
        end = start - 1
        start = flat.rfind(" ", line, max(line, end)) + 1 or line
        word = flat[start:end]
    word = word.lstrip("([\"'")
    start = end - len(word)
    if not word or not (word[0].isalpha() or word[0] == "/"):
        return None
    low = word.lower()
    if word[0].isupper() and low.endswith(_ENDINGS) and len(word) > 4 and low not in _APART:
        return start
    if low in _APART:
        before = flat[flat.rfind(" ", line, max(line, start - 1)) + 1 or line : max(line, start - 1)].lstrip("([\"'")
        return start - 1 - len(before) if before[:1].isupper() and before.isalpha() else None
    # Calle de la Luna, 12: a kind of street, links, and a name of at most five capitalised words
    names = 0
    while True:
        bare = word.rstrip(",").lstrip("([\"'")
        low = bare.lower()
        if bare[:2].lower() == "c/":
            return end - len(word) + (len(word) - len(word.lstrip("([\"'"))) if names or len(bare) > 2 else None
        if low in _BEFORE:
            return end - len(word.lstrip("([\"'")) if names else None
        if names and word.endswith(",") or not bare or not bare[0].isalpha():
            return None
        if bare[0].isupper():
            names += 1
        elif low not in _LINKS:
            return None
        if names > 5 or start <= line:
            return None
        end = start - 1
        start = flat.rfind(" ", line, end) + 1 or line
        word = flat[start:end]


def addresses(flat: str) -> Iterator[tuple[int, int]]:
    """Streets with a house number, looked for around each short number."""
    done = 0
    for m in _HOUSE.finditer(flat):
        a, b = m.span()
        if a < done:
            continue
        before = flat[a - 1] if a else "\n"
        follows = flat[b : b + 1]
        if before not in ".,/:#-" and follows and follows in " ,abcdefghijklmnopqrstuvwxyz-":
            found = _NUMBER_FIRST.match(flat, a)
            if found and not _NOT_HOUSE.search(flat, max(0, a - 12), a):
                done = found.end()
                yield a, done
                continue
        if before == " " and b - a < 5 and (flat[a - 2].isalpha() or flat[a - 2] in ".,º"):
            start = _street_before(flat, a)
            found = start is not None and _BEHIND.match(flat, a)
            if found:
                done = found.end()
                yield start, done


# -- words and folding ---------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*")
_CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґў", "a b v g d e e zh z i i k l m n o p r s t u f h ts ch sh sch - y - e yu ya i i e g u".split()))
_SPECIAL = {"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"}
_SOUND = ((re.compile("w"), "v"), (re.compile("z"), "s"), (re.compile("ck|k|q"), "k"), (re.compile("ph"), "f"), (re.compile("y|j"), "i"), (re.compile(r"(.)\1+"), r"\1"))
#: shorter words carry too few letters to be told from particles and abbreviations
SHORTEST = 2
_PARTICLES = frozenset("van von der den de del della di da dos du la le ter ten zu zur bin al el".split())


@functools.lru_cache(maxsize=300_000)
def fold(word: str) -> str:
    """Letters of a word without marks, case and script: the form that terms and mailboxes are compared in."""
    low = unicodedata.normalize("NFKD", word.casefold())
    out = []
    for c in low:
        if c.isalpha():
            out.append(_CYRILLIC.get(c) or _SPECIAL.get(c, c))
    s = "".join(out).replace("-", "")
    for pattern, to in _SOUND:
        s = pattern.sub(to, s)
    return s


def mailbox_pieces(local: str) -> set[str]:
    """Folded parts of a local part that may be names; behind or before one letter the rest as well."""
    out = set()
    for part in re.split(r"[^\w]|[_\d]+", local.split("+", 1)[0]):
        f = fold(part)
        if len(f) >= SHORTEST:
            out.add(f)
            if len(part) >= 5:
                out.add(fold(part[1:]))
    return out


def mailboxes(flat: str) -> Iterator[re.Match]:
    """Mailboxes of a flattened text, spelled out or hidden from harvesters."""
    return EMAIL.finditer(flat) if "@" in flat or _MAYBE_AT.search(flat) else iter(())


def _flat(text: str) -> str:
    return text if text.isascii() or not _ODD.search(text) else text.translate(_FLAT)


#: runs of the signs that identity numbers, and telephone numbers behind their first sign, are made of
_ID_RUN = re.compile(r"[\dA-Z][\dA-Z -]{5,}")
_DIGIT_RUN = re.compile(r"\d[\d ().\-/]{5,}")


def _inside(pattern: re.Pattern[str], flat: str, runs: re.Pattern[str], beyond: int) -> Iterator[re.Match]:
    """What pattern.finditer finds, looked for in runs of its signs only; `beyond` signs behind a run may belong to it."""
    done = 0
    for run in runs.finditer(flat):
        a, b = run.span()
        while a and flat[a - 1] in "+(:ltTLeE":
            a -= 1  # tel:+(
        a = max(a, done)
        while m := pattern.search(flat, a, b + beyond):
            if m.start() >= b:
                break
            yield m
            a = done = m.end()


def grammar_spans(text: str) -> list[tuple[int, int, str]]:
    """Entities with a grammar: (start, end, kind), without overlap; mailboxes go before numbers, numbers before addresses."""
    flat = _flat(text)
    taken: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in taken)

    taken.extend((*m.span(), "email") for m in mailboxes(flat))
    if _HAS_DIGIT.search(flat):
        for m in _inside(ID_NUMBER, flat, _ID_RUN, 2):
            kind = m.lastgroup
            a, b = m.span()
            if not free(a, b):
                continue
            before, after = flat[max(0, a - 48) : a], flat[b : b + 40]
            near = re.split(r"[.;\n](?=\s)", before)[-1] if not re.search(r"\bno\.\W*$", before) else before
            labelled = bool(_ID_WORDS.search(near) or _ID_AFTER.match(after))
            if _NOT_ID.search(before) and not labelled:
                continue
            if labelled or kind in ("ssn", "nino", "steuer", "nir", "pass", "dni", "eleven") and _digits_ok(kind, m.group()):
                if kind == "pass" and not labelled and not re.search(r"\d.*[A-Z]|[A-Z].*\d", m.group()[1:8] + "0A"):
                    continue
                taken.append((a, b, "id_number"))
        for m in _inside(PHONE, flat, _DIGIT_RUN, 24):
            digits = sum(c.isdigit() for c in m.group())
            if 7 <= digits <= 20 and free(*m.span()):
                taken.append((*m.span(), "phone"))
        for m in _inside(_LOOSE_NUMBER, flat, _DIGIT_RUN, 1):
            a, b = m.span()
            if _CALLED.search(flat, max(0, a - 24), a) and 7 <= sum(c.isdigit() for c in m.group()) <= 15 and free(a, b) and not _DATE.search(m.group()):
                taken.append((a, b, "phone"))
        taken.extend((a, b, "address") for a, b in addresses(flat) if free(a, b))
    return sorted(taken)


#: every form of _AT without a plain @ holds one of these; the word alone needs a host name behind it
_MAYBE_AT = re.compile(
    rf"\s(?:AT|at)\s+{_LABEL}(?:\.|{_DOT})|[(\[{{<]\s*(?:at|AT|At|ät|chez)\s*[)\]}}>]|arroba|\(a\)|_AT_|_at_|&#64;|&commat;|%40"
)
_HAS_DIGIT = re.compile(r"\d")

# -- candidate pairs and their contexts ----------------------------------------------------------------------------

_NAME = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_PARTICLE = "|".join(sorted(_PARTICLES))
#: a word that begins like a name: a capital (or a letter without case), or a clipped article before one (d'Orvane)
_FIRST = re.compile(rf"\b(?:[^\W\d_a-z]|[a-z]{{1,2}}['’](?=[^\W\d_a-z]))[^\W\d_]*(?:['’-][^\W\d_]+)*(?=\. |,? (?:[^\W\d_a-z]|[a-z]{{1,2}}['’]|(?:{_PARTICLE}) ))")
_SECOND = re.compile(rf"(?:, | )((?:(?:(?i:{_PARTICLE})|[^\W\d_a-z]\.) )*)({_NAME})")
_SMALL = re.compile(r"\b[a-zß-ÿ][^\W\d_]+")

# cues of persons, common words of several languages (fixed values)
_TITLES = frozenset("dr prof mr mrs ms mx sir madam herr frau dipl ing mag monsieur madame mme mlle m sr sra srta señor señora dra don doña sig dott pan pani pán paní г госпожа господин".split())
_CLOSINGS = frozenset("regards sincerely cheers thanks thank greetings wishes yours grüße grüsse grüßen gruß gruss dank cordialement salutations bises merci saludos atentamente gracias abrazo saluti grazie cumprimentos abraços groeten groetjes hälsningar hilsen pozdrawiam pozdrowienia pozdravem уважением".split())
_LABELS = frozenset("owner author reviewer contact name editor maintainer manager responsible assignee approver signed sender from zuständig verantwortlich ansprechpartner autor name bearbeiter responsable auteur contacto autora titular contatto autore kontakt osoba автор ответственный".split())
_AUTHORS = frozenset("by ask asked told according to with from von laut mit par selon avec por según con da secondo przez od от".split())
_DEEDS = frozenset("approved said says wrote writes asked asks told replied reviewed signed confirmed reported noted thinks will has hat sagt schrieb meint bittet a dit écrit demande validé aprobó dijo escribió pidió ha scritto disse napisał they he she".split())
#: classes of contexts (<run>: the pair continues an earlier one) -> bits of evidence that they start from
PRIOR_BITS = {"<run>": -3.0, "<title>": 9.0, "<closing>": 7.0, "<label>": 6.0, "<author>": 4.0, "<deed>": 4.0, "<mailbox>": 7.0}


def _blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with mailboxes and other entities blanked, at the same length."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, _ in spans:
        parts += (text[at:a], "\x01" * (b - a))
        at = b
    return "".join((*parts, text[at:]))


def _capitalised(word: str) -> bool:
    """Does a word begin like a name: a capital, or a clipped article before one (d'Orvane)?"""
    return word[0].isupper() or len(word) > 3 and word[1] in "'’" and word[2].isupper()


def _is_initial(text: str, m: re.Match) -> bool:
    return m.end() - m.start() == 1 and m.group().isupper() and text[m.end() : m.end() + 1] == "."


def candidate_pairs(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(first term, second term, left context, right context) of neighbouring capitalised words, particles and middle
    initials between them skipped; the first one is "" for an initial."""
    inside = -1
    for a in _FIRST.finditer(text):
        first, at = a.group(), a.end()
        if len(first) == 1 and first.isupper() and text[at : at + 1] == ".":
            first, at = "", at + 1
        elif len(first) < SHORTEST or not _capitalised(first):
            continue
        b = _SECOND.match(text, at)
        if not b or len(b[2]) < SHORTEST or not _capitalised(b[2]) or not first and text[at] == ",":
            continue
        yield first, b[2], "<run>" if a.start() == inside else left_context(text, a.start()), right_context(text, b.end())
        inside = b.start(2)


def _tokens(piece: str) -> list[str]:
    return _TOKEN.findall(_NUMBERS.sub("0", _BOXES.sub("\x01", piece.casefold())))


_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|\x01")
_NUMBERS, _BOXES = re.compile(r"\d+"), re.compile("\x01+")


def left_context(text: str, at: int) -> str:
    """The class of what stands before a place, else the two nearest words or signs in its line, numbers as 0."""
    line = text.rfind("\n", 0, at) + 1
    size = 24
    parts = _tokens(text[max(line, at - size) : at])
    while len(parts) < 3 and at - size > line:
        size *= 2
        parts = _tokens(text[max(line, at - size) : at])
    if not any(p.isalnum() for p in parts):
        above = text[text.rfind("\n", 0, max(0, line - 1)) + 1 : max(0, line - 1)]
        words = [p for p in _tokens(above) if p.isalnum()] if len(above) < 60 else []
        if words and (words[-1] in _CLOSINGS or words[0] in _CLOSINGS or len(words) < 5 and above.rstrip().endswith(",")):
            return "<closing>"
        return " ".join(["^", *parts[-1:]])
    last = parts[-1]
    if last in _TITLES or last == "." and len(parts) > 1 and parts[-2] in _TITLES:
        return "<title>"
    if last == ":":
        sentence = re.split(r"[.;!?]\s", text[line : at - 1])[-1]
        return "<label>" if any(w in _LABELS for w in _tokens(sentence)) else "word :"
    if last in _AUTHORS:
        return "<author>"
    return " ".join(parts[-2:])


def right_context(text: str, at: int) -> str:
    """The class of what stands behind a place, else the two nearest words or signs in its line."""
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    size = 24
    parts = _tokens(text[at : min(end, at + size)])
    while len(parts) < 3 and at + size < end:
        size *= 2
        parts = _tokens(text[at : min(end, at + size)])
    if not parts:
        return "$"
    if "\x01" in parts[:1] or "\x01" in parts[1:3] and not parts[0].isalnum() and parts[0] != ":":
        return "<mailbox>"
    if parts[0] in _DEEDS or parts[0] == "," and parts[1:2] and parts[1] in _DEEDS:
        return "<deed>"
    return " ".join([*parts[:2], "$"][:2])


def _carried(f1: str, f2: str, pieces: set[str], locals_: set[str]) -> bool:
    """Does a mailbox of the text carry both terms of a pair, or one and the initial of the other?"""
    if f1 in pieces and f2 in pieces:
        return True
    return any(x in locals_ for x in (f1 + f2, f2 + f1, f1[:1] + f2, f2 + f1[:1], f1 + f2[:1], f2[:1] + f1)) if f1 else False


_STATS = pa.schema([("what", pa.string()), ("a", pa.string()), ("b", pa.string()), ("left", pa.string()), ("right", pa.string()), ("n", pa.int64())])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task: terms, mailboxes, both, and pairs with their contexts; flushed when they get many."""
    counts: Counter = Counter()
    small: Counter = Counter()

    def flush() -> pa.RecordBatch:
        for w, n in small.items():
            counts["small", fold(w), "", "", ""] += n
        cols = list(zip(*((*k, n) for k, n in counts.items()))) or [[] for _ in _STATS]
        counts.clear()
        small.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _STATS)], schema=_STATS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            pieces: set[str] = set()
            locals_: set[str] = set()
            spans: list[tuple[int, int, str]] = []
            for m in mailboxes(_flat(text)):
                spans.append((*m.span(), "email"))
                pieces |= mailbox_pieces(m["local"])
                locals_.add(fold(m["local"].split("+", 1)[0]))
            blank = _blanked(text, spans)
            terms: set[str] = set()
            for w1, w2, left, right in candidate_pairs(blank):
                f1, f2 = fold(w1), fold(w2)
                if len(f1) == 1 or len(f2) < SHORTEST:
                    continue
                if f1 == f2:
                    continue
                counts["pair", f1, f2, left, right] += 1
                if spans and _carried(f1, f2, pieces, locals_):
                    counts["carried", f1, f2, "", ""] += 1
                terms.update((f1, f2) if f1 else (f2,))
                for w in (w1, w2):
                    if "-" in w:
                        terms.update(x for x in map(fold, w.split("-")) if len(x) >= SHORTEST)
            counts["texts", "", "", "", ""] += 1
            for t in pieces:
                counts["mail", t, "", "", ""] += 1
            for t in terms:
                counts["term", t, "", "", ""] += 1
            for t in terms & pieces:
                counts["both", t, "", "", ""] += 1
            small.update(set(_SMALL.findall(blank)))
        if len(counts) + len(small) > 200_000:
            yield flush()
    yield flush()


def _prior_bits(context: str) -> Column:
    priors = F.create_map(*(F.lit(x) for kv in PRIOR_BITS.items() for x in kv))
    return F.coalesce(priors[F.col(context)], F.lit(0.0))


def _log_odds(p: str, n: str, prior: Column) -> Column:
    """log2 odds of p among n places, seen from PRIOR_WEIGHT places at the odds `prior` (a probability)."""
    return F.log2((F.col(p) + PRIOR_WEIGHT * prior) / (F.col(n) - F.col(p) + PRIOR_WEIGHT * (F.lit(1.0) - prior)))


def term_disclosure(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, bits, n_texts, source: the terms that disclose persons, with the strength of their evidence.

    source is `mailbox` (bits of mutual information) or `context` (bits of log odds).
    """
    stats = cut(
        docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text).alias("text"))
        .mapInArrow(_statistics, "what string, a string, b string, left string, right string, n long")
        .groupBy("what", "a", "b", "left", "right").agg(F.sum("n").alias("n"))
    )
    total = stats.where("what = 'texts'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    by = lambda what, n: stats.where(F.col("what") == what).select(F.col("a").alias("term"), F.col("n").alias(n))
    pairs = stats.where("what = 'pair'").groupBy("a", "b", "left", "right").agg(F.sum("n").alias("n"))
    # terms of pairs that the corpus mostly writes in small letters are ordinary words
    uses = pairs.select(F.explode(F.array("a", "b")).alias("term"), "n").where("term <> ''").groupBy("term").agg(F.sum("n").alias("n_pairs"))
    ordinary = uses.join(by("small", "n_small"), "term").where("n_small > n_pairs").select("term")
    bits = F.log2(F.col("n_both") * F.lit(float(max(total, 1))) / (F.col("n_term") * F.col("n_mail")))
    mutual = by("both", "n_both").join(by("term", "n_term"), "term").join(by("mail", "n_mail"), "term").withColumn("bits", bits).where(F.col("bits") >= MAIL_BITS)
    carried = stats.where("what = 'carried'").select(F.explode(F.array("a", "b")).alias("term")).where("term <> ''").distinct()
    known = (
        mutual.join(carried.withColumn("carried", F.lit(True)), "term", "left").where((F.col("n_both") >= MIN_TEXTS) | F.col("carried"))
        .select("term", "bits", F.col("n_term").alias("n_texts"), F.lit("mailbox").alias("source"))
    )
    lone = carried.join(by("term", "n_term"), "term").select("term", F.log2(F.lit(float(max(total, 1))) / F.col("n_term")).alias("bits"), F.col("n_term").alias("n_texts"), F.lit("mailbox").alias("source"))
    known = cut(known.unionByName(lone.where(F.col("bits") >= MAIL_BITS)).groupBy("term").agg(F.max("bits").alias("bits"), F.max("n_texts").alias("n_texts"), F.first("source").alias("source")))
    # expectation and maximisation: how likely each pair is a person, and how much each context and place says so
    start = F.lit(BASE_BITS) + _prior_bits("left") + _prior_bits("right")
    belief = pairs.groupBy("a", "b").agg((F.sum(F.col("n") * start) / F.sum("n")).alias("bits"))
    for _ in range(CONTEXT_ROUNDS):
        have = known.select("term")
        marked = cut(
            pairs.join(belief, ["a", "b"])
            .join(have.select(F.col("term").alias("a"), F.lit(1).alias("in_a")), "a", "left")
            .join(have.select(F.col("term").alias("b"), F.lit(1).alias("in_b")), "b", "left")
            .withColumn("person", (F.col("in_a").isNotNull() | (F.col("a") == "")) & F.col("in_b").isNotNull())
            .select("a", "b", "left", "right", "n", "person", F.when(F.col("person"), F.col("n")).otherwise(F.col("n") / (1 + F.pow(F.lit(2.0), -F.col("bits")))).alias("p"))
        )
        seen = marked.agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        rate = (seen["p"] + 0.5) / (seen["n"] + 1.0)
        base = math.log2(rate / (1 - rate))
        sides = [marked.select(F.lit(s).alias("side"), F.col(s).alias("context"), "n", "p") for s in ("left", "right")]
        odds = sides[0].unionByName(sides[1]).groupBy("side", "context").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        odds = odds.select("side", "context", (_log_odds("p", "n", 1 / (1 + F.pow(F.lit(2.0), -(F.lit(base) + _prior_bits("context"))))) - base).alias("odds"))
        judged = marked
        for side in ("left", "right"):
            judged = judged.join(odds.where(F.col("side") == side).select(F.col("context").alias(side), F.col("odds").alias(f"odds_{side}")), side)
        judged = judged.withColumn("here", F.col("odds_left") + F.col("odds_right") + F.lit(base))
        classed = (F.col("left").startswith("<") & (F.col("odds_left") >= CLASS_ODDS)) | (F.col("right").startswith("<") & (F.col("odds_right") >= CLASS_ODDS))
        belief = cut(judged.groupBy("a", "b").agg(
            (F.sum(F.col("n") * F.col("here")) / F.sum("n")).alias("bits"), F.sum("n").alias("n_texts"), F.count_if(F.col("here") >= STRONG_ODDS).alias("strong"), F.max(classed).alias("classed"), F.max("person").alias("person"), F.sum(F.when(F.col("left") == "<run>", F.col("n")).otherwise(0)).alias("within")
        ))
        clear = belief.where((F.col("bits") >= CONTEXT_ODDS) & ~F.col("person") & (F.col("within") * 2 < F.col("n_texts")) & (F.col("classed") | (F.col("n_texts") >= MIN_TEXTS) & (F.col("strong") >= STRONG_CONTEXTS)))
        fresh = clear.join(ordinary.select(F.col("term").alias("a")), "a", "left_anti").join(ordinary.select(F.col("term").alias("b")), "b", "left_anti")
        fresh = fresh.select(F.explode(F.array("a", "b")).alias("term"), "bits", "n_texts").where("term <> ''").groupBy("term").agg(F.max("bits").alias("bits"), F.sum("n_texts").alias("n_texts"))
        share = belief.where("within * 2 < n_texts").select(F.explode(F.array("a", "b")).alias("term"), "n_texts", F.when(F.col("person"), 1.0).otherwise(1 / (1 + F.pow(F.lit(2.0), -F.col("bits")))).alias("p"))
        share = share.groupBy("term").agg((F.sum(F.col("n_texts") * F.col("p")) / F.sum("n_texts")).alias("share")).where(F.col("share") >= TERM_SHARE)
        fresh = fresh.join(have, "term", "left_anti").join(share, "term").select("term", "bits", "n_texts", F.lit("context").alias("source"))
        known = cut(known.unionByName(fresh))
        belief = belief.select("a", "b", "bits")
    return known


# -- labelling -----------------------------------------------------------------------------------------------------


def _place(term: str) -> int:
    return xxhash.xxh64_intdigest(term, 42) % TABLE_BITS


class TermTable:
    """Folded terms as a bit table of fixed size: every term is in it, some other words are as well."""

    def __init__(self, bits: bytes) -> None:
        self.bits = bits

    def __contains__(self, term: str) -> bool:
        at = _place(term)
        return bool(self.bits[at >> 3] >> (at & 7) & 1)


def term_table(disclosing: DataFrame) -> TermTable:
    """The bit table of the terms, built by the executors; the driver gets at most TABLE_BITS bits."""
    place = F.pmod(F.xxhash64("term"), F.lit(TABLE_BITS))
    place = F.when(F.xxhash64("term") < 0, F.pmod(F.xxhash64("term") % TABLE_BITS + TABLE_BITS, F.lit(TABLE_BITS))).otherwise(place)
    rows = disclosing.select(place.alias("at")).groupBy((F.col("at") / 32768).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    table = bytearray(TABLE_BITS >> 3)
    for r in rows:
        table[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = r["bits"]
    return TermTable(bytes(table))


#: a token of a run: start, end, kind (T capitalised or t other term, i initial, p particle), the sign before it (" " or ","), terms it may be
Token = tuple[int, int, str, str, tuple[str, ...]]


class Spotter:
    """Runs of words that may disclose, in texts: the decisions about words are kept."""

    def __init__(self, table) -> None:
        self.table = table
        self.terms: dict[str, tuple[str, ...]] = {}

    def may_be(self, word: str) -> tuple[str, ...]:
        got = self.terms.get(word)
        if got is None:
            if len(self.terms) > 200_000:
                self.terms.clear()
            f = fold(word)
            forms = [f, *(map(fold, word.split("-")) if "-" in word else ())]
            got = self.terms[word] = tuple(x for x in dict.fromkeys(forms) if len(x) >= SHORTEST and x in self.table)
        return got

    def runs(self, text: str, grammar: list[tuple[int, int, str]]) -> list[list[Token]]:
        """Runs of words that may disclose, initials and particles with plain gaps, each with a word that may disclose."""
        if not any(map(self.may_be, set(WORD.findall(text)))):
            return []
        blank = _blanked(text, grammar)
        out: list[list[Token]] = []
        run: list[Token] = []
        last = -1
        for m in WORD.finditer(blank):
            word = m.group()
            terms = self.may_be(word)
            kind = ("T" if _capitalised(word) else "t") if terms else "i" if _is_initial(blank, m) else "p" if word.lower() in _PARTICLES else ""
            gap = blank[last : m.start()] if run else ""
            if run and run[-1][2] == "i" and gap:
                gap = gap[1:] or " "
            if run and (not kind or gap not in (" ", ", ")):
                if any(t[2] in "tT" for t in run):
                    out.append(run)
                run = []
            if kind:
                run.append((m.start(), m.end(), kind, "," if run and gap == ", " else " ", terms))
                last = m.end()
        if any(t[2] in "tT" for t in run):
            out.append(run)
        return out


def packed_run(run: list[Token]) -> str:
    """A run as a text, positions from its start: equal runs are equal texts."""
    first = run[0][0]
    return "\n".join("\t".join((str(a - first), str(b - first), kind, gap, *terms)) for a, b, kind, gap, terms in run)


def unpacked_run(packed: str) -> list[Token]:
    rows = (line.split("\t") for line in packed.split("\n"))
    return [(int(a), int(b), kind, gap, tuple(terms)) for a, b, kind, gap, *terms in rows]


def names_of_run(run: list[Token], known) -> list[tuple[int, int]]:
    """Spans of names in a run, given the terms that do disclose."""
    hits = [next((t for t in terms if t in known), None) for _, _, _, _, terms in run]
    kinds = ["t" if h else k if k in "ip" else "" for h, (_, _, k, _, _) in zip(hits, run)]
    out, i = [], 0
    while i < len(run):
        if kinds[i] not in ("t", "i"):
            i += 1
            continue
        j, terms, initials, end, commas = i, [], 0, None, 0
        while True:
            if kinds[j] == "t":
                terms.append(hits[j])
                end = j
            elif kinds[j] == "i":
                initials += 1
                if terms:
                    end = j
            elif kinds[j] != "p":
                break
            if j + 1 >= len(run):
                break
            if run[j + 1][3] == ",":
                commas += 1
                if commas > 1 or len(terms) != 1:
                    break
            j += 1
        if end is not None and (len(set(terms)) >= 2 or terms and initials):
            first = i
            while first > 0 and kinds[first - 1] == "p" and run[first][3] == " ":
                first -= 1  # VAN DER QUELL, Tomas
            out.append((run[first][0], run[end][1] + (kinds[end] == "i")))
            i = end + 1
        else:
            i += 1
    return out


def spans_of_run(run: list[Token], known, lone_terms: bool) -> list[tuple[int, int]]:
    """Names and, if wanted, lone capitalised terms above the threshold."""
    names = names_of_run(run, known)
    if lone_terms:
        names += [(a, b) for a, b, kind, _, terms in run if kind == "T" and any(t in known for t in terms) and not any(x <= a < y for x, y in names)]
    return sorted(names)


def all_spans(text: str, known) -> list[tuple[int, int, str]]:
    """Entities and names of one text, given all terms: the plain form of what the tables below do."""
    grammar = grammar_spans(text)
    names = [(a, b, "name") for run in Spotter(known).runs(text, grammar) for a, b in names_of_run(run, known)]
    return sorted([*grammar, *names])


_SPOTS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("kind", pa.string()), ("at", pa.int64()), ("end", pa.int64()), ("run", pa.string()), ("terms", pa.list_(pa.string()))])
_SPOTS_DDL = "doc_id long, key binary, kind string, at long, end long, run string, terms array<string>"
_NAMED_DDL = "run string, spans array<struct<a:long,b:long>>"


def spots(docs: DataFrame, disclosing: DataFrame, whole: bool) -> DataFrame:
    """What a text may hold: grammar entities (kind, at, end), and runs of words that may disclose (kind name, run, terms).

    whole: every entity, under the hash of its text; else each kind of a text once, under its doc_id.
    """
    table = docs.sparkSession.sparkContext.broadcast(term_table(disclosing).bits)  # TABLE_BITS bits at every size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(TermTable(table.value))
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grammar = grammar_spans(text)
                key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest() if whole else None
                doc = None if whole else doc
                if whole:
                    out.extend((None, key, kind, a, b, None, None) for a, b, kind in grammar)
                else:
                    out.extend((doc, None, kind, None, None, None, None) for kind in dict.fromkeys(k for _, _, k in grammar))
                for run in spotter.runs(text, grammar):
                    terms = sorted({t for token in run for t in token[4]})
                    out.append((doc, key, "name", run[0][0] if whole else None, None, packed_run(run), terms))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(_SPOTS)], schema=_SPOTS)

    some = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(some.mapInArrow(work, _SPOTS_DDL).distinct())


def confirmed_runs(spotted: DataFrame, disclosing: DataFrame, lone_terms: bool) -> DataFrame:
    """run, spans: the names (and lone terms) in each distinct run, formed of terms that the join confirms."""
    terms = spotted.where("run is not null").select("run", "terms").distinct().select("run", F.explode("terms").alias("term"))
    sure = terms.join(disclosing.select("term").distinct(), "term", "left_semi").groupBy("run").agg(F.collect_set("term").alias("sure"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = spans_of_run(unpacked_run(run), frozenset(known), lone_terms)
                if spans:
                    rows.append((run, [{"a": a, "b": b} for a, b in spans]))
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind)], names=["run", "spans"])

    return sure.mapInArrow(work, _NAMED_DDL)


def found_kinds(docs: DataFrame, disclosing: DataFrame | None = None) -> DataFrame:
    """doc_id, kind: one row for each text and kind of personal information in it."""
    disclosing = term_disclosure(docs) if disclosing is None else disclosing
    spotted = spots(docs, disclosing, whole=False)
    names = spotted.where("kind = 'name'").join(confirmed_runs(spotted, disclosing, lone_terms=False).select("run"), "run", "left_semi")
    return spotted.where("kind <> 'name'").select("doc_id", "kind").unionByName(names.select("doc_id", "kind")).distinct()


def disclosing_texts(docs: DataFrame, disclosing: DataFrame | None = None) -> DataFrame:
    """doc_id, term, bits, source, in_name: the method alone, over every text.

    One row for each text and term above the disclosure thresholds in it; in_name tells whether it stands in a name
    (generalised as a whole) or alone.  Terms inside grammar entities don't count.
    """
    disclosing = term_disclosure(docs) if disclosing is None else disclosing
    spotted = spots(docs, disclosing, whole=False).where("kind = 'name'")
    named = confirmed_runs(spotted, disclosing, lone_terms=False).select("run", F.lit(True).alias("named"))
    runs = spotted.join(named, "run", "left").select("doc_id", F.explode("terms").alias("term"), F.coalesce("named", F.lit(False)).alias("named"))
    return runs.groupBy("doc_id", "term").agg(F.max("named").alias("in_name")).join(disclosing.select("term", "bits", "source"), "term").select("doc_id", "term", "bits", "source", "in_name")


def sanitise(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Entities as typed placeholders; spans that lie in an earlier one are left out."""
    parts, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            parts += (text[at:a], PLACEHOLDERS[kind])
            at = b
    return "".join((*parts, text[at:]))


def sanitised(docs: DataFrame, disclosing: DataFrame | None = None, lone_terms: bool = True) -> DataFrame:
    """doc_id and the text with typed placeholders; null and empty texts stay as they are."""
    disclosing = term_disclosure(docs) if disclosing is None else disclosing
    spotted = spots(docs, disclosing, whole=True)
    names = spotted.where("kind = 'name'").join(confirmed_runs(spotted, disclosing, lone_terms), "run").select("key", "at", F.explode("spans").alias("s"))
    names = names.select("key", F.struct((F.col("at") + F.col("s.a")).alias("a"), (F.col("at") + F.col("s.b")).alias("b"), F.lit("name").alias("kind")).alias("span"))
    spans = spotted.where("kind <> 'name'").select("key", F.struct(F.col("at").alias("a"), F.col("end").alias("b"), "kind").alias("span")).unionByName(names)
    spans = spans.groupBy("key").agg(F.collect_list("span").alias("spans"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2("text", 256)).alias("key")).join(spans, "key", "left").select("doc_id", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, found = (c.to_pylist() for c in batch.columns)
            clean = [sanitise(t, [(x["a"], x["b"], x["kind"]) for x in f]) if f else t for t, f in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(clean, pa.string())], names=["doc_id", "text"])

    return keyed.mapInArrow(work, "doc_id long, text string")
