"""Text that was decoded with the wrong character encoding: detection and repair with a hidden Markov model.

States: `clean`, one for each pair (written in, read as), `lost` for bytes that became U+FFFD and `utf16` for byte
pairs read as single characters.  Characters are labelled in units: a token (a run without ASCII white space that holds
a non-ASCII or control character) as a whole where one state explains it, for an encoding that spreads a character
over several others leaves no smaller unit; a token that is clean as a whole but not in its parts is cut behind its runs of non-ASCII
characters, at changes of script and around UTF-8 sequences, so that right and wrong characters of one token get
states of their own.  ASCII tokens say nothing about any state.  A state emits a unit with the probability that the
character model gives to the unit's inverse transform; the character model (bigrams, backing off to classes of
characters) is trained on a few sentences a language.  Transitions are sticky within a line and loose between lines.
Viterbi labels the units and every labelled span gets the inverse transform of its state.  A span that another state
explains nearly as well (within NEAR nats) by another text is restored by the better state, but not as complete.

Defined results: null and empty texts are clean; pure ASCII text without NUL is clean and is never decoded; U+FFFD
is damage that can't be undone and stays in the restored text; texts of any length are labelled whole, token by
token.  The model is fixed: it depends neither on the rows nor on their number.
"""

from __future__ import annotations

import codecs
import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.llm.seedtext import SEEDS

TOKEN = re.compile(r"(\r\n|\r|\n)|([^ \t\r\n]*[^\x01-\x7e \t\r\n][^ \t\r\n]*)")
_RUN = re.compile(r"[^\x00-\x7e]+")
SUSPECT = re.compile(r"[^\x01-\x7e]")
#: passes over the encodings: (written in, read as); `x2` and `x3` pairs were garbled twice and three times
PAIRS: tuple[tuple[str, str], ...] = tuple(
    (e, d)
    for e, many in {
        "utf-8": "cp1252 latin-1 cp1250 iso8859-2 cp1251 cp1253 cp1254 mac_roman cp437 cp850 cp852 cp866 koi8-r gbk shift_jis euc_jp",
        "utf-8x2": "cp1252 latin-1",
        "utf-8x3": "cp1252 latin-1",
        "cp1251": "cp1252 koi8-r cp866 mac_cyrillic cp437",
        "koi8-r": "cp1251 cp1252 cp866",
        "cp866": "latin-1 cp1251 cp1252 koi8-r",
        "mac_cyrillic": "cp1251 cp1252 latin-1",
        "iso8859-5": "cp1251 cp1252",
        "cp1253": "cp1252 cp1251",
        "cp737": "latin-1 cp1252 cp1253",
        "cp1250": "cp1252 iso8859-2 cp1251",
        "iso8859-2": "cp1252 cp1250",
        "cp852": "cp1252 latin-1 cp1250",
        "cp437": "cp1252 latin-1",
        "cp850": "cp1252 latin-1",
        "mac_roman": "cp1252 latin-1",
        "cp1252": "mac_roman cp437 cp850 cp1251 cp1250 cp1253 koi8-r iso8859-5",
        "cp1254": "cp1252",
        "cp1257": "cp1252",
        "cp1258": "cp1252",
        "cp874": "cp1252 latin-1",
        "cp1255": "cp1252",
        "cp1256": "cp1252",
        "shift_jis": "cp1252 latin-1 cp1251",
        "euc_jp": "cp1252 latin-1",
        "gbk": "cp1252 latin-1 cp1251",
        "big5": "cp1252 latin-1",
        "euc_kr": "cp1252 latin-1",
    }.items()
    for d in many.split()
)
STATES: tuple[str, ...] = ("clean", *(f"{e}>{d}" for e, d in PAIRS), "lost", "utf16")
CLEAN, LOST, UTF16 = 0, len(STATES) - 2, len(STATES) - 1
LOG_STAY, LOG_SWITCH = math.log(0.97), math.log(0.03 / len(STATES))
LINE_STAY, LINE_CLEAN, LINE_SWITCH = math.log(0.6), math.log(0.38), math.log(0.02 / len(STATES))
#: between parts of one token, which are only cut apart where their states differ
PIECE_SWITCH = math.log(0.1 / len(STATES))
LINE, WORD, INSIDE = range(3)
START_CLEAN, START_OTHER = math.log(0.95), math.log(0.05 / len(STATES))
#: a token that a state can't have produced costs so many nats more than under the clean state
IMPOSSIBLE = 25.0
#: a second state so near leaves open which text was meant
NEAR = 3.0


# -- character classes and the character model ---------------------------------------------------------------------

_CLASS_SIZE = {"al": 26, "au": 26, "dg": 10, "ap": 34, "ll": 180, "lu": 180, "cl": 48, "cu": 48, "gl": 40, "gu": 40, "ka": 180, "ha": 20000, "hg": 11172, "ar": 120, "he": 30, "ty": 16, "sy": 60, "bx": 300, "c0": 30, "c1": 32, "sp": 16, "em": 1500, "mn": 200, "jo": 15, "bd": 1, "cf": 1200, "ot": 60000}
_ASCII = frozenset(("al", "au", "dg", "ap", "bd"))
_LATIN = frozenset(("al", "au", "ll", "lu"))
#: letters of other scripts that are drawn like Latin ones (fixed values)
LOOKALIKES = frozenset("АВЕЅІЈКМНОРСТУХаеорсухѕіјԁһԛԝɡ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρυκα" "ՏՍՕՈօսոհցյզ")
#: least log probability of what is odd but no sign of a wrong encoding: (class, floor); under the clean state only
_FLOORS = {"ty": -4.5, "sp": -6.0, "jo": -6.5, "cf": -6.0, "mn": -6.5, "em": -7.0}


@functools.lru_cache(maxsize=70_000)
def char_class(c: str) -> str:
    o = ord(c)
    if c == " ":
        return "bd"
    if o < 128:
        if c.islower():
            return "al"
        if c.isupper():
            return "au"
        if c.isdigit():
            return "dg"
        return "ap" if o >= 32 or c in "\t\n\r" else "c0"
    if o < 160:
        return "c1"
    if c in "“”‘’–—…«»‚„‹›":
        return "ty"
    if c in "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff\ufe0e\ufe0f":
        return "jo"
    cat = unicodedata.category(c)
    if cat in ("Zs", "Zl", "Zp"):
        return "sp"
    if cat in ("Mn", "Mc", "Me"):
        return "mn"
    if o < 0x250 and cat[0] == "L" and c not in "ªº":
        return "lu" if cat == "Lu" else "ll"
    if 0x1E00 <= o < 0x1F00:
        return "lu" if cat == "Lu" else "ll"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        if cat[0] == "L":
            return "gu" if cat == "Lu" else "gl"
        return "ot"
    if 0x400 <= o < 0x530:
        return "cu" if cat == "Lu" else "cl" if cat[0] == "L" else "ot"
    if o < 0x250:
        return "sy"
    if 0xFF00 < o < 0xFF5F or 0x1D400 <= o < 0x1D800 or 0xFB00 <= o < 0xFB07:
        return "cf"
    if 0x3040 <= o < 0x3100 or 0x3000 < o < 0x3020 or 0xFF5F <= o < 0xFFF0:
        return "ka"
    if 0x3400 <= o < 0xA000 or 0x20000 <= o < 0x32000:
        return "ha"
    if 0xAC00 <= o < 0xD7B0:
        return "hg"
    if 0x600 <= o < 0x780:
        return "ar"
    if 0x590 <= o < 0x600:
        return "he"
    if 0x2500 <= o < 0x25A0 or 0x2200 <= o < 0x2400 or c in "⌐∙√ⁿ₧ƒ":
        return "bx"
    if cat == "So" or 0x1F000 <= o < 0x20000:
        return "em"
    return "ot"


class CharModel:
    """log P(c | previous c): bigrams of the seeds, backed off to class transitions and class unigrams."""

    def __init__(self, texts: dict[str, str]) -> None:
        pair, first, cls_pair, cls_first = Counter(), Counter(), Counter(), Counter()
        uni, uni_cls = Counter(), Counter()
        for text in texts.values():
            for word in text.split(" "):
                prev = " "
                for c in word + " ":
                    a, b = char_class(prev), char_class(c)
                    pair[prev, c] += 1
                    first[prev] += 1
                    cls_pair[a, b] += 1
                    cls_first[a] += 1
                    uni[c] += 1
                    uni_cls[b] += 1
                    prev = c
        self.pair, self.first, self.cls_pair, self.cls_first, self.uni, self.uni_cls = pair, first, cls_pair, cls_first, uni, uni_cls
        self.cache: dict[tuple[str, str], float] = {}

    def log(self, prev: str, c: str) -> float:
        got = self.cache.get((prev, c))
        if got is not None:
            return got
        a, b = char_class(prev), char_class(c)
        if a in _ASCII and b in _ASCII:
            value = math.log(0.9 / 60)  # ASCII beside ASCII: the same under every state
        else:
            p_cls = (self.cls_pair[a, b] + 0.02) / (self.cls_first[a] + 0.02 * len(_CLASS_SIZE) + 1)
            p_uni = (self.uni[c] + 0.05) / (self.uni_cls[b] + 0.05 * _CLASS_SIZE[b])
            n = self.first[prev]
            weight = n / (n + 8.0)
            p = weight * self.pair[prev, c] / n if n else 0.0
            value = math.log(p + (1 - weight) * p_cls * p_uni + 1e-9)
        if len(self.cache) < 500_000:
            self.cache[prev, c] = value
        return value

    def word(self, text: str) -> float:
        """log P of a token that was written in its right encoding."""
        total, prev, log = 0.0, " ", self.log
        for c in text:
            total += log(prev, c)
            prev = c
        return total + log(prev, " ")

    def as_read(self, text: str) -> float:
        """The same under the clean state, where invisible characters, odd spaces, compatibility forms and single
        look-alike letters are spelling, not damage."""
        total, prev, last = 0.0, " ", "bd"
        for c in text + " ":
            now = char_class(c)
            value = self.log(prev, c)
            if now in _FLOORS and value < _FLOORS[now] and c not in "‚„‹›":
                value = _FLOORS[now]
            elif last in _FLOORS and value < -5.0 and now in _ASCII:
                value = -5.0
            elif value < -4.0 and (c in LOOKALIKES and last in _LATIN or prev in LOOKALIKES and now in _LATIN):
                value = -4.0
            elif value < -5.0 and c in LOOKALIKES and last in _ASCII:
                value = -5.0
            total += value
            prev, last = c, now
        return total


# -- inverse transforms --------------------------------------------------------------------------------------------


def _byte_table(decoding: str) -> dict[int, int]:
    table: dict[int, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(decoding)
        except UnicodeDecodeError:
            c = chr(b)  # readers pass undefined bytes through
        table.setdefault(ord(c), b)
    return table


_MULTIBYTE = {"gbk", "shift_jis", "euc_jp", "big5", "euc_kr"}
_TABLES: dict[str, dict[int, int]] = {}


def _to_bytes(text: str, decoding: str) -> bytes:
    if decoding in _MULTIBYTE:
        return text.encode(decoding)
    table = _TABLES.get(decoding)
    if table is None:
        table = _TABLES[decoding] = _byte_table(decoding)
    return codecs.charmap_encode(text, "strict", table)[0]


def invert(text: str, state: int) -> str | None:
    """The text as it was written, if the state can have produced it from something else; else None."""
    if state in (CLEAN, LOST):
        return text
    if state == UTF16:
        return unpair(text)
    e, d = PAIRS[state - 1]
    rounds, e = (int(e[-1]), e[:-2]) if e[-2:-1] == "x" else (1, e)
    try:
        out = text
        for _ in range(rounds):
            out = _to_bytes(out, d).decode(e)
    except (UnicodeError, ValueError):
        return None
    return out if out != text else None


_SCRIPTS = {"cl": "c", "cu": "c", "gl": "g", "gu": "g", "ha": "e", "ka": "e", "hg": "k", "ar": "a", "he": "h"}


@functools.lru_cache(maxsize=1)
def _utf8_runs() -> tuple[re.Pattern[str], ...]:
    """For each reading of one byte a character: runs that are whole UTF-8 sequences."""
    out = []
    for e, d in PAIRS:
        if e == "utf-8" and d not in _MULTIBYTE:
            back: dict[int, str] = {}
            for c, byte in _byte_table(d).items():
                back.setdefault(byte, re.escape(chr(c)))
            some = lambda a, b: "[" + "".join(back[x] for x in range(a, b) if x in back) + "]"  # noqa: B023, E731
            cont = some(0x80, 0xC0)
            out.append(re.compile(f"(?:{some(0xC2, 0xE0)}{cont}|{some(0xE0, 0xF0)}{cont}{cont}|{some(0xF0, 0xF5)}{cont}{cont}{cont})+"))
    return tuple(out)


def places_to_cut(token: str) -> list[int]:
    """Where the state may change inside a token: behind runs of non-ASCII characters, at changes of script in them,
    and around whole UTF-8 sequences read one byte a character."""
    cuts = set()
    for m in _RUN.finditer(token):
        cuts.add(m.end())
        script = [_SCRIPTS.get(char_class(c), "") for c in m.group()]
        cuts.update(m.start() + i for i in range(1, len(script)) if script[i] != script[i - 1])
    for pattern in _utf8_runs():
        cuts.update(x for m in pattern.finditer(token) for x in m.span())
    return sorted(cuts - {0, len(token)})


def unpair(text: str) -> str:
    """Characters from little-endian byte pairs that were read one by one; a lost byte gives U+FFFD."""
    if text.startswith("��"):
        text = text[2:]
    if text[:1] == "\x00":
        text = text[1:]
    out = []
    for i in range(0, len(text) - 1, 2):
        lo, hi = ord(text[i]), ord(text[i + 1])
        out.append(chr(hi << 8 | lo) if lo < 256 and hi < 256 and not 0xD8 <= hi < 0xE0 else "�")
    return "".join(out)


# -- the model -----------------------------------------------------------------------------------------------------


class Labeller:
    """Viterbi over the tokens of a text; scores of tokens are cached, for words come again and again."""

    def __init__(self, cache_size: int = 200_000) -> None:
        self.model = CharModel(SEEDS)
        self.scores = functools.lru_cache(maxsize=cache_size)(self._scores)
        self.pieces = functools.lru_cache(maxsize=cache_size)(self._pieces)

    def _scores(self, token: str) -> tuple[np.ndarray, bool]:
        score = np.empty(len(STATES))
        clean = self.model.as_read(token)
        score[:] = clean - IMPOSSIBLE
        score[CLEAN] = clean
        if "\x00" in token:
            score[UTF16] = clean + 20.0 * token.count("\x00")
        elif "�" in token:
            score[LOST] = clean + 14.0 * token.count("�")
        else:
            for s in range(1, LOST):
                was = invert(token, s)
                if was is not None:
                    score[s] = self.model.word(was)
        return score, bool(score[CLEAN] >= score.max() - 1e-9)

    def _pieces(self, token: str) -> tuple[tuple[int, int], ...]:
        """Units of a token: itself, or its parts if these are explained by states of their own and it isn't."""
        whole = ((0, len(token)),)
        score, clean = self.scores(token)
        if not clean:
            return whole
        cuts = places_to_cut(token)
        if not cuts:
            return whole
        parts = tuple(zip([0, *cuts], [*cuts, len(token)]))
        return whole if all(self.scores(token[a:b])[1] for a, b in parts) else parts

    def _path(self, text: str) -> tuple[list[tuple[int, int]], list[int], list[np.ndarray]]:
        """Spans of the units, the best path of states, and the scores of each unit; all empty if all is clean."""
        nothing: tuple[list, list, list] = ([], [], [])
        if not SUSPECT.search(text):
            return nothing
        spans, emitted, steps, trivial = [], [], [], True
        new_line = False
        for m in TOKEN.finditer(text):
            if m.group(1):
                new_line = True
                continue
            token, start = m.group(2), m.start(2)
            for a, b in self.pieces(token):
                score, clean = self.scores(token[a:b])
                trivial = trivial and clean
                spans.append((start + a, start + b))
                emitted.append(score)
                steps.append(LINE if new_line else INSIDE if a else WORD)
                new_line = False
        if trivial:
            return nothing  # the all-clean path is best in every factor
        prev = np.full(len(STATES), START_OTHER)
        prev[CLEAN] = START_CLEAN
        prev = prev + emitted[0]
        back: list[np.ndarray] = []
        own = np.arange(len(STATES))
        for score, step in zip(emitted[1:], steps[1:]):
            best = int(prev.argmax())
            if step == LINE:
                stay, move = prev + LINE_STAY, prev[best] + LINE_SWITCH
                came = np.where(stay >= move, own, best)
                value = np.maximum(stay, move)
                to_clean = prev[best] + LINE_CLEAN
                if to_clean > value[CLEAN]:
                    value[CLEAN], came[CLEAN] = to_clean, best
            else:
                stay, move = prev + LOG_STAY, prev[best] + (PIECE_SWITCH if step == INSIDE else LOG_SWITCH)
                came = np.where(stay >= move, own, best)
                value = np.maximum(stay, move)
            back.append(came)
            prev = value + score
        state = int(prev.argmax())
        path = [state]
        for came in reversed(back):
            state = int(came[state])
            path.append(state)
        path.reverse()
        return spans, path, emitted

    def label(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, state) of the units that aren't clean."""
        spans, path, _ = self._path(text)
        return [(a, b, s) for (a, b), s in zip(spans, path) if s != CLEAN]

    def _open(self, text: str, spans: list[tuple[int, int]], state: int, scores: list[np.ndarray]) -> bool:
        """Does another state explain the units of one state nearly as well, by another text?"""
        total = np.sum(scores, axis=0)
        for s in np.flatnonzero(total[1:LOST] >= total[state] - NEAR) + 1:
            if s != state and any(invert(text[a:b], int(s)) != invert(text[a:b], state) for a, b in spans):
                return True
        return False

    def garbled(self, text: str | None) -> bool:
        return bool(text) and bool(self.label(text))

    def restore(self, text: str) -> tuple[str, list[str], bool]:
        """Restored text, the states of its garbled spans, and whether everything could be restored."""
        spans, path, emitted = self._path(text)
        found = [(a, b, s) for (a, b), s in zip(spans, path) if s != CLEAN]
        if not found:
            return text, [], True
        states = sorted({STATES[s] for _, _, s in found})
        if any(s == UTF16 for _, _, s in found) and text.count("\x00") * 4 > len(text):
            fixed = unpair(text)
            return fixed, states, "\ufffd" not in fixed
        out, at, whole = [], 0, True
        for a, b, s in found:
            out.append(text[at:a])
            was = invert(text[a:b], s)
            if was is None or s in (LOST, UTF16):
                whole = False
                was = text[a:b] if was is None else was
            out.append(was)
            at = b
        out.append(text[at:])
        for s in {s for _, _, s in found if s not in (LOST, UTF16)} if whole else ():
            mine = [i for i, p in enumerate(path) if p == s]
            whole = whole and not self._open(text, [spans[i] for i in mine], s, [emitted[i] for i in mine])
        return "".join(out), states, whole


@functools.lru_cache(maxsize=1)
def labeller() -> Labeller:
    """One labeller a Python worker."""
    return Labeller()


def suspects(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text holds a non-ASCII character or NUL: decided in the JVM without decoding."""
    c = F.col(text)
    return texts.where(c.isNotNull() & ((F.octet_length(c) != F.char_length(c)) | (F.instr(c, "\x00") > 0)))


_FIXED = "row_id long, restored string, states string, complete boolean"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lab = labeller()
    schema = pa.schema([("row_id", pa.int64()), ("restored", pa.string()), ("states", pa.string()), ("complete", pa.bool_())])
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fixed, states, whole = lab.restore(text)
            if states:
                for c, v in zip(out, (row, fixed, ",".join(states), whole)):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lab = labeller()
    schema = pa.schema([("row_id", pa.int64())])
    for batch in batches:
        hit = [row for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if lab.garbled(text)]
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64())], schema=schema)


def garbled_rows(texts: DataFrame, row_id: str = "fetch_id", text: str = "text") -> DataFrame:
    """row_id of the rows whose text is garbled, each once."""
    rows = suspects(texts.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")))
    return rows.mapInArrow(_detect, "row_id long").where("row_id is not null").distinct()


def restored_rows(texts: DataFrame, row_id: str = "fetch_id", text: str = "text") -> DataFrame:
    """row_id, restored text, labelled states and whether all of it was restored, for the garbled rows.

    A row delivered twice with one id and text comes out once.
    """
    rows = suspects(texts.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")))
    return rows.mapInArrow(_repair, _FIXED).distinct()
