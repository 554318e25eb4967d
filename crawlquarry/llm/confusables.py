"""One consistent form for text that looks the same but differs in its characters.

1. Look-alike classes: union-find over strings and code points.  Edges: compatibility forms of printable ASCII,
   composed letters and their decompositions, look-alike letters of other scripts, odd spaces and U+0020, invisible
   characters and the empty string, and ordinary spellings that are drawn alike (s with cedilla and s with comma, the
   hyphens, the quotes).  Classes are transitive (fullwidth, mathematical and Cyrillic A are one class).  A letter with
   marks is in one class with every order and partial composition of them, Hangul syllables with their jamo included:
   these classes have no end, so their edge is found in the text (the canonical composition of the sequence).
2. Representative of a class: the most frequent of its ordinary spellings in the whole corpus, counted in one
   distributed pass; look-alike letters of other scripts count only inside words otherwise Latin.  Ties: ASCII first,
   then shorter, then as listed, then smaller.  A class with an ASCII spelling keeps it, for names, fields and paths are ASCII.
3. Rewriting: an Aho-Corasick automaton of all other members walks the text, longest match first, and replaces
   greedily, again until nothing is left.  Look-alike letters are replaced only in words otherwise Latin, or where a
   whole word spells a known name.

A rewritten ordinary spelling (kind `spelling`) is no case: which one stands depends on the corpus, and none is wrong.

Defined results: null and empty texts have no case; ASCII text is never touched; a byte order mark as the very first
character, joiners that a script or an emoji needs, emoji, and words truly of another script stay, so do typographic
quotes, dashes and ellipsis beside ASCII ones; texts of any length are walked whole.  With an empty table ASCII members
represent their classes.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.llm import mojibake
from crawlquarry.session import cut

#: letters of other scripts (and phonetic letters) and the Latin letters they are drawn like (fixed values)
LETTER_PAIRS = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухѕіјԁһԛԝкѵӀӏҮүԌҽ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρυακϹϲϳϜγ" "ՏՍՕԼՈօսոհցյզք" "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏃᎠᎡᎳᏀᎥᏪ" "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ" "ⲞⲟⲢⲣⲤⲥⲬⲎⲒⲔⲘⲚⲦ" "ɑɡɩ",
        "ABESIJKMHOPCTYXaeopcyxsijdhqwkvIlYyGe" "ABEZHIKMNOPTYXovipuakCcjFy" "SUOLNounhgjqf" "ABCEHJKLMPRSTVZDRWGiW" "ABCDEFGHIJKLMNOPRSTUVWXYZ" "OoPpCcXHIKMNT" "agi",
    )
)
#: ordinary spellings of one script that are drawn alike; none of them is a case (fixed values)
SPELLINGS = ("şș", "ŞȘ", "ţț", "ŢȚ", "ÐĐƉ", "đɖ", "əǝ", "ƏƎ", "’ʼ", "‘ʻ", "“‟", "–‒−", "‐‑", "—―", "·‧∙⋅", "•‣", "…⋯")
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0"
JOINERS = "\u200c\u200d\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f"
TYPOGRAPHIC = "\u2026\u2025\u2024"
MOST_CRAWLERS = 100_000
_RAISED = ("<super>", "<sub>", "<fraction>")
_INNER = frozenset("_" + INVISIBLE + JOINERS + "".join(chr(o) for o in range(0x300, 0x370)))
_HYPHEN = frozenset("-")
KINDS = ("compatibility", "decomposed", "invisible", "space", "look-alike", "spelling")


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = defaultdict(list)
        for x in self.parent:
            groups[self.find(x)].append(x)
        return [sorted(g) for g in groups.values()]


@functools.lru_cache(maxsize=1)
def edges() -> tuple[tuple[str, str, str], ...]:
    """(variant, ordinary spelling, kind), from the Unicode data and the fixed pairs above; without Hangul syllables and their jamo."""
    out: list[tuple[str, str, str]] = []
    for o in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= o < 0xD7B0 or 0xD800 <= o < 0xE000 or 0x3400 <= o < 0xA000 or 0x20000 <= o < 0xE0000:
            continue
        c = chr(o)
        if c in LETTER_PAIRS or c in INVISIBLE or c in JOINERS or c in TYPOGRAPHIC:
            continue
        if unicodedata.category(c) == "Zs":
            out.append((c, " ", "space"))
            continue
        how = unicodedata.decomposition(c)
        if not how:
            continue
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and not how.startswith(_RAISED):
            if plain and all(32 < ord(x) < 127 for x in plain):
                out.append((c, plain, "compatibility"))
            elif plain in LETTER_PAIRS or c in "\u212b\u2126":
                out.append((c, plain, "compatibility"))
        if not how.startswith("<") and len(how.split()) == 2:
            full, step = unicodedata.normalize("NFD", c), "".join(chr(int(x, 16)) for x in how.split())
            if unicodedata.normalize("NFC", full) == c:
                out.extend((x, c, "decomposed") for x in {full, step})
    out.extend((c, "", "invisible") for c in INVISIBLE + JOINERS)
    out.extend((c, latin, "look-alike") for c, latin in LETTER_PAIRS.items())
    return tuple(out)


@functools.lru_cache(maxsize=1)
def joining_marks() -> str:
    """Characters that compose with, or are ordered behind, the one before them."""
    seconds = set()
    for o in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= o < 0xD7B0 or 0xD800 <= o < 0xE000 or 0x3400 <= o < 0xA000 or 0x20000 <= o < 0xE0000:
            continue
        c = chr(o)
        if unicodedata.combining(c):
            seconds.add(c)
        how = unicodedata.decomposition(c)
        if how and how[0] != "<":
            seconds.update(chr(int(x, 16)) for x in how.split()[1:])
    return "".join(sorted(seconds))


_WIDE = re.compile("[\U00010000-\U0010ffff]")
_JAMO = "[\u1100-\u1112\uac00-\ud7a3][\u1161-\u1175\u11a8-\u11c2]+"


@functools.lru_cache(maxsize=2)
def _sequence(wide: bool) -> tuple[re.Pattern[str], re.Pattern[str]]:
    """A joining mark or jamo; a character with marks, or jamo that may form a syllable.  Only the wide form knows marks
    beyond the basic plane: without them the engine looks characters up instead of trying ranges."""
    marks = "".join(m for m in joining_marks() if wide or ord(m) < 0x10000)
    return re.compile(f"[{marks}\u1161-\u1175\u11a8-\u11c2]"), re.compile(f"[^{marks}]?[{marks}]+|{_JAMO}")


def uncomposed(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, composed) of the sequences that canonical equivalence writes otherwise, and not longer."""
    mark, sequence = _sequence(bool(_WIDE.search(text)))
    for m in sequence.finditer(text) if mark.search(text) else ():
        seq = m.group()
        composed = unicodedata.normalize("NFC", seq)
        if composed != seq and len(composed) <= len(seq):
            yield m.start(), m.end(), composed


@functools.lru_cache(maxsize=1)
def look_alike_classes() -> tuple[tuple[str, ...], ...]:
    """Transitive classes of strings and code points that look the same."""
    sets = UnionFind()
    for variant, plain, _ in edges():
        sets.union(variant, plain)
    for group in SPELLINGS:
        for other in group[1:]:
            sets.union(group[0], other)
    return tuple(tuple(g) for g in sets.classes())


def members() -> frozenset[str]:
    return frozenset(x for g in look_alike_classes() for x in g)


def choose_representatives(counts: dict[str, int]) -> dict[str, str]:
    """member -> representative of its class; members that represent themselves are left out.

    The most frequent of a class's ordinary spellings (those that aren't the variant side of any edge); a variant can't
    represent its class however often it occurs, for what counts as a case doesn't depend on the corpus.  An ASCII
    spelling goes before all others.
    """
    variants = {v for v, _, _ in edges()}
    place = {c: i for group in SPELLINGS for i, c in enumerate(group)}
    out: dict[str, str] = {}
    for group in look_alike_classes():
        ordinary = [x for x in group if x not in variants] or list(group)
        plain = [x for x in ordinary if x.isascii()]
        best = min(plain or ordinary, key=lambda x: (-counts.get(x, 0), len(x), place.get(x, 0), x))
        out.update((x, best) for x in group if x != best)
    return out


def _is_latin(c: str) -> bool:
    return c.isalpha() and (c.isascii() or c in "ªº" or 0xC0 <= ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00)


def _needs_joiner(text: str, at: int) -> bool:
    """Is the joiner or variation selector at this place one that a script or an emoji needs?"""
    before = text[at - 1] if at else ""
    if not before:
        return False
    if before in JOINERS:
        return _needs_joiner(text, at - 1)
    if "\ufe00" <= text[at] <= "\ufe0f":
        return not before.isalpha() or ord(before) >= 0x2E80 or unicodedata.category(before)[0] == "S"
    if before.isalpha() or unicodedata.category(before)[0] == "M":
        return not _is_latin(before) and before not in LETTER_PAIRS and not 0x370 <= ord(before) < 0x590 and unicodedata.normalize("NFKC", before).isascii() is False
    return unicodedata.category(before) in ("So", "Sk")


def _word_at(text: str, at: int, what: frozenset[str] = frozenset()) -> str:
    """The word around a place: letters, digits, `_`, marks, invisible characters, and those given."""
    a, b = at, at + 1
    while a and (text[a - 1].isalnum() or text[a - 1] in _INNER or text[a - 1] in what):
        a -= 1
    while b < len(text) and (text[b].isalnum() or text[b] in _INNER or text[b] in what):
        b += 1
    return text[a:b]


def _latin_otherwise(word: str) -> bool:
    """Has the word a Latin letter, and no letter that isn't Latin or drawn like one?"""
    latin = False
    for c in word:
        if c.isalpha():
            if _is_latin(c) or unicodedata.normalize("NFKC", c).isascii():
                latin = True
            elif c not in LETTER_PAIRS:
                return False
    return latin


def _in_latin_word(text: str, at: int) -> bool:
    return _latin_otherwise(_word_at(text, at))


class Rewriter:
    """Greedy rewriting with a multi-pattern automaton."""

    def __init__(self, representatives: dict[str, str], names: Iterable[str] = ()) -> None:
        kinds: dict[str, str] = {}
        for variant, plain, kind in edges():
            kinds.setdefault(variant, kind)
        self.automaton = ahocorasick.Automaton()
        self.plain: dict[str, str] = {}
        for member, rep in representatives.items():
            if member == "" or member.isascii():
                continue
            kind = kinds.get(member, "spelling")
            self.automaton.add_word(member, (len(member), rep, kind))
            self.plain[member] = rep
        if len(self.automaton):
            self.automaton.make_automaton()
        self.names = frozenset(n.casefold() for n in names)

    def _skeleton(self, word: str) -> str:
        return "".join(LETTER_PAIRS.get(c, "" if c in INVISIBLE or c in JOINERS else c) for c in unicodedata.normalize("NFKC", word))

    def _latin_word(self, text: str, a: int) -> bool:
        """Is the word around this place otherwise Latin, or exactly the look of a known name?"""
        return _in_latin_word(text, a) or self._skeleton(_word_at(text, a, _HYPHEN)).casefold() in self.names

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, replacement, kind) of the cases and rewritten spellings, in order and without overlap."""
        if not text or text.isascii():
            return []
        out = [(a, b, composed, "decomposed") for a, b, composed in uncomposed(text)]
        sequences = list(out)
        taken = 0
        for end, (size, rep, kind) in self.automaton.iter_long(text) if len(self.automaton) else ():
            a, b = end + 1 - size, end + 1
            while taken < len(sequences) and sequences[taken][1] <= a:
                taken += 1
            if taken < len(sequences) and sequences[taken][0] < b:
                continue  # composed first, then looked at again
            if kind == "look-alike":
                if not self._latin_word(text, a):
                    continue
            elif kind == "invisible":
                c = text[a]
                if c == "\ufeff" and a == 0:
                    continue
                if c in JOINERS and _needs_joiner(text, a):
                    continue
            out.append((a, b, rep, kind))
        return sorted(out) if sequences else out

    def rewrite(self, text: str | None) -> str | None:
        """The consistent form: repeated until nothing changes, for a replacement can complete another case.

        It ends: a round composes, or replaces members by representatives, and no representative is replaced.
        """
        while text and (found := self.find(text)):
            parts, at = [], 0
            for a, b, rep, _ in found:
                parts += (text[at:a], rep)
                at = b
            text = "".join((*parts, text[at:]))
        return text


# -- distributed passes --------------------------------------------------------------------------------------------


def _count_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of class members in a task's texts: one row a member that occurs."""
    known = members()
    single = np.array(sorted(ord(x) for x in known if len(x) == 1 and not x.isascii()), dtype=np.uint32)
    plain_strings = ahocorasick.Automaton()
    for x in known:
        if len(x) > 1 and x.isascii():
            plain_strings.add_word(x, x)
    plain_strings.make_automaton()
    ends = "".join(sorted({x[-1] for x in known if len(x) > 1 and not x.isascii()}))
    marked = re.compile(f".[{ends}]+")
    foreign = re.compile("[" + "".join(LETTER_PAIRS) + "]")
    total: Counter = Counter()
    ascii_total = np.zeros(128, dtype=np.int64)
    for batch in batches:
        col = batch.column(0)
        if col.null_count:
            col = col.drop_null()
        if len(col) == 0:
            continue
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        ascii_total += np.bincount(raw[raw < 128], minlength=128)
        total.update(x for _, x in plain_strings.iter(raw.tobytes().decode("utf-8", "replace")))
        if (raw >= 128).any():
            odd = np.concatenate(([0], np.cumsum(raw >= 128)))
            rel = offsets - offsets[0]
            rows = np.flatnonzero(odd[rel[1:]] > odd[rel[:-1]])
            odd_texts = col.take(pa.array(rows)).to_pylist()
            text = "\n".join(odd_texts)
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            points = points[points >= 128]
            at = np.searchsorted(single, points)
            at[at == len(single)] = 0
            codes, n = np.unique(points[single[at] == points], return_counts=True)
            for code, k in zip(codes.tolist(), n.tolist()):
                c = chr(code)
                if c not in LETTER_PAIRS:
                    total[c] += k
            total.update(x for x in marked.findall(text) if x in known)
            for odd_text in odd_texts:
                for m in foreign.finditer(odd_text):
                    total[m.group()] += _in_latin_word(odd_text, m.start())
    for o in range(33, 127):
        if chr(o) in known and ascii_total[o]:
            total[chr(o)] += int(ascii_total[o])
    if ascii_total[32]:
        total[" "] += int(ascii_total[32])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["member", "n"])


def member_counts(texts: DataFrame, text: str = "text") -> dict[str, int]:
    """Occurrences of every class member over all texts; at most as many rows as the classes have members."""
    counted = texts.select(F.col(text).alias("text")).where("text is not null and text <> ''").mapInArrow(_count_members, "member string, n long")
    return {r["member"]: r["n"] for r in counted.groupBy("member").agg(F.sum("n").alias("n")).collect()}


@functools.lru_cache(maxsize=4)
def _rewriter(reps: tuple[tuple[str, str], ...], names: tuple[str, ...]) -> Rewriter:
    return Rewriter(dict(reps), names)


_FLAGS = "row_id long, garbled boolean, found boolean, kinds string, normalised string"
_FLAG_SCHEMA = pa.schema([("row_id", pa.int64()), ("garbled", pa.bool_()), ("found", pa.bool_()), ("kinds", pa.string()), ("normalised", pa.string())])


def _flag(reps: tuple[tuple[str, str], ...], names: tuple[str, ...], with_encoding: bool, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = _rewriter(reps, names)
        lab = mojibake.labeller() if with_encoding else None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                garbled = lab.garbled(text) if lab else False
                found = [] if garbled else rewriter.find(text)
                if garbled or found:
                    for c, v in zip(out, (row, garbled, any(x[3] != "spelling" for x in found), ",".join(sorted({x[3] for x in found})), rewriter.rewrite(text) if found and with_text else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, _FLAG_SCHEMA)], schema=_FLAG_SCHEMA)

    return work


def flagged(texts: DataFrame, representatives: dict[str, str], names: Iterable[str], with_encoding: bool, with_text: bool = False) -> DataFrame:
    """row_id, garbled, found (a case), kinds and normalised text of the rows (row_id, text) that are garbled, hold a
    case or an ordinary spelling that another one represents."""
    rows = mojibake.suspects(texts.select(F.col("row_id").cast("long").alias("row_id"), "text"))
    work = _flag(tuple(sorted(representatives.items())), tuple(sorted(names)), with_encoding, with_text)
    return rows.mapInArrow(work, _FLAGS).where("row_id is not null")


def unified_rows(fetches: DataFrame, agents: DataFrame, crawlers: DataFrame, with_text: bool = True) -> DataFrame:
    """src, row_id, found, kinds, normalised for every text or agent value that holds a case (found) or a rewritten spelling.

    `crawlers` is the fixed rule pack of crawler names; its names and tokens are collected, and a pack of more than
    MOST_CRAWLERS is refused.  Rows of fetches whose text is garbled are left to the encoding repair.
    """
    if crawlers.count() > MOST_CRAWLERS:
        raise ValueError("the rule pack holds too many crawlers for the driver")
    known = [n for r in crawlers.select("name", "tokens").collect() for n in (r["name"], *(r["tokens"] or ())) if n]
    texts = fetches.select(F.col("fetch_id").alias("row_id"), F.col("text"))
    raws = agents.select(F.col("agent_id").alias("row_id"), F.col("raw").alias("text"))
    reps = choose_representatives(member_counts(texts.select("text").unionByName(raws.select("text"))))
    flags = cut(flagged(texts, reps, known, with_encoding=True, with_text=with_text))
    garbled = flags.where("garbled").select(F.col("row_id").alias("garbled_fetch")).distinct()
    in_texts = flags.where("not garbled").select(F.lit("fetches").alias("src"), "row_id", "found", "kinds", "normalised").join(garbled, F.col("row_id") == F.col("garbled_fetch"), "left_anti").distinct()
    odd_raws = mojibake.suspects(agents.select(F.col("agent_id").alias("row_id"), F.col("raw").alias("text"), "fetch_id"))
    sound = odd_raws.join(garbled, F.col("fetch_id") == F.col("garbled_fetch"), "left_anti").select("row_id", "text")
    in_raws = flagged(sound, reps, known, with_encoding=False, with_text=with_text).select(F.lit("agents").alias("src"), "row_id", "found", "kinds", "normalised").distinct()
    return in_texts.unionByName(in_raws)


def unified_agents(agents: DataFrame, crawlers: DataFrame, unified: DataFrame) -> DataFrame:
    """Every distinct agent value in its consistent form, with the crawler it then names and its number of rows."""
    fixed = unified.where("src = 'agents'").select(F.col("row_id").alias("agent_id"), "normalised")
    tokens = crawlers.select(F.col("name").alias("crawler"), F.explode("tokens").alias("crawler_token"))
    form = F.coalesce("normalised", "raw")
    seen = agents.select("agent_id", "raw").where("raw is not null").join(fixed, "agent_id", "left").select(form.alias("form"), F.col("normalised").isNotNull().alias("rewritten"))
    token = F.lower(F.regexp_extract(F.trim("form"), r"^\*|^[A-Za-z0-9_-]*", 0))
    counted = seen.groupBy("form").agg(F.count("*").alias("n_rows"), F.count_if("rewritten").alias("n_rewritten")).withColumn("token", token)
    return counted.join(tokens, F.col("token") == F.col("crawler_token"), "left").select("form", "token", "crawler", "n_rows", "n_rewritten")
