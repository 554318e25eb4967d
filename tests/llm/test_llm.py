"""The text-corpus operators on small fixtures: brute force, round trips, invariants, and the defined edge cases."""

import itertools
import json
import random
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlquarry.llm import canondup, confusables, mixing, mojibake, packing, pii, residue, termfreq, tokens
from crawlquarry.llm.seedtext import SEEDS

LONG = "Disallow: /a\n" * 60_000


# -- p1 ------------------------------------------------------------------------------------------------------------

NAMES = ["Socape", "Tangle-Bot", "marlinbot"]


@pytest.fixture(scope="module")
def rewriter():
    return confusables.Rewriter(confusables.choose_representatives({}), NAMES)


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("Ｕｓｅｒ－Ａｇｅｎｔ： *", "User-Agent: *"), ("𝐌𝐚𝐫𝐥𝐢𝐧", "Marlin"), ("o\ufb03ce \ufb02int", "office flint"), ("Ku\u0308hl", "K\u00fchl"), ("a\u00a0b\u3000c\u2007d", "a b c d"), ("So\u2060ca\u00adpe\u200b", "Socape"),
        ("S\u03bfcape \u041carlin\u0412\u043et Ex\u0585cap", "Socape MarlinBot Exocap"), ("\u0405\u043e\u0441\u0430\u0440\u0435", "Socape"), ("x\ufeff", "x"), ("Socape\u200d", "Socape"), ("\uff45\u0301", "\u00e9"), ("\u212b \u2126", "\u00c5 \u03a9"),
    ],
)
def test_variants_become_one_form(rewriter, text, plain):
    assert rewriter.rewrite(text) == plain and rewriter.find(text)
    assert not rewriter.find(plain)


@pytest.mark.parametrize("text", ["", "plain\tascii\r\n", "déjà vu", "Не обходите раздел poppy", "Паук", "Αράχνη bot", "“a” – b…", "👩‍💻 ❤️", "صفحه‌ها را", "﻿User-agent: *", "このsorrelページは", "m² 5º", "Страница ABC", "κάθε μήνα 5 µm", "ӕ", LONG])
def test_ordinary_text_stays(rewriter, text):
    assert rewriter.find(text) == [] and rewriter.rewrite(text) == text


def test_classes_are_transitive_and_follow_frequency():
    group = next(g for g in confusables.look_alike_classes() if "A" in g)
    assert {"А", "Α", "Ａ", "𝐀"} <= set(group)
    assert confusables.choose_representatives({})["Ａ"] == "A"
    assert confusables.choose_representatives({"\u00e9": 3, "e\u0301": 5})["e\u0301"] == "\u00e9"


def test_frequency_decides_among_ordinary_spellings():
    group = next(g for g in confusables.look_alike_classes() if "ş" in g)
    assert set(group) >= {"ş", "ș"}
    turkish, romanian = confusables.choose_representatives({"ş": 9, "ș": 2}), confusables.choose_representatives({"ş": 2, "ș": 9})
    assert turkish["ș"] == "ş" and romanian["ş"] == "ș" and "ş" not in turkish
    assert confusables.Rewriter(turkish).rewrite("aș \u2013 s\u0326") == "aş \u2013 ş" and confusables.Rewriter(romanian).rewrite("aş") == "aș"
    assert [k for *_, k in confusables.Rewriter(romanian).find("aş")] == ["spelling"]
    assert confusables.choose_representatives({"е": 10**9})["е"] == "e"  # a variant never represents


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeăŞoé\u0301\u0302\u0323\u0327\u0328\u0307\u1100\u1161\u11a8\uac00\u0915\u093c\u0958x", max_size=12))
def test_canonically_equal_texts_come_out_equal(text):
    r = confusables.Rewriter({}, ())
    nfd = unicodedata.normalize("NFD", text)
    assert r.rewrite(nfd) == r.rewrite(text) or "\u0958" in text
    if "\u0958" not in text:
        assert r.rewrite(text) == unicodedata.normalize("NFC", text)


@pytest.mark.parametrize(("text", "plain"), [("e\u0302\u0323", "\u1ec7"), ("\u00e9\u0323", "\u1eb9\u0301"), ("e\u0323\u0323\u0302", "\u1ec7\u0323"), ("\u1112\u1161\u11ab", "한"), ("\ud558\u11ab", "한"), ("B\u0251\u0261el", "Bagel"), ("pa\u04cfe", "pale"), ("ꓮlpha", "Alpha")])
def test_orders_jamo_and_letters(rewriter, text, plain):
    assert rewriter.find(text) and rewriter.rewrite(text) == plain and not [x for x in rewriter.find(plain) if x[3] != "spelling"]


def test_rewriting_has_no_round_limit(rewriter):
    text = "Ｓ" + "\u200b\u0301" * 50
    once = rewriter.rewrite(text)
    assert rewriter.find(once) == [] and once == "Ś" + "\u0301" * 49


def test_union_find_against_brute_force():
    rnd = random.Random(1)
    for _ in range(50):
        pairs = [(str(rnd.randint(0, 9)), str(rnd.randint(0, 9))) for _ in range(6)]
        sets = confusables.UnionFind()
        for a, b in pairs:
            sets.union(a, b)
        groups = [{x} for x in {y for p in pairs for y in p}]
        for a, b in pairs:
            ga, gb = next(g for g in groups if a in g), next(g for g in groups if b in g)
            if ga is not gb:
                groups.remove(gb)
                ga |= gb
        assert sorted(map(sorted, sets.classes())) == sorted(map(sorted, groups))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAe\u0301\u00e9\uff4f\u200b\u041a -", max_size=20))
def test_rewriting_settles(text):
    r = confusables.Rewriter(confusables.choose_representatives({}), NAMES)
    once = r.rewrite(text)
    assert r.rewrite(once) == once


def test_unified_rows(spark):
    fetches = spark.createDataFrame([(1, "Ｄisallow: /", 0), (2, "cafÃ© Ｄ", 0), (3, None, 0), (4, "", 0), (1, "Ｄisallow: /", 0), (5, "ok", 0)], "fetch_id long, text string, raw int")
    agents = spark.createDataFrame([(1, 5, "Sοcape"), (2, 2, "Sοcape"), (3, 5, None), (4, None, "Socape​"), (5, 5, "*")], "agent_id long, fetch_id long, raw string")
    crawlers = spark.createDataFrame([("Socape", ["socape"]), (None, None)], "name string, tokens array<string>")
    got = sorted((r["src"], r["row_id"], r["normalised"]) for r in confusables.unified_rows(fetches, agents, crawlers).collect())
    assert got == [("agents", 1, "Socape"), ("agents", 4, "Socape"), ("fetches", 1, "Disallow: /")]
    assert all(r["found"] for r in confusables.unified_rows(fetches, agents, crawlers).collect())
    forms = {r["form"]: r["crawler"] for r in confusables.unified_agents(agents, crawlers, confusables.unified_rows(fetches, agents, crawlers)).collect()}
    assert forms["Socape"] == "Socape" and forms["*"] is None
    assert confusables.unified_rows(fetches.limit(0), agents.limit(0), crawlers).count() == 0


def test_member_counts(spark):
    texts = spark.createDataFrame([("office AAＡ",), ("Sοc ο ου",), (None,), ("é",)], "text string")
    got = confusables.member_counts(texts)
    assert got["A"] == 2 and got["Ａ"] == 1 and got["ο"] == 1 and got["é"] == 1 and got["ffi"] == 1


# -- p2 ------------------------------------------------------------------------------------------------------------

ROUND_TRIP = [
    ("utf-8>cp1252", "de"), ("utf-8>latin-1", "cs"), ("utf-8>cp437", "sv"), ("utf-8>mac_roman", "pt"), ("utf-8>cp1251", "ru"), ("utf-8>iso8859-2", "cs"), ("cp1251>cp1252", "ru"), ("koi8-r>cp1251", "ru"),
    ("cp866>cp1252", "ru"), ("cp1253>cp1252", "el"), ("iso8859-2>cp1252", "cs"), ("mac_roman>cp1252", "sv"), ("cp850>cp1252", "pt"), ("shift_jis>cp1252", "ja"), ("euc_jp>cp1252", "ja"), ("utf-8x2>cp1252", "fr"),
]


@pytest.mark.parametrize(("pair", "lang"), ROUND_TRIP)
def test_garbled_lines_are_found_and_restored(pair, lang):
    state = mojibake.STATES.index(pair)
    e, d = mojibake.PAIRS[state - 1]
    sentence = SEEDS[lang].split(". ")[0].split("。")[0].replace("’", "'")
    raw = sentence
    for _ in range(2 if e.endswith("x2") else 1):
        table = {b: c for c, b in mojibake._byte_table(d).items()}
        raw = "".join(chr(table[b]) for b in raw.encode(e.removesuffix("x2")))
    assert raw != sentence
    text = f"User-agent: *\n# {raw}\nDisallow: /x\n"
    lab = mojibake.labeller()
    assert lab.garbled(text)
    fixed, states, whole = lab.restore(text)
    assert fixed == f"User-agent: *\n# {sentence}\nDisallow: /x\n" and whole and states


@pytest.mark.parametrize("lang", sorted(SEEDS))
def test_clean_languages_stay(lang):
    assert not mojibake.labeller().garbled("# " + SEEDS[lang].replace(". ", "\n# "))


@pytest.mark.parametrize("text", [None, "", "plain", "a b", "Sοcape", "Ｕｓｅｒ", "﻿x", "👍 “x” – y…", "Soc­ape", LONG])
def test_clean_oddities_stay(text):
    assert not mojibake.labeller().garbled(text)


def test_lost_and_paired_bytes():
    lab = mojibake.labeller()
    fixed, states, whole = lab.restore("# pr�fen")
    assert (fixed, states, whole) == ("# pr�fen", ["lost"], False)
    fixed, states, whole = lab.restore("��" + "".join(c + "\x00" for c in "User-agent: *\n"))
    assert fixed == "User-agent: *\n" and "utf16" in states


def misread(text: str, e: str, d: str) -> str:
    table = {b: c for c, b in mojibake._byte_table(d).items()}
    rounds, e = (int(e[-1]), e[:-2]) if e[-2] == "x" else (1, e)
    for _ in range(rounds):
        text = "".join(chr(table[b]) for b in text.encode(e))
    return text


@pytest.mark.parametrize(("text", "fixed"), [("Disallow: /café/cafÃ©", "Disallow: /café/café"), ("日本語のページcafÃ©", "日本語のページcafé"), ("日本語のページÃ©tÃ©", "日本語のページété"), ("# Не трогайте/Ð¿Ð°Ð¿ÐºÐ°", "# Не трогайте/папка")])
def test_right_and_wrong_characters_of_one_token(text, fixed):
    assert mojibake.labeller().restore(text)[0] == fixed


@pytest.mark.parametrize(
    ("text", "e", "d"),
    [("中文測試", "big5", "latin-1"), ("Grüße", "latin-1", "iso8859-5"), ("crème brûlée", "utf-8x3", "cp1252"), ("é", "utf-8x3", "latin-1"), ("ไม่ได้รับอนุญาต", "cp874", "cp1252"), ("įėjimas uždarytas į sodą", "cp1257", "cp1252")],
)
def test_more_pairs_are_restored(text, e, d):
    fixed, _, whole = mojibake.labeller().restore("# " + misread(text, e, d))
    assert (fixed, whole) == ("# " + text, True)


def test_near_states_leave_a_text_open():
    lab = mojibake.labeller()
    near = None
    for word in ("şifre", "ığdır", "değişti", "ćwiczenie", "žluť", "ď", "Ž", "ñ", "Å", "ş", "ð", "þ"):
        for e, d in mojibake.PAIRS:
            try:
                raw = misread(word, e, d)
            except (UnicodeError, KeyError):
                continue
            fixed, states, whole = lab.restore("# " + raw)
            if not states or fixed == "# " + word:
                continue
            spans, path, emitted = lab._path("# " + raw)
            total = sum(emitted[i] for i, s in enumerate(path) if s)
            best = max(path)
            others = [s for s in range(1, mojibake.LOST) if total[s] >= total[best] - mojibake.NEAR and mojibake.invert(raw, s) not in (None, mojibake.invert(raw, best))]
            if len(spans) == 1 and others:
                near = whole
    assert near is False


def test_places_to_cut():
    assert mojibake.places_to_cut("éÃ©") == [1] and mojibake.places_to_cut("abc") == [] and mojibake.places_to_cut("日本Ã©t") == [2, 4]


def test_viterbi_is_the_best_path():
    """Against every path, over the states that a token scores best in."""
    lab = mojibake.labeller()
    text = "grÃ¼n à für\n# Ã¤r slo¾ku"
    spans = [m.span(2) for m in mojibake.TOKEN.finditer(text) if m.group(2)]
    breaks = [False, False, False, True, False][: len(spans)]
    scores = [lab.scores(text[a:b])[0] for a, b in spans]
    some = sorted({0, *(int(s.argmax()) for s in scores)})

    def cost(path):
        total = (mojibake.START_CLEAN if path[0] == 0 else mojibake.START_OTHER) + scores[0][path[0]]
        for k in range(1, len(path)):
            a, b = path[k - 1], path[k]
            line = breaks[k]
            step = max([mojibake.LINE_STAY if line else mojibake.LOG_STAY] * (a == b) + [mojibake.LINE_SWITCH if line else mojibake.LOG_SWITCH] + [mojibake.LINE_CLEAN] * (line and b == 0))
            total += step + scores[k][b]
        return total

    best = max(itertools.product(some, repeat=len(spans)), key=cost)
    got = {(a, b): s for a, b, s in lab.label(text)}
    assert [got.get(s, 0) for s in spans] == list(best)


def test_garbled_rows(spark):
    rows = [(1, "grÃ¼n", 0), (1, "grÃ¼n", 0), (2, None, 0), (3, "", 0), (4, "ok", 0), (5, "x\x00y\x00", 0), (None, "grÃ¼n", 0)]
    df = spark.createDataFrame(rows, "fetch_id long, text string, row_id int")
    assert sorted(r[0] for r in mojibake.garbled_rows(df).collect()) == [1, 5]
    assert [r["restored"] for r in mojibake.restored_rows(df).where("row_id = 1").collect()] == ["grün"]
    assert mojibake.garbled_rows(df.limit(0)).count() == 0


# -- p3 ------------------------------------------------------------------------------------------------------------


def brute_key(text):
    import re

    lines = ["".join(c for c in x.lower() if c.isalnum()) for x in re.split(r"\r\n|\r|\n", text or "")]
    return tuple(sorted(x for x in lines if x))


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_copies_of_texts_against_brute_force(spark, parts):
    rnd = random.Random(int(parts))
    pool = ["a", "A ", "b-", "", "#", "é", "E", "b", "ſ"]
    rows = [(rnd.randint(1, 400), rnd.choice(["\n", "\r\n", "\r"]).join(rnd.choices(pool, k=rnd.randint(0, 4)))) for _ in range(500)]
    rows += [(1000 + i, "hot\nGroup") for i in range(400)] + [(5000, None), (5001, "  ")]
    rows = list({r[0]: r for r in rows}.values())
    rows += rows[:30]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        keyed = canondup.text_keys(spark.createDataFrame([(*r, 1) for r in rows], "fetch_id long, text string, key int"))
        got = sorted((r["keep_id"], r["copy_id"]) for r in canondup.copy_pairs(keyed).collect())
        sizes = sorted((r["keep_id"], r["copies"]) for r in canondup.distinct_contents(keyed).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    sets = defaultdict(set)
    for i, t in rows:
        if brute_key(t):
            sets[brute_key(t)].add(i)
    assert got == sorted((min(s), i) for s in sets.values() for i in s if i != min(s))
    assert sizes == sorted((min(s), len(s)) for s in sets.values())


def test_record_keys():
    k = canondup.record_key
    a = {"domain": "A.example", "n": 1, "crawlers": {"X": "open", "Y": None}, "ok": True}
    same = [
        json.dumps(a), json.dumps(dict(reversed(a.items()))), json.dumps(a, indent=1), json.dumps(a).replace('"', "'"), json.dumps(a)[:-1] + ",}", json.dumps(a) + ",", "  " + json.dumps(a) + ";",
        '{"DOMAIN":"a.EXAMPLE.","N":"1","crawlers":{"y":null,"x":"Open"},"ok":true}', '{"dom\\u0061in":"a example","n":1,"crawlers":{"X":"open","Y":null},"ok":true}',
    ]
    assert len({k(x) for x in same}) == 1
    other = [json.dumps(a | {"n": 2}), json.dumps(a | {"crawlers": {"X": "open"}}), json.dumps({x: y for x, y in a.items() if x != "ok"}), json.dumps(a | {"crawlers": {"X": None, "Y": "open"}}), "[1]", "not json"]
    assert len({k(x) for x in [same[0], *other]}) == 7
    assert k(None) is None and k("") is None and k(" .,") is None and k("{}") is None
    assert k("Not  JSON!") == k("not json") and k("{" * 50) is None and k('{"a":') is not None


def test_record_pairs(spark):
    df = spark.createDataFrame([(3, '{"a":1}', 0), (1, "{'A': '1'}", 0), (2, None, 0), (4, '{"a":2}', 0)], "line_id long, raw string, id int")
    assert [tuple(r) for r in canondup.copy_pairs(canondup.record_keys(df)).collect()] == [("record_lines", 1, 3)]
    assert canondup.copy_pairs(canondup.record_keys(df.limit(0))).count() == 0


# -- p4 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("flush", [3, 2_000_000])
def test_counts_against_a_dictionary(spark, flush):
    rnd = random.Random(flush)
    rows = [(rnd.choice("ab"), rnd.choice(["x", "xy", "xyz" * 9, "é", "/a/b", "", None, " "]), rnd.choice([1, 2, 3, 4, None])) for _ in range(600)]
    rows += [("a", "hot", i) for i in range(500)] + [("a", f"/long/prefix/of/term/{i}", i) for i in range(300)]
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"]) for r in termfreq.term_counts(spark.createDataFrame([(*r, 0) for r in rows], "field string, term string, record_id long, n int"), flush).collect()}
    want: dict = {}
    for f, t, i in rows:
        if t:
            n, s = want.setdefault((f, t), [0, set()])
            want[f, t][0] += 1
            if i is not None:
                s.add(i)
    assert got == {k: (n, len(s)) for k, (n, s) in want.items()}


def test_burst_trie():
    trie = termfreq.BurstTrie(burst_at=4)
    words = ["", "a", "ab", "abc", *[f"ab{i}" for i in range(30)], "b"]
    for w in words * 2:
        trie.add(w, 1, np.array([len(w)]))
    got = list(trie.items())
    assert trie.bursts > 1 and sorted(t for t, _, _ in got) == sorted(words) and all(n == 2 and list(ids) == [len(t)] for t, n, ids in got)


def test_ids_of_a_leaf_are_merged(monkeypatch):
    monkeypatch.setattr(termfreq, "MERGE_AT", 8)
    trie = termfreq.BurstTrie()
    for i in range(1000):
        trie.add("hot", 1, np.array([i % 50]))
        assert trie.held <= 120
    [(term, n, ids)] = trie.items()
    assert (term, n, list(ids)) == ("hot", 1000, list(range(50)))


def test_values_without_records_are_written_out(spark):
    """Null record ids hold no ids, but their values fill the trie as well."""
    rows = [("f", f"v{i}", None) for i in range(500)]
    work = termfreq._map_side({}, 10)
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([r[2] for r in part], pa.int64())], names=["field", "term", "record_id"])
    out = list(work(iter([batch(rows[i : i + 20]) for i in range(0, 500, 20)])))
    assert len(out) == 25 and sum(b.num_rows for b in out) == 500


def test_salts_follow_the_share_of_a_value(spark):
    rows = [("f", "hot", i) for i in range(3000)] + [("f", f"cold{i}x", i) for i in range(6000)]
    values = spark.createDataFrame(rows, "field string, term string, record_id long")
    hot = termfreq.hot_prefixes(values, 20)
    assert hot["f", "hot"] == 27 and termfreq.route_of("f", "hot", hot) == ("hot", 27) and hot["f", "cold"] == 54  # of 80 fair shares
    assert termfreq.route_of("f", "cold5x", hot) == ("cold5x", 1) and termfreq.route_of("f", "other", hot) == ("ot", 1)
    assert len(set(termfreq._salt_of(np.arange(3000), 27).tolist())) == 27 and termfreq.hot_prefixes(values.limit(0), 20) == {}


def test_marks(spark):
    rows = [("f", "common", i) for i in range(10)] + [("f", "rare", 1), ("f", "rare", 1), ("f", "mid", 1), ("f", "mid", 2), ("f", "mid", 3)] + [("f", "other", i) for i in range(10, 40)]
    got = {r["term"]: r["mark"] for r in termfreq.marked_terms(spark.createDataFrame(rows, "field string, term string, record_id long")).collect()}
    assert got == {"common": "common", "rare": "rare", "mid": None, "other": "common"}
    assert termfreq.marked_terms(spark.createDataFrame([], "field string, term string, record_id long")).count() == 0


# -- p6 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Sitemap: https://{{ site.url }}/s.xml", "placeholder"), ("Disallow: /${path}/", "placeholder"), ("Host: %%HOST%%", "placeholder"), ("# [[name]]", "placeholder"), ("Sitemap: <your sitemap address>", "placeholder"),
        ("Sitemap: __base_url__/s.xml", "placeholder"), ("Disallow: /{0}/", "placeholder"), ("# XXXX-NAME-XXXX", "placeholder"), ("{% include 'x' %}", "placeholder"), ("<?php echo $x; ?>", "placeholder"), ("# TODO: add the rules", "placeholder"),
        ("Host: replace-me", "placeholder"), ("Lorem ipsum dolor sit amet", "filler"), ("asdf asdf qwer asdf test test", "filler"), ("Your text here. Your text here.", "filler"), ("Error 404: Not Found", "message"),
        ("<html><title>502 Bad Gateway</title>", "message"), ('{"error":"gone"}', "message"), ("Traceback (most recent call last):", "message"), ("Seite nicht gefunden", "message"), ("Access denied.", "message"),
        ("Please enable JavaScript", "script notice"), ("Bitte aktivieren Sie JavaScript, um x zu nutzen", "script notice"), ("<noscript>x</noscript>", "script notice"),
    ],
)
def test_residue_is_found(text, kind):
    assert kind in residue.residue_kinds(text)
    assert kind in residue.residue_kinds("User-agent: *\r\nDisallow: /x\r\n" + text)


@pytest.mark.parametrize(
    "text",
    [
        None, "", "User-agent: *\nDisallow: /todo/\nDisallow: /lorem/\nAllow: /your-account/\nDisallow: /errors/404\nDisallow: /maintenance/", "# error pages live under /errors/x\n# forbidden means 403 here, not 404", "# the old TODO list is gone",
        "# no JavaScript is needed to read these pages", "# set {a, b} shares one rule", "Disallow: /*?m[]=\nDisallow: /__cache/\nDisallow: /%7Ea/%e2%82%ac/", "# dummy rule for x removed", "<html><body><p>Opening hours 8:00 to 18:00</p></body></html>",
        "# write `{{ name }}` for a placeholder, for example", "\ufffd\ufffd# no JavaScript is needed to read these pages", LONG,
    ],
)
def test_mentions_are_no_residue(text):
    assert residue.residue_kinds(text) == []


FILLER = "lorem dorenim litus tenscit rutem perequa nandro viderim"


@pytest.mark.parametrize("text", [f"# 218z4r\nUser-agent: *\n# {FILLER}", f"User-agent: *\r\nDisallow: /x # {FILLER}", f"## {FILLER.replace('lorem', 'sapta')}", "#Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod", "# asdf asdf qwer asdf test test"])
def test_comment_of_filler_is_residue(text):
    assert residue.residue_kinds(text) == ["filler"]


@pytest.mark.parametrize("text", ["# the lorem ipsum paragraph was taken out", f'# "{FILLER}" is gone', f"# for example {FILLER}", "# error pages live under /errors/ember --", "# lorem ipsum removed", f"User-agent: *\nDisallow: /{FILLER.replace(' ', '/')}/#{FILLER}"])
def test_comment_that_mentions_filler_is_none(text):
    assert residue.residue_kinds(text) == []


@pytest.mark.parametrize(
    "text",
    ["Sitemap: https://{{ " + "a" * 500 + " }}/x", "x <%\n foo\n%> y", "{{#if\n x}}", "<?php echo\n 1 ?>", "<?php open", "${" + "a" * 200 + "}", "Welcome to {company}", "Host: [[" + "site_" * 40 + "]]", "{{ a {{ b }}", "%%" + "A" * 100 + "%%"],
)
def test_placeholders_of_any_length_and_across_lines(text):
    assert residue.residue_kinds(text) == ["placeholder"]


@pytest.mark.parametrize("text", ["{{", "{{ }}", "{% %", "<% " * 20_000, "{{ " * 20_000, "${" * 20_000 + "}", "[[1]]", "${a b}", "Disallow: /{a,b}/", "# set {opal, fable} shares one rule", "# {lower} then {upper}, for example"])
def test_open_delimiters_are_no_placeholders(text):
    assert residue.residue_kinds(text) == []


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Error establishing a database connection", "message"), ("Sorry, nothing lives at this address.", "message"), ("Server said no.", "message"), ("Der Server antwortet leider nicht", "message"),
        ("Bitte schalten Sie Skripte ein", "script notice"), ("Scripts need to run here", "script notice"),
    ],
)
def test_sentences_dense_in_cues(text, kind):
    assert residue.residue_kinds(text) == [kind] and residue.residue_kinds(f"<html><body><p>{text}</p></body></html>") == [kind]


@pytest.mark.parametrize("text", ["do not crawl this site", "We are closed on Sundays, but our shop has many pages with goods of all kinds.", "# the server said no", "Disallow: /server-error", "no", "<p>Our site shows maps and tours; no guide is needed for most of them.</p>"])
def test_ordinary_sentences_are_not_dense(text):
    assert residue.residue_kinds(text) == []


def test_placeholders_alone(spark):
    bodies = spark.createDataFrame(
        [("a", 1, "x {{ y }}\n${z}", 0), ("a", 1, "x {{ y }}\n${z}", 0), ("a", 2, "# for example {{ y }}", 0), ("a", 3, "Internal Server Error", 0), ("a", 4, None, 0), ("a", 5, "", 0), ("a", 6, "Disallow: /", 0)], "src string, row_id long, body string, weight int"
    )
    got = {r["row_id"]: (r["n_full"], r["n_discounted"], r["weight"], r["grammars"]) for r in residue.placeholder_rows(bodies).collect()}
    assert got == {1: (2, 0, 2.0, ["dollar brace", "double brace"]), 2: (0, 1, 0.0, ["double brace"])}
    assert residue.placeholder_rows(bodies.limit(0)).count() == 0


def test_residue_tables(spark):
    bodies = spark.createDataFrame([("a", 1, "Error 404: Gone", 0), ("a", 1, "Error 404: Gone", 0), ("a", 2, None, 0), ("a", 3, "", 0), ("a", 4, "Disallow: /", 0)], "src string, row_id long, body string, kinds int")
    assert [tuple(r) for r in residue.residue_rows(bodies).collect()] == [("a", 1, "message")]
    assert sorted(r["row_id"] for r in residue.without_residue(bodies).collect()) == [2, 3, 4]
    assert residue.residue_rows(bodies.limit(0)).count() == 0


# -- p7, p8 --------------------------------------------------------------------------------------------------------


def test_packer_never_overfills():
    rnd = random.Random(2)
    p = packing.Packer(100, 4)
    used: Counter = Counter()
    for _ in range(2000):
        s = rnd.randint(0, 100)
        used[p.put(s)] += s
    assert max(used.values()) <= 100 and sum(used.values()) / (100 * len(used)) > 0.8
    parts = list(packing.Packer(10).split(35))
    assert [(a, n) for _, _, a, n in parts] == [(0, 10), (10, 10), (20, 10), (30, 5)] and len({w for w, *_ in parts}) == 4
    with pytest.raises(ValueError):
        packing.Packer(0)


def test_packed(spark):
    rnd = random.Random(4)
    docs = [(i, "s1" if i % 3 else "s2", " ".join(["word"] * rnd.randint(0, 60)), 9) for i in range(400)] + [(900, "s1", None, 9), (901, None, "x " * 900, 9), (5, "s1", "word", 9)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, container int").repartition(70)
    limits = spark.createDataFrame([(1, 64, None), (2, 200, "s2"), (3, 10, "none")], "pack_id int, capacity_tokens int, source string")
    rows = packing.packed(df, limits, windows=3).collect()
    used, per_doc = Counter(), defaultdict(list)
    for r in rows:
        used[r["pack_id"], r["container"]] += r["n_tokens"]
        per_doc[r["pack_id"], r["doc_id"]].append((r["piece"], r["first_token"], r["n_tokens"]))
    caps = {1: 64, 2: 200}
    assert all(n <= caps[p] for (p, _), n in used.items())
    sizes = {i: tokens.count(t) for i, _, t, _ in docs if t is not None and i != 5}
    for i, n in sizes.items():
        pieces = sorted(per_doc[1, i])
        assert sum(x[2] for x in pieces) == n and (len(pieces) == 1) == (n <= 64)
    assert len(per_doc[1, 5]) == 2 and {d for p, d in per_doc if p == 2} == {i for i, s, t, _ in docs if s == "s2"}
    total = sum(n for (p, _), n in used.items() if p == 1)
    assert total / (64 * len([1 for p, _ in used if p == 1])) > 0.85
    report = {r["pack_id"]: r for r in packing.fill_report(packing.packed(df, limits, windows=3), limits).collect()}
    assert report[1]["tokens"] == total and report[1]["fullest"] <= 64
    assert packing.packed(df.limit(0), limits).count() == 0


def test_texts_without_an_id_are_packed(spark):
    docs = spark.createDataFrame([(None, "s", "word word word"), (1, "s", "word word"), (None, "s", None)], "doc_id long, source string, text string")
    limits = spark.createDataFrame([(1, 64, None)], "pack_id int, capacity_tokens int, source string")
    rows = packing.packed(docs, limits).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(tokens.count(t) for t in ("word word word", "word word")) and {r["doc_id"] for r in rows} == {None, 1}


def test_mixed(spark):
    docs = [(i, "big", f"text number {i} " + "word " * (i % 7), 0) for i in range(600)] + [(1000 + i, "small", f"small text {i} " + "word " * 5, 0) for i in range(60)] + [(2000, "small", "small text 0 word word word word word ", 0), (3000, None, "x", 0), (3001, "big", None, 0), (3002, "unused", "y", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, copies int")
    targets = spark.createDataFrame([(1, "big", 0.5, 1), (1, "small", 0.4, 3), (1, "missing", 0.1, 2), (2, "small", 1.0, None)], "mix_id int, source string, target_share double, max_repeats int")
    rows = mixing.mixed(df, targets).collect()
    copies = Counter((r["mix_id"], r["doc_id"]) for r in rows)
    cap = {"big": 1, "small": 3}
    src = {i: s for i, s, _, _ in docs}
    assert all(n <= cap[src[d]] for (m, d), n in copies.items() if m == 1) and not {2000, 3000, 3001, 3002} & {d for _, d in copies}
    report = {(r["mix_id"], r["source"]): r for r in mixing.share_report(df, targets).collect()}
    assert abs(report[1, "small"]["actual_share"] - 0.4 / 0.9) < 0.06 and report[1, "missing"]["tokens"] == 0 and report[2, "small"]["actual_share"] == 1.0
    assert sum(r["tokens"] for k, r in report.items() if k[0] == 1) == sum(r["n_tokens"] for r in rows if r["mix_id"] == 1)
    again = Counter((r["mix_id"], r["doc_id"]) for r in mixing.mixed(df.repartition(9), targets).collect())
    assert again == copies
    forced = {(r["mix_id"], r["source"]): r for r in mixing.share_report(df, targets, total_tokens=1e9).collect()}
    assert forced[1, "small"]["rate"] == 3.0 and forced[1, "small"]["most_copies"] == 3 and forced[1, "big"]["most_copies"] == 1
    assert mixing.mixed(df.limit(0), targets).count() == 0


# -- p9 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("mail a.b+c@host.example now", "email"), ("crawl-desk(at)prism.invalid", "email"), ("zofia [at] mica [dot] invalid", "email"), ("webmaster AT meadow DOT example", "email"), ("+44 1632 960876", "phone"), ("00 33 1 99 00 83 24", "phone"),
        ("(303) 555-0165", "phone"), ("503.555.0143", "phone"), ("030/23125885", "phone"), ("tel:+12025550141", "phone"), ("+４４ ７７００ ９００３９２", "phone"), ("SSN 123-45-6789", "id_number"), ("QQ 46 62 32 B", "id_number"), ("DNI 00068325-S", "id_number"),
        ("00 393 590 219", "id_number"), ("passport no. K0N1J6GK8", "id_number"), ("2 00 21 99 873 904 24", "id_number"), ("37 N Marrow Blvd Apt 38", "address"), ("Möwenweg 65", "address"), ("7, rue des Tilleuls", "address"), ("C/ del Puente 8, 4º B", "address"), ("ul. Lipowska 12/3", "address"),
    ],
)
def test_grammars(text, kind):
    assert [k for _, _, k in pii.grammar_spans(text)] == [kind]


@pytest.mark.parametrize("at", ["(at)", "[AT]", "{ at }", "<At>", " at ", " AT ", "(ät)", " (ät) ", "[chez]", "(arroba)", " arroba ", " (a) ", "&#64;", "&commat;", "%40"])
def test_mailboxes_pass_the_gate(at):
    assert [k for _, _, k in pii.grammar_spans(f"Fragen: maren{at}moos.example")] == ["email"]


@pytest.mark.parametrize("text", ["", "robots-lint@8.0.5", "%u@%h and @SoundSkua", "Log export 2841725868901", "Serial 4188-1541-48", "45.893.38/2 and 20260936-1510", "2026-01-18, 18.01.2026", "from 203.0.113.180", "Build 4.9.7.830", "See section 30, Chart Street edition", "Hall 48. Lane 17 of x", "0x50C4FF5BE8", "Ticket OPS-15061 at 05:42", "Body hash f6a49c3ac63d0123"])
def test_look_alikes_of_numbers(text):
    assert pii.grammar_spans(text) == []


def corpus():
    rnd = random.Random(8)
    given, family = ["Zofia", "Oskar", "Maren", "Tomas"], ["Kestermann", "Vorlund", "Brånvik", "d'Orvane"]
    rows = []
    for i in range(160):
        g, f = rnd.choice(given), rnd.choice(family)
        local = pii.unicodedata.normalize("NFKD", f"{g}.{f}".lower().replace("'", "")).encode("ascii", "ignore").decode()
        rows.append((i, rnd.choice([f"Reviewed by {g} {f} last week. Mail {local}@host.example", f"I asked {g} {f} about it, see {local}@host.example.", f"Project Amber Pebble starts. {g} {f} approved the change, {local}@x.test"])))
    return rows + [(500 + i, "Project Amber Pebble starts on 2026-01-02. The Raven Satin edition.") for i in range(60)] + [(900, "Reviewed by Иван Петров last week."), (901, "I asked Иван Петров about it, twice."), (902, None), (903, ""), (904, "KESTERMANN, Zofia and O. Vorlund; lol ask maren brånvik")]


def test_names_are_learned_from_the_corpus(spark):
    docs = spark.createDataFrame([(*r, 0) for r in corpus()], "doc_id long, text string, term int")
    terms = {r["term"] for r in pii.term_disclosure(docs).collect()}
    assert {pii.fold(x) for x in ("Zofia", "Kestermann", "Vorlund", "d'Orvane")} <= terms and not {pii.fold(x) for x in ("Amber", "Pebble", "Raven", "Reviewed")} & terms
    assert {pii.fold("Иван"), pii.fold("Петров")} <= terms  # from contexts alone
    found = defaultdict(set)
    for r in pii.found_kinds(docs).collect():
        found[r["doc_id"]].add(r["kind"])
    assert all("name" in found[i] and "email" in found[i] for i in range(160)) and "name" in found[904] and not any(i in found for i in (*range(500, 560), 902, 903))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[904] == "[NAME] and [NAME]; lol ask [NAME]" and clean[500] == corpus()[160][1] and clean[902] is None and clean[903] == ""


def test_false_hits_of_the_bit_table_change_nothing(spark, monkeypatch):
    rows = [*corpus(), (904, "Twice under one key: Zofia Vorlund"), (None, "Maren Brånvik-Vorlund, without a key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = pii.term_disclosure(docs)
    results = lambda: [sorted(map(repr, f(docs, terms).collect())) for f in (pii.found_kinds, pii.sanitised, pii.disclosing_texts)]
    want = results()
    monkeypatch.setattr(pii, "term_table", lambda _: pii.TermTable(b"\xff" * (pii.TABLE_BITS >> 3)))
    assert results() == want and len(want[1]) == len(rows)


def test_tables_follow_the_plain_form(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    terms = pii.term_disclosure(docs)
    known = frozenset(r["term"] for r in terms.collect())
    want = {(i, k) for i, t in corpus() if t for _, _, k in pii.all_spans(t, known)}
    assert {(r["doc_id"], r["kind"]) for r in pii.found_kinds(docs, terms).collect()} == want
    method = pii.disclosing_texts(docs, terms).collect()
    assert {r["doc_id"] for r in method if r["in_name"]} == {i for i, k in want if k == "name"} and {r["term"] for r in method} <= known
    assert all(r["bits"] >= 1 and r["source"] in ("mailbox", "context") for r in method)


def test_method_on_empty_and_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string").withColumn("term", F.lit("clash"))
    for f in (pii.term_disclosure, pii.disclosing_texts, pii.found_kinds):
        assert f(docs).count() == 0 and f(docs.limit(0)).count() == 0


def test_names_of_one_text_only(spark):
    """One text each, no term twice: a title, a closing, a label, an author with a deed, a mailbox of both terms."""
    texts = [
        "Dr. Alma Reuther approved the list.", "Please look at it.\nBest regards,\nIngo Falkner", "Owner of the rule: Petra Holm", "I asked Sven Adler, he wrote that rule", "Bo Li wrote it, bo.li@host.example",
        "Nils Krag | nkrag@host.example", "Reviewed by Dr. Xu Wei last week.", "Liebe Grüße\nJana Moor",
    ]
    plain = [f"Project Amber Pebble{i} starts on 2026-01-02. The Raven Satin edition, see Hall {i}. Crawler Desk asked for /x." for i in range(40)]
    rows = list(enumerate([*texts, *plain]))
    found = {r["doc_id"] for r in pii.found_kinds(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["kind"] == "name"}
    assert found == set(range(len(texts)))


@pytest.mark.skipif(not Path("/root/testdata/sf0.1/documents.parquet").exists(), reason="needs the test data")
def test_names_at_a_small_scale(spark):
    """Of the names that the terms of a ten times larger table show, nine in ten are found from the small table alone."""
    large, small = (spark.read.parquet(f"/root/testdata/sf{x}/documents.parquet") for x in ("0.1", "0.01"))
    want = {r["doc_id"] for r in pii.found_kinds(small, pii.term_disclosure(large)).collect() if r["kind"] == "name"}
    got = {r["doc_id"] for r in pii.found_kinds(small).collect() if r["kind"] == "name"}
    assert len(want) > 100 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(got)


def test_a_label_belongs_to_the_number_behind_it():
    text = "Tél. +44 7700 900427 Pièce d'identité : 9625075033, and 7712345678 serves as proof of identity"
    assert [k for _, _, k in pii.grammar_spans(text)] == ["phone", "id_number", "id_number"]


def test_long_contexts_and_long_names():
    word = "x" * 60
    assert pii.left_context(f"{word} {word} ", 122) == f"{word} {word}" and pii.right_context(f" {word} {word} b", 0) == f"{word} {word}"
    assert [(a, b) for a, b, _, _ in pii.candidate_pairs("by Bo Li, Xu Wei")] == [("Bo", "Li"), ("Li", "Xu"), ("Xu", "Wei")]


@pytest.mark.parametrize(
    ("text", "street"),
    [("Jl. Sudirman 5", "Jl. Sudirman 5"), ("in der Langen Straße 7a.", "Langen Straße 7a"), ("Paseo de las Flores, 18", "Paseo de las Flores, 18"), ("ul. Nowy Świat 12/3", "ul. Nowy Świat 12/3"), ("ул. Ленина, д. 4", "ул. Ленина, д. 4"), ("(C/ Mayor 3)", "C/ Mayor 3"), ("x Hauptstraße 5 y", "Hauptstraße 5")],
)
def test_addresses(text, street):
    assert [text[a:b] for a, b in pii.addresses(text)] == [street]


@pytest.mark.parametrize("text", ["line 12", "Version 4 ab", "Regel 7", "Zeile 3\n4", "x", "5", "12 rules", "Der Weg 400000", "am 5", "Die Straße 5 Sekunden", "zählt 25 Gruppen. Projekt Grove Quartz beginnt"])
def test_no_addresses(text):
    assert list(pii.addresses(text)) == []


def test_no_names_without_evidence(spark):
    docs = spark.createDataFrame([(1, "Anna Berg and Carl Dahl")], "doc_id long, text string")
    assert pii.found_kinds(docs).count() == 0 and pii.found_kinds(docs.limit(0)).count() == 0


def test_queries_are_complete():
    from crawlquarry.llm import queries

    for n in (1, 2, 3, 4, 6, 9):
        assert f"p{n}_found" in queries.QUERIES
    assert any(q.startswith("p7_") for q in queries.QUERIES) and any(q.startswith("p8_") for q in queries.QUERIES)
    assert set(queries.SQL) <= set(queries.QUERIES)
