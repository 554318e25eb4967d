"""Parsing, matching, findings, recon and roll-ups on small files, and random paths against a plain Python version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from crawlquarry import config as C
from crawlquarry.functions import text as T
from crawlquarry.functions.messages import plural_category, substitute, worded
from crawlquarry.functions.presentation import html_of, rendered
from crawlquarry.operators import findings as G
from crawlquarry.operators import match as M
from crawlquarry.operators import parse as P
from crawlquarry.operators import recon as R
from crawlquarry.operators import rollup as U


def parsed(spark, *texts, site="https://site.example"):
    return P.parse(spark.createDataFrame([(i, t, site) for i, t in enumerate(texts)], "file_id long, text string, site_url string"))


CRAWLERS = [(1, "MarlinBot", ["marlinbot"], "search"), (2, "Loom", ["loomreader-image", "loomreader"], "ai_training"), (3, "Other", ["other"], "ai_training")]


def crawlers(spark):
    return spark.createDataFrame(CRAWLERS, "ord int, name string, tokens array<string>, category string")


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_empty_null_and_odd_files(spark):
    p = parsed(spark, "", None, "﻿User-agent: *\r\nDisallow: /a", "#\n\n  \n:\nfoo")
    assert ids(P.lines(p), "file_id", "line", "kind") == [
        (0, 1, "blank"), (1, 1, "blank"), (2, 1, "user-agent"), (2, 2, "rule"), (3, 1, "comment"), (3, 2, "blank"), (3, 3, "blank"), (3, 4, "unknown"), (3, 5, "invalid"),
    ]
    assert ids(P.rules(p), "file_id", "group_id", "path") == [(2, 1, "/a")]
    assert p.limit(0).count() == 0 and P.groups(p.limit(0)).count() == 0


def test_line_ends_keep_the_last_empty_line(spark):
    assert P.lines(parsed(spark, "a:1\rb:2\r\nc:3\n")).count() == 4


def test_groups_continue_over_blank_comment_and_sitemap_lines(spark):
    text = "Disallow: /early\nUser-agent: a\n\n# x\nSitemap: https://s.example/m.xml\nUser-agent: b\nDisallow: /x\nCrawl-delay: 5\nCrawl-delay: 9\nUser-agent: c\nAllow:\n"
    p = parsed(spark, text)
    assert ids(P.groups(p), "group_id", "start_line", "end_line", "crawl_delay", "n_agents", "n_rules") == [(1, 2, 9, 5.0, 2, 1), (2, 10, 11, None, 1, 1)]
    assert ids(P.agents(p), "group_id", "token") == [(1, "a"), (1, "b"), (2, "c")]
    assert ids(G.syntax_findings(p).where("id like 'parser.crawlDelayDup%' or id = 'parser.ruleBeforeAgent' or id = 'parser.emptyAllow'"), "id", "line") == [("parser.crawlDelayDuplicate", 9), ("parser.emptyAllow", 11), ("parser.ruleBeforeAgent", 1)]


def test_field_repairs(spark):
    p = parsed(spark, "User​-agent： MarlinBot/2.1\nDisalow: /a\nDisаllow: /b\n- Allow: /c\nDiisallow: /d\nnoindex: /e\nai: x\nhost: h.example\nhost: i.example")
    assert ids(P.rules(p), "type", "path") == [("allow", "/c"), ("disallow", "/a"), ("disallow", "/b"), ("disallow", "/d")]
    assert ids(P.agents(p), "raw", "token") == [("MarlinBot/2.1", "marlinbot")]
    found = ids(G.syntax_findings(p), "id")
    for want in ("parser.invisibleChar", "parser.fullwidthColon", "parser.misspelling", "parser.homoglyph", "parser.junkBeforeField", "parser.noindex", "parser.aiDirective", "parser.hostObsolete", "parser.hostDuplicate", "parser.tokenTail"):
        assert want in found
    assert ids(P.hosts(p), "value") == ["h.example"]


def test_utf16_text_is_repaired(spark):
    p = parsed(spark, "".join(c + "\x00" for c in "User-agent: *\nDisallow: /x"))
    assert ids(P.rules(p), "path") == ["/x"] and "parser.utf16" in ids(G.syntax_findings(p), "id")


def test_file_level_findings(spark):
    p = parsed(spark, "<p>hi</p>\nUser-agent: *\nDisallow: /", "<!doctype html><script>eval(1)</script>", "User-agent: *\nDisallow:", "<script>eval(1)</script>\n<b>Warning</b>: x\nlitespeed cache\n�", "x" * 512_001)
    f = G.syntax_findings(p)
    has = lambda n: set(ids(f.where(F.col("file_id") == n), "id"))
    assert {"parser.htmlFragment", "parser.starBlocksAll", "parser.noSitemap"} <= has(0)
    assert "parser.htmlFragment" not in has(1) and "parser.noRules" in has(1)
    assert {"security.injectedCode", "parser.serverErrorOutput", "parser.pluginOutput", "parser.invalidUtf8"} <= has(3)
    assert {"parser.tooLarge", "parser.longLine"} <= has(4)


def test_content_signal_and_glued_comments(spark):
    p = parsed(spark, "User-agent: *\nContent-Signal: search=yes, ai-train=no\nContent-Signal: search=maybe\n# end.Disallow: /x\n# Disallow: /y\nDisallow: /a#b\nDisallow: /img/.*|x\nDisallow: no slash")
    got = ids(G.syntax_findings(p).where("phase = 1"), "id", "line")
    for want in (("parser.contentSignal", 2), ("parser.contentSignalInvalid", 3), ("parser.gluedComment", 4), ("lint.commentedRule", 5), ("parser.hashInValue", 6), ("parser.regexSyntax", 7), ("parser.pathNoSlash", 8), ("parser.spaceInPath", 8)):
        assert want in got


def plain_norm(s):
    out = []
    for part in re.findall(r"(?s)%[0-9A-Fa-f]{2}|.", s):
        if len(part) == 3:
            c = chr(int(part[1:], 16))
            out.append(c if re.fullmatch(r"[A-Za-z0-9\-._~]", c) else part.upper())
        elif "!" <= part <= "~":
            out.append(part)
        else:
            out.append("".join(f"%{b:02X}" for b in part.encode()))
    return "".join(out)


def plain_match(pattern, path):
    pattern, path = plain_norm(pattern), plain_norm(path)
    anchored = pattern.endswith("$")
    body = pattern[:-1] if anchored else pattern
    return re.match(".*".join(map(re.escape, body.split("*"))) + ("$" if anchored else ""), path, re.S) is not None


def test_paths_and_patterns_against_plain_python(spark):
    rnd = random.Random(7)
    chars = ["/", "a", "b", "*", "$", "%41", "%2f", "%zz", "_", "?", "é", "\\", ".", "%", "😀", " "]
    rows = [("/" + "".join(rnd.choices(chars, k=rnd.randint(0, 6))), "/" + "".join(rnd.choices([c for c in chars if c != "*"], k=rnd.randint(0, 8)))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "pattern string, path string")
    got = df.select("pattern", "path", T.normalise_encoding(F.col("path")).alias("n"), T.path_matches(F.col("pattern"), F.col("path")).alias("m")).collect()
    for r in got:
        assert r["n"] == plain_norm(r["path"])
        assert r["m"] == plain_match(r["pattern"], r["path"]), (r["pattern"], r["path"])


def test_decisions_against_plain_python(spark):
    rnd = random.Random(11)
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rnd.randint(0, 3)):
            lines += [f"User-agent: {t}" for t in rnd.sample(["*", "marlinbot", "loomreader"], rnd.randint(1, 2))]
            lines += [f"{rnd.choice(['Allow', 'Disallow'])}: {rnd.choice(['', '/', '/a', '/a*b', '/*.pdf$', '/a/', '*c'])}" for _ in range(rnd.randint(0, 4))]
        texts.append("\n".join(lines))
    paths = ["/", "/a", "/ab.pdf", "/a/c", "/robots.txt"]
    got = {(r["file_id"], r["crawler"], r["path"]): (r["allowed"], r["line"]) for r in M.access_grid(parsed(spark, *texts), crawlers(spark), paths).collect()}
    for i, text in enumerate(texts):
        groups, last = [], None
        for n, line in enumerate(text.split("\n"), 1):
            if not line:
                continue
            k, v = line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
            if k == "User-agent":
                if last != "ua":
                    groups.append(([], []))
                groups[-1][0].append(v)
            else:
                groups[-1][1].append((k == "Allow", v, n))
            last = "ua" if k == "User-agent" else "rule"
        for _, name, tokens, _ in CRAWLERS:
            pick = next((t for t in (*tokens, "*") if any(t in g[0] for g in groups)), None)
            rules = [r for g in groups if pick in g[0] for r in g[1] if r[1]]
            for path in paths:
                best = max(((len(p), a, -n) for a, p, n in rules if plain_match(p, path)), default=None)
                want = (True, None) if path == "/robots.txt" else (best is None or best[1], None if best is None else -best[2])
                assert got[i, name, path] == want


def test_check_access_with_probes(spark):
    p = parsed(spark, "User-agent: marlinbot\nCrawl-delay: 3\nDisallow: /a\nUser-agent: *\nDisallow: /")
    probes = spark.createDataFrame([(0, ["marlinbot"], "https://x.example/b?c#d"), (0, ["zzz"], ""), (0, ["zzz"], "/robots.txt"), (9, ["a"], "/x")], "file_id long, tokens array<string>, path string")
    got = {(r["file_id"], r["path"]): (r["token"], r["specific"], r["crawl_delay"], r["allowed"]) for r in M.check_access(p, probes).collect()}
    assert got == {(0, "/b?c"): ("marlinbot", True, 3.0, True), (0, "/"): ("*", False, None, False), (0, "/robots.txt"): ("*", False, None, True), (9, "/x"): (None, False, None, True)}


def test_verdicts_and_cards(spark):
    p = parsed(spark, "User-agent: *\nDisallow: /\nUser-agent: loomreader\nDisallow: /x\nAllow: /y", "", "User-agent: *\nDisallow: /\nAllow: /")
    v = M.crawler_verdicts(p, crawlers(spark))
    assert ids(v, "file_id", "crawler", "verdict") == [(0, "Loom", "partial"), (0, "MarlinBot", "blocked"), (0, "Other", "blocked"), (1, "Loom", "open"), (1, "MarlinBot", "open"), (1, "Other", "open"), (2, "Loom", "partial"), (2, "MarlinBot", "partial"), (2, "Other", "partial")]
    assert ids(U.ai_status(v, ["ai_training"]), "file_id", "n_blocked", "callout") == [(0, 1, "warning"), (1, 0, "info"), (2, 0, "info")]
    assert ids(U.leaderboard(v, ["ai_training"]), "crawler", "blocked", "blocked_percent") == [("Loom", 0, 0), ("Other", 1, 33)]


def test_clean_params(spark):
    p = parsed(spark, "Clean-param: ref&sid /shop/\nClean-param: bad name x y\nUser-agent: *")
    probes = spark.createDataFrame([(0, "/shop/a?ref=1&x=2&sid"), (0, "/other?ref=1"), (0, "/shop/?ref=1")], "file_id long, path string")
    assert ids(M.cleaned_paths(p, probes), "path", "cleaned") == [("/other?ref=1", "/other?ref=1"), ("/shop/?ref=1", "/shop/"), ("/shop/a?ref=1&x=2&sid", "/shop/a?x=2")]


def test_search_findings(spark):
    p = parsed(spark, "User-agent: *\nDisallow: /shop\nDisallow: /shopping/\nDisallow: /a/\nDisallow: /a/b\nAllow: /a/b\nDisallow: /*?\nDisallow: /js/\nDisallow: /robots\nDisallow: /x.css$\nDisallow: https://site.example/z\nDisallow: /a/")
    got = ids(G.seo_findings(p), "id", "line")
    for want in (("seo.trailingSlash", 2), ("seo.redundant", 3), ("seo.queryStringBlock", 7), ("seo.assetBlock", 8), ("seo.selfBlock", 9), ("seo.cssJsBlock", 10), ("lint.absoluteUrl", 11), ("seo.duplicate", 12), ("seo.overridden", 5)):
        assert want in got, (want, got)
    assert len([x for x in got if x[1] == 12 and x[0] != "seo.trailingSlash"]) == 1


def test_sitemap_findings(spark):
    p = parsed(spark, "Sitemap: https://site.example/a.xml\nSitemap: HTTPS://SITE.example:443/a.xml\nSitemap: http://www.site.example/b.xml\nSitemap: https://other.test/c.xml\nSitemap: https://m.site.example/d.xml\nSitemap: /rel.xml")
    assert ids(G.sitemap_findings(p), "line", "id") == [(2, "sitemap.duplicate"), (3, "sitemap.protocolMismatch"), (4, "sitemap.crossDomain"), (5, "sitemap.otherSubdomain")]


def test_fetch_findings(spark):
    kind = "file_id long, body string, fetch struct<robots_url:string,final_url:string,status:int,content_type:string,redirect_limit:boolean,headers:struct<cache_control:string,x_robots_tag:string,retry_after:string,vary:string>>"
    u = "https://site.example/robots.txt"
    rows = [
        (0, "", (u, u, 503, None, False, (None, None, "90000", None))),
        (1, "<html>", (u, "https://www.site.example/r.txt", 200, "text/html; charset=ISO-8859-1", False, ("max-age=900000", "noindex", None, "User-Agent"))),
        (2, "x", (u, u, 200, None, True, ("no-store", None, None, None))),
        (3, "x", None),
    ]
    got = ids(G.fetch_findings(spark.createDataFrame(rows, kind)), "file_id", "id")
    assert [x[1].split(".")[-1] for x in got if x[0] == 0] == ["retryAfterLong", "serverError"]
    assert {x[1].split(".")[-1] for x in got if x[0] == 1} == {"contentType", "htmlBody", "charset", "cacheTooLong", "xRobotsTag", "varyUserAgent", "redirectSameSite", "notRobotsPath"}
    assert {x[1].split(".")[-1] for x in got if x[0] == 2} == {"contentTypeMissing", "cacheNoStore", "redirectLimit"}
    assert not [x for x in got if x[0] == 3]


def test_recon(spark):
    config = C.load()
    p = parsed(spark, "# generated by X, see CR-123, 2026-01-02, mail a@b.example, 10.0.0.1 https://stage.site.example/x\nUser-agent: *\nDisallow: /wp-admin/\nDisallow: /wp-content/x\nDisallow: /backup/db.sql.gz\nDisallow: /api/v2/\nDisallow: /v2/\nDisallow: /staging/\nDisallow: /feed/\nDisallow: /partner/\nDisallow: /*?q=x&utm_source=y\nSitemap: https://bucket-a.s3.amazonaws.com/m.xml")
    scores = R.platform_scores(p, config)
    assert ids(R.primary_platform(scores), "platform") == ["WordPress"]
    assert ("/wp-admin/", "info") in ids(R.sensitive_paths(p, config, R.primary_platform(scores)), "path", "severity")
    assert ("/backup/db.sql.gz", "high") in ids(R.sensitive_paths(p, config), "path", "severity")
    assert ids(R.cloud_assets(p, config), "provider", "bucket") == [("Amazon S3", "bucket-a")]
    assert ("stage.site.example", "subdomain", "stage") in ids(R.leaked_hosts(p, config), "host", "relation", "env")
    assert ids(R.environment_paths(p, config), "hint") == ["staging", "v2"]
    assert ids(R.api_endpoints(p, config), "path", "version") == [("/api/v2/", "v2")]
    assert ids(R.data_feeds(p, config), "path") == ["/feed/"] and ids(R.portals(p, config), "kind") == ["partners"]
    assert ids(R.search_paths(p, config), "line") == [11] and ids(R.parameters(p, config), "name", "role") == [("q", "search"), ("utm_source", "tracking")]
    assert ids(R.extensions(p, config), "ext") == ["gz", "sql"] or "gz" in ids(R.extensions(p, config), "ext")
    assert set(ids(R.mined_comments(P.comments(p), config), "kind")) >= {"email", "ticket", "date", "ip", "url"}
    assert ids(R.generators(p, config), "generator") == ["generic generator"]


def test_dates(spark):
    df = spark.createDataFrame([("3 March 2024",), ("no year",), ("May 2025",)], "t string")
    assert [str(r[0]) for r in df.select(R.text_date(F.col("t"))).collect()] == ["2024-03-03", "None", "2025-05-01"]
    today = F.to_date(F.lit("2026-01-01"))
    assert spark.range(1).select(R.date_note(F.to_date(F.lit("2023-01-01")), today), R.date_note(F.to_date(F.lit("2026-01-11")), today)).first() == ("3 years old", "in 10 days")


def test_scalars(spark):
    row = spark.range(1).select(T.root_domain(F.lit("www.a.b.co.uk")), T.kib(F.lit(2048)), T.csv_cell(F.lit('a"b')), T.body_hash(F.lit("")), T.body_hash(F.lit("a")), T.report_filename(F.lit("https://www.A.example/"), F.to_date(F.lit("2026-01-02")))).first()
    assert tuple(row) == ("b.co.uk", "2", '"a""b"', "", "af63dc4c8601ec8c", "a-example-robots-audit-2026-01-02")


def test_messages_and_reports(spark):
    assert substitute("{a} {b} {c}", {"a": "{b}", "b": "x"}) == "{b} x {c}"
    df = spark.createDataFrame([("en", 1), ("pl", 22), ("pl", 25), ("cs", 3), ("fr", 0), ("xx", 2)], "l string, n int")
    assert [r[0] for r in df.select(plural_category(F.col("l"), F.col("n"))).collect()] == ["one", "few", "many", "few", "one", "other"]
    p = parsed(spark, "User-agent: *\nDisallow: shop\n")
    f = G.syntax_findings(p)
    assert "The path shop of a Disallow starts with neither / nor *." in ids(worded(f), "message")
    v, sec = M.crawler_verdicts(p, crawlers(spark)), R.sensitive_paths(p, C.load())
    summary = U.report_summary(p, f, sec, v, M.star_policy(p), R.primary_platform(R.platform_scores(p, C.load())), "ai_training")
    row = rendered(U.nested_report(p, summary, f, v, sec)).first()
    assert "`parser.pathNoSlash` (line 2)" in row["markdown"] and "<h1>" in row["html"] and '"schema_version":"1.0"' in row["json"]
    assert html_of("# a\n- `b`\n") .count("<li><code>b</code></li>") == 1
    assert U.actions(f).where("action = 'missing slashes'").count() == 1
    wide = U.tagged(U.tabs(p.withColumn("fetch", F.struct(F.lit(None).cast("string").alias("final_url"))), f, {"security": sec}) | {"wide": spark.range(1).selectExpr("id as file_id", *[f"{i} as x{i}" for i in range(9)])})
    assert wide.columns == ["sheet", "file", *[f"c{i}" for i in range(1, 10)]] and wide.where("sheet = 'wide'").first()["c9"] == "8"


def test_config():
    base = C.load()
    assert C.load({"limits": {"max_age": 5}})["limits"] == {"retry_after": 86400, "max_age": 5}
    assert C.load("[rules]\ndisabled = ['parser.bom']\n")["rules"]["disabled"] == ["parser.bom"]
    for bad in ({"api": [{"kind": "x", "pattern": "("}]}, {"rules": {"levels": {"a": "loud"}}}, {"cloud": [{"provider": "p", "kind": "k", "host": "h", "bucket": "segment:x"}]}, {"security": {"signature": [{"category": "admin", "severity": "low", "reason": "r"}]}}):
        with pytest.raises(ValueError):
            C.load(bad)
    assert base["checks"]["seo_traps"]


def test_overrides(spark):
    f = G.syntax_findings(parsed(spark, "﻿"))
    got = G.with_overrides(f, ["parser.bom"], {"parser.noRules": "error"})
    assert ids(got, "id", "level") == [("parser.noRules", "error")]


# -- one pass over each file ---------------------------------------------------------------------------------------


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_and_reports_scan_and_parse_once(spark, tmp_path):
    rows = [(i, "d", "https://site.example", 200, "text/plain", False, "User-agent: *\nDisallow: /wp-admin/\nSitemap: https://x.example/m.xml") for i in range(20)]
    fetch = "fetch_id long, domain string, site_url string, status int, content_type string, redirect_limit boolean, text string"
    more = {"source": "string", "robots_url": "string", "final_url": "string", "status_text": "string", "bytes": "long", "truncated": "boolean", "redirects": "array<struct<from_url:string,status:int,to_url:string>>", "headers": "struct<cache_control:string,expires:string,x_robots_tag:string,retry_after:string,vary:string,content_encoding:string>", "observed_at": "timestamp"}
    df = spark.createDataFrame(rows, fetch).select("*", *[F.lit(None).cast(t).alias(c) for c, t in more.items()])
    df.write.parquet(str(tmp_path / "fetches.parquet"))
    files = P.files_of_fetches(spark.read.parquet(str(tmp_path / "fetches.parquet")))
    config = C.load()
    found = G.all_findings(P.parse(files), config["checks"], config["crawlers"]["legacy_tokens"])
    assert plan_of(found).count("FileScan") == 1 and "Join" not in plan_of(found)
    assert plan_of(found.groupBy("id").count()).count("FileScan") == 1
    kinds = {r["kind"] for r in found.select("kind").distinct().collect()}
    assert kinds == {"syntax", "sitemap"} or kinds >= {"sitemap"}


def test_findings_in_one_pass_are_those_of_the_checks(spark):
    p = parsed(spark, "\ufeffUser-agent: *\nDisallow: /A\nDisallow: /a*\nNoindex: /x\nSitemap: http://other.example/m.xml\nSitemap: http://other.example/m.xml", "", None, "User-agent:\nUser-agent: Loom\nDisallow: /robots.txt")
    one = sorted(map(repr, G.all_findings(p, None, ["loom"]).collect()))
    apart = G.syntax_findings(p).unionByName(G.seo_findings(p)).unionByName(G.sitemap_findings(p)).unionByName(G.legacy_bot_findings(p, ["loom"]))
    assert one == sorted(map(repr, apart.collect()))
    off = G.all_findings(p, {"seo_traps": False, "sitemaps": False})
    assert sorted(map(repr, off.collect())) == sorted(map(repr, G.syntax_findings(p).collect()))


def test_repeated_rows_are_dropped_narrowly(spark):
    from crawlquarry.session import rows_once

    df = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "b", 0), (None, "c", 0), (3, None, 0)], "id long, t string, n int")
    once = rows_once(df, "id")
    assert sorted((r["id"], r["t"] or "") for r in once.collect()) == [(1, "a"), (2, "b"), (3, "")]
    assert "Exchange" not in plan_of(rows_once(df.where("id = 1"), "id")) and rows_once(df.limit(0), "id").count() == 0


def test_bit_tables(spark):
    from crawlquarry.session import bit_table, in_table

    some = spark.range(0, 5000, 7)
    table, bits = bit_table(some, F.col("id"))
    hits = {r["id"] for r in spark.range(5000).where(in_table(table, bits, F.col("id"))).collect()}
    assert hits >= {r["id"] for r in some.collect()} and len(hits) < 1500
    assert not any(bit_table(some.limit(0), F.col("id"))[0])


# -- findings, comments, actions, cards ----------------------------------------------------------------------------


def test_variants(spark):
    p = parsed(spark, "User-agent:\nUser-agent: Loom\nDisallow: /a", "User-agent: *\nUser-agent: !!\nDisallow: /b", "User-agent:\nDisallow: /c", "<iframe src=x>", "<script>eval(1)</script>", "<a style='display:none' href=x>", "<marquee>")
    got = ids(G.syntax_findings(p).where("id in ('parser.emptyUserAgent', 'parser.invalidToken', 'security.injectedCode')"), "file_id", "id", "variant")
    assert got == [
        (0, "parser.emptyUserAgent", "others"), (1, "parser.invalidToken", "star"), (2, "parser.emptyUserAgent", None), (3, "security.injectedCode", "iframe"), (4, "security.injectedCode", "script"), (5, "security.injectedCode", "hiddenLink"), (6, "security.injectedCode", "marquee"),
    ]
    assert "A User-agent line names nobody; its rules are those of Loom." in ids(worded(G.syntax_findings(p)), "message")


def test_every_finding_is_worded(spark):
    import inspect

    named = set(re.findall(r'"((?:parser|seo|lint|sitemap|fetch\.warn|security)\.[A-Za-z]+)"', inspect.getsource(G)))
    from crawlquarry.functions.messages import ENGLISH

    assert len(named) > 70 and all(any(k == i or k.startswith(i + ".") for k in ENGLISH) for i in named), [i for i in named if not any(k == i or k.startswith(i + ".") for k in ENGLISH)]


def test_comment_mining(spark):
    c = spark.createDataFrame(
        [(1, 1, "updated by Dave Miller on 12/31/2024, ticket #123 and CR-77, UTF-16"), (1, 2, "contact: dave@host.example, by jo@x.example"), (1, 3, "1 October 2027, Oct 2020, 2026-01-11"), (1, 4, "10.0.0.1 and 93.184.216.34 TODO fixme"), (1, 5, "by Google, thanks to Anna"), (1, 6, None), (1, 7, "")], "file_id long, line int, text string"
    )
    got = {(r["line"], r["kind"], r["value"]): r["remark"] for r in R.mined_comments(c, C.load(), F.to_date(F.lit("2026-01-01"))).collect()}
    assert {(1, "person", "Dave Miller"), (1, "date", "12/31/2024"), (1, "ticket", "ticket #123"), (1, "ticket", "CR-77"), (2, "email", "dave@host.example"), (2, "email", "jo@x.example"), (5, "person", "Anna"), (4, "note", "todo")} <= set(got)
    assert not [k for k in got if k[:2] in ((2, "person"),) or k[2] in ("UTF-16", "Google", "fixme")]
    assert got[3, "date", "1 October 2027"] == "in 2 years" and got[3, "date", "Oct 2020"] == "5 years old" and got[3, "date", "2026-01-11"] == "in 10 days"
    assert got[4, "ip", "10.0.0.1"] == "private" and got[4, "ip", "93.184.216.34"] == "public"
    assert R.mined_comments(c.limit(0), C.load()).count() == 0


def test_recon_switches_and_evidence(spark):
    p = parsed(spark, "# wordpress\nUser-agent: *\nDisallow: /wp-admin/\nDisallow: /xmlrpc.php\nSitemap: https://x.s3.amazonaws.com/m.xml\n# see x.s3.amazonaws.com and stage.site.example")
    config = C.load({"recon": {"hosts": False, "data": False}})
    assert set(R.recon(p, config)) == {"platforms", "generators", "cloud", "apis", "extensions", "comments"} and R.recon(p, C.load({"checks": {"recon": False}})) == {}
    assert ("WordPress", 1, "comment") in ids(R.platform_evidence(p, config), "platform", "line", "strength") and ("WordPress", 3, "strong") in ids(R.platform_evidence(p, config), "platform", "line", "strength")
    [host] = R.leaked_hosts(p, config).where("host = 'stage.site.example'").collect()
    assert [(s["line"], s["source"]) for s in host["sources"]] == [(6, "comment")] and host["n_sources"] == 1


def test_every_cloud_provider_has_a_host(spark):
    """One made-up host a provider: the first that matches is the provider itself, and its bucket language reads it."""
    pack = C.load()["cloud"]
    hosts = {
        "Amazon S3": "b.s3.amazonaws.com", "Google Cloud Storage": "b.storage.googleapis.com", "Azure Blob Storage": "b.blob.core.windows.net", "DigitalOcean Spaces": "b.fra1.digitaloceanspaces.com", "CloudFront": "d1.cloudfront.net", "Netlify": "b.netlify.app",
        "Heroku": "b.herokuapp.com", "Azure App Service": "b.azurewebsites.net", "Google App Engine": "b.appspot.com", "Firebase Hosting": "b.web.app", "Cloudflare R2": "b.r2.dev", "Cloudflare Pages": "b.pages.dev", "Vercel": "b.vercel.app", "GitHub Pages": "b.github.io",
        "Backblaze B2": "b.backblazeb2.com", "Linode Object Storage": "b.linodeobjects.com", "Fastly": "b.fastly.net", "AWS Lambda URL": "x.lambda-url.eu-west-1.on.aws", "Oracle Object Storage": "objectstorage.eu-1.oraclecloud.com",
    }
    p = parsed(spark, "\n".join(f"Sitemap: https://{h}/b/b/x.xml" for h in hosts.values()))
    got = {r["host"]: (r["provider"], r["bucket"]) for r in R.cloud_assets(p, C.load()).collect()}
    assert {h: got[h][0] for h in hosts.values()} == {h: n for n, h in hosts.items()} and len(pack) >= 37
    assert all(b == "b" for _, (n, b) in got.items() if b and n not in ("Azure Blob Storage",))


def test_cards_actions_and_texts(spark):
    p = parsed(spark, "# mail a@b.example\nUser-agent: Loom\nDisallow: /\nUser-agent: *\nDisallow: /admin/", "User-agent: *\nDisallow: /", "", "User-agent: loomreader\nDisallow: /\nUser-agent: other\nDisallow: /")
    v = M.crawler_verdicts(p, crawlers(spark))
    cards = {r["file_id"]: r for r in U.ai_cards(v, ["ai_training"], {"ai_training": "AI training"}).collect()}
    assert cards[1]["callout"] == "ok" and cards[1]["headline"] == "AI training: 2 of 2 blocked" and cards[2]["callout_text"] == "None of them is restricted." and cards[3]["callout"] == "ok"
    assert cards[0]["callout"] == "info" and [c["explanation"] for c in cards[0]["groups"][0]["crawlers"]] == ["group of *", "group of *"]
    uneven = M.crawler_verdicts(parsed(spark, "User-agent: other\nDisallow: /"), crawlers(spark))
    assert U.ai_cards(uneven, ["ai_training"]).first()["callout_text"] == "Not blocked: Loom" and U.ai_cards(v, ["none"]).first()["callout_text"] == "No crawler of this kind is known."
    from crawlquarry.analysis import analyze

    a = analyze(p, crawlers(spark), C.load({"crawlers": {"ai_categories": ["ai_training"]}}), now="2026-01-01T00:00:00Z", once=True)
    todo = {(r["file_id"], r["action"]): r for r in a.actions.collect()}
    assert todo[0, "security"]["items"] == ["admin", "/admin/"] and (1, "all blocked") in todo and (0, "add sitemap") in todo and (2, "decide on AI") in todo and (2, "none") not in todo
    names = [n for n, _ in U.ACTIONS]
    assert len(names) == 23 and all(r["ord"] == U.ORDER[r["action"]] for r in todo.values())
    row = {r["file_id"]: r for r in a.report.collect()}[0]
    assert [line for line in row["markdown"].split("\n") if line.startswith("## ")] == ["## Summary", "## Recommended actions", "## Issues", "## Crawlers", "## Sensitive paths", "## Sitemaps", "## What the file gives away", "## Groups"]
    text = {r["file_id"]: r["text"] for r in a.summary_text.collect()}[0]
    assert text.startswith("errors 0, warnings") and "Disallow: /admin/ (admin, administration area)" in text and "1. " in text
    assert U.tab_tsv(a.tabs, "nothing") is None and {r["tab"] for r in U.tab_tsv(a.tabs, "all").collect()} == {"Rules", "Sitemaps", "Issues", "Recon"}
    probes = spark.createDataFrame([(0, "Loom", "/x"), (0, "MarlinBot", "/admin/y"), (1, "x", "/robots.txt")], "file_id long, token string, path string")
    assert ids(a.allowed(probes), "file_id", "allowed") == [(0, False), (0, False), (1, True)]
    assert a.lines.count() and a.groups.count() and a.rules.count() and a.issues.where("message is null").count() == 0 and a.sitemaps.count() == 0 and a.star.count() == 4 and a.ai.count() == 4


def test_shared_tables_are_written_once(spark):
    from crawlquarry.analysis import analyze

    a = analyze(parsed(spark, "User-agent: *\nDisallow: /wp-admin/"), crawlers(spark), once=True)
    assert a.scores.inputFiles() and not set(a.scores.inputFiles()) & set(a.parsed.inputFiles())
    assert a.recon["platforms"] is a.scores and a.scores.first()["platform"]


def test_rule_pack_checks():
    from crawlquarry import analysis

    assert analysis.validate_config("[rules]\ndisabled = []\n") == [] and "loud" in analysis.validate_config("[rules.levels]\na = 'loud'\n")[0]
    assert analysis.default_config().startswith("# Rule pack") and analysis.version()


def test_sentences(spark):
    from crawlquarry.functions.messages import outcome_sentences

    p = parsed(spark, "User-agent: a\nUser-agent: b\nUser-agent: c\nUser-agent: d\nDisallow: /x\nUser-agent: *\nAllow: /y", "User-agent: *\nDisallow: /z")
    got = ids(outcome_sentences(M.rule_outcomes(p)), "sentence")
    assert got == ["/x is blocked for a, b, c and 1 more by line 5.", "/y is open to crawlers without rules of their own because of line 7.", "/z is blocked for every crawler by line 2."]


def test_date_of(spark):
    df = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("x",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(T.date_of(F.col("t"))).collect()] == ["2026-01-02", "None", "None"]


def test_hashes_of_many_texts():
    rnd = random.Random(4)
    values = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 1, 7, 300]))) for _ in range(60)]
    assert T.fnv1a_batch(values) == [T.fnv1a_64(v) if v else "" for v in values] and T.fnv1a_batch([]) == []


def test_kib_ties(spark):
    assert [r[0] for r in spark.createDataFrame([(256,), (768,), (1024,), (1500,)], "n long").select(T.kib(F.col("n"))).collect()] == ["0.3", "0.8", "1", "1.5"]
