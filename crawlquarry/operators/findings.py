"""Findings about files: syntax, search visibility, sitemaps, responses.  One row a finding:

file_id, phase, line, id, level, kind, variant, params.  `id` is stable across languages; wording is rendered late (see
`functions.messages`).  All checks of a file run inside its row; only `explode` multiplies rows, nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.text import (
    is_absolute_url, normal_url, normalise_encoding, normalise_path, root_domain, sample_path, strip_www, trim_space, url_host, url_path, url_port, valid_http_url, whole_site,
)
from crawlquarry.operators import match as M
from crawlquarry.operators import parse as P
from crawlquarry.operators.parse import let

FINDING = "struct<phase:int,line:int,id:string,level:string,kind:string,variant:string,params:map<string,string>>"
HEADER_LIMITS = {"retry_after": 86_400, "max_age": 86_400}
LEGACY_THRESHOLD = 10

# markers that are looked for in lower-case text (fixed values)
HTML_TAGS = ("<script", "</script", "<a href", "<p>", "</p>", "<div", "<center", "<iframe", "<!--", "<br", "<span", "<img ", "<meta ", "<style", "<marquee", "<?php", "</body", "<table")
PLUGIN_MARKERS = ("total size saved", "load from cache", "page cache", "cached page generated", "served from cache", "wp super cache", "w3 total cache", "litespeed cache", "performance optimized by", "minified by")
ERROR_MARKERS = ("<b>warning</b>:", "<b>notice</b>:", "<b>deprecated</b>:", "<b>fatal error</b>:", "php warning:", "php fatal error:", "stack trace:", "traceback (most recent call last)")
OBFUSCATION = ("atob(", "eval(", "fromcharcode", "_0x", "document.write", "unescape(", "window.location")
HIDING = ("display:none", "display: none", "width:0px", "width: 0px", "left:-", "left: -")
PLACEHOLDERS = ("example.com", "example.org", "example.net", "domainnamehere", "yourdomain", "your-domain", "yoursite", "your-site", "mydomain.com", "your_domain", "<name of spider>", "<path>", "<nothing>", "{{")
REGEX_TOKENS = ("\\.", "^/", "(?", "[a-z", "[0-9", ".+", "|")
DIRECTIVE_NAMES = ("user-agent:", "disallow:", "allow:", "sitemap:", "crawl-delay:")
SIGNAL_KEYS = ("search", "ai-input", "ai-train")
QUERY_PATTERNS = ("/*?", "/*?*", "/?*", "*?", "*?*", "/*?$")
ASSET_DIRS = ("/js/", "/css/", "/js", "/css")
IMAGE_DIRS = ("/images/", "/images", "/img/", "/image/", "/wp-content/uploads/", "/uploads/")
IMAGE_FILES = (".jpg$", ".jpeg$", ".png$", ".gif$", ".webp$", "*.jpg", "*.png", "*.jpeg", "*.gif")


def finding(phase: int, level: str | Column, ident: str | Column, line: Column | None = None, kind: str = "syntax", variant: Column | str | None = None, **params: Column) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    pairs = [x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]
    shown = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(phase).alias("phase"), (F.lit(None) if line is None else line).cast("int").alias("line"), as_col(ident).alias("id"), as_col(level).alias("level"),
        F.lit(kind).alias("kind"), as_col(variant).cast("string").alias("variant"), shown.cast("map<string,string>").alias("params"),
    )


def _some(*found: Column) -> Column:
    """The findings that are there, in order."""
    return F.filter(F.array(*[f.cast(FINDING) for f in found]), lambda x: x.isNotNull())


def _any_in(text: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def _first_in(text: Column, needles: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in needles])


def looks_like_html(text: Column) -> Column:
    head = F.lower(F.regexp_replace(F.left(text, F.lit(2000)), r"^[\t-\r \x{85}\p{Z}]+", ""))
    return head.startswith("<!doctype html") | head.startswith("<html") | (head.startswith("<?xml") & F.contains(head, F.lit("<html")))


def _line_with(lines: Column, needle: Column) -> Column:
    return F.get(F.filter(lines, lambda x: F.contains(F.lower(x["raw"]), needle)), F.lit(0))["n"]


def _file_findings(lines: Column) -> Column:
    low = F.lower(F.col("src"))
    page = looks_like_html(F.col("src"))
    injected = (
        F.when(F.contains(low, F.lit("<script")) & _any_in(low, OBFUSCATION), "script").when(F.contains(low, F.lit("<iframe")), "iframe").when(F.contains(low, F.lit("<marquee")), "marquee")
        .when(F.contains(low, F.lit("<a ")) & _any_in(low, HIDING), "hiddenLink")
    )
    error, plugin, tag = _first_in(low, ERROR_MARKERS), _first_in(low, PLUGIN_MARKERS), _first_in(low, HTML_TAGS)
    long_line = F.get(F.filter(lines, lambda x: F.length(x["raw"]) > P.LONG_LINE), F.lit(0))
    return _some(
        F.when(F.col("size") > P.READ_LIMIT, finding(0, "warning", "parser.tooLarge", kib=F.floor(F.col("size") / 1024))),
        F.when(F.col("bom"), finding(0, "info", "parser.bom", F.lit(1))),
        F.when(F.col("utf16"), finding(0, "error", "parser.utf16", F.lit(1))),
        F.when(~page & injected.isNotNull(), finding(0, "error", "security.injectedCode", kind="security", variant=injected)),
        F.when(~page & error.isNotNull(), finding(0, "error", "parser.serverErrorOutput", _line_with(lines, error))),
        F.when(~page & plugin.isNotNull(), finding(0, "warning", "parser.pluginOutput", _line_with(lines, plugin))),
        F.when(~page & tag.isNotNull(), finding(0, "error", "parser.htmlFragment", _line_with(lines, tag), tag=F.rtrim(tag))),
        F.when(~page & F.contains(F.col("src"), F.lit("�")), finding(0, "warning", "parser.invalidUtf8")),
        F.when(long_line.isNotNull(), finding(1, "info", "parser.longLine", long_line["n"], chars=F.length(long_line["raw"]))),
        _first_flagged(lines, "invisible", "parser.invisibleChar"),
        _first_flagged(lines, "fullwidth_colon", "parser.fullwidthColon"),
    )


def _first_flagged(lines: Column, flag: str, ident: str) -> Column:
    first = F.get(F.filter(lines, lambda x: x[flag] & x["has_colon"]), F.lit(0))
    return F.when(first.isNotNull(), finding(1, "warning", ident, first["n"]))


def _glued(comment: Column) -> Column:
    """Name of a directive hidden in a comment because a line break is missing before it, in the fixed order."""
    low = F.lower(comment)
    tests = [F.when(low.rlike(rf"[\p{{L}}\p{{N}}.]{'(?<!dis)' if n == 'allow:' else ''}{n}"), F.lit(n[:-1])) for n in DIRECTIVE_NAMES]
    return F.coalesce(*tests)


def _commented(comment: Column) -> Column:
    squeezed = F.lower(F.regexp_replace(F.regexp_replace(comment, "^#+", ""), r"[\t-\r \x{85}\p{Z}]+", ""))
    return F.coalesce(*[F.when(squeezed.startswith(n), F.lit(n[:-1])) for n in DIRECTIVE_NAMES])


def content_signal_bad(value: Column) -> Column:
    """Parts of a Content-Signal list that aren't key=yes|no with a known key."""
    parts = F.filter(F.transform(F.split(value, ","), trim_space), lambda p: p != "")
    key = lambda p: F.lower(trim_space(F.substring_index(p, "=", 1)))
    val = lambda p: F.when(F.instr(p, "=") > 0, F.lower(trim_space(F.substring(p, F.instr(p, "=") + 1, F.length(p))))).otherwise("")
    return F.filter(parts, lambda p: ~(key(p).isin(*SIGNAL_KEYS) & val(p).isin("yes", "no")))


def _nameless(groups: Column) -> Column:
    """User-agent lines without a token: line, variant (others if the group names crawlers, star if it names `*`), names."""

    def of(g: Column) -> Column:
        named = F.filter(g["agents"], lambda a: ~a["token"].isin("", "*"))
        star = F.exists(g["agents"], lambda a: a["token"] == "*")
        variant = F.when(star, F.lit("star")).when(F.size(named) > 0, F.lit("others"))
        return F.transform(F.filter(g["agents"], lambda a: a["token"] == ""), lambda a: F.struct(a["line"].alias("line"), variant.alias("variant"), F.when(variant == "others", F.array_join(F.transform(named, lambda b: b["raw"]), ", ")).alias("names")))

    return F.flatten(F.transform(groups, of))


def _line_findings(x: Column, first_group: Column, first_host: Column, first_delay: Column, valid_delays: Column, nameless: Column) -> Column:
    n, field, value, low = x["n"], x["field"], x["value"], F.lower(x["value"])
    grouped = n > first_group
    rule = (x["kind"] == "rule") & grouped
    glued = F.when(x["comment"].isNotNull(), _glued(x["comment"]))
    hash_cut = field.isin("allow", "disallow", "sitemap") & (value != "") & x["comment"].isNotNull() & x["text_before"] & ~x["last_before"].rlike(r"^[\t-\r \x{85}\p{Z}]\z")
    place = F.when(field.isin("user-agent", "sitemap") | (rule & (value != "")), _first_in(low, PLACEHOLDERS))
    absolute = is_absolute_url(value)
    token_state = F.when(value == "", F.lit("parser.emptyUserAgent")).when(x["token"] == "", F.lit("parser.invalidToken"))
    delay = P.crawl_delay_value(value)
    repeated = F.size(F.filter(valid_delays, lambda d: (d["start"] == _group_start(valid_delays, n)) & (d["line"] < n))) > 0
    in_group = x["kind"].isin("crawl-delay") & grouped
    clean_words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    clean_names = F.filter(F.split(F.coalesce(F.get(clean_words, F.lit(0)), F.lit("")), "&"), lambda w: w != "")
    clean_ok = (F.size(clean_words) <= 2) & (F.size(clean_names) > 0) & F.forall(clean_names, lambda w: w.rlike(r"^[A-Za-z0-9_.-]+\z")) & F.coalesce(F.get(clean_words, F.lit(1)), F.lit("/")).rlike("^[/*]")
    raw_field, unknown = x["raw_field"], x["kind"] == "unknown"
    unknown_id = (
        F.when(raw_field.isin("http", "https") & value.startswith("//"), F.lit("parser.bareUrl"))
        .when(raw_field == "noindex", F.lit("parser.noindex"))
        .when(raw_field.isin(*P.META_ROBOTS), F.lit("parser.metaRobots"))
        .when(raw_field.isin(*P.AI_DIRECTIVES) | raw_field.startswith("ai-") | raw_field.startswith("llm"), F.lit("parser.aiDirective"))
        .when(raw_field == "content-signal", F.when(F.size(content_signal_bad(value)) == 0, F.lit("parser.contentSignal")).otherwise("parser.contentSignalInvalid"))
        .when(raw_field.isin(*P.LEGACY_DIRECTIVES), F.lit("parser.nonStandardDirective"))
        .otherwise("parser.unknownDirective")
    )
    unknown_level = F.when(unknown_id == "parser.bareUrl", F.lit("error")).when(unknown_id.isin("parser.aiDirective", "parser.contentSignal", "parser.nonStandardDirective"), F.lit("info")).otherwise("warning")
    return _some(
        F.when(glued.isNotNull(), finding(1, "error", "parser.gluedComment", n, directive=glued)),
        F.when((x["kind"] == "comment") & glued.isNull() & _commented(x["comment"]).isNotNull(), finding(1, "info", "lint.commentedRule", n, directive=_commented(x["comment"]))),
        F.when(x["kind"] == "invalid", finding(1, "error", "parser.notFieldValue", n, variant=F.when(P.nearest_directive(raw_field).isNotNull(), F.lit("hint")), field=P.nearest_directive(raw_field))),
        F.when(x["has_colon"] & x["lookalike"], finding(1, "warning", "parser.homoglyph", n, field=raw_field)),
        F.when(x["misspelt"], finding(1, "info", "parser.misspelling", n, raw=raw_field, field=field)),
        F.when(field.isNotNull() & x["junk"].isNotNull(), finding(1, "warning", "parser.junkBeforeField", n, junk=x["junk"], field=field)),
        F.when(hash_cut & ((field == "sitemap") | grouped), finding(1, "warning", "parser.hashInValue", n, variant=F.when(field == "sitemap", F.lit("sitemap")), truncated=value)),
        F.when((field == "user-agent") & token_state.isNotNull(), let(F.get(F.filter(nameless, lambda y: y["line"] == n), F.lit(0)), lambda y: finding(1, F.when(value == "", F.lit("error")).otherwise("warning"), token_state, n, variant=y["variant"], value=value, names=y["names"]))),
        F.when((field == "user-agent") & token_state.isNull() & (x["token"] != "*") & (x["token"] != low), finding(1, "info", "parser.tokenTail", n, token=x["token"], value=value)),
        F.when((x["kind"] == "rule") & ~grouped, finding(1, "error", "parser.ruleBeforeAgent", n, variant=F.when(value != "", field), directive=field)),
        F.when(rule & (value == ""), finding(1, "info", F.when(field == "allow", F.lit("parser.emptyAllow")).otherwise("parser.emptyDisallow"), n)),
        F.when(rule & (value != "") & ~value.rlike("^[/*]") & ~absolute, finding(1, "warning", "parser.pathNoSlash", n, variant=field, value=value)),
        F.when(rule & (field == "disallow") & value.rlike(r"^\*+\z"), finding(1, "warning", "parser.wildcardOnly", n, value=value)),
        F.when(rule & F.contains(value, F.lit(" ")), finding(1, "warning", "parser.spaceInPath", n, value=value)),
        F.when(rule & ~absolute & _any_in(value, REGEX_TOKENS), finding(1, "warning", "parser.regexSyntax", n, value=value)),
        F.when(rule & (F.octet_length(value) != F.length(value)), finding(1, "info", "parser.nonAsciiPath", n, value=value)),
        F.when(place.isNotNull(), finding(1, "warning", "parser.placeholder", n, value=value, placeholder=place)),
        F.when((x["kind"] == "crawl-delay") & ~grouped, finding(1, "error", "parser.crawlDelayBeforeAgent", n)),
        F.when(in_group & delay.isNotNull() & repeated, finding(1, "info", "parser.crawlDelayDuplicate", n)),
        F.when(in_group & (delay >= P.HIGH_CRAWL_DELAY), finding(1, "warning", "parser.crawlDelayHigh", n, seconds=delay, pages=F.floor(86400 / delay))),
        F.when(in_group & delay.isNull(), finding(1, "warning", "parser.crawlDelayNaN", n, value=value)),
        F.when(in_group & (n == first_delay), finding(1, "info", "parser.crawlDelayNonStandard", n)),
        F.when((field == "sitemap") & ~valid_http_url(value), finding(1, "warning", "parser.sitemapInvalid", n, value=value)),
        F.when(field == "host", finding(1, "info", F.when(n == first_host, F.lit("parser.hostObsolete")).otherwise("parser.hostDuplicate"), n)),
        F.when(field == "clean-param", finding(1, F.when(clean_ok & (F.octet_length(value) <= P.CLEAN_PARAM_MAX), F.lit("info")).otherwise("warning"), F.when(~clean_ok, F.lit("parser.cleanParamMalformed")).when(F.octet_length(value) > P.CLEAN_PARAM_MAX, F.lit("parser.cleanParamTooLong")).otherwise("parser.cleanParamInfo"), n)),
        F.when(unknown, finding(1, unknown_level, unknown_id, n, field=raw_field, value=value)),
    )


def _group_start(delays: Column, n: Column) -> Column:
    return F.array_max(F.transform(F.filter(delays, lambda d: d["line"] <= n), lambda d: d["start"]))


def _group_findings(groups: Column) -> Column:
    empty = F.flatten(F.transform(groups, lambda g: _some(F.when((F.size(g["rules"]) == 0) & g["crawl_delay"].isNull(), finding(2, "info", "parser.emptyGroup", g["start_line"], variant=F.when(F.size(M.rules_of_token(groups, M.scope_token(g))) > 0, F.lit("merged")))))))
    tokens = F.filter(F.flatten(F.transform(groups, lambda g: F.transform(g["agents"], lambda a: a["token"]))), lambda t: t != "")
    repeated = let(tokens, lambda ts: F.flatten(F.transform(F.array_distinct(ts), lambda t: let(F.size(F.filter(ts, lambda u: u == t)), lambda k: _some(F.when(k > 1, finding(2, "info", "parser.tokenRepeated", token=t, n=k)))))))
    star = F.flatten(F.transform(F.filter(groups, lambda g: F.exists(g["agents"], lambda a: a["token"] == "*")), lambda g: g["rules"]))
    blocks = let(star, lambda r: F.exists(r, lambda x: (x["type"] == "disallow") & whole_site(x["path"])) & ~F.exists(r, lambda x: (x["type"] == "allow") & (x["path"] != "")))
    no_map = ~F.exists("lines", lambda x: x["kind"] == "sitemap")
    rest = _some(F.when(blocks, finding(2, "warning", "parser.starBlocksAll")), F.when(no_map & (F.size(groups) > 0), finding(2, "info", "parser.noSitemap")))
    return F.concat(_some(F.when(F.size(groups) == 0, finding(2, "info", "parser.noRules"))), empty, repeated, rest)


def _explode(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("file_id", *keep, F.explode_outer("found").alias("f")).where("f is not null").select("file_id", *keep, "f.phase", "f.line", "f.id", "f.level", "f.kind", "f.variant", "f.params")


#: signs in a value without which no finding about it is possible: wildcards alone, other than visible ASCII, regular expressions, placeholders
_ODD_VALUE = r"(?i)^\*+\z|[^!-~]|\\\.|\^/|\(\?|\[a-z|\[0-9|\.\+|\||example\.(com|org|net)|domainnamehere|your[-_]?domain|your-?site|mydomain\.com|<|\{\{"


def _may_be_odd(x: Column, first_group: Column) -> Column:
    """False only for lines that can have no finding: most lines of most files, which then need no further look."""
    value = x["value"]
    rule = (x["kind"] == "rule") & (x["n"] > first_group) & value.rlike(r"^[/*]")
    agent = (x["kind"] == "user-agent") & (x["token"] != "") & ((x["token"] == "*") | (x["token"] == F.lower(value)))
    plain = (rule | agent | ((x["kind"] == "sitemap") & valid_http_url(value))) & ~value.rlike(_ODD_VALUE)
    return ~F.coalesce(plain & x["comment"].isNull() & x["junk"].isNull() & ~x["misspelt"] & ~x["lookalike"], F.lit(False))


def _syntax() -> Column:
    """Array of the syntax findings of a parsed row."""
    first_line = lambda kind: F.coalesce(F.get(F.filter("lines", lambda x: x["kind"] == kind), F.lit(0))["n"], F.lit(2_000_000_000))
    delays = F.flatten(F.transform("groups", lambda g: F.transform(F.filter(g["delays"], lambda d: d["delay"].isNotNull()), lambda d: F.named_struct(F.lit("start"), g["start_line"], F.lit("line"), d["line"]))))
    first_delay = F.array_min(F.flatten(F.transform("groups", lambda g: F.transform(g["delays"], lambda d: d["line"]))))
    context = F.named_struct(F.lit("group"), first_line("user-agent"), F.lit("host"), first_line("host"), F.lit("delay"), first_delay, F.lit("delays"), delays, F.lit("nameless"), _nameless(F.col("groups")))
    odd = lambda c: F.filter("lines", lambda x: (x["kind"] != "blank") & _may_be_odd(x, c["group"]))
    single = let(context, lambda c: F.flatten(F.transform(odd(c), lambda x: _line_findings(x, c["group"], c["host"], c["delay"], c["delays"], c["nameless"]))))
    return F.concat(_file_findings(F.col("lines")), _group_findings(F.col("groups")), single)


def with_syntax(parsed: DataFrame) -> DataFrame:
    """Adds `found`, the array of the file's syntax findings."""
    return parsed.withColumn("found", _syntax())


def syntax_findings(parsed: DataFrame) -> DataFrame:
    return _explode(with_syntax(parsed))


# -- search visibility ---------------------------------------------------------------------------------------------


def _holds(scope: Column, r: Column, path: Column) -> Column:
    """Does the file really do to a path what the rule says, for the crawlers of the rule's group?"""
    return M.decide(scope, normalise_encoding(path))["allowed"] == (r["type"] == "allow")


def _blocked(groups: Column, path: Column) -> Column:
    return ~M.decide(M.rules_of_token(groups, F.lit("*")), normalise_encoding(path))["allowed"]


def _rule_findings(groups: Column, every: Column, scope: Column, g: Column, r: Column) -> Column:
    p, line = r["path"], r["line"]
    last = F.substring_index(p, "/", -1)
    trailing = (p != "") & ~whole_site(p) & ~p.rlike(r"[*$?]") & ~p.endswith("/") & (last != "") & ~F.contains(last, F.lit("."))
    sibling = F.exists(every, lambda q: F.startswith(q, p) & (F.length(q) > F.length(p)) & (F.substring(q, F.length(p) + 1, F.lit(1)) != "/"))
    disallow = (r["type"] == "disallow") & (p != "")
    low = F.lower(p)
    star = disallow & F.exists(g["agents"], lambda a: a["token"] == "*")
    file_in = lambda name: F.concat(F.regexp_replace(p, r"/+\z", ""), F.lit(f"/{name}"))
    broad = (
        F.when(low.isin(*QUERY_PATTERNS), F.when(_blocked(groups, F.lit("/?page=2")), F.lit("seo.queryStringBlock")))
        .when(low.isin(*ASSET_DIRS), F.when(_blocked(groups, file_in("app.js")), F.lit("seo.assetBlock")))
        .when(low.rlike(r"\.(css|js)\$?\z"), F.when(_blocked(groups, sample_path(p)), F.lit("seo.cssJsBlock")))
        .when(low.isin(*IMAGE_DIRS), F.when(_blocked(groups, file_in("photo.jpg")), F.lit("seo.imageBlock")))
        .when(F.exists(F.array(*map(F.lit, IMAGE_FILES)), lambda e: low.endswith(e)), F.when(_blocked(groups, sample_path(p)), F.lit("seo.imageBlock")))
    )
    url_rest = normalise_path(p)
    return _some(
        F.when(trailing & _holds(scope, r, F.concat(p, F.lit("-old"))), finding(3, F.when(sibling, F.lit("warning")).otherwise("info"), "seo.trailingSlash", line, "seo-trap", r["type"], path=p)),
        F.when(disallow & ~whole_site(p) & M.hits(r, F.lit("/robots.txt")) & _holds(scope, r, F.lit("/robots.txt")), finding(4, "warning", "seo.selfBlock", line, "seo-trap", path=p)),
        F.when(p.rlike("[A-Z]"), finding(5, "info", "seo.caseSensitive", line, "seo-trap", path=p, lower=sample_path(low))),
        F.when(star & broad.isNotNull(), finding(6, F.when(broad == "seo.imageBlock", F.lit("info")).otherwise("warning"), broad, line, "seo-trap", path=p)),
        F.when((p != "") & is_absolute_url(p), finding(9, "warning", "lint.absoluteUrl", line, "seo-trap", r["type"], path=url_rest)),
    )


def _shadow_check(rules: Column, scope: Column) -> Column:
    """Rules of one scope that never change the outcome: line, id, level, variant, winner."""

    def one(b: Column) -> Column:
        anchored = b["path"].endswith("$")
        literal = normalise_encoding(F.when(anchored, F.substring(b["path"], F.lit(1), F.length(b["path"]) - 1)).otherwise(b["path"]))

        def judge(lit: Column) -> Column:
            same = lambda r: (r["type"] == b["type"]) & (r["path"] == b["path"])
            others = F.filter(rules, lambda r: (r["path"] != "") & ~((r["line"] == b["line"]) & same(r)) & (anchored | ~r["path"].endswith("$")) & ~(same(r) & (r["line"] > b["line"])) & M.hits(r, lit))
            best = F.array_max(F.transform(others, lambda r: F.struct(r["norm_len"].alias("len"), (r["type"] == "allow").alias("allow"), (-r["line"]).alias("neg"), r["path"].alias("path"))))

            def verdict(w: Column) -> Column:
                same_type = w["allow"] == (b["type"] == "allow")
                ident = (
                    F.when(same_type & (w["path"] == b["path"]), F.lit("seo.duplicate")).when(same_type, F.lit("seo.redundant"))
                    .when((w["len"] > b["norm_len"]) | ((w["len"] == b["norm_len"]) & w["allow"]), F.lit("seo.overridden"))
                )
                hit = w.isNotNull() & ident.isNotNull()
                return F.when(hit, finding(7, F.when(ident == "seo.overridden", F.lit("warning")).otherwise("info"), ident, b["line"], "seo-trap", F.when(ident == "seo.overridden", b["type"]), path=b["path"], winner=w["path"], by=-w["neg"], scope=scope))

            return let(best, verdict)

        return F.when((b["path"] == "") | F.contains(b["path"], F.lit("*")), F.lit(None)).otherwise(let(literal, judge))

    return F.filter(F.transform(rules, one), lambda f: f.isNotNull())


def _first_per_line(found: Column) -> Column:
    return let(found, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, F.lit(1), i), lambda y: y["line"] == x["line"])))


def _shadowed(groups: Column) -> Column:
    own = F.flatten(F.transform(groups, lambda g: _shadow_check(g["rules"], F.lit(""))))
    tokens = F.filter(M.file_tokens(groups), lambda t: t != "")
    many = F.filter(tokens, lambda t: F.size(F.filter(groups, lambda g: F.exists(g["agents"], lambda a: a["token"] == t))) > 1)
    merged = F.flatten(F.transform(many, lambda t: _shadow_check(F.flatten(F.transform(F.filter(groups, lambda g: F.exists(g["agents"], lambda a: a["token"] == t)), lambda g: g["rules"])), t)))
    return _first_per_line(F.concat(own, merged))


def _seo(gs: Column) -> Column:
    """Array of the search findings of groups that carry patterns."""
    paths = F.transform(F.flatten(F.transform(gs, lambda h: h["rules"])), lambda r: r["path"])
    of_group = lambda every, g: let(M.rules_of_token(gs, M.scope_token(g)), lambda scope: F.flatten(F.transform(g["rules"], lambda r: _rule_findings(gs, every, scope, g, r))))
    return F.concat(let(paths, lambda every: F.flatten(F.transform(gs, lambda g: of_group(every, g)))), _shadowed(gs))


def seo_findings(parsed: DataFrame) -> DataFrame:
    """Trailing slashes, self blocks, case, broad blocks, absolute URLs and rules that never change the outcome."""
    return _explode(M.with_patterns(parsed).withColumn("found", _seo(F.col("groups"))))


def _sitemaps() -> Column:
    """Array of the findings about the valid sitemap URLs of a parsed row."""
    maps = F.filter("lines", lambda x: (x["kind"] == "sitemap") & valid_http_url(x["value"]))
    keyed = F.transform(maps, lambda x: F.struct(x["n"].alias("n"), normal_url(x["value"]).alias("url")))
    site, host = F.lower(F.col("site_url")), url_host(F.col("site_url"))

    def one(m: Column, first: Column) -> Column:
        map_host = url_host(m["url"])
        judge = site.rlike("^https?://") & host.isNotNull() & map_host.isNotNull()
        far = strip_www(host) != strip_www(map_host)
        return F.when(first < m["n"], _some(finding(8, "info", "sitemap.duplicate", m["n"], "sitemap", first=first))).otherwise(
            _some(
                F.when(judge & site.startswith("https:") & m["url"].startswith("http:"), finding(8, "warning", "sitemap.protocolMismatch", m["n"], "sitemap", url=F.regexp_replace(m["url"], "^http:", "https:"))),
                F.when(judge & site.startswith("http:") & m["url"].startswith("https:"), finding(8, "info", "sitemap.httpsOnHttp", m["n"], "sitemap")),
                F.when(judge & far, finding(8, F.when(root_domain(host) != root_domain(map_host), F.lit("warning")).otherwise("info"), F.when(root_domain(host) != root_domain(map_host), F.lit("sitemap.crossDomain")).otherwise("sitemap.otherSubdomain"), m["n"], "sitemap", host=map_host, site=host)),
            )
        )

    return let(keyed, lambda ms: F.flatten(F.transform(ms, lambda m: one(m, F.array_min(F.transform(F.filter(ms, lambda o: o["url"] == m["url"]), lambda o: o["n"]))))))


def sitemap_findings(parsed: DataFrame) -> DataFrame:
    """Duplicates of valid sitemap URLs, and against `site_url`: protocol, domain and host."""
    return _explode(parsed.withColumn("found", _sitemaps()))


def _legacy(legacy_tokens: list[str]) -> Column:
    """Array of the finding about a block list of old tools, if the row has one."""
    names = F.array(*[F.lit(t.lower()) for t in legacy_tokens])
    hits = F.filter(F.flatten(F.transform("groups", lambda g: F.transform(g["agents"], lambda a: F.struct(F.lower(trim_space(a["raw"])).alias("name"), a["line"].alias("line"))))), lambda a: F.array_contains(names, a["name"]))
    return let(hits, lambda h: let(F.size(F.array_distinct(F.transform(h, lambda a: a["name"]))), lambda k: _some(F.when(k >= LEGACY_THRESHOLD, finding(10, "info", "lint.legacyBadBots", F.get(h, F.lit(0))["line"], "lint", n=k)))))


def legacy_bot_findings(parsed: DataFrame, legacy_tokens: list[str]) -> DataFrame:
    """Block lists that name LEGACY_THRESHOLD or more names of a list of tools long gone."""
    return _explode(parsed.withColumn("found", _legacy(legacy_tokens)))


# -- responses -----------------------------------------------------------------------------------------------------


def _cache_directive(header: Column, name: str) -> Column:
    """Value of a Cache-Control directive: '' without one, null if it isn't there."""
    d = F.get(F.filter(F.transform(F.split(header, ","), trim_space), lambda x: (F.lower(x) == name) | F.lower(x).startswith(f"{name}=")), F.lit(0))
    return F.when(d.isNotNull(), F.when(F.instr(d, "=") > 0, F.regexp_replace(trim_space(F.substring(d, F.instr(d, "=") + 1, F.length(d))), '^"+|"+\\z', "")).otherwise(""))


def _whole_number(c: Column) -> Column:
    return F.when(trim_space(c).rlike(r"^\+?[0-9]{1,18}\z"), trim_space(c).cast("long"))


def _fetch(headers: bool = True, limits: dict[str, int] | None = None) -> Column:
    """Array of the findings about the response of a row; none for a null `fetch`."""
    limit = HEADER_LIMITS | (limits or {})
    f, h = F.col("fetch"), F.col("fetch.headers")
    status = f["status"]
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    media = F.nullif(F.lower(trim_space(F.substring_index(f["content_type"], ";", 1))), F.lit(""))
    charset = F.get(F.filter(F.transform(F.slice(F.split(f["content_type"], ";"), 2, 100), trim_space), lambda p: p.startswith("charset=") | p.startswith("CHARSET=")), F.lit(0))
    charset = F.lower(F.regexp_replace(F.substring(charset, 9, 200), '^"+|"+\\z', ""))
    cc, age = h["cache_control"], _cache_directive(h["cache_control"], "max-age")
    no_store = _cache_directive(cc, "no-store").isNotNull() | _cache_directive(cc, "no-cache").isNotNull() | F.coalesce(trim_space(age) == "0", F.lit(False))
    retry = _whole_number(h["retry_after"])
    vary = F.exists(F.transform(F.split(h["vary"], ","), lambda v: F.lower(trim_space(v))), lambda v: v.isin("user-agent", "*"))
    limited = F.coalesce(f["redirect_limit"], F.lit(False))
    place = lambda u: F.concat(url_host(u), F.coalesce(F.concat(F.lit(":"), url_port(u)), F.lit("")))
    a, b = place(f["robots_url"]), place(f["final_url"])
    bare = lambda x: F.regexp_replace(x, r"^www\.", "")
    k = "fetch"
    response = [
        F.when(status.between(500, 599), finding(11, "error", "fetch.warn.serverError", kind=k, status=status)).when(status == 429, finding(11, "warning", "fetch.warn.rateLimited", kind=k)).when(status.isin(401, 403), finding(11, "info", "fetch.warn.forbidden", kind=k, status=status)),
        F.when(ok, F.when(media.isNull(), finding(11, "warning", "fetch.warn.contentTypeMissing", kind=k)).when(media != "text/plain", finding(11, "warning", "fetch.warn.contentType", kind=k, type=media))),
        F.when(ok & looks_like_html(F.coalesce("body", F.lit(""))), finding(11, "error", "fetch.warn.htmlBody", kind=k)),
    ]
    header = [
        F.when(status.isin(429, 503) & (retry > limit["retry_after"]), finding(12, "warning", "fetch.warn.retryAfterLong", kind=k, seconds=retry, status=status)),
        F.when(ok & charset.isNotNull() & ~charset.isin("utf-8", "utf8", "us-ascii", "ascii"), finding(12, "warning", "fetch.warn.charset", kind=k, charset=charset)),
        F.when(ok & cc.isNotNull(), F.when(no_store, finding(12, "info", "fetch.warn.cacheNoStore", kind=k, value=trim_space(cc))).when(_whole_number(age) > limit["max_age"], finding(12, "warning", "fetch.warn.cacheTooLong", kind=k, maxage=_whole_number(age)))),
        F.when(ok & (trim_space(h["x_robots_tag"]) != ""), finding(12, "info", "fetch.warn.xRobotsTag", kind=k, value=trim_space(h["x_robots_tag"]))),
        F.when(ok & vary, finding(12, "info", "fetch.warn.varyUserAgent", kind=k, value=trim_space(h["vary"]))),
    ]
    redirect = [
        F.when(limited, finding(13, "error", "fetch.warn.redirectLimit", kind=k)),
        F.when(~limited & (a != b), F.when(bare(a) == bare(b), finding(13, "info", "fetch.warn.redirectSameSite", kind=k, host=b)).otherwise(finding(13, "warning", "fetch.warn.redirectOtherHost", kind=k, **{"from": a, "to": b}))),
        F.when(~limited & a.isNotNull() & b.isNotNull() & (url_path(f["final_url"]) != "/robots.txt"), finding(13, "warning", "fetch.warn.notRobotsPath", kind=k, path=url_path(f["final_url"]))),
    ]
    return F.when(f.isNotNull(), _some(*response, *(header if headers else []), *redirect))


def fetch_findings(files: DataFrame, headers: bool = True, limits: dict[str, int] | None = None) -> DataFrame:
    """Status, media type, charset, caching, robots header, Vary and redirects; files need `fetch` and `body`.

    A file without a fetch (null struct) has none.
    """
    return _explode(files.withColumn("found", _fetch(headers, limits)))


def all_findings(parsed: DataFrame, switches: dict[str, bool] | None = None, legacy_tokens: list[str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """Findings of every enabled check.  Needs site_url for sitemaps and fetch for responses, where these columns exist.

    The checks' arrays are concatenated in the row of the file and exploded once: one scan, one parser, no join.
    """
    on = {"seo_traps": True, "sitemaps": True, "headers": True} | (switches or {})
    ready = M.with_patterns(parsed)
    found = [_syntax()]
    if on["seo_traps"]:
        found += [_seo(F.col("groups")), *([_legacy(legacy_tokens)] if legacy_tokens else [])]
    if on["sitemaps"] and "site_url" in parsed.columns:
        found.append(_sitemaps())
    if "fetch" in parsed.columns:
        found.append(F.coalesce(_fetch(on["headers"], limits), F.array().cast(f"array<{FINDING}>")))
    return _explode(ready.withColumn("found", F.concat(*found)))


def with_overrides(findings: DataFrame, disabled: list[str], levels: dict[str, str]) -> DataFrame:
    """Drops disabled ids and overrides levels; both come from the rule pack and are literals."""
    out = findings.where(~F.col("id").isin(*disabled)) if disabled else findings
    if levels:
        out = out.withColumn("level", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), F.col("id")), F.col("level")))
    return out
