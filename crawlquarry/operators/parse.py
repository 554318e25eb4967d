"""Texts to relational tables: lines, groups, agents, rules, sitemaps, hosts, parameters, unknown directives, comments.

A file is parsed inside its own row: its lines are an array that a few `transform` steps classify, and groups are
slices of the array of directives between the User-agent lines that open a group.  No step shuffles; the tables are
`explode`s of the parsed rows.

Input: file_id BIGINT, text STRING; other columns are carried along untouched.  A null text is an empty one; repeated
rows are parsed each; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.text import extract_token, trim_space, valid_http_url
from crawlquarry.session import rows_once, spread

READ_LIMIT = 500 * 1024
LONG_LINE = 2000
HIGH_CRAWL_DELAY = 60.0
CLEAN_PARAM_MAX = 500
COMMENT_MAX = 2000
#: canonical directive names in the order that breaks ties of distance (fixed values)
CANONICAL = ("user-agent", "allow", "disallow", "crawl-delay", "sitemap", "host", "clean-param")
#: spellings that are read as a directive (fixed values)
ALIASES = {
    "user-agent": "user-agent", "useragent": "user-agent", "user agent": "user-agent", "user_agent": "user-agent", "user -agent": "user-agent", "user - agent": "user-agent",
    "allow": "allow",
    "disallow": "disallow", "dissallow": "disallow", "disalow": "disallow", "dissalow": "disallow",
    "crawl-delay": "crawl-delay", "crawldelay": "crawl-delay", "crawl delay": "crawl-delay",
    "sitemap": "sitemap", "site-map": "sitemap", "sitemaps": "sitemap",
    "host": "host",
    "clean-param": "clean-param", "cleanparam": "clean-param",
}
#: directives of their own that are never read as a misspelling (fixed values)
AI_DIRECTIVES = ("license", "disallowaitraining", "allowaitraining", "ai", "tdm-reservation", "tdmrep", "tdm-policy", "content-usage")
LEGACY_DIRECTIVES = ("request-rate", "visit-time", "schemamap")
META_ROBOTS = ("nofollow", "noarchive", "nosnippet", "noimageindex", "unavailable_after", "notranslate", "max-snippet", "max-image-preview", "max-video-preview", "noodp", "noydir", "index", "follow")
OTHER_DIRECTIVES = ("noindex", "content-signal", "http", "https")
INVISIBLE = "\ufeff\u200b\u200c\u200d\u2060\u00ad"
LOOKALIKE_FROM, LOOKALIKE_TO = "аАеЕоОрРсСух", "aaeeooppccyx"
KIND_OF = {"user-agent": "user-agent", "allow": "rule", "disallow": "rule", "crawl-delay": "crawl-delay", "sitemap": "sitemap", "host": "host", "clean-param": "clean-param"}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: it is bound as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def nearest_directive(raw: Column) -> Column:
    """The canonical name within two edits of a field of four bytes or more, else null."""
    ranked = F.array(*[F.struct(F.levenshtein(raw, F.lit(n), 2).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(CANONICAL)])
    return F.when(F.octet_length(raw) >= 4, F.array_min(F.filter(ranked, lambda x: x["d"] >= 0))["name"])


def known_other(raw: Column) -> Column:
    return raw.isin(*AI_DIRECTIVES, *LEGACY_DIRECTIVES, *META_ROBOTS, *OTHER_DIRECTIVES) | raw.startswith("ai-") | raw.startswith("llm")


def _lines(src: Column) -> Column:
    """Array of classified lines; each step is one `transform`, so nothing is computed twice."""
    step = F.transform(
        F.split(src, "\r\n|\r|\n", -1),
        lambda raw, i: F.struct((i + 1).cast("int").alias("n"), raw.alias("raw"), F.instr(raw, "#").alias("hash"), F.substring_index(raw, "#", 1).alias("before")),
    )
    step = F.transform(
        step,
        lambda x: F.struct(
            x["n"].alias("n"), x["raw"].alias("raw"), (x["hash"] > 0).alias("has_comment"),
            F.when(x["hash"] > 0, F.substring(x["raw"], x["hash"], F.length(x["raw"]))).alias("comment"),
            F.contains(x["before"], F.lit("：")).alias("fullwidth_colon"),
            F.when(x["hash"] > 0, F.length(x["before"]) > 0).otherwise(False).alias("text_before"),
            F.substring(x["before"], -1, 1).alias("last_before"),
            trim_space(F.replace(x["before"], F.lit("："), F.lit(":"))).alias("content"),
        ),
    )
    step = F.transform(step, lambda x: x.withField("colon", F.instr(x["content"], ":")))
    step = F.transform(
        step,
        lambda x: x.withField("field_src", F.when(x["colon"] > 0, F.substring(x["content"], F.lit(1), x["colon"] - 1)).otherwise(x["content"])).withField(
            "value", F.when(x["colon"] > 0, trim_space(F.substring(x["content"], x["colon"] + 1, F.length(x["content"])))).otherwise("")
        ),
    )
    step = F.transform(step, lambda x: x.withField("seen", F.translate(x["field_src"], INVISIBLE, "")))
    step = F.transform(step, lambda x: x.withField("folded", F.translate(x["seen"], LOOKALIKE_FROM, LOOKALIKE_TO)))
    step = F.transform(step, lambda x: x.withField("low", F.lower(trim_space(x["folded"]))))
    step = F.transform(step, lambda x: x.withField("rest", F.regexp_replace(x["low"], r"^[^A-Za-z0-9]+", "")))
    step = F.transform(step, lambda x: x.withField("raw_field", F.when(x["rest"] == "", x["low"]).otherwise(x["rest"])))
    step = F.transform(step, lambda x: x.withField("known", _lookup(x["raw_field"], ALIASES)))
    step = F.transform(
        step,
        lambda x: x.withField(
            "field", F.when(x["content"] == "", None).when(x["colon"] == 0, None).when(x["known"].isNotNull(), x["known"]).when(known_other(x["raw_field"]), None).otherwise(nearest_directive(x["raw_field"]))
        ),
    )

    def final(x: Column) -> Column:
        junk = F.when(x["rest"] != "", F.substring(x["low"], F.lit(1), F.length(x["low"]) - F.length(x["rest"])))
        kind = (
            F.when(x["content"] == "", F.when(x["has_comment"], F.lit("comment")).otherwise(F.lit("blank")))
            .when(x["colon"] == 0, F.lit("invalid"))
            .when(x["field"].isNull(), F.lit("unknown"))
            .otherwise(_lookup(x["field"], KIND_OF))
        )
        value = x["value"]
        return F.struct(
            x["n"].alias("n"), x["raw"].alias("raw"), kind.alias("kind"), x["field"].alias("field"), x["raw_field"].alias("raw_field"), value.alias("value"),
            x["content"].alias("content"), x["comment"].alias("comment"), x["text_before"].alias("text_before"), x["last_before"].alias("last_before"),
            (x["colon"] > 0).alias("has_colon"), x["fullwidth_colon"].alias("fullwidth_colon"),
            (x["seen"] != x["field_src"]).alias("invisible"), (x["folded"] != x["seen"]).alias("lookalike"),
            F.when(junk.rlike("[^ ]"), junk).alias("junk"),
            (x["field"].isNotNull() & (x["field"] != x["raw_field"])).alias("misspelt"),
            F.when(x["field"] == "user-agent", extract_token(value)).alias("token"),
        )

    return F.transform(step, final)


def crawl_delay_value(value: Column) -> Column:
    """A finite number of zero or more, else null; `5d` and blanks are no numbers."""
    return F.when(value.rlike(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), F.nullif(value.try_cast("double"), F.lit(float("inf")))).when(value.rlike(r"^-0*\.?0*\z") & value.rlike("0"), F.lit(0.0))


def parse(files: DataFrame) -> DataFrame:
    """The files with `lines` and `groups` (arrays), `size`, `bom`, `utf16` and the repaired text `src`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = files.withColumns({"size": F.octet_length(text).cast("long"), "bom": text.startswith("\ufeff"), "src": F.when(text.startswith("\ufeff"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)})
    head = F.left(F.col("src"), F.lit(512))
    nuls = F.length(head) - F.length(F.replace(head, F.lit("\x00"), F.lit("")))
    out = out.withColumn("utf16", (F.length(head) >= 4) & (nuls * 4 >= F.length(head)))
    out = out.withColumn("src", F.when(F.col("utf16"), F.translate("src", "\x00\ufeff\ufffe", "")).otherwise(F.col("src")))
    out = out.withColumn("lines", _lines(F.col("src")))
    return with_groups(out)


# explode_outer and a filter behind it: a plain explode makes the optimizer copy the whole expression into a filter below


def with_groups(parsed: DataFrame) -> DataFrame:
    """Adds `orphans` (directives before the first group) and `groups`: group_id, start_line, end_line, agents, rules, delays."""
    directives = F.filter("lines", lambda x: x["kind"].isin("user-agent", "rule", "crawl-delay"))
    is_agent = lambda x: x["kind"] == "user-agent"

    def opened(d: Column) -> Column:
        """Places of the User-agent lines that open a group: not directly behind another one."""
        pairs = F.arrays_zip(d.alias("now"), F.concat(F.array(F.lit(None).cast("string")), F.transform(d, lambda x: x["kind"])).alias("before"))
        marked = F.transform(F.slice(pairs, F.lit(1), F.greatest(F.size(d), F.lit(1))), lambda x, i: F.when(is_agent(x["now"]) & ~F.coalesce(x["before"] == "user-agent", F.lit(False)), i + 1))
        return F.filter(marked, lambda i: i.isNotNull())

    def cut_up(d: Column, at: Column) -> Column:
        """orphans and the slices between openings."""
        ends = F.concat(F.slice(at, F.lit(2), F.greatest(F.size(at), F.lit(1))), F.array(F.size(d) + 1))
        spans = F.zip_with(at, F.slice(ends, F.lit(1), F.greatest(F.size(at), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.struct(
            F.slice(d, F.lit(1), F.coalesce(F.get(at, F.lit(0)), F.size(d) + 1) - 1).alias("orphans"),
            F.transform(F.filter(spans, lambda s: s["a"].isNotNull() & s["b"].isNotNull()), lambda s, k: group(F.struct((k + 1).alias("k"), F.slice(d, s["a"], s["b"] - s["a"]).alias("items")))).alias("groups"),
        )

    def group(g: Column) -> Column:
        items = g["items"]
        pick = lambda kind: F.filter(items, lambda x: x["kind"] == kind)
        delays = F.transform(pick("crawl-delay"), lambda x: F.struct(x["n"].alias("line"), x["value"].alias("value"), crawl_delay_value(x["value"]).alias("delay")))
        return F.struct(
            g["k"].cast("int").alias("group_id"), F.element_at(items, 1)["n"].alias("start_line"), F.element_at(items, -1)["n"].alias("end_line"),
            F.transform(pick("user-agent"), lambda x: F.struct(x["value"].alias("raw"), x["token"].alias("token"), x["n"].alias("line"))).alias("agents"),
            F.transform(pick("rule"), lambda x: F.struct(x["field"].alias("type"), x["value"].alias("path"), x["n"].alias("line"))).alias("rules"),
            delays.alias("delays"), F.get(F.filter(delays, lambda d: d["delay"].isNotNull()), F.lit(0))["delay"].alias("crawl_delay"),
        )

    out = parsed.withColumn("__s", let(directives, lambda d: let(opened(d), lambda at: cut_up(d, at))))
    return out.withColumns({"orphans": F.col("__s.orphans"), "groups": F.col("__s.groups")}).drop("__s")


# -- tables --------------------------------------------------------------------------------------------------------


def lines(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode_outer("lines").alias("l")).where("l is not null").select("file_id", F.col("l.n").alias("line"), "l.raw", "l.kind", F.when(F.col("l.kind").isin("blank", "comment", "invalid"), None).otherwise(F.coalesce("l.field", "l.raw_field")).alias("field"), "l.value")


def groups(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode_outer("groups").alias("g")).where("g is not null").select(
        "file_id", "g.group_id", "g.start_line", "g.end_line", "g.crawl_delay", F.size("g.agents").alias("n_agents"), F.size("g.rules").alias("n_rules")
    )


def agents(parsed: DataFrame) -> DataFrame:
    return parsed.select("file_id", F.explode_outer("groups").alias("g")).where("g is not null").select("file_id", "g.group_id", F.explode_outer("g.agents").alias("a")).where("a is not null").select("file_id", "group_id", "a.raw", "a.token", "a.line")


def rules(parsed: DataFrame) -> DataFrame:
    """Rules of groups, empty paths included; rules before the first group don't count."""
    return parsed.select("file_id", F.explode_outer("groups").alias("g")).where("g is not null").select("file_id", "g.group_id", F.explode_outer("g.rules").alias("r")).where("r is not null").select("file_id", "group_id", "r.type", "r.path", "r.line")


def effective_rules(parsed: DataFrame) -> DataFrame:
    """Rules with a path, with its lower-case form."""
    return rules(parsed).where("path <> ''").withColumn("lower", F.lower("path"))


def _of_kind(parsed: DataFrame, kind: str) -> DataFrame:
    return parsed.select("file_id", F.explode_outer(F.filter("lines", lambda x: x["kind"] == kind)).alias("l")).where("l is not null").select("file_id", F.col("l.n").alias("line"), F.col("l.value").alias("value"), F.col("l.raw_field").alias("raw_field"))


def sitemaps(parsed: DataFrame) -> DataFrame:
    return _of_kind(parsed, "sitemap").select("file_id", F.col("value").alias("url"), "line", valid_http_url(F.col("value")).alias("valid"))


def hosts(parsed: DataFrame) -> DataFrame:
    """The first Host line of each file."""
    first = F.get(F.filter("lines", lambda x: x["kind"] == "host"), F.lit(0))
    return parsed.select("file_id", first.alias("h")).where("h is not null").select("file_id", "h.value", F.col("h.n").alias("line"))


def clean_params(parsed: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.col("value"), r"\s+"), lambda x: x != "")
    out = _of_kind(parsed, "clean-param").withColumn("w", words)
    names = F.filter(F.split(F.coalesce(F.get("w", F.lit(0)), F.lit("")), "&"), lambda x: x != "")
    path = F.coalesce(F.get("w", F.lit(1)), F.lit("/"))
    valid = (F.size("w") <= 2) & (F.size(names) > 0) & F.forall(names, lambda x: x.rlike(r"^[A-Za-z0-9_.-]+\z")) & path.rlike(r"^[/*]")
    return out.select("file_id", names.alias("params"), path.alias("path"), "line", valid.alias("valid"), F.octet_length("value").alias("n_bytes"))


def unknown_directives(parsed: DataFrame) -> DataFrame:
    return _of_kind(parsed, "unknown").select("file_id", F.col("raw_field").alias("field"), "value", "line")


def comments(parsed: DataFrame) -> DataFrame:
    """Text after the first `#` of each line, trimmed, without empty ones, at most COMMENT_MAX characters."""
    found = F.filter(F.transform("lines", lambda x: F.struct(x["n"].alias("line"), F.left(trim_space(F.substring(x["comment"], 2, 2_147_483_647)), F.lit(COMMENT_MAX)).alias("text"))), lambda c: c["text"] != "")
    return parsed.select("file_id", F.explode_outer(found).alias("c")).where("c is not null").select("file_id", "c.line", "c.text")


def files_of_fetches(fetches: DataFrame, gate: bool = True) -> DataFrame:
    """Files of a table of fetches: each fetch once; with `gate`, the body of an unusable answer is empty.

    A fetch delivered twice is kept once, by id (only such rows are shuffled); the response comes along as the struct `fetch`.
    """
    usable = F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~F.coalesce("redirect_limit", F.lit(False))
    text = F.coalesce(F.col("text"), F.lit(""))
    response = F.struct("source", "robots_url", "final_url", "status", "status_text", "content_type", "bytes", "truncated", "redirects", "redirect_limit", "headers")
    once = spread(rows_once(fetches, "fetch_id"))
    return once.select(
        F.col("fetch_id").alias("file_id"), F.when(usable, text).otherwise("").alias("text") if gate else text.alias("text"),
        "domain", F.coalesce("site_url", F.regexp_extract("final_url", r"(?i)^(https?://[^/?#]+)", 1)).alias("site_url"), response.alias("fetch"), F.col("text").alias("body"), "observed_at",
    )


def once_by_domain(fetches: DataFrame) -> DataFrame:
    """The latest fetch of every domain, ties by the highest fetch_id."""
    best = fetches.where("domain is not null and fetch_id is not null").groupBy("domain").agg(F.max(F.struct("observed_at", "fetch_id"))["fetch_id"].alias("fetch_id"))
    return rows_once(fetches, "fetch_id").join(best, ["domain", "fetch_id"], "left_semi")
