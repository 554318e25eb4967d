"""Roll-ups over files: status cards, summaries, crawl records and summary, leaderboard, report, tables for export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.text import body_hash, tsv_cell
from crawlquarry.operators import parse as P

LEVEL_RANK = {"error": 0, "warning": 1, "info": 2}


def ai_status(verdicts: DataFrame, categories: list[str]) -> DataFrame:
    """For every file and AI category: open, partial, blocked, total; and the callout of the first category."""
    mine = verdicts.where(F.col("category").isin(*categories))
    count = lambda v: F.count_if(F.col("verdict") == v)
    per = mine.groupBy("file_id", "category").agg(count("open").alias("n_open"), count("partial").alias("n_partial"), count("blocked").alias("n_blocked"), F.count("*").alias("total"), F.max("specific").alias("named"))
    callout = (
        F.when(F.col("n_blocked") == F.col("total"), "ok").when(F.col("n_blocked") + F.col("n_partial") == 0, "info").when((F.col("n_blocked") == 0) & ~F.col("named"), "info").otherwise("warning")
    )
    return per.withColumn("callout", F.when(F.col("category") == categories[0], callout)).drop("named")


def ai_cards(verdicts: DataFrame, categories: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """One card a file: file_id, headline, callout, callout_text, groups (category, label, counts, crawlers with an explanation).

    callout is about the first category: none of it, all blocked, none restricted, restricted but none named, else uneven.
    """
    labels = labels or {}
    table = F.create_map(*[F.lit(x) for c in categories for x in (c, labels.get(c, c.replace("_", " ")))])
    place = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i)])
    why = F.when(F.col("token").isNull(), "no group applies").when(F.col("specific"), F.concat(F.lit("group of "), "token")).otherwise("group of *")
    one = F.struct("ord", F.col("crawler").alias("name"), "verdict", F.col("token").alias("group_used"), why.alias("explanation"), "specific")
    count = lambda v: F.count_if(F.col("verdict") == v)
    per = verdicts.where(F.col("category").isin(*categories)).groupBy("file_id", "category").agg(
        count("open").alias("open"), count("partial").alias("partial"), count("blocked").alias("blocked"), F.count("*").alias("total"), F.array_sort(F.collect_list(one)).alias("crawlers")
    )  # crawlers of the fixed list
    group = F.struct(F.element_at(place, F.col("category")).alias("place"), "category", F.element_at(table, F.col("category")).alias("label"), "open", "partial", "blocked", "total", "crawlers")
    cards = verdicts.select("file_id").distinct().join(per.select("file_id", group.alias("g")).groupBy("file_id").agg(F.array_sort(F.collect_list("g")).alias("groups")), "file_id", "left")
    first = F.get(F.filter("groups", lambda g: g["place"] == 0), F.lit(0))
    listed = F.array_join(F.transform(F.filter(first["crawlers"], lambda c: c["verdict"] != "blocked"), lambda c: c["name"]), ", ")
    named = F.exists(first["crawlers"], lambda c: c["specific"])
    state = (
        F.when(first.isNull(), F.array(F.lit("info"), F.lit("No crawler of this kind is known.")))
        .when(first["blocked"] == first["total"], F.array(F.lit("ok"), F.lit("All of them are blocked.")))
        .when(first["blocked"] + first["partial"] == 0, F.array(F.lit("info"), F.lit("None of them is restricted.")))
        .when((first["blocked"] == 0) & ~named, F.array(F.lit("info"), F.lit("None of them is named.")))
        .otherwise(F.array(F.lit("warning"), F.concat(F.lit("Not blocked: "), listed)))
    )
    line = F.array_join(F.transform("groups", lambda g: F.concat(g["label"], F.lit(": "), g["blocked"].cast("string"), F.lit(" of "), g["total"].cast("string"), F.lit(" blocked"))), " · ")
    return cards.select("file_id", F.coalesce(line, F.lit("")).alias("headline"), state[0].alias("callout"), state[1].alias("callout_text"), "groups")


def issue_counts(findings: DataFrame) -> DataFrame:
    level = lambda v: F.count_if(F.col("level") == v)
    return findings.groupBy("file_id").agg(level("error").alias("errors"), level("warning").alias("warnings"), level("info").alias("infos"))


def file_sizes(parsed: DataFrame) -> DataFrame:
    """Groups, rules (empty ones too), sitemaps and bytes of every file, within its row."""
    return parsed.select(
        "file_id", "size", F.size("groups").alias("n_groups"), F.aggregate("groups", F.lit(0), lambda a, g: a + F.size(g["rules"])).alias("n_rules"), F.size(F.filter("lines", lambda x: x["kind"] == "sitemap")).alias("n_sitemaps")
    )


def report_summary(parsed: DataFrame, findings: DataFrame, security: DataFrame, verdicts: DataFrame, star: DataFrame, platforms: DataFrame, training: str) -> DataFrame:
    """One row a file with the counts a report opens with; every input is keyed by file_id, so one exchange serves all."""
    sec = security.groupBy("file_id").agg(F.count("*").alias("security_findings"))
    ai = verdicts.where(F.col("category") == training).groupBy("file_id").agg(F.count_if(F.col("verdict") == "blocked").alias("ai_training_blocked"), F.count("*").alias("ai_training_total"))
    out = file_sizes(parsed)
    for part in (issue_counts(findings), sec, ai, star.select("file_id", F.col("verdict").alias("policy"), "has_star_group"), platforms):
        out = out.join(part, "file_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("errors", "warnings", "infos", "security_findings", "ai_training_blocked", "ai_training_total")}
    return out.withColumns(zero)


def crawl_records(files: DataFrame, summary: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The wide record of every file: response, hash, counts, platform, crawlers map."""
    crawlers = verdicts.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("crawler", "verdict")))).alias("crawlers"))  # crawlers of the fixed list
    response = files.select("file_id", "domain", "fetch", body_hash(F.col("text")).alias("hash"))
    return response.join(summary, "file_id").join(crawlers, "file_id", "left").select(
        F.col("file_id").alias("record_id"), "domain", F.lit(True).alias("ok"), "fetch.status", "fetch.final_url", F.size("fetch.redirects").alias("redirects"), "fetch.bytes", "hash",
        "n_groups", "n_rules", "n_sitemaps", "errors", "warnings", "security_findings", "platform", "crawlers", "ai_training_blocked", "ai_training_total",
    )


def crawl_summary(records: DataFrame) -> DataFrame:
    """Counts over records in one pass by grouping sets: what, key, verdict, n.

    what: total, fetched, unreachable, with_robots, status, platform, crawler.  Exactly repeated records count once.
    """
    once = records.dropDuplicates(["record_id"])
    flat = once.select(F.col("status").cast("string").alias("status"), "platform", "ok", F.explode_outer(F.map_entries("crawlers")).alias("e"), F.col("record_id"))
    per_crawler = flat.where("e is not null").groupBy(F.col("e.key").alias("key"), F.col("e.value").alias("verdict")).agg(F.count("*").alias("n")).select(F.lit("crawler").alias("what"), "key", "verdict", "n")
    sets = once.select(F.coalesce(F.col("status").cast("string"), F.lit("none")).alias("status"), F.coalesce("platform", F.lit("none")).alias("platform"), "ok", F.coalesce(F.col("status").between(200, 299), F.lit(False)).alias("robots")).groupingSets([["status"], ["platform"], []], "status", "platform").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("ok").alias("fetched"), F.count_if("robots").alias("robots")
    )
    by = sets.where("g <> 3").select(F.when(F.col("g") == 1, "status").otherwise("platform").alias("what"), F.coalesce("status", "platform").alias("key"), F.lit(None).cast("string").alias("verdict"), "n")
    rows = F.array(*[F.struct(F.lit(w).alias("what"), c.cast("long").alias("n")) for w, c in (("total", F.col("n")), ("fetched", F.col("fetched")), ("unreachable", F.col("n") - F.col("fetched")), ("with_robots", F.col("robots")))])
    total = sets.where("g = 3").select(F.explode(rows).alias("r")).select("r.what", F.lit("").alias("key"), F.lit(None).cast("string").alias("verdict"), "r.n")
    return total.unionByName(by).unionByName(per_crawler)


def leaderboard(verdicts: DataFrame, categories: list[str]) -> DataFrame:
    """Blocked, restricted and open counts of every AI crawler, with the share that blocks it in whole percent."""
    mine = verdicts.where(F.col("category").isin(*categories))
    per = mine.groupBy("crawler").agg(*[F.count_if(F.col("verdict") == v).alias(a) for v, a in (("blocked", "blocked"), ("partial", "restricted"), ("open", "open"))], F.count("*").alias("sites"))
    return per.withColumn("blocked_percent", F.floor(F.col("blocked") * 100 / F.col("sites") + 0.5).cast("long"))


def worst(findings: DataFrame) -> DataFrame:
    """Worst level of every file: what a gate compares with its threshold."""
    rank = F.create_map(*[F.lit(x) for kv in LEVEL_RANK.items() for x in kv])
    return findings.groupBy("file_id").agg(F.min_by("level", F.element_at(rank, F.col("level"))).alias("worst"))


def line_notes(findings: DataFrame) -> DataFrame:
    return findings.where("line is not null").groupBy("file_id", "line").agg(F.array_sort(F.collect_list(F.struct("phase", "id"))).alias("f")).select("file_id", "line", F.transform("f", lambda x: x["id"]).alias("ids"))


# -- tables for export ---------------------------------------------------------------------------------------------


def tabs(parsed: DataFrame, findings: DataFrame, recon_tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """rules, sitemaps (the file itself first), issues and recon as tables."""
    rules = P.rules(parsed).join(P.agents(parsed).groupBy("file_id", "group_id").agg(F.array_join(F.array_sort(F.collect_list("raw")), ", ").alias("user_agents")), ["file_id", "group_id"]).select("file_id", "line", "user_agents", F.initcap("type").alias("rule"), "path")
    known = [c for c, of in (("fetch.final_url", "fetch"), ("site_url", "site_url")) if of in parsed.columns]
    own = parsed.select("file_id", F.lit(0).alias("line"), (F.coalesce(*known) if known else F.lit(None).cast("string")).alias("url"), F.lit(True).alias("valid"))
    maps = own.unionByName(P.sitemaps(parsed).select("file_id", "line", "url", "valid"))
    issues = findings.select("file_id", "line", F.when(F.col("level") == "info", "note").otherwise(F.col("level")).alias("level"), "kind", "id", "variant")
    parts = None
    for name, df in recon_tables.items():
        shown = F.concat_ws(" | ", *[F.col(c).cast("string") if not dict(df.dtypes)[c].startswith("array") else F.array_join(F.col(c).cast("array<string>"), ", ") for c in df.columns if c not in ("file_id", "line")])
        part = df.select("file_id", (F.col("line") if "line" in df.columns else F.lit(None)).cast("int").alias("line"), F.lit(name).alias("category"), shown.alias("item"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = issues.select("file_id", "line", F.lit("").alias("category"), F.lit("").alias("item")).limit(0)
    return {"rules": rules, "sitemaps": maps, "issues": issues, "recon": parts}


def tagged(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables as uniform text columns: sheet, file, and as many cells as the widest table has columns."""
    out = None
    width = max((len(df.columns) - ("file_id" in df.columns) for df in tables.values()), default=0)
    for name, df in tables.items():
        cols = [c for c in df.columns if c != "file_id"]
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols] + [F.lit("")] * (width - len(cols))
        part = df.select(F.lit(name).alias("sheet"), F.col("file_id").cast("string").alias("file"), *[c.alias(f"c{i + 1}") for i, c in enumerate(cells)])
        out = part if out is None else out.unionByName(part)
    return out


def nested_report(parsed: DataFrame, summary: DataFrame, findings: DataFrame, verdicts: DataFrame, security: DataFrame, recon: DataFrame | None = None, todo: DataFrame | None = None) -> DataFrame:
    """file_id and the report as one nested struct, ready for to_json; lists hold one file's rows only.

    recon (file_id, category, line, item) and todo (recommended_actions) add their lists; sitemaps come from the file.
    """
    lists = {
        "findings": findings.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("phase", "line", "id", "level", "kind", "variant"))).alias("findings")),
        "crawlers": verdicts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "crawler", "category", "token", "verdict"))).alias("crawlers")),
        "security": security.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "path", "category", "severity"))).alias("security")),
    }
    if recon is not None:
        lists["recon"] = recon.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("category", "line", "item"))).alias("recon"))
    if todo is not None:
        lists["actions"] = todo.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "action", "n", "lines", "items"))).alias("actions"))
    maps = F.transform(F.filter("lines", lambda x: x["kind"] == "sitemap"), lambda x: F.struct(x["n"].alias("line"), x["value"].alias("url")))
    out = parsed.select("file_id", maps.alias("sitemaps"), F.transform("groups", lambda g: F.struct(g["group_id"].alias("id"), g["agents"].alias("agents"), g["rules"].alias("rules"), g["crawl_delay"].alias("crawl_delay"))).alias("groups")).join(summary, "file_id")
    for df in lists.values():
        out = out.join(df, "file_id", "left")
    return out.select("file_id", F.struct(F.lit("1.0").alias("schema_version"), *[F.col(c) for c in out.columns if c != "file_id"]).alias("report"))


# -- recommended actions -------------------------------------------------------------------------------------------

#: actions of a report in order (fixed order); those with ids follow from findings, the others from what is named
ACTIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("redirect chain", ()), ("server error", ()), ("errors", ()), ("trailing slashes", ("seo.trailingSlash",)), ("self block", ("seo.selfBlock",)), ("useless rules", ("seo.redundant", "seo.duplicate", "seo.overridden")),
    ("absolute rules", ("lint.absoluteUrl",)), ("missing slashes", ("parser.pathNoSlash",)), ("sitemap protocol", ("sitemap.protocolMismatch",)), ("sitemap domain", ("sitemap.crossDomain",)), ("invalid sitemaps", ("parser.sitemapInvalid",)),
    ("add sitemap", ()), ("noindex", ("parser.noindex",)), ("crawl delay", ("parser.crawlDelayNonStandard",)), ("all blocked", ()), ("security", ()), ("uneven AI access", ()), ("decide on AI", ()), ("buckets", ()), ("test hosts", ()),
    ("personal data", ()), ("byte order mark", ("parser.bom",)), ("none", ()),
)
ORDER = {name: i for i, (name, _) in enumerate(ACTIONS)}
LINES_SHOWN = 6
ITEMS_SHOWN = 5


def _action(name: str) -> Column:
    return F.struct(F.lit(ORDER[name]).alias("ord"), F.lit(name).alias("action"))


def actions(findings: DataFrame) -> DataFrame:
    """Actions that follow from findings, in order, with at most LINES_SHOWN lines each (a report's list)."""
    pairs = F.create_map(*[x for name, ids in ACTIONS for k in ids for x in (F.lit(k), _action(name))])
    both = F.array(F.when(F.col("level") == "error", _action("errors")), F.try_element_at(pairs, F.col("id")))
    rows = findings.select("file_id", "line", F.explode(both).alias("a")).where("a is not null")
    return rows.groupBy("file_id", "a.ord", "a.action").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("line")), 1, LINES_SHOWN).alias("lines"))


def recommended_actions(parsed: DataFrame, findings: DataFrame, security: DataFrame, star: DataFrame, cards: DataFrame, recon: dict[str, DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """file_id, ord, action, n, lines, items: what to do about every file, in order; `none` for files without anything.

    keep: what holds the actions found, which are read twice (written).
    items: the first ITEMS_SHOWN paths of a security category (label first), or the crawlers, buckets and hosts meant.
    """
    none, lines = F.array().cast("array<string>"), F.array().cast("array<int>")

    def rows(df: DataFrame, name: str, n: Column, items: Column = none) -> DataFrame:
        return df.select("file_id", F.lit(ORDER[name]).alias("ord"), F.lit(name).alias("action"), n.cast("long").alias("n"), lines.alias("lines"), items.alias("items"))

    def listed(df: DataFrame, name: str, item: Column) -> DataFrame:
        return rows(df.groupBy("file_id").agg(F.array_sort(F.collect_set(item)).alias("items")), name, F.size("items"), F.col("items"))  # items of one file

    one = F.lit(1)
    out = [actions(findings).select("file_id", "ord", "action", "n", "lines", none.alias("items"))]
    if "fetch" in parsed.columns:
        out.append(rows(parsed.where("fetch.redirect_limit"), "redirect chain", one))
        out.append(rows(parsed.where("fetch.status >= 500"), "server error", one))
    bare = parsed.where(~F.exists("lines", lambda x: x["kind"] == "sitemap") & F.exists("groups", lambda g: F.size(g["rules"]) > 0))
    out.append(rows(bare, "add sitemap", one))
    out.append(rows(star.where("has_star_group and verdict = 'blocked'"), "all blocked", one))
    grave = security.where("severity <> 'low'").select("file_id", "category").distinct()
    paths = security.join(grave, ["file_id", "category"], "left_semi").groupBy("file_id", "category").agg(F.array_sort(F.collect_list(F.struct("line", "path"))).alias("p"))
    out.append(rows(paths, "security", F.size("p"), F.concat(F.array("category"), F.transform(F.slice("p", 1, ITEMS_SHOWN), lambda x: x["path"]))))
    first = F.get("groups", F.lit(0))
    open_ones = F.transform(F.filter(first["crawlers"], lambda c: c["verdict"] != "blocked"), lambda c: c["name"])
    out.append(rows(cards.where("callout = 'warning'"), "uneven AI access", F.size(open_ones), open_ones))
    out.append(rows(cards.where("callout = 'info' and size(groups) > 0"), "decide on AI", one))
    if "cloud" in recon:
        out.append(listed(recon["cloud"].where("kind = 'storage'"), "buckets", F.coalesce("bucket", "host")))
    if "hosts" in recon:
        out.append(listed(recon["hosts"].where("env is not null"), "test hosts", F.col("host")))
    if "comments" in recon:
        out.append(listed(recon["comments"].where("kind in ('email', 'person', 'ip', 'ticket')"), "personal data", F.col("kind")))
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    found = keep(found)
    rest = parsed.select("file_id").join(found.select("file_id").distinct(), "file_id", "left_anti")
    return found.unionByName(rows(rest, "none", F.lit(0)))


TAB_LABELS = {"rules": "Rules", "sitemaps": "Sitemaps", "issues": "Issues", "recon": "Recon"}


def tab_tsv(tables: dict[str, DataFrame], tab: str) -> DataFrame | None:
    """Lines of one tab, or of `all` tabs, as tab-separated text (file_id, tab, text); None for an unknown tab."""
    names = list(tables) if tab == "all" else [tab] if tab in tables else []
    out = None
    for name in names:
        df = tables[name]
        cells = [tsv_cell(F.col(c)) for c in df.columns if c != "file_id"]
        part = df.select("file_id", F.lit(TAB_LABELS.get(name, name)).alias("tab"), F.concat_ws("\t", *cells).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def summary_text(summary: DataFrame, findings: DataFrame, security: DataFrame, actions_: DataFrame) -> DataFrame:
    """file_id, text: counts, issues that aren't mere notes by level and line, sensitive paths, and actions in order."""
    rank = F.create_map(*[F.lit(x) for kv in LEVEL_RANK.items() for x in kv])
    far = F.lit(2_000_000_000)
    issue = F.struct(F.element_at(rank, F.col("level")).alias("r"), F.coalesce("line", far).alias("l"), F.concat_ws(" ", F.rpad("level", 7, " "), F.when(F.col("line").isNotNull(), F.concat(F.lit("L"), F.col("line").cast("string"))), F.concat_ws(".", "id", "variant")).alias("t"))
    path = F.struct("line", F.concat(F.rpad("severity", 7, " "), F.lit(" L"), F.col("line").cast("string"), F.lit(" Disallow: "), F.col("path"), F.lit(" ("), F.col("category"), F.lit(", "), F.col("reason"), F.lit(")")).alias("t"))
    todo = F.struct("ord", F.concat_ws(" ", "action", F.array_join(F.col("items"), ", ")).alias("t"))
    lists = (
        findings.where("level <> 'info'").groupBy("file_id").agg(F.array_sort(F.collect_list(issue)).alias("i")),
        security.groupBy("file_id").agg(F.array_sort(F.collect_list(path)).alias("s")), actions_.groupBy("file_id").agg(F.array_sort(F.collect_list(todo)).alias("a")),
    )
    out = summary
    for df in lists:
        out = out.join(df, "file_id", "left")
    texts = lambda c: F.coalesce(F.transform(c, lambda x: x["t"]), F.array().cast("array<string>"))
    head = F.concat_ws("", F.lit("errors "), "errors", F.lit(", warnings "), "warnings", F.lit(", notes "), "infos", F.lit("; sensitive paths "), "security_findings", F.lit("; AI training blocked "), "ai_training_blocked", F.lit("/"), "ai_training_total")
    numbered = F.transform(texts("a"), lambda t, k: F.concat((k + 1).cast("string"), F.lit(". "), t))
    return out.select("file_id", F.array_join(F.concat(F.array(head, F.lit("")), texts("i"), texts("s"), F.array(F.lit(""), F.lit("Recommended actions:")), numbered), "\n").alias("text"))
