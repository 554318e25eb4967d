"""What rules and comments give away: sensitive paths, platform, generators, cloud hosts, host names, interfaces,
feeds, portals, search, file types and comment metadata.

Signatures come from the rule pack and become literals: one CASE for each list, in the pack's order, so the first match
wins with early exit and nothing is joined or shuffled.  First-wins lists keep the earliest line by a window over the
file's own rows.  Empty tables give empty results; repeated rules are kept or dropped as each docstring says.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlquarry import config as C
from crawlquarry.functions.text import (
    extract_hostnames, extract_urls, is_absolute_url, is_ipv4, is_private_ip, plain_path, root_domain, segments, strip_www, url_host, url_path, whole_site,
)
from crawlquarry.operators import parse as P

SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2, "info": 3}


def _first_case(text: Column, entries: list[tuple[str, Column]]) -> Column:
    """Value of the first entry whose pattern is found in the text."""
    return F.coalesce(*[F.when(text.rlike(p), v) for p, v in entries], F.lit(None))


def _first_per(df: DataFrame, *keys: str) -> DataFrame:
    """The earliest line of each key in each file."""
    w = Window.partitionBy("file_id", *keys).orderBy("line")
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


# -- sensitive paths -----------------------------------------------------------------------------------------------


def sensitive_paths(parsed: DataFrame, config: dict[str, Any], platforms: DataFrame | None = None) -> DataFrame:
    """Disallow rules that point at sensitive places: file_id, path, line, category, severity, reason, user_agents.

    The most severe matching signature wins, ties go to the pack's order.  A path that belongs to the stock file of the
    file's platform (`platforms`: file_id, platform) is a mere note.
    """
    rows = parsed.select("file_id", F.explode_outer("groups").alias("g")).where("g is not null").select("file_id", F.transform("g.agents", lambda a: a["raw"]).alias("user_agents"), F.explode_outer("g.rules").alias("r")).where("r is not null")
    rows = rows.select("file_id", "user_agents", "r.type", "r.path", "r.line").where((F.col("type") == "disallow") & (F.col("path") != "") & ~whole_site(F.col("path")))
    rows = rows.withColumn("p", F.regexp_replace(F.lower("path"), r"\$\z", ""))
    for x in config["security"].get("ignore", []):
        rows = rows.where(~F.col("p").rlike(x))
    entries = []
    for s in sorted(config["security"]["signature"], key=lambda s: SEVERITY_RANK[s["severity"]]):
        entries.append((_signature(s), F.struct(F.lit(s["category"]).alias("category"), F.lit(s["severity"]).alias("severity"), F.lit(s["reason"]).alias("reason"))))
    rows = rows.where(F.col("p").rlike("|".join(x for x, _ in entries))).withColumn("s", _first_case(F.col("p"), entries)).where("s is not null")
    if platforms is not None:
        stock = [(p["name"], d.lower()) for p in config.get("platform", []) for d in p.get("defaults", [])]
        rows = rows.join(platforms.select("file_id", "platform"), "file_id", "left")
        hit = F.concat_ws("\x1f", F.coalesce("platform", F.lit("")), "p").isin(*[f"{a}\x1f{b}" for a, b in stock]) if stock else F.lit(False)
        rows = rows.withColumn("s", F.when(hit, F.struct(F.col("s.category").alias("category"), F.lit("info").alias("severity"), F.lit("stock path of the platform").alias("reason"))).otherwise(F.col("s")))
    return rows.select("file_id", "path", "line", "s.category", "s.severity", "s.reason", "user_agents")


def _signature(s: dict[str, Any]) -> str:
    patterns = ([C.keyword_pattern(s["keywords"])] if s.get("keywords") else []) + ([s["pattern"]] if s.get("pattern") else [])
    return "|".join(f"(?:{x})" for x in patterns)


def grave_paths(groups: Column, config: dict[str, Any]) -> Column:
    """Paths that sensitive_paths, without platforms, gives the severity `high`, as an array in the row of the file.

    The most severe signature wins, so one of that severity is enough.
    """
    high = "|".join(_signature(s) for s in config["security"]["signature"] if s["severity"] == "high") or r"(?!)"
    rules = F.filter(F.flatten(F.transform(groups, lambda g: g["rules"])), lambda r: (r["type"] == "disallow") & (r["path"] != "") & ~whole_site(r["path"]))

    def grave(path: Column) -> Column:
        low = F.regexp_replace(F.lower(path), r"\$\z", "")
        hit = low.rlike(high)
        for x in config["security"].get("ignore", []):
            hit = hit & ~low.rlike(x)
        return hit

    return F.filter(F.array_distinct(F.transform(rules, lambda r: r["path"])), grave)


def security_categories(findings: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Categories present in each file, in the pack's order, with label and advice."""
    info = {c["id"]: (i, c["label"], c["advice"]) for i, c in enumerate(config["security"]["category"])}
    pick = lambda i, d: F.coalesce(*[F.when(F.col("category") == k, F.lit(v[i])) for k, v in info.items()], d)
    return findings.groupBy("file_id", "category").agg(F.count("*").alias("n")).select("file_id", pick(0, F.lit(len(info))).alias("ord"), "category", pick(1, F.col("category")).alias("label"), pick(2, F.lit("")).alias("advice"), "n")


# -- platform and generators ---------------------------------------------------------------------------------------


def platform_scores(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Score of every platform with a hit in a file: 2 x distinct strong + distinct weak + 3 x comment lines.

    For each rule the first strong pattern counts, else the first weak one; weak hits alone need two.
    """
    sigs = config.get("platform", [])
    union = lambda *kinds: "|".join(f"(?:{x})" for s in sigs for k in kinds for x in s.get(k, [])) or r"(?!)"
    # most paths and comments speak for no platform: one pattern of all drops them before each platform looks
    paths = F.array_distinct(F.filter(F.transform(F.flatten(F.transform("groups", lambda g: g["rules"])), lambda r: F.lower(r["path"])), lambda p: (p != "") & p.rlike(union("strong", "weak"))))
    notes = F.filter(F.transform(F.filter("lines", lambda x: x["comment"].isNotNull()), lambda x: F.lower(x["comment"])), lambda c: c.rlike(union("comments")))
    base = parsed.select("file_id", paths.alias("paths"), notes.alias("notes"))

    def one(i: int, s: dict[str, Any]) -> Column:
        hit = lambda p: F.coalesce(*[F.when(p.rlike(x), F.lit(f"s{k}")) for k, x in enumerate(s.get("strong", []))], *[F.when(p.rlike(x), F.lit(f"w{k}")) for k, x in enumerate(s.get("weak", []))], F.lit(None))
        found = F.array_distinct(F.filter(F.transform("paths", hit), lambda h: h.isNotNull()))
        strong = F.size(F.filter(found, lambda h: h.startswith("s")))
        weak = F.size(found) - strong
        comment_pattern = "|".join(f"(?:{x})" for x in s.get("comments", [])) or r"(?!)"
        said = F.size(F.filter("notes", lambda c: c.rlike(comment_pattern)))
        return F.named_struct(F.lit("ord"), F.lit(i), F.lit("platform"), F.lit(s["name"]), F.lit("kind"), F.lit(s["kind"]), F.lit("strong"), strong, F.lit("weak"), weak, F.lit("said"), said)

    if not sigs:
        return base.select("file_id", F.lit("").alias("platform"), F.lit("").alias("kind"), F.lit(0).alias("score"), F.lit("").alias("confidence")).limit(0)
    rows = base.select("file_id", F.explode_outer(F.array(*[one(i, s) for i, s in enumerate(sigs)])).alias("s")).where("s is not null").select("file_id", "s.*")
    rows = rows.where("strong > 0 or said > 0 or weak >= 2").withColumn("score", F.expr("2 * strong + weak + 3 * said"))
    confidence = F.when((F.col("strong") == 0) & (F.col("said") == 0), "low").when(F.col("score") >= 4, "high").when(F.col("score") >= 2, "medium").otherwise("low")
    return rows.select("file_id", "platform", "kind", "score", confidence.alias("confidence"))


def platform_evidence(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """What speaks for each platform: file_id, platform, line, source (rule or comment), strength, text; one row a line and platform.

    A rule speaks by its first strong pattern, else by its first weak one, a comment by any of the platform's.
    """
    sigs = config.get("platform", [])

    def of_rule(path: Column) -> Column:
        """(platform, strength) that a path speaks for."""
        found = [
            F.coalesce(*[F.when(path.rlike("|".join(f"(?:{x})" for x in s[k])), F.struct(F.lit(s["name"]).alias("platform"), F.lit(k).alias("strength"))) for k in ("strong", "weak") if s.get(k)], F.lit(None))
            for s in sigs if s.get("strong") or s.get("weak")
        ]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    said = [F.when(F.lower("text").rlike("|".join(f"(?:{x})" for x in s["comments"])), F.struct(F.lit(s["name"]).alias("platform"), F.lit("comment").alias("strength"))) for s in sigs if s.get("comments")]
    rules = P.effective_rules(parsed).select("file_id", "line", F.lit("rule").alias("source"), F.col("path").alias("text"), F.explode_outer(of_rule(F.col("lower"))).alias("e"))
    notes = P.comments(parsed).select("file_id", "line", F.lit("comment").alias("source"), "text", F.explode_outer(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("e"))
    return rules.unionByName(notes).where("e is not null").select("file_id", "e.platform", "line", "source", "e.strength", "text").dropDuplicates(["file_id", "platform", "line", "source"])


def primary_platform(scores: DataFrame) -> DataFrame:
    """The best platform of each file that may be one and isn't of low confidence: file_id, platform."""
    able = scores.where(F.col("kind").isin("cms", "ecommerce", "hosting", "forum", "wiki") & (F.col("confidence") != "low"))
    return able.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "platform"))["platform"].alias("platform"))


def generators(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """First comment line of each file that names a generator: file_id, generator, line, text."""
    hits = F.array(*[F.when(F.lower("text").rlike("|".join(f"(?:{x})" for x in g["comments"])), F.lit(g["name"])) for g in config.get("generator", [])])
    rows = P.comments(parsed).select("file_id", "line", "text", F.explode_outer(F.filter(hits, lambda x: x.isNotNull())).alias("generator")).where("generator is not null")
    return rows.groupBy("file_id", "generator").agg(F.min(F.struct("line", "text")).alias("m")).select("file_id", "generator", "m.line", "m.text")


# -- URLs and hosts ------------------------------------------------------------------------------------------------


def collected_urls(parsed: DataFrame) -> DataFrame:
    """URLs of valid sitemaps, Host, absolute rules and comments: file_id, ord, line, source, url."""
    maps = P.sitemaps(parsed).where("valid").select("file_id", F.lit(0).alias("ord"), "line", F.lit("Sitemap").alias("source"), "url")
    host = P.hosts(parsed).where("value <> ''").select("file_id", F.lit(1).alias("ord"), "line", F.lit("Host").alias("source"), F.when(is_absolute_url(F.col("value")), F.col("value")).otherwise(F.concat(F.lit("https://"), "value")).alias("url"))
    rules = P.rules(parsed).where(is_absolute_url(F.col("path"))).select("file_id", F.lit(2).alias("ord"), "line", F.initcap("type").alias("source"), F.col("path").alias("url"))
    said = P.comments(parsed).select("file_id", F.lit(3).alias("ord"), "line", F.lit("comment").alias("source"), F.explode_outer(extract_urls(F.col("text"))).alias("url")).where("url is not null")
    return maps.unionByName(host).unionByName(rules).unionByName(said)


def bucket_of(url: Column, host: Column, spec: str) -> Column:
    """Bucket by the pack's little language: the first alternative with any part, its parts joined by ` / `."""
    path = url_path(url)
    segs = F.filter(F.split(path, "/"), lambda x: x != "")

    def part(kind: str, arg: str) -> Column:
        if kind == "segment":
            return F.get(segs, F.lit(int(arg) - 1))
        return F.nullif(F.regexp_extract(host if kind == "host" else path, arg, 1), F.lit(""))

    return F.coalesce(*[F.nullif(F.concat_ws(" / ", *[part(k, a) for k, a in parts]), F.lit("")) for parts in C.parse_bucket_spec(spec)])


def cloud_assets(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Hosts of cloud providers, each host and bucket of a file once, at its first mention."""
    rows = collected_urls(parsed).withColumn("host", url_host(F.col("url"))).where("host is not null")
    pack = config.get("cloud", [])
    if not pack:
        return rows.select("file_id", "line", "source", "host", F.lit("").alias("provider"), F.lit("").alias("kind"), F.lit("").alias("bucket")).limit(0)
    which = F.coalesce(*[F.when(F.col("host").rlike(c["host"]), F.struct(F.lit(i).alias("i"), F.lit(c["provider"]).alias("provider"), F.lit(c["kind"]).alias("kind"))) for i, c in enumerate(pack)])
    rows = rows.select("*", F.explode_outer(F.array(which)).alias("c")).where("c is not null")  # the explode keeps the many patterns from being copied
    bucket = F.coalesce(*[F.when(F.col("c.i") == i, bucket_of(F.col("url"), F.col("host"), c["bucket"])) for i, c in enumerate(pack) if c.get("bucket")], F.lit(None).cast("string"))
    rows = rows.select("file_id", "ord", "line", "source", "host", "c.provider", "c.kind", bucket.alias("bucket"))
    w = Window.partitionBy("file_id", "host", "bucket").orderBy("ord", "line")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "ord")


def environment_tag(host: Column, config: dict[str, Any]) -> Column:
    """Label of a host that smells of a test or staging system."""
    bare = strip_www(host)
    root = root_domain(host)
    subs = F.split(F.when(F.length(bare) > F.length(root) + 1, F.substring(bare, F.lit(1), F.length(bare) - F.length(root) - 1)).otherwise(""), r"\.")
    exact = F.get(F.filter(subs, lambda x: x.rlike(config["hosts"]["env_labels"])), F.lit(0))
    loose = F.get(F.filter(F.split(bare, r"\."), lambda x: x.rlike(config["hosts"]["env_label_fallback"])), F.lit(0))
    return F.coalesce(exact, loose)


def leaked_hosts(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Hosts other than the site itself and cloud hosts: file_id, host, relation, env, n_sources, first_line, sources.

    sources are the mentions (line, source) of one file, each once, in order.
    """
    blank_mail = F.regexp_replace("text", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", " ")
    urls = collected_urls(parsed).where("source <> 'comment'").select("file_id", "line", "source", F.coalesce(url_host(F.col("url")), F.lit("")).alias("host"))
    said = P.comments(parsed).withColumn("t", blank_mail).select("file_id", "line", F.lit("comment").alias("source"), F.explode_outer(F.array_distinct(F.concat(F.transform(extract_urls(F.col("t")), url_host), extract_hostnames(F.col("t"))))).alias("host")).where("host is not null")
    mentions = urls.unionByName(said).where("host is not null and host <> ''")
    cloud = "|".join(f"(?:{c['host']})" for c in config.get("cloud", [])) or r"(?!)"
    sites = parsed.select("file_id", url_host(F.col("site_url")).alias("site")) if "site_url" in parsed.columns else parsed.select("file_id", F.lit(None).cast("string").alias("site"))
    per_host = mentions.where(~F.col("host").rlike(cloud)).groupBy("file_id", "host").agg(F.array_sort(F.collect_set(F.struct("line", "source"))).alias("sources")).withColumns({"n_sources": F.size("sources").cast("long"), "first_line": F.array_min(F.transform("sources", lambda x: x["line"]))})
    rows = per_host.join(sites, "file_id").where(F.col("site").isNull() | (strip_www(F.col("host")) != strip_www(F.col("site"))))
    relation = F.when(is_ipv4(F.col("host")), "ip").when(root_domain(F.col("host")) == root_domain(F.col("site")), "subdomain").otherwise("external")
    env = F.when(is_ipv4(F.col("host")), F.when(is_private_ip(F.col("host")), F.lit("private address"))).otherwise(environment_tag(F.col("host"), config))
    return rows.select("file_id", "host", relation.alias("relation"), env.alias("env"), "n_sources", "first_line", "sources")


def environment_paths(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Rule paths with a segment that smells of a test system; `/vN` alone counts.  Each path of a file once."""
    h = config["hosts"]
    rows = P.effective_rules(parsed).where(~is_absolute_url(F.col("path"))).withColumn("segs", segments(F.col("path")))
    hint = F.coalesce(F.get(F.filter("segs", lambda s: s.rlike(h["env_paths"]) | s.rlike(h["env_path_hint"])), F.lit(0)), F.when((F.size("segs") == 1) & F.get("segs", F.lit(0)).rlike(r"^v[0-9]+\z"), F.get("segs", F.lit(0))))
    return _first_per(rows.withColumn("hint", hint).where("hint is not null"), "path").select("file_id", "path", "line", "hint")


def api_endpoints(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Rule paths of interfaces by the first matching kind, with their version; `/vN` alone is none.  Each path once."""
    rows = P.effective_rules(parsed).where(~is_absolute_url(F.col("path"))).withColumn("segs", segments(F.col("path")))
    kind = _first_case(F.col("lower"), [(a["pattern"], F.lit(a["kind"])) for a in config.get("api", [])])
    rows = rows.where(~((F.size("segs") == 1) & F.get("segs", F.lit(0)).rlike(r"^v[0-9]+\z"))).withColumn("kind", kind).where("kind is not null")
    return _first_per(rows.withColumn("version", F.get(F.filter("segs", lambda s: s.rlike(r"^v[0-9]+\z")), F.lit(0))), "path").select("file_id", "path", "line", "kind", "version")


def data_feeds(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    d = config["data"]
    rows = P.effective_rules(parsed).where(~is_absolute_url(F.col("path"))).withColumns({"segs": segments(F.col("path")), "plain": plain_path(F.col("lower"))})
    is_feed = F.exists("segs", lambda s: s.rlike(d["feed_words"])) | (F.substring_index("plain", "?", 1).rlike(d["feed_file"]) & (F.col("plain").rlike(d["feed_hint"]) | F.col("lower").rlike(d["feed_file_wildcard"])))
    kind = F.coalesce(_first_case(F.col("lower"), [(x["pattern"], F.lit(x["label"])) for x in d["feed_kind"]]), F.lit("feed"))
    return _first_per(rows.where(is_feed).withColumn("kind", kind), "path").select("file_id", "path", "line", "kind")


def portals(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    d = config["data"]
    rows = P.effective_rules(parsed).where(~is_absolute_url(F.col("path"))).withColumn("seg", F.get(F.filter(segments(F.col("path")), lambda s: s.rlike(d["portal_words"])), F.lit(0))).where("seg is not null")
    kind = F.coalesce(_first_case(F.col("seg"), [(x["pattern"], F.lit(x["label"])) for x in d["portal_kind"]]), F.lit("portal"))
    return _first_per(rows.withColumn("kind", kind), "path").select("file_id", "path", "line", "kind")


def _queries(parsed: DataFrame) -> DataFrame:
    rows = P.effective_rules(parsed).where(~is_absolute_url(F.col("path"))).withColumn("plain", plain_path(F.col("lower")))
    return rows.withColumn("query", F.when(F.instr("plain", "?") > 0, F.substring(F.col("plain"), F.instr("plain", "?") + 1, F.length("plain"))))


def search_paths(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    d = config["data"]
    keyed = F.exists(F.split("query", "&"), lambda p: F.contains(p, F.lit("=")) & F.substring_index(p, "=", 1).isin(*d["search_keys"]))
    hit = F.exists(segments(F.col("path")), lambda s: s.rlike(d["search_segments"])) | F.coalesce(keyed, F.lit(False))
    return _first_per(_queries(parsed).where(hit), "path").select("file_id", "path", "line")


def parameters(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Query parameters of rule paths: file_id, name, role, lines (with repeats, in order)."""
    d = config["data"]
    names = F.filter(F.transform(F.split("query", "&"), lambda p: F.substring_index(p, "=", 1)), lambda n: n.rlike(r"^[A-Za-z0-9_\[\]-]+\z"))
    rows = _queries(parsed).where("query is not null").select("file_id", "line", F.explode_outer(names).alias("name")).where("name is not null")
    role = F.when(F.col("name").isin(*d["search_keys"]), "search").when(F.col("name").isin(*d["filter_keys"]), "filter").when(F.col("name").rlike(d["tracking_keys"]), "tracking").otherwise("other")
    return rows.groupBy("file_id", "name").agg(F.array_sort(F.collect_list("line")).alias("lines")).select("file_id", "name", role.alias("role"), "lines")  # lines of one file


# -- file types ----------------------------------------------------------------------------------------------------


def path_extensions(path: Column) -> Column:
    """Extensions in a rule path: `.ext` before the end or `$ * / ?`, and that of the plain path; each once."""
    low = F.lower(path)
    inner = F.regexp_extract_all(low, F.lit(r"\.([a-z0-9]{1,8})(?=\z|[$*/?])"), F.lit(1))
    tail = F.regexp_extract(F.substring_index(plain_path(low), "?", 1), r"\.([a-z0-9]{1,8})\z", 1)
    return F.array_distinct(F.filter(F.concat(inner, F.array(tail)), lambda x: x != ""))


def extensions(parsed: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Known file types in rules: file_id, ext, label, category, risk, tech, n, examples (first three)."""
    pack = {e: x for x in config.get("extension", []) for e in x["exts"]}
    known = F.create_map(*[y for e, x in pack.items() for y in (F.lit(e), F.named_struct(F.lit("label"), F.lit(x["label"]), F.lit("category"), F.lit(x["category"]), F.lit("risk"), F.lit(x["risk"]), F.lit("tech"), F.lit(x.get("tech")).cast("string")))])
    rows = P.effective_rules(parsed).select("file_id", "path", "line", F.explode_outer(path_extensions(F.col("path"))).alias("ext")).where("ext is not null").withColumn("x", F.element_at(known, F.col("ext"))).where("x is not null")
    per = rows.groupBy("file_id", "ext", "x").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line", "path"))).alias("p"))  # rules of one file
    return per.select("file_id", "ext", "x.label", "x.category", "x.risk", "x.tech", "n", F.transform(F.slice("p", 1, 3), lambda y: y["path"]).alias("examples"))


def tech_hints(exts: DataFrame) -> DataFrame:
    return exts.where("tech is not null").groupBy("file_id").agg(F.array_sort(F.collect_set("tech")).alias("tech"))


# -- comments ------------------------------------------------------------------------------------------------------


#: kinds of metadata in the order of a report (fixed order)
COMMENT_KINDS = ("email", "person", "ticket", "date", "ip", "url", "vendor", "note")


def mined_comments(comments: DataFrame, config: dict[str, Any], today: Column | None = None) -> DataFrame:
    """Metadata in comments (file_id, line, text): file_id, line, kind, value, remark; each kind and value of a line once.

    Kinds: email, person (a name behind a word for authors, unless an address begins there), ticket (keys and numbers
    behind a word for tickets), date (in digits or words), ip, url, vendor, and note (the first note word only).
    remark: how far a date lies from `today`, whether an address is private; else null.
    """
    m = config["comments"]
    every = lambda k: F.regexp_extract_all("text", F.lit("(?U)" + m[k] if k in ("email", "ticket", "date", "ip") else m[k]), F.lit(1))
    allowed = lambda values, k: F.filter(values, lambda x: ~x.rlike(m[k]))
    day = lambda x: F.try_to_date(F.replace(x, F.lit("/"), F.lit("-")), "yyyy-MM-dd")
    remark = lambda d: date_note(d, today) if today is not None else F.lit(None)
    none = lambda x: F.lit(None)
    tagged = [
        _tag("email", every("email"), none),
        _tag("person", allowed(every("person"), "person_deny"), none),
        _tag("ticket", F.concat(allowed(every("ticket"), "ticket_deny"), every("ticket_word")), none),
        _tag("date", every("date"), lambda x: remark(day(x))),
        _tag("date", every("slash_date"), none),
        _tag("date", every("text_date"), lambda x: remark(text_date(x))),
        _tag("ip", every("ip"), lambda x: F.when(is_private_ip(x), F.lit("private")).otherwise("public")),
        _tag("url", extract_urls(F.col("text")), none),
        _tag("vendor", every("vendor"), none),
        _tag("note", F.transform(F.slice(every("notes"), 1, 1), F.lower), none),
    ]
    rows = comments.select("file_id", "line", F.explode_outer(F.concat(*tagged)).alias("c")).where("c is not null").select("file_id", "line", "c.kind", F.trim("c.value").alias("value"), "c.remark")
    per = rows.withColumn("k", F.lower("value")).groupBy("file_id", "line", "kind", "k").agg(F.min(F.struct("value", "remark")).alias("v"))
    return per.select("file_id", "line", "kind", "v.value", "v.remark")


def _tag(kind: str, values: Column, remark) -> Column:
    return F.transform(values, lambda x: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("value"), x, F.lit("remark"), remark(x).cast("string")))


def date_note(date: Column, today: Column) -> Column:
    """Years ahead or old for dates more than a year away, days for those ahead, else nothing."""
    days = F.datediff(date, today)
    return (
        F.when(days > 365, F.concat(F.lit("in "), F.round(days / 365.0).cast("int"), F.lit(" years"))).when(days > 0, F.concat(F.lit("in "), days, F.lit(" days"))).when(days < -365, F.concat(F.round(-days / 365.0).cast("int"), F.lit(" years old")))
    )


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def text_date(text: Column) -> Column:
    """Date in words: the last four-digit number, the first month in calendar order, the first number of one or two digits if it is a day (else 1)."""
    year = F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(\d{4})\b"), F.lit(1)), F.lit(-1)).cast("int")
    month = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(m)), F.lit(i + 1)) for i, m in enumerate(_MONTHS)])
    days = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})\b"), F.lit(1)), lambda x: x.cast("int"))
    first = F.get(days, F.lit(0))
    day = F.when(first.between(1, 31), first).otherwise(1)
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day)) if hasattr(F, "try_to_date") else F.to_date(F.format_string("%04d-%02d-%02d", year, month, day))


def recon_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of items of each category in each file: file_id, category, n."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("file_id").agg(F.count("*").alias("n")).select("file_id", F.lit(name).alias("category"), "n")
        out = part if out is None else out.unionByName(part)
    return out


#: switch of the rule pack's [recon] table -> the tables that it turns off
RECON_PARTS = {
    "platform": ("platforms",), "generators": ("generators",), "cloud": ("cloud",), "hosts": ("hosts", "env_paths"), "apis": ("apis",), "data": ("feeds", "portals", "search", "parameters"), "extensions": ("extensions",), "comments": ("comments",),
}


def recon(parsed: DataFrame, config: dict[str, Any], today: Column | None = None) -> dict[str, DataFrame]:
    """Every recon table of the files that the pack's switches leave on, by name; `checks.recon` turns all off."""
    build = {
        "platforms": lambda: platform_scores(parsed, config), "generators": lambda: generators(parsed, config), "cloud": lambda: cloud_assets(parsed, config), "hosts": lambda: leaked_hosts(parsed, config),
        "env_paths": lambda: environment_paths(parsed, config), "apis": lambda: api_endpoints(parsed, config), "feeds": lambda: data_feeds(parsed, config), "portals": lambda: portals(parsed, config),
        "search": lambda: search_paths(parsed, config), "parameters": lambda: parameters(parsed, config), "extensions": lambda: extensions(parsed, config), "comments": lambda: mined_comments(P.comments(parsed), config, today),
    }
    if not config["checks"].get("recon", True):
        return {}
    off = {t for k, tables in RECON_PARTS.items() if not config.get("recon", {}).get(k, True) for t in tables}
    return {name: make() for name, make in build.items() if name not in off}
