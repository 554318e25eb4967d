"""Who may fetch what: group selection, longest-match evaluation, verdicts, parameters.

Rules stay in the row of their file, as arrays with their LIKE patterns computed once; a decision is an argmax over
the matching rules of the selected groups, so nothing is shuffled for it.  The crawler dimension is a small fixed list
that becomes a literal (its size is checked), not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlquarry.functions.text import clean_parameters, like_pattern, normalise_encoding, normalise_path, sample_path, whole_site
from crawlquarry.operators import parse as P
from crawlquarry.operators.parse import let

MOST_CRAWLERS = 2_000
_RULE = "struct<type:string,path:string,line:int>"


def with_patterns(parsed: DataFrame) -> DataFrame:
    """Adds to every rule of `groups`: group_id, length of its normal form, literal prefix and LIKE pattern; empty paths are kept."""

    def ruled(g: Column) -> Column:
        rules = F.transform(
            g["rules"],
            lambda r: let(
                normalise_encoding(r["path"]),
                lambda norm: F.struct(
                    r["type"].alias("type"), r["path"].alias("path"), r["line"].alias("line"), g["group_id"].alias("group_id"),
                    F.length(norm).alias("norm_len"), F.substring_index(F.regexp_replace(norm, r"\$\z", ""), "*", 1).alias("prefix"), (norm.rlike(r"^[^*]*\**\z") & ~norm.endswith("$")).alias("simple"), _like_of_norm(norm).alias("pattern"),
                ),
            ),
        )
        return g.withField("rules", rules)

    return parsed.withColumn("groups", F.transform("groups", ruled))


def _like_of_norm(norm: Column) -> Column:
    anchored = norm.endswith("$")
    body = F.when(anchored, F.substring(norm, F.lit(1), F.length(norm) - 1)).otherwise(norm)
    return F.concat(F.regexp_replace(F.regexp_replace(body, r"([\\%_])", r"\\$1"), r"\*+", "%"), F.when(anchored, F.lit("")).otherwise(F.lit("%")))


def hits(rule: Column, path: Column) -> Column:
    """Does a rule of with_patterns match a normal path?  Most end at the literal prefix; LIKE is the exception."""
    return F.startswith(path, rule["prefix"]) & (rule["simple"] | F.like(path, rule["pattern"]))


def file_tokens(groups: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(g["agents"], lambda a: a["token"]))))


def rules_of_token(groups: Column, token: Column) -> Column:
    """Non-empty rules of every group that names the token."""
    mine = F.filter(groups, lambda g: F.exists(g["agents"], lambda a: a["token"] == token))
    return F.filter(F.flatten(F.transform(mine, lambda g: g["rules"])), lambda r: r["path"] != "")


def selected_token(tokens: Column, wanted: Column) -> Column:
    """The most specific wanted token that the file has, else `*` if it has that, else null."""
    first = F.get(F.filter(wanted, lambda t: F.array_contains(tokens, t)), F.lit(0))
    return F.coalesce(first, F.when(F.array_contains(tokens, "*"), F.lit("*")))


def decide(rules: Column, path: Column) -> Column:
    """struct<allowed, rule>: longest pattern, then Allow, then the earlier line; no match is allowed.

    `path` is normal (see normalise_encoding); `rules` come from with_patterns.
    """
    matching = F.filter(rules, lambda r: hits(r, path))
    ranked = F.transform(matching, lambda r: F.struct(r["norm_len"].alias("len"), (r["type"] == "allow").alias("allow"), (-r["line"]).alias("neg"), r["path"].alias("path")))
    return let(F.array_max(ranked), lambda b: F.struct(F.coalesce(b["allow"], F.lit(True)).alias("allowed"), F.when(b.isNotNull(), F.struct(F.when(b["allow"], F.lit("allow")).otherwise("disallow").alias("type"), b["path"].alias("path"), (-b["neg"]).cast("int").alias("line"))).alias("rule")))


def scope_token(group: Column) -> Column:
    """Token that a group's rules are judged under: `*` for a group that names it or nobody, else its first token."""
    named = F.filter(group["agents"], lambda a: a["token"] != "")
    star = (F.size(named) == 0) | F.exists(named, lambda a: a["token"] == "*")
    return F.when(star, F.lit("*")).otherwise(F.get(named, F.lit(0))["token"])


def crawler_literal(crawlers: DataFrame) -> Column:
    """The crawler dimension (ord, name, tokens, category) as an array literal."""
    rows = crawlers.select("ord", "name", "tokens", "category").orderBy("ord").limit(MOST_CRAWLERS + 1).collect()
    if len(rows) > MOST_CRAWLERS:
        raise ValueError(f"more than {MOST_CRAWLERS} crawlers: the dimension is meant to be a fixed list")
    kind = "array<struct<ord:int,name:string,tokens:array<string>,category:string>>"
    if not rows:
        return F.array().cast(kind)
    one = lambda r: F.struct(F.lit(r["ord"]).cast("int").alias("ord"), F.lit(r["name"]).alias("name"), F.array(*[F.lit(t) for t in r["tokens"] or ()]).cast("array<string>").alias("tokens"), F.lit(r["category"]).cast("string").alias("category"))
    return F.array(*map(one, rows))


def _summary(groups: Column, token: Column) -> Column:
    rules = F.when(token.isNull(), F.array().cast("array<struct<type:string,path:string>>")).otherwise(
        F.transform(rules_of_token(groups, token), lambda r: F.struct(r["type"].alias("type"), r["path"].alias("path")))
    )
    delays = F.transform(F.filter(groups, lambda g: F.exists(g["agents"], lambda a: a["token"] == token) & g["crawl_delay"].isNotNull()), lambda g: g["crawl_delay"])

    def of(r: Column) -> Column:
        allow, disallow = F.size(F.filter(r, lambda x: x["type"] == "allow")), F.size(F.filter(r, lambda x: x["type"] == "disallow"))
        whole = F.exists(r, lambda x: (x["type"] == "disallow") & whole_site(x["path"]))
        verdict = F.when(whole & (allow == 0), F.lit("blocked")).when(disallow == 0, F.lit("open")).otherwise("partial")
        return F.struct(token.alias("token"), allow.alias("n_allow"), disallow.alias("n_disallow"), verdict.alias("verdict"), F.get(delays, F.lit(0)).alias("crawl_delay"))

    return let(rules, of)


def _summed(parsed: DataFrame, crawlers: DataFrame, *keep: str) -> DataFrame:
    """picks: the crawlers with the token selected for each; sums: one summary for each of these tokens."""
    base = parsed.select(*keep, "groups", crawler_literal(crawlers).alias("all"))
    picked = base.select(*keep, "groups", let(file_tokens(F.col("groups")), lambda t: F.transform("all", lambda c: F.struct(c["ord"].alias("ord"), c["name"].alias("name"), c["category"].alias("category"), selected_token(t, c["tokens"]).alias("token")))).alias("picks"))
    return picked.select(*keep, "picks", F.transform(F.array_distinct(F.transform("picks", lambda p: p["token"])), lambda t: _summary(F.col("groups"), t)).alias("sums"))


def file_verdicts(parsed: DataFrame, crawlers: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and verdicts: an array of (crawler, verdict) for all crawlers with a name, in the row of the file."""
    of = lambda sums: F.transform(F.filter("picks", lambda p: p["name"].isNotNull()), lambda p: F.struct(p["name"].alias("crawler"), F.get(F.filter(sums, lambda s: s["token"].eqNullSafe(p["token"])), F.lit(0))["verdict"].alias("verdict")))
    return _summed(parsed, crawlers, *keep).select(*keep, let(F.col("sums"), of).alias("verdicts"))


def crawler_verdicts(parsed: DataFrame, crawlers: DataFrame) -> DataFrame:
    """file_id, crawler, category, token, specific, n_allow, n_disallow, verdict, crawl_delay: every file and crawler.

    Summaries are computed once for each token that is selected in a file; most crawlers share `*`.
    """
    rows = _summed(parsed, crawlers, "file_id").select("file_id", "sums", F.explode_outer("picks").alias("p")).where("p is not null").select("file_id", "p", F.get(F.filter("sums", lambda s: s["token"].eqNullSafe(F.col("p.token"))), F.lit(0)).alias("s"))
    return rows.select(
        "file_id", F.col("p.ord").alias("ord"), F.col("p.name").alias("crawler"), F.col("p.category").alias("category"), F.col("p.token").alias("token"),
        F.coalesce(F.col("p.token") != "*", F.lit(False)).alias("specific"), "s.n_allow", "s.n_disallow", "s.verdict", "s.crawl_delay",
    )


def star_policy(parsed: DataFrame) -> DataFrame:
    """What crawlers without a group of their own get, for every file."""
    has = F.array_contains(file_tokens(F.col("groups")), "*")
    return parsed.select("file_id", has.alias("has_star_group"), _summary(F.col("groups"), F.when(has, F.lit("*"))).alias("s")).select("file_id", "has_star_group", "s.n_allow", "s.n_disallow", "s.verdict", "s.crawl_delay")


def check_access(parsed: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (file_id, tokens most specific first, path) -> token, specific, crawl_delay, always, allowed, rule, path.

    Probes meet their file by file_id (one shuffle of both sides, or none if Spark broadcasts the smaller); a probe
    of an unknown file is judged by an empty one.
    """
    ready = with_patterns(parsed).select("file_id", "groups")
    joined = probes.join(ready, "file_id", "left").withColumn("groups", F.coalesce("groups", F.array().cast(ready.schema["groups"].dataType)))
    return judged(joined)


def judged(rows: DataFrame) -> DataFrame:
    """Rows with groups (with patterns), tokens and path: the access decision of each."""
    rows = rows.withColumns({"path": normalise_path(F.col("path")), "token": selected_token(file_tokens(F.col("groups")), F.col("tokens"))})
    own = F.when(F.col("token").isNull(), F.array()).otherwise(rules_of_token(F.col("groups"), F.col("token")))
    rows = rows.withColumn("d", let(normalise_encoding(F.col("path")), lambda p: decide(own, p)))
    delays = F.transform(F.filter("groups", lambda g: F.exists(g["agents"], lambda a: a["token"] == F.col("token")) & g["crawl_delay"].isNotNull()), lambda g: g["crawl_delay"])
    always = F.col("path") == "/robots.txt"
    keep = [c for c in rows.columns if c not in ("groups", "d", "token", "path")]
    return rows.select(
        *keep, "path", "token", F.coalesce(F.col("token") != "*", F.lit(False)).alias("specific"), F.get(delays, F.lit(0)).alias("crawl_delay"), always.alias("always"),
        (always | F.col("d.allowed")).alias("allowed"), F.when(~always, F.col("d.rule")).alias("rule"),
    )


def access_grid(parsed: DataFrame, crawlers: DataFrame, paths: list[str]) -> DataFrame:
    """Every file, crawler and path of a short fixed list: file_id, crawler, path, allowed and the deciding rule.

    Decisions are made once for each selected token and path of a file, then spread over the crawlers.
    """
    lit_paths = F.array(*[F.lit(p) for p in paths])
    base = with_patterns(parsed).select("file_id", "groups", crawler_literal(crawlers).alias("all"))
    picked = base.select("file_id", "groups", let(file_tokens(F.col("groups")), lambda t: F.transform("all", lambda c: F.struct(c["name"].alias("name"), selected_token(t, c["tokens"]).alias("token")))).alias("picks"))

    def of_token(t: Column) -> Column:
        rules = F.when(t.isNull(), F.array()).otherwise(rules_of_token(F.col("groups"), t))
        return F.struct(t.alias("token"), let(rules, lambda r: F.transform(lit_paths, lambda p: let(normalise_path(p), lambda q: F.struct(q.alias("path"), let(normalise_encoding(q), lambda n: decide(r, n)).alias("d"))))).alias("made"))

    made = picked.select("file_id", "picks", F.transform(F.array_distinct(F.transform("picks", lambda p: p["token"])), of_token).alias("made"))
    rows = made.select("file_id", "made", F.explode_outer("picks").alias("p")).where("p is not null").select("file_id", F.col("p.name").alias("crawler"), F.col("p.token").alias("token"), F.explode_outer(F.get(F.filter("made", lambda m: m["token"].eqNullSafe(F.col("p.token"))), F.lit(0))["made"]).alias("m")).where("m is not null")
    always = F.col("m.path") == "/robots.txt"
    return rows.select("file_id", "crawler", "token", F.col("m.path").alias("path"), (always | F.col("m.d.allowed")).alias("allowed"), F.when(~always, F.col("m.d.rule.path")).alias("rule"), F.when(~always, F.col("m.d.rule.line")).alias("line"))


def cleaned_paths(parsed: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (file_id, path) -> path without the parameters that valid Clean-param lines drop for it, and their names."""
    cp = P.clean_params(parsed).where("valid").select("file_id", "params", like_pattern(F.col("path")).alias("pattern"))
    per_file = cp.groupBy("file_id").agg(F.collect_list(F.struct("params", "pattern")).alias("cps"))  # lines of one file, bounded by the read limit
    rows = probes.join(per_file, "file_id", "left").withColumn("path", normalise_path(F.col("path")))
    base = normalise_encoding(F.substring_index("path", "?", 1))
    names = let(base, lambda b: F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce("cps", F.array().cast("array<struct<params:array<string>,pattern:string>>")), lambda x: F.like(b, x["pattern"])), lambda x: x["params"]))))
    out = rows.withColumn("c", clean_parameters(F.col("path"), names))
    return out.select(*[c for c in probes.columns if c != "path"], "path", F.col("c.path").alias("cleaned"), F.col("c.removed").alias("removed"))


def outcome(groups: Column, group: Column, path: Column) -> Column:
    """struct<state, audience, path, line, names>: what really happens to a path for the crawlers of a group; names are
    those of a group with names, as written."""
    token = scope_token(group)
    others = F.exists(groups, lambda g: F.exists(g["agents"], lambda a: (a["token"] != "") & (a["token"] != "*")))
    who = F.when(token != "*", F.lit("named")).when(others, F.lit("default")).otherwise("all")
    names = F.when(token != "*", F.transform(F.filter(group["agents"], lambda a: a["token"] != ""), lambda a: a["raw"]))
    return let(decide(rules_of_token(groups, token), normalise_encoding(path)), lambda d: F.struct(F.when(~d["allowed"], F.lit("blocked")).when(d["rule"].isNull(), F.lit("open")).otherwise("allowed").alias("state"), who.alias("audience"), path.alias("path"), d["rule"]["line"].alias("line"), names.alias("names")))


def rule_outcomes(parsed: DataFrame) -> DataFrame:
    """For every rule with a path: a sample path and what really happens to it."""
    ready = with_patterns(parsed).select("file_id", "groups")
    rows = ready.select("file_id", "groups", F.explode_outer("groups").alias("g")).where("g is not null").select("file_id", "groups", "g", F.explode_outer(F.filter("g.rules", lambda r: r["path"] != "")).alias("r")).where("r is not null")
    out = rows.select("file_id", F.col("g.group_id").alias("group_id"), F.col("r.line").alias("line"), F.col("r.type").alias("type"), F.col("r.path").alias("rule_path"), outcome(F.col("groups"), F.col("g"), sample_path(F.col("r.path"))).alias("o"))
    return out.select("file_id", "group_id", "line", "type", "rule_path", F.col("o.path").alias("path"), F.col("o.state").alias("state"), F.col("o.audience").alias("audience"), F.col("o.line").alias("decided_by"), F.coalesce("o.names", F.array().cast("array<string>")).alias("names"))
