"""SQL of the engine's queries: common tables built once as CTEs, in the dialect of the comparison engine."""

# ruff: noqa: E501
from __future__ import annotations

from crawlquarry.operators import parse as P

SP = r"[\t-\r \x{85}\p{Z}]"
_ALIASES = ", ".join(f"'{k}': '{v}'" for k, v in P.ALIASES.items())
_OTHER = ", ".join(f"'{x}'" for x in (*P.AI_DIRECTIVES, *P.LEGACY_DIRECTIVES, *P.META_ROBOTS, *P.OTHER_DIRECTIVES))
#: that engine counts bytes, so every other character becomes one
_ONE = r"regexp_replace(raw_field, '[^\x00-\x7F]', '?', 'g')"
_NEAR = "least(" + ", ".join(f"case when levenshtein({_ONE}, '{n}') <= 2 then levenshtein({_ONE}, '{n}') * 10 + {i} else 999 end" for i, n in enumerate(P.CANONICAL)) + ")"
_CANON = "[" + ", ".join(f"'{n}'" for n in P.CANONICAL) + "]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


_FETCHES = r"""
  files0 as (
  select distinct on (fetch_id) fetch_id as file_id, domain, coalesce(site_url, nullif(regexp_extract(final_url, '(?i)^(https?://[^/?#]+)', 1), '')) as site_url, status, content_type, redirect_limit, robots_url, final_url, headers, text as body,
         case when coalesce(status between 200 and 299, false) and not coalesce(redirect_limit, false) then coalesce(text, '') else '' end as text
  from fetches where fetch_id is not null
)"""


def base(files0: str) -> str:
    """The common tables over any tables that end in files0 (file_id, text, ...)."""
    return "with " + files0 + _PARSED


_PARSED = rf"""
, files1 as (
  select *, starts_with(text, chr(65279)) as bom, case when starts_with(text, chr(65279)) then substr(text, 2) else text end as src0 from files0
), files as (
  select *, length(substr(src0, 1, 512)) >= 4 and (length(substr(src0, 1, 512)) - length(replace(substr(src0, 1, 512), chr(0), ''))) * 4 >= length(substr(src0, 1, 512)) as utf16,
         case when length(substr(src0, 1, 512)) >= 4 and (length(substr(src0, 1, 512)) - length(replace(substr(src0, 1, 512), chr(0), ''))) * 4 >= length(substr(src0, 1, 512))
              then replace(replace(replace(src0, chr(0), ''), chr(65279), ''), chr(65534), '') else src0 end as src
  from files1
), l0 as (
  select file_id, generate_subscripts(a, 1) as line, unnest(a) as raw from (select file_id, regexp_split_to_array(src, '\r\n|\r|\n') as a from files)
), l1 as (
  select *, contains(raw, '#') as has_comment, case when contains(raw, '#') then substr(raw, instr(raw, '#')) end as comment, {trim("replace(split_part(raw, '#', 1), '：', ':')")} as content from l0
), l2 as (
  select *, instr(content, ':') as colon, case when instr(content, ':') > 0 then substr(content, 1, instr(content, ':') - 1) else content end as field_src,
         case when instr(content, ':') > 0 then {trim("substr(content, instr(content, ':') + 1)")} else '' end as value from l1
), l3 as (
  select *, lower({trim(f"translate(regexp_replace(field_src, '[{P.INVISIBLE}]', '', 'g'), '{P.LOOKALIKE_FROM}', '{P.LOOKALIKE_TO}')")}) as low from l2
), l4 as (
  select *, case when regexp_replace(low, '^[^A-Za-z0-9]+', '') = '' then low else regexp_replace(low, '^[^A-Za-z0-9]+', '') end as raw_field from l3
), l5 as (
  select *, case when content = '' or colon = 0 then null
       when map {{{_ALIASES}}}[raw_field] is not null then map {{{_ALIASES}}}[raw_field]
       when raw_field in ({_OTHER}) or starts_with(raw_field, 'ai-') or starts_with(raw_field, 'llm') then null
       when strlen(raw_field) < 4 or {_NEAR} = 999 then null else {_CANON}[({_NEAR}) % 10 + 1] end as field from l4
), lines as (
  select file_id, line, raw, has_comment, comment, content, colon, raw_field, value, field,
         case when content = '' then case when has_comment then 'comment' else 'blank' end when colon = 0 then 'invalid' when field is null then 'unknown' when field in ('allow', 'disallow') then 'rule' else field end as kind,
         case when field = 'user-agent' then case when starts_with(value, '*') then '*' else lower(regexp_extract(value, '^[A-Za-z0-9_-]*', 0)) end end as token
  from l5
), d0 as (
  select *, coalesce(kind = 'user-agent' and lag(kind) over (partition by file_id order by line) is distinct from 'user-agent', false) as opens from lines where kind in ('user-agent', 'rule', 'crawl-delay')
), directives as (
  select *, sum(opens::int) over (partition by file_id order by line) as group_id from d0
), agents as (select file_id, group_id, value as raw, token, line from directives where kind = 'user-agent' and group_id > 0),
rules as (select file_id, group_id, field as type, value as path, line from directives where kind = 'rule' and group_id > 0),
delays as (
  select file_id, group_id, line, value, case when regexp_matches(value, '^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast(value as double) end as delay from directives where kind = 'crawl-delay' and group_id > 0
), groups as (
  select d.file_id, d.group_id, min(d.line) as start_line, max(d.line) as end_line, count(*) filter (kind = 'user-agent') as n_agents, count(*) filter (kind = 'rule') as n_rules,
         (select arg_min(x.delay, x.line) from delays x where x.file_id = d.file_id and x.group_id = d.group_id and x.delay is not null) as crawl_delay
  from directives d where group_id > 0 group by 1, 2
), wanted as (
  select ord, name as crawler, category, generate_subscripts(t, 1) as rank, unnest(t) as token from (select ord, name, category, list_append(tokens, '*') as t from crawlers)
), file_tokens as (select distinct file_id, token from agents),
picked as (
  select f.file_id, c.ord, c.name as crawler, c.category, (select arg_min(w.token, w.rank) from wanted w join file_tokens t on t.token = w.token and t.file_id = f.file_id where w.crawler = c.name) as token
  from files f, crawlers c
), token_rules as (
  select t.file_id, t.token, r.type, r.path, r.line from file_tokens t join rules r on r.file_id = t.file_id
  and exists (select 1 from agents a where a.file_id = r.file_id and a.group_id = r.group_id and a.token = t.token) where r.path <> ''
), sums as (
  select t.file_id, t.token, count(*) filter (r.type = 'allow') as n_allow, count(*) filter (r.type = 'disallow') as n_disallow,
         coalesce(bool_or(r.type = 'disallow' and regexp_matches(r.path, '^/\**$')), false) as whole
  from file_tokens t left join token_rules r on r.file_id = t.file_id and r.token = t.token group by 1, 2
), verdicts as (
  select p.file_id, p.ord, p.crawler, p.category, p.token, coalesce(p.token <> '*', false) as specific, coalesce(s.n_allow, 0) as n_allow, coalesce(s.n_disallow, 0) as n_disallow,
         case when s.whole and s.n_allow = 0 then 'blocked' when coalesce(s.n_disallow, 0) = 0 then 'open' else 'partial' end as verdict
  from picked p left join sums s on s.file_id = p.file_id and s.token = p.token
)
"""

BASE = base(_FETCHES)

#: paths of rules with their parts: plain without one final `$` and `*`, segments, query
RULE_PATHS = rf"""
, paths as (
  select *, list_filter(string_split(split_part(plain, '?', 1), '/'), lambda x: x <> '') as segs, case when contains(plain, '?') then substr(plain, instr(plain, '?') + 1) end as query
  from (select file_id, line, path, lower(path) as low, replace(regexp_replace(lower(path), '\$$', ''), '*', '') as plain from rules where path <> '' and not regexp_matches(path, '(?i)^https?://'))
)
"""
_DIRECTIVES = r"list_filter(list_transform(regexp_split_to_array({}, '\r\n|\r|\n'), lambda x: regexp_replace(regexp_replace(split_part(x, '#', 1), '^[\s\p{{Z}}\x{{FEFF}}]+', ''), '[\s\p{{Z}}]+$', '')), lambda x: x <> '')"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"

SQL = {
    "star_policy": BASE + """select f.file_id, s.token is not null as has_star_group, coalesce(s.n_allow, 0) as n_allow, coalesce(s.n_disallow, 0) as n_disallow,
      case when s.whole and s.n_allow = 0 then 'blocked' when coalesce(s.n_disallow, 0) = 0 then 'open' else 'partial' end as verdict,
      (select arg_min(g.crawl_delay, g.group_id) from groups g where g.file_id = f.file_id and g.crawl_delay is not null and exists (select 1 from agents a where a.file_id = g.file_id and a.group_id = g.group_id and a.token = '*')) as crawl_delay
      from files f left join sums s on s.file_id = f.file_id and s.token = '*'""",
    "clean_params": BASE + r"""select file_id, list_filter(string_split(coalesce(w[1], ''), '&'), lambda x: x <> '') as params, coalesce(w[2], '/') as path, line,
      len(w) <= 2 and len(list_filter(string_split(coalesce(w[1], ''), '&'), lambda x: x <> '')) > 0 and regexp_matches(coalesce(w[1], ''), '^[A-Za-z0-9_.&-]+$') and regexp_matches(coalesce(w[2], '/'), '^[/*]') as valid, strlen(value) as n_bytes
      from (select *, list_filter(regexp_split_to_array(value, '\s+'), lambda x: x <> '') as w from lines where kind = 'clean-param')""",
    "sitemaps": BASE + r"""select file_id, value as url, line, regexp_matches(value, '(?i)^https?:/{0,2}[^/\s?#\\<>^|]+[^\s]*$') as valid from lines where kind = 'sitemap'""",
    "environment_paths": BASE + RULE_PATHS + r"""select file_id, path, min(line) as line, arg_min(hint, line) as hint from (
      select *, coalesce(list_filter(segs, lambda s: regexp_matches(s, '^(dev|test|staging|stage|beta|demo|sandbox|old|new|preview|draft|redesign|relaunch)$') or regexp_matches(s, '(staging|preprod|relaunch|redesign)'))[1],
        case when len(segs) = 1 and regexp_matches(segs[1], '^v[0-9]+$') then segs[1] end) as hint from paths) where hint is not null group by 1, 2""",
    "api_endpoints": BASE + RULE_PATHS + r"""select file_id, path, min(line) as line, arg_min(kind, line) as kind, first(list_filter(segs, lambda s: regexp_matches(s, '^v[0-9]+$'))[1] order by line) as version from (
      select *, case when regexp_matches(low, '/graphql') then 'graphql' when regexp_matches(low, '/(swagger|openapi|api-docs|redoc)') then 'docs' when regexp_matches(low, '/(actuator|health|metrics|status)(/|$|\*|\?)') then 'ops'
        when regexp_matches(low, '/(xmlrpc|jsonrpc|soap|rpc)') then 'rpc' when regexp_matches(low, '/(api|rest|v[0-9]+)(/|$|\*|\?)') then 'gateway' end as kind from paths)
      where kind is not null and not (len(segs) = 1 and regexp_matches(segs[1], '^v[0-9]+$')) group by 1, 2""",
    "portals": BASE + RULE_PATHS + r"""select file_id, path, min(line) as line, arg_min(case when regexp_matches(seg, 'partner|reseller|supplier') then 'partners' when regexp_matches(seg, 'vip|members') then 'members' else 'portal' end, line) as kind from (
      select *, list_filter(segs, lambda s: regexp_matches(s, '^(partner|partners|dealer|dealers|vip|wholesale|b2b|reseller|members|portal|supplier)$'))[1] as seg from paths) where seg is not null group by 1, 2""",
    "search_paths": BASE + RULE_PATHS + r"""select file_id, path, min(line) as line from paths where len(list_filter(segs, lambda s: regexp_matches(s, '^(search|suche|recherche|buscar|busca|find|catalogsearch)$'))) > 0
      or len(list_filter(string_split(coalesce(query, ''), '&'), lambda p: contains(p, '=') and split_part(p, '=', 1) in ('q', 'query', 's', 'search', 'keyword', 'keywords', 'term'))) > 0 group by 1, 2""",
    "search_parameters": BASE + RULE_PATHS + r"""select file_id, name, case when name in ('q', 'query', 's', 'search', 'keyword', 'keywords', 'term') then 'search' when name in ('sort', 'order', 'filter', 'page', 'color', 'size', 'price', 'limit', 'view', 'dir') then 'filter'
      when regexp_matches(name, '^(utm_[a-z]+|gclid|fbclid|ref|__ref|sid|sessionid|affiliate|campaign)$') then 'tracking' else 'other' end as role, list(line order by line) as lines
      from (select file_id, line, unnest(list_filter(list_transform(string_split(query, '&'), lambda p: split_part(p, '=', 1)), lambda n: regexp_matches(n, '^[A-Za-z0-9_\[\]-]+$'))) as name from paths where query is not null) group by 1, 2""",
    "change_history": r"""with o as (
      select distinct on (fetch_id) domain, observed_at, fetch_id as obs_id, status, text as body, content_type from fetches where fetch_id is not null
    ), p as (
      select *, coalesce(contains(lower(coalesce(content_type, '')), 'text/html') or starts_with(ltrim(lower(left(coalesce(body, ''), 64)), ' '), '<!doctype html') or starts_with(ltrim(lower(left(coalesce(body, ''), 64)), ' '), '<html') or status in (403, 429) or status >= 500, true) as t,
             case when coalesce(status between 200 and 299, false) and not regexp_matches(lower(regexp_replace(left(coalesce(body, ''), 2000), '^[\t-\r \x{85}\p{Z}]+', '')), '^(<!doctype html|<html)') then coalesce(body, '') else '' end as used
      from o where domain is not null and observed_at is not null
    ), q as (
      select *, """ + _DIRECTIVES.format("used") + r""" as ls, coalesce(max(case when not t then 1 end) over (partition by domain order by observed_at, obs_id rows between unbounded preceding and 1 preceding), 0) as earlier from p
    ), r as (
      select *, lag(ls) over w as before, row_number() over w as n from q where not t or (earlier = 0 and status in (404, 410)) window w as (partition by domain order by observed_at, obs_id)
    )
    select domain, observed_at, obs_id, status, case when n = 1 then 'seeded' else 'changed' end as event, len(ls) as n_lines from r where n = 1 or ls is distinct from before""",
    "syntax_core": BASE + rf"""
      , first_group as (select file_id, min(line) as line from lines where kind = 'user-agent' group by 1),
      placed as (select l.*, coalesce(l.line > g.line, false) as grouped from lines l left join first_group g using (file_id)),
      delay_lines as (select d.*, case when regexp_matches(value, '^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast(value as double) when regexp_matches(value, '^-0*\.?0*$') and contains(value, '0') then 0.0 end as d from placed d where kind = 'crawl-delay')
      select file_id, cast(line as int) as line, id, level from (
        select file_id, null as line, 'parser.tooLarge' as id, 'warning' as level from files where strlen(text) > 512000
        union all select file_id, 1, 'parser.bom', 'info' from files where bom
        union all select file_id, 1, 'parser.utf16', 'error' from files where utf16
        union all select file_id, min(line), 'parser.longLine', 'info' from lines where length(raw) > 2000 group by 1
        union all select file_id, line, 'parser.notFieldValue', 'error' from lines where kind = 'invalid'
        union all select file_id, line, 'parser.misspelling', 'info' from lines where field is not null and field <> raw_field
        union all select file_id, line, case when value = '' then 'parser.emptyUserAgent' else 'parser.invalidToken' end, case when value = '' then 'error' else 'warning' end from lines where kind = 'user-agent' and token = ''
        union all select file_id, line, 'parser.tokenTail', 'info' from lines where kind = 'user-agent' and token not in ('', '*') and token <> lower(value)
        union all select file_id, line, 'parser.ruleBeforeAgent', 'error' from placed where kind = 'rule' and not grouped
        union all select file_id, line, case when field = 'allow' then 'parser.emptyAllow' else 'parser.emptyDisallow' end, 'info' from placed where kind = 'rule' and grouped and value = ''
        union all select file_id, line, 'parser.pathNoSlash', 'warning' from placed where kind = 'rule' and grouped and value <> '' and not regexp_matches(value, '^[/*]') and not regexp_matches(value, '(?i)^https?://')
        union all select file_id, line, 'parser.wildcardOnly', 'warning' from placed where kind = 'rule' and grouped and field = 'disallow' and regexp_matches(value, '^\*+$')
        union all select file_id, line, 'parser.spaceInPath', 'warning' from placed where kind = 'rule' and grouped and contains(value, ' ')
        union all select file_id, line, 'parser.nonAsciiPath', 'info' from placed where kind = 'rule' and grouped and strlen(value) <> length(value)
        union all select file_id, line, 'parser.crawlDelayBeforeAgent', 'error' from placed where kind = 'crawl-delay' and not grouped
        union all select file_id, line, 'parser.crawlDelayHigh', 'warning' from delay_lines where grouped and d >= 60
        union all select file_id, line, 'parser.crawlDelayNaN', 'warning' from delay_lines where grouped and d is null
        union all select file_id, min(line), 'parser.crawlDelayNonStandard', 'info' from delay_lines where grouped group by 1
        union all select file_id, line, case when row_number() over (partition by file_id order by line) = 1 then 'parser.hostObsolete' else 'parser.hostDuplicate' end, 'info' from lines where kind = 'host'
        union all select file_id, line, 'parser.noindex', 'warning' from lines where kind = 'unknown' and raw_field = 'noindex'
        union all select file_id, null, 'parser.noRules', 'info' from files f where not exists (select 1 from groups g where g.file_id = f.file_id)
        union all select file_id, null, 'parser.noSitemap', 'info' from (select distinct file_id from groups) g where not exists (select 1 from lines l where l.file_id = g.file_id and l.kind = 'sitemap')
        union all select file_id, start_line, 'parser.emptyGroup', 'info' from groups where n_rules = 0 and crawl_delay is null
      )""",
    "case_notes": BASE + "select file_id, line, path from rules where regexp_matches(path, '[A-Z]')",
    "fetch_ids": BASE + r"""
      , h as (
        select *, coalesce(status between 200 and 299, false) as ok, nullif(lower(trim(split_part(content_type, ';', 1))), '') as media, headers.cache_control as cc,
               lower(regexp_replace(regexp_extract(content_type, ';\s*(?:charset|CHARSET)=([^;]*)', 1), '^"+|"+$', '', 'g')) as cs,
               list_transform(string_split(coalesce(headers.cache_control, ''), ','), lambda x: lower(trim(x))) as cd, regexp_extract(lower(coalesce(headers.cache_control, '')), '(?:^|,)\s*max-age=\s*"?([0-9]+)', 1) as age,
               regexp_extract(robots_url, '^https?://([^/?#]+)', 1) as a, regexp_extract(final_url, '^https?://([^/?#]+)', 1) as b
        from files
      )
      select file_id, id from (
        select file_id, case when status between 500 and 599 then 'serverError' when status = 429 then 'rateLimited' when status in (401, 403) then 'forbidden' end as id from h
        union all select file_id, case when ok and media is null then 'contentTypeMissing' when ok and media <> 'text/plain' then 'contentType' end from h
        union all select file_id, 'htmlBody' from h where ok and regexp_matches(lower(regexp_replace(left(coalesce(body, ''), 2000), '^[\t-\r \x{85}\p{Z}]+', '')), '^(<!doctype html|<html)')
        union all select file_id, 'retryAfterLong' from h where status in (429, 503) and try_cast(trim(headers.retry_after) as bigint) > 86400 and regexp_matches(trim(headers.retry_after), '^\+?[0-9]+$')
        union all select file_id, 'charset' from h where ok and regexp_matches(coalesce(content_type, ''), ';\s*(charset|CHARSET)=') and trim(cs) not in ('utf-8', 'utf8', 'us-ascii', 'ascii')
        union all select file_id, case when list_contains(cd, 'no-store') or list_contains(cd, 'no-cache') or age = '0' then 'cacheNoStore' when try_cast(age as bigint) > 86400 then 'cacheTooLong' end from h where ok and cc is not null
        union all select file_id, 'xRobotsTag' from h where ok and trim(headers.x_robots_tag) <> ''
        union all select file_id, 'varyUserAgent' from h where ok and len(list_filter(string_split(coalesce(headers.vary, ''), ','), lambda v: lower(trim(v)) in ('user-agent', '*'))) > 0
        union all select file_id, 'redirectLimit' from h where coalesce(redirect_limit, false)
        union all select file_id, case when regexp_replace(lower(a), '^www\.', '') = regexp_replace(lower(b), '^www\.', '') then 'redirectSameSite' else 'redirectOtherHost' end from h where not coalesce(redirect_limit, false) and a <> '' and b <> '' and lower(a) <> lower(b)
        union all select file_id, 'notRobotsPath' from h where not coalesce(redirect_limit, false) and a <> '' and b <> '' and regexp_extract(final_url, '^https?://[^/?#]+([^?#]*)', 1) <> '/robots.txt'
      ) where id is not null""",
    "extension_counts": BASE + r"""select file_id, ext, count(*) as n from (
      select file_id, line, unnest(list_distinct(list_filter(list_append(regexp_extract_all(lower(path), '\.([a-z0-9]{1,8})(?:$|[$*/?])', 1), regexp_extract(split_part(replace(regexp_replace(lower(path), '\$$', ''), '*', ''), '?', 1), '\.([a-z0-9]{1,8})$', 1)), lambda x: x <> ''))) as ext
      from rules where path <> '') where ext in ('pdf', 'doc', 'xls', 'csv', 'zip', 'gz', 'php', 'asp', 'aspx', 'json', 'xml', 'gif', 'js', 'css') group by 1, 2""",
    "parse_lines": BASE + "select file_id, line, raw, kind, case when kind in ('blank', 'comment', 'invalid') then null else coalesce(field, raw_field) end as field, value from lines",
    "parse_groups": BASE + "select file_id, cast(group_id as bigint) as group_id, start_line, end_line, crawl_delay, n_agents, n_rules from groups",
    "parse_agents": BASE + "select file_id, cast(group_id as bigint) as group_id, raw, token, line from agents",
    "parse_rules": BASE + "select file_id, cast(group_id as bigint) as group_id, type, path, line from rules",
    "typo_repair": BASE + "select file_id, line, raw_field as raw, field from lines where field is not null and field <> raw_field",
    "comments": BASE + rf"select file_id, line, substr({trim('substr(comment, 2)')}, 1, 2000) as text from lines where comment is not null and {trim('substr(comment, 2)')} <> ''",
    "first_hosts": BASE + "select file_id, arg_min(value, line) as value, min(line) as line from lines where kind = 'host' group by file_id",
    "unknown_directives": BASE + "select file_id, raw_field as field, value, line from lines where kind = 'unknown'",
    "crawler_verdicts": BASE + "select file_id, ord, crawler, category, token, specific, n_allow, n_disallow, verdict from verdicts",
    "leaderboard": BASE + """select crawler, count(*) filter (verdict = 'blocked') as blocked, count(*) filter (verdict = 'partial') as restricted, count(*) filter (verdict = 'open') as open, count(*) as sites,
      cast(floor(count(*) filter (verdict = 'blocked') * 100 / count(*) + 0.5) as bigint) as blocked_percent from verdicts where category in ('ai_training', 'ai_assistant') group by crawler""",
    "ai_status": BASE + """select file_id, category, count(*) filter (verdict = 'open') as n_open, count(*) filter (verdict = 'partial') as n_partial, count(*) filter (verdict = 'blocked') as n_blocked, count(*) as total,
      case when category <> 'ai_training' then null when count(*) filter (verdict = 'blocked') = count(*) then 'ok' when count(*) filter (verdict <> 'open') = 0 then 'info'
           when count(*) filter (verdict = 'blocked') = 0 and not bool_or(specific) then 'info' else 'warning' end as callout
      from verdicts where category in ('ai_training', 'ai_assistant') group by 1, 2""",
    "file_sizes": BASE + """select f.file_id, cast(strlen(f.text) as bigint) as size, (select count(*) from groups g where g.file_id = f.file_id) as n_groups, (select count(*) from rules r where r.file_id = f.file_id) as n_rules,
      (select count(*) from lines l where l.file_id = f.file_id and l.kind = 'sitemap') as n_sitemaps from files f""",
    "sensitive_paths_admin": BASE + r"""select file_id, path, line from rules where type = 'disallow' and path <> '' and regexp_matches(lower(path), '(?:^|/)(?:admin|administrator|wp\-admin|backend|manager|cpanel|phpmyadmin)(?:/|$|\*|\.)')
      and not regexp_matches(path, '^/\**$') and not regexp_matches(lower(path), '^/wp-content/|^/assets/')""",
    "token_repeated": BASE + "select file_id, token, count(*) as n from agents where token <> '' group by 1, 2 having count(*) > 1",
    "star_blocks_all": BASE + r"""select a.file_id from (select distinct file_id, group_id from agents where token = '*') a join rules r using (file_id, group_id)
      group by 1 having bool_or(r.type = 'disallow' and regexp_matches(r.path, '^/\**$')) and not bool_or(r.type = 'allow' and r.path <> '')""",
    "high_crawl_delays": BASE + "select file_id, line, delay as seconds from delays where delay >= 60",
    "longest_match_access": BASE + r""", probes as (select unnest(['/', '/login', '/search?q=1', '/admin/x', '/robots.txt', '/robots.txt?x', '/private/a.pdf']) as path),
    matched as (
      select t.file_id, t.token, p.path, r.type, r.path as rule, r.line, length(r.path) as len
      from file_tokens t join token_rules r on r.file_id = t.file_id and r.token = t.token, probes p
      where regexp_matches(r.path, '^[!-~]*$') and not contains(r.path, '%')
        and p.path like replace(replace(replace(regexp_replace(case when right(r.path, 1) = '$' then left(r.path, -1) else r.path end, '\\', '\\\\', 'g'), '_', '\_'), '*', '%'), '%%', '%') || case when right(r.path, 1) = '$' then '' else '%' end escape '\'
    ), best as (select file_id, token, path, arg_max({'type': type, 'rule': rule, 'line': line}, {'len': len, 'allow': type = 'allow', 'neg': -line}) as b from matched group by 1, 2, 3)
    select p.file_id, p.crawler, p.token, q.path, q.path = '/robots.txt' or coalesce(b.b.type = 'allow', true) as allowed, case when q.path <> '/robots.txt' then b.b.rule end as rule, case when q.path <> '/robots.txt' then b.b.line end as line
    from picked p cross join probes q left join best b on b.file_id = p.file_id and b.token = p.token and b.path = q.path""",
    "fetch_status_findings": r"""select distinct fetch_id as file_id, case when status between 500 and 599 then 'fetch.warn.serverError' when status = 429 then 'fetch.warn.rateLimited' else 'fetch.warn.forbidden' end as id
      from fetches where status between 500 and 599 or status in (429, 401, 403)""",
    "enabled_sites": "select domain, name, category from sites where coalesce(enabled, true) and domain is not null",
    "crawl_summary": r"""with once as (select distinct on (record_id) * from audit_records), e as (select unnest(map_keys(crawlers)) as key, unnest(map_values(crawlers)) as verdict from once)
      select 'crawler' as what, key, verdict, count(*) as n from e group by 2, 3
      union all select 'status', coalesce(status::varchar, 'none'), null, count(*) from once group by 2
      union all select 'platform', coalesce(platform, 'none'), null, count(*) from once group by 2
      union all select 'total', '', null, count(*) from once union all select 'fetched', '', null, count(*) filter (ok) from once
      union all select 'unreachable', '', null, count(*) - count(*) filter (ok) from once union all select 'with_robots', '', null, count(*) filter (status between 200 and 299) from once""",
    "comment_tickets": r"""select distinct doc_id as file_id, ticket as value from (select doc_id, unnest(regexp_extract_all(text, '\b([A-Z]{2,6}-[0-9]{2,6})\b', 1)) as ticket from documents)""",
}
