"""SQL of access decisions, versions of files, and what the rule pack finds; the pack's signatures become CASEs and VALUES."""

# ruff: noqa: E501
from __future__ import annotations

import re

from crawlquarry import config as C
from crawlquarry.functions.text import SECOND_LEVEL
from crawlquarry.operators import findings as G
from crawlquarry.operators import parse as P
from crawlquarry.plans.engine_sql import _DIRECTIVES, _STRIP, BASE, RULE_PATHS, base, trim

PACK = C.load()


def text(s: str | None) -> str:
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    """Percent-encoding in one form: unreserved ASCII decoded, hex digits upper case, all but visible ASCII encoded."""
    code = "((instr('0123456789ABCDEF', upper(substr(y, 2, 1))) - 1) * 16 + instr('0123456789ABCDEF', upper(substr(y, 3, 1))) - 1)::int"
    one = (
        f"case when length(y) = 3 then case when regexp_matches(chr({code}), '^[A-Za-z0-9._~-]$') then chr({code}) else upper(y) end "
        r"when regexp_matches(y, '^[!-~]$') then y else regexp_replace(hex(encode(y)), '(..)', '%\1', 'g') end"
    )
    return f"case when regexp_matches({x}, '^[!-$&-~]*$') then {x} else array_to_string(list_transform(regexp_extract_all({x}, '(?s)%[0-9A-Fa-f]{{2}}|.'), lambda y: {one}), '') end"


def like(n: str) -> str:
    """LIKE pattern of a normal path pattern."""
    body = f"case when right({n}, 1) = '$' then left({n}, -1) else {n} end"
    return rf"regexp_replace(regexp_replace({body}, '([\\%_])', '\\\1', 'g'), '\*+', '%', 'g') || case when right({n}, 1) = '$' then '' else '%' end"


def sample(x: str) -> str:
    plain = rf"replace(regexp_replace({trim(x)}, '\$$', ''), '*', '')"
    return f"case when starts_with({plain}, '/') then {plain} else '/' || {plain} end"


NORMAL = rf"""
, ruled as (select file_id, group_id, type, path, line, {norm("path")} as n from rules where path <> ''),
patterned as (select *, {like("n")} as pat, length(n) as len from ruled),
of_token as (
  select t.file_id, t.token, r.type, r.path, r.line, r.pat, r.len from file_tokens t join patterned r on r.file_id = t.file_id
  and exists (select 1 from agents a where a.file_id = r.file_id and a.group_id = r.group_id and a.token = t.token)
)
"""

#: deliveries of site_snapshots, each with the site's next one; file_id is (first snapshot, run numbers)
_PAIRS = r"""
  s as (select * from site_snapshots where domain is not null),
  standing as (select run_no, domain, min(snap_id) as first, coalesce(arg_max(robots_txt, struct_pack(f := fetched_at, s := snap_id)), '') as b from (select run_no, domain, coalesce(robots_txt, '') as robots_txt, fetched_at, snap_id from s) group by 1, 2),
  lagged as (select domain, b, run_no, min(first) over (partition by domain) as first, lag(run_no) over w as prev_run_no, lag(b) over w as a from standing window w as (partition by domain order by run_no)),
  deliveries as (select first as file_id, prev_run_no, run_no, a, b from lagged where prev_run_no is not null)
"""
_VERSIONS = base(
    _PAIRS
    + """,
  files0 as (
    select {'file_id': file_id, 'prev_run_no': prev_run_no, 'run_no': run_no, 'side': side} as file_id, null as site_url, text
    from (select file_id, prev_run_no, run_no, unnest(['a', 'b']) as side, unnest([a, b]) as text from deliveries where a <> b)
  )"""
)
_KEY = "{0}.file_id.file_id as file_id, {0}.file_id.prev_run_no as prev_run_no, {0}.file_id.run_no as run_no"
_OTHER_SIDE = "{1}.file_id.file_id = {0}.file_id.file_id and {1}.file_id.prev_run_no = {0}.file_id.prev_run_no and {1}.file_id.run_no = {0}.file_id.run_no and {1}.file_id.side <> {0}.file_id.side"


def root(host: str) -> str:
    """The last two labels, three behind a listed second-level suffix."""
    listed = ", ".join(text(x) for x in SECOND_LEVEL)
    last = lambda n: f"array_to_string(string_split({host}, '.')[-{n}:], '.')"
    return f"case when len(string_split({host}, '.')) <= 2 then {host} when {last(2)} in ({listed}) then {last(3)} else {last(2)} end"


def first_case(column: str, entries: list[tuple[str, str]], otherwise: str = "null") -> str:
    return "case " + " ".join(f"when regexp_matches({column}, {text(p)}) then {v}" for p, v in entries) + f" else {otherwise} end"


def _signatures() -> list[tuple[str, str]]:
    rank = {"high": 0, "medium": 1, "low": 2, "info": 3}
    out = []
    for _, s in sorted(enumerate(PACK["security"]["signature"]), key=lambda x: (rank[x[1]["severity"]], x[0])):
        words = "|".join(re.escape(w) for w in s.get("keywords", []))
        parts = ([rf"(?:^|/)(?:{words})(?:/|$|\*|\.)"] if words else []) + ([s["pattern"]] if s.get("pattern") else [])
        out.append(("|".join(f"(?:{x})" for x in parts), f"{{'category': {text(s['category'])}, 'severity': {text(s['severity'])}, 'reason': {text(s['reason'])}}}"))
    return out


def _platform_rows() -> str:
    rows = []
    for i, p in enumerate(PACK["platform"]):
        for kind in ("strong", "weak"):
            rows += [f"({i}, {text(p['name'])}, {text(p['kind'])}, '{kind}', {k}, {text(x)})" for k, x in enumerate(p.get(kind, []))]
    return ", ".join(rows)


def _said_rows() -> str:
    return ", ".join(f"({text(p['name'])}, {text('|'.join(f'(?:{x})' for x in p['comments']))})" for p in PACK["platform"] if p.get("comments"))


PLATFORMS = rf"""
, pack(ord, platform, kind, strength, k, pattern) as (values {_platform_rows()}),
said_pack(platform, pattern) as (values {_said_rows()}),
distinct_paths as (select distinct file_id, lower(path) as low, path from rules where path <> ''),
rule_hits as (
  select file_id, low, platform, arg_min(strength || k, case strength when 'strong' then k else 1000 + k end) as hit
  from (select distinct file_id, low from distinct_paths) d join pack on regexp_matches(low, pattern) group by 1, 2, 3
),
rule_scores as (select file_id, platform, count(distinct hit) filter (starts_with(hit, 'strong')) as strong, count(distinct hit) filter (starts_with(hit, 'weak')) as weak from rule_hits group by 1, 2),
said as (select file_id, platform, count(*) as said from lines join said_pack on comment is not null and regexp_matches(lower(comment), pattern) group by 1, 2),
scores as (
  select file_id, platform, kind, 2 * strong + weak + 3 * said as score, case when strong = 0 and said = 0 then 'low' when 2 * strong + weak + 3 * said >= 4 then 'high' when 2 * strong + weak + 3 * said >= 2 then 'medium' else 'low' end as confidence
  from (select coalesce(r.file_id, s.file_id) as file_id, coalesce(r.platform, s.platform) as platform, coalesce(strong, 0) as strong, coalesce(weak, 0) as weak, coalesce(said, 0) as said from rule_scores r full join said s on r.file_id = s.file_id and r.platform = s.platform)
  join (select distinct platform, kind from pack) using (platform) where strong > 0 or said > 0 or weak >= 2
),
primary_platform as (
  select file_id, arg_min(platform, {{'s': -score, 'p': platform}}) as platform from scores where kind in ('cms', 'ecommerce', 'hosting', 'forum', 'wiki') and confidence <> 'low' group by 1
)
"""
_STOCK = ", ".join(f"{text(p['name'] + chr(31) + d.lower())}" for p in PACK["platform"] for d in p.get("defaults", [])) or "''"
_IGNORED = "|".join(f"(?:{x})" for x in PACK["security"].get("ignore", [])) or "^$"
SECURITY = rf"""
, judged_paths as (
  select file_id, group_id, path, line, p, {first_case("p", _signatures())} as s
  from (select *, regexp_replace(lower(path), '\$$', '') as p from rules where type = 'disallow' and path <> '' and not regexp_matches(path, '^/\**$')) where not regexp_matches(p, {text(_IGNORED)})
), security as (
  select j.file_id, j.path, j.line, j.s.category as category, case when coalesce(f.platform, '') || chr(31) || j.p in ({_STOCK}) then 'info' else j.s.severity end as severity,
         case when coalesce(f.platform, '') || chr(31) || j.p in ({_STOCK}) then 'stock path of the platform' else j.s.reason end as reason,
         (select list(a.raw order by a.line) from agents a where a.file_id = j.file_id and a.group_id = j.group_id) as user_agents
  from judged_paths j left join primary_platform f on f.file_id = j.file_id where j.s is not null
)
"""
_EXTS = ", ".join(f"({text(e)}, {text(x['label'])}, {text(x['category'])}, {text(x['risk'])}, {text(x.get('tech'))})" for x in PACK["extension"] for e in x["exts"])
_EXT_LIST = r"list_distinct(list_filter(list_append(regexp_extract_all(lower(path), '\.([a-z0-9]{1,8})(?:$|[$*/?])', 1), regexp_extract(split_part(replace(regexp_replace(lower(path), '\$$', ''), '*', ''), '?', 1), '\.([a-z0-9]{1,8})$', 1)), lambda x: x <> ''))"
_D = PACK["data"]
_M = PACK["comments"]

def first_in(column: str, needles: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when contains({column}, {text(n)}) then {text(n)}" for n in needles) + " end"


def any_in(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({column}, {text(n)})" for n in needles) + ")"


_NEAREST = "least(" + ", ".join(f"case when levenshtein(one, '{n}') <= 2 then levenshtein(one, '{n}') * 10 + {i} else 999 end" for i, n in enumerate(P.CANONICAL)) + ")"
_GLUED = "case " + " ".join(
    rf"when regexp_matches({'low_comment' if n != 'allow:' else chr(114) + 'eplace(low_comment, ' + chr(39) + 'disallow:' + chr(39) + ', ' + chr(39) + '#' + chr(39) + ')'}, '[\p{{L}}\p{{N}}.]{n}') then '{n[:-1]}'" for n in G.DIRECTIVE_NAMES
) + " end"
_COMMENTED = "case " + " ".join(f"when starts_with(squeezed, '{n}') then '{n[:-1]}'" for n in G.DIRECTIVE_NAMES) + " end"
_SPACES = r"[\t-\r \x{85}\p{Z}]"
_KEYS = ", ".join(f"'{k}'" for k in G.SIGNAL_KEYS)

#: every syntax finding: file_id, line, id, level, kind, variant, params as text (k=v in order of k, joined by ;)
SYNTAX = rf"""
, first_of as (select file_id, min(line) filter (kind = 'user-agent') as g, min(line) filter (kind = 'host') as h from lines group by 1),
m as (
  select l.*, k.kind, k.token, coalesce(l.line > f.g, false) as grouped, f.h, lower(l.value) as low_value, lower(l.comment) as low_comment,
    regexp_replace(l.field_src, '[{P.INVISIBLE}]', '', 'g') as seen, translate(regexp_replace(l.field_src, '[{P.INVISIBLE}]', '', 'g'), '{P.LOOKALIKE_FROM}', '{P.LOOKALIKE_TO}') as folded,
    case when regexp_replace(l.low, '^[^A-Za-z0-9]+', '') <> '' then left(l.low, length(l.low) - length(regexp_replace(l.low, '^[^A-Za-z0-9]+', ''))) end as junk0,
    split_part(l.raw, '#', 1) as before, lower(regexp_replace(regexp_replace(l.comment, '^#+', ''), '{_SPACES}+', '', 'g')) as squeezed, regexp_replace(l.raw_field, '[^\x00-\x7F]', '?', 'g') as one
  from l5 l join lines k on k.file_id = l.file_id and k.line = l.line left join first_of f on f.file_id = l.file_id
), doc as (
  select *, lower(src) as low, regexp_matches(lower(regexp_replace(left(src, 2000), '^{_SPACES}+', '')), '^(<!doctype html|<html)') or (starts_with(lower(regexp_replace(left(src, 2000), '^{_SPACES}+', '')), '<?xml') and contains(lower(left(regexp_replace(left(src, 2000), '^{_SPACES}+', ''), 2000)), '<html')) as page from files
), doc2 as (
  select *, {first_in("low", G.ERROR_MARKERS)} as err, {first_in("low", G.PLUGIN_MARKERS)} as plug, {first_in("low", G.HTML_TAGS)} as tag,
    case when contains(low, '<script') and {any_in("low", G.OBFUSCATION)} then 'script' when contains(low, '<iframe') then 'iframe' when contains(low, '<marquee') then 'marquee' when contains(low, '<a ') and {any_in("low", G.HIDING)} then 'hiddenLink' end as injected from doc
), glue as (select file_id, line, kind, {_GLUED} as glued, {_COMMENTED} as commented from m where comment is not null),
delay_lines as (
  select m.*, d.group_id, case when regexp_matches(m.value, '^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast(m.value as double) when regexp_matches(m.value, '^-0*\.?0*$') and contains(m.value, '0') then 0.0 end as d
  from m left join directives d on d.file_id = m.file_id and d.line = m.line where m.kind = 'crawl-delay'
), nameless as (
  select a.file_id, a.line, case when bool_or(b.token = '*') then 'star' when bool_or(b.token not in ('', '*')) then 'others' end as variant,
    case when not bool_or(b.token = '*') and bool_or(b.token not in ('', '*')) then string_agg(b.raw, ', ' order by b.line) filter (b.token not in ('', '*')) end as names
  from agents a join agents b on b.file_id = a.file_id and b.group_id = a.group_id where a.token = '' group by 1, 2
), signals as (
  select file_id, line, len(list_filter(list_filter(list_transform(string_split(value, ','), lambda x: {trim("x")}), lambda x: x <> ''),
    lambda p: not (lower({trim("split_part(p, '=', 1)")}) in ({_KEYS}) and case when contains(p, '=') then lower({trim("substr(p, instr(p, '=') + 1)")}) else '' end in ('yes', 'no')))) as bad from m where kind = 'unknown' and raw_field = 'content-signal'
), cleans as (
  select file_id, line, value, len(w) <= 2 and len(names) > 0 and len(list_filter(names, lambda x: not regexp_matches(x, '^[A-Za-z0-9_.-]+$'))) = 0 and regexp_matches(coalesce(w[2], '/'), '^[/*]') as ok
  from (select *, list_filter(string_split(coalesce(w[1], ''), '&'), lambda x: x <> '') as names from (select *, list_filter(regexp_split_to_array(value, '\s+'), lambda x: x <> '') as w from m where field = 'clean-param'))
), unknowns as (
  select m.*, case when raw_field in ('http', 'https') and starts_with(value, '//') then 'parser.bareUrl' when raw_field = 'noindex' then 'parser.noindex' when raw_field in ({", ".join(text(x) for x in P.META_ROBOTS)}) then 'parser.metaRobots'
    when raw_field in ({", ".join(text(x) for x in P.AI_DIRECTIVES)}) or starts_with(raw_field, 'ai-') or starts_with(raw_field, 'llm') then 'parser.aiDirective'
    when raw_field = 'content-signal' then case when s.bad = 0 then 'parser.contentSignal' else 'parser.contentSignalInvalid' end
    when raw_field in ({", ".join(text(x) for x in P.LEGACY_DIRECTIVES)}) then 'parser.nonStandardDirective' else 'parser.unknownDirective' end as id
  from m left join signals s on s.file_id = m.file_id and s.line = m.line where kind = 'unknown'
), merged as (
  select g.file_id, g.start_line, exists (select 1 from of_scope o where o.file_id = g.file_id and o.group_id = g.group_id) as merged from groups g where g.n_rules = 0 and g.crawl_delay is null
), syntax as (
  select file_id, cast(line as int) as line, id, level, kind, variant, params from (
    select file_id, null as line, 'parser.tooLarge' as id, 'warning' as level, 'syntax' as kind, null as variant, 'kib=' || (strlen(text) // 1024) as params from files where strlen(text) > 512000
    union all select file_id, 1, 'parser.bom', 'info', 'syntax', null, '' from files where bom
    union all select file_id, 1, 'parser.utf16', 'error', 'syntax', null, '' from files where utf16
    union all select file_id, null, 'security.injectedCode', 'error', 'security', injected, '' from doc2 where not page and injected is not null
    union all select file_id, (select min(l.line) from lines l where l.file_id = d.file_id and contains(lower(l.raw), d.err)), 'parser.serverErrorOutput', 'error', 'syntax', null, '' from doc2 d where not page and err is not null
    union all select file_id, (select min(l.line) from lines l where l.file_id = d.file_id and contains(lower(l.raw), d.plug)), 'parser.pluginOutput', 'warning', 'syntax', null, '' from doc2 d where not page and plug is not null
    union all select file_id, (select min(l.line) from lines l where l.file_id = d.file_id and contains(lower(l.raw), d.tag)), 'parser.htmlFragment', 'error', 'syntax', null, 'tag=' || rtrim(tag) from doc2 d where not page and tag is not null
    union all select file_id, null, 'parser.invalidUtf8', 'warning', 'syntax', null, '' from doc2 where not page and contains(src, chr(65533))
    union all select file_id, min(line), 'parser.longLine', 'info', 'syntax', null, 'chars=' || arg_min(length(raw), line) from lines where length(raw) > 2000 group by 1
    union all select file_id, min(line), 'parser.invisibleChar', 'warning', 'syntax', null, '' from m where seen <> field_src and colon > 0 group by 1
    union all select file_id, min(line), 'parser.fullwidthColon', 'warning', 'syntax', null, '' from m where contains(before, '：') and colon > 0 group by 1
    union all select file_id, line, 'parser.gluedComment', 'error', 'syntax', null, 'directive=' || glued from glue where glued is not null
    union all select file_id, line, 'lint.commentedRule', 'info', 'syntax', null, 'directive=' || commented from glue where kind = 'comment' and glued is null and commented is not null
    union all select file_id, line, 'parser.notFieldValue', 'error', 'syntax', case when strlen(raw_field) >= 4 and {_NEAREST} < 999 then 'hint' end, 'field=' || case when strlen(raw_field) >= 4 and {_NEAREST} < 999 then [{", ".join(text(x) for x in P.CANONICAL)}][{_NEAREST} % 10 + 1] else '' end from m where kind = 'invalid'
    union all select file_id, line, 'parser.homoglyph', 'warning', 'syntax', null, 'field=' || raw_field from m where colon > 0 and folded <> seen
    union all select file_id, line, 'parser.misspelling', 'info', 'syntax', null, 'field=' || field || ';raw=' || raw_field from m where field is not null and field <> raw_field
    union all select file_id, line, 'parser.junkBeforeField', 'warning', 'syntax', null, 'field=' || field || ';junk=' || junk0 from m where field is not null and regexp_matches(junk0, '[^ ]')
    union all select file_id, line, 'parser.hashInValue', 'warning', 'syntax', case when field = 'sitemap' then 'sitemap' end, 'truncated=' || value from m
      where field in ('allow', 'disallow', 'sitemap') and value <> '' and comment is not null and before <> '' and not regexp_matches(right(before, 1), '^{_SPACES}$') and (field = 'sitemap' or grouped)
    union all select m.file_id, m.line, case when value = '' then 'parser.emptyUserAgent' else 'parser.invalidToken' end, case when value = '' then 'error' else 'warning' end, 'syntax', n.variant, 'names=' || coalesce(n.names, '') || ';value=' || value
      from m left join nameless n on n.file_id = m.file_id and n.line = m.line where kind = 'user-agent' and token = ''
    union all select file_id, line, 'parser.tokenTail', 'info', 'syntax', null, 'token=' || token || ';value=' || value from m where kind = 'user-agent' and token not in ('', '*') and token <> low_value
    union all select file_id, line, 'parser.ruleBeforeAgent', 'error', 'syntax', case when value <> '' then field end, 'directive=' || field from m where kind = 'rule' and not grouped
    union all select file_id, line, case when field = 'allow' then 'parser.emptyAllow' else 'parser.emptyDisallow' end, 'info', 'syntax', null, '' from m where kind = 'rule' and grouped and value = ''
    union all select file_id, line, 'parser.pathNoSlash', 'warning', 'syntax', field, 'value=' || value from m where kind = 'rule' and grouped and value <> '' and not regexp_matches(value, '^[/*]') and not regexp_matches(value, '(?i)^https?://')
    union all select file_id, line, 'parser.wildcardOnly', 'warning', 'syntax', null, 'value=' || value from m where kind = 'rule' and grouped and field = 'disallow' and regexp_matches(value, '^\*+$')
    union all select file_id, line, 'parser.spaceInPath', 'warning', 'syntax', null, 'value=' || value from m where kind = 'rule' and grouped and contains(value, ' ')
    union all select file_id, line, 'parser.regexSyntax', 'warning', 'syntax', null, 'value=' || value from m where kind = 'rule' and grouped and not regexp_matches(value, '(?i)^https?://') and {any_in("value", G.REGEX_TOKENS)}
    union all select file_id, line, 'parser.nonAsciiPath', 'info', 'syntax', null, 'value=' || value from m where kind = 'rule' and grouped and strlen(value) <> length(value)
    union all select file_id, line, 'parser.placeholder', 'warning', 'syntax', null, 'placeholder=' || {first_in("low_value", G.PLACEHOLDERS)} || ';value=' || value from m
      where (field in ('user-agent', 'sitemap') or (kind = 'rule' and grouped and value <> '')) and {first_in("low_value", G.PLACEHOLDERS)} is not null
    union all select file_id, line, 'parser.crawlDelayBeforeAgent', 'error', 'syntax', null, '' from m where kind = 'crawl-delay' and not grouped
    union all select x.file_id, x.line, 'parser.crawlDelayDuplicate', 'info', 'syntax', null, '' from delay_lines x where grouped and d is not null and exists (select 1 from delay_lines y where y.file_id = x.file_id and y.group_id = x.group_id and y.line < x.line and y.d is not null)
    union all select file_id, line, 'parser.crawlDelayHigh', 'warning', 'syntax', null, 'pages=' || cast(floor(86400 / d) as bigint) || ';seconds=' || cast(d as varchar) from delay_lines where grouped and d >= 60
    union all select file_id, line, 'parser.crawlDelayNaN', 'warning', 'syntax', null, 'value=' || value from delay_lines where grouped and d is null
    union all select file_id, min(line), 'parser.crawlDelayNonStandard', 'info', 'syntax', null, '' from delay_lines where grouped group by 1
    union all select file_id, line, 'parser.sitemapInvalid', 'warning', 'syntax', null, 'value=' || value from m where field = 'sitemap' and not regexp_matches(value, '(?i)^https?:/{{0,2}}[^/\s?#\\<>^|]+[^\s]*$')
    union all select file_id, line, case when line = h then 'parser.hostObsolete' else 'parser.hostDuplicate' end, 'info', 'syntax', null, '' from m where kind = 'host'
    union all select file_id, line, case when not ok then 'parser.cleanParamMalformed' when strlen(value) > 500 then 'parser.cleanParamTooLong' else 'parser.cleanParamInfo' end, case when ok and strlen(value) <= 500 then 'info' else 'warning' end, 'syntax', null, '' from cleans
    union all select file_id, line, id, case when id = 'parser.bareUrl' then 'error' when id in ('parser.aiDirective', 'parser.contentSignal', 'parser.nonStandardDirective') then 'info' else 'warning' end, 'syntax', null, 'field=' || raw_field || ';value=' || value from unknowns
    union all select file_id, null, 'parser.noRules', 'info', 'syntax', null, '' from files f where not exists (select 1 from groups g where g.file_id = f.file_id)
    union all select file_id, start_line, 'parser.emptyGroup', 'info', 'syntax', case when merged then 'merged' end, '' from merged
    union all select file_id, null, 'parser.tokenRepeated', 'info', 'syntax', null, 'n=' || count(*) || ';token=' || token from agents where token <> '' group by file_id, token having count(*) > 1
    union all select a.file_id, null, 'parser.starBlocksAll', 'warning', 'syntax', null, '' from (select distinct file_id, group_id from agents where token = '*') a join rules r using (file_id, group_id)
      group by 1 having bool_or(r.type = 'disallow' and regexp_matches(r.path, '^/\**$')) and not bool_or(r.type = 'allow' and r.path <> '')
    union all select file_id, null, 'parser.noSitemap', 'info', 'syntax', null, '' from (select distinct file_id from groups) g where not exists (select 1 from lines l where l.file_id = g.file_id and l.kind = 'sitemap')
  )
)
"""
#: groups with the rules of the token that they are judged under
SCOPED = """
, named_groups as (select file_id, group_id, bool_or(token = '*') as star, arg_min(token, line) as first from agents where token <> '' group by 1, 2),
group_scope as (select g.file_id, g.group_id, case when n.first is null or n.star then '*' else n.first end as token from groups g left join named_groups n using (file_id, group_id)),
of_scope as (select s.file_id, s.group_id, r.path from group_scope s join token_rules r on r.file_id = s.file_id and r.token = s.token)
"""


def _list(xs) -> str:
    return ", ".join(text(x) for x in xs)


_FILE_IN = r"regexp_replace(path, '/+$', '') || "
_NORMAL_PATH = rf"case when {trim('path')} = '' then '/' else case when rest = '' then '/' when starts_with(rest, '/') then rest else '/' || rest end end"
#: every search finding, in the form of the syntax findings
SEO = rf"""
, g_rules as (
  select r.*, {norm("r.path")} as n, lower(r.path) as low, s.token as scope, exists (select 1 from agents a where a.file_id = r.file_id and a.group_id = r.group_id and a.token = '*') as star, regexp_matches(r.path, '^/\**$') as whole,
    reverse(split_part(reverse(r.path), '/', 1)) as last, {sample("lower(r.path)")} as low_sample, {sample("r.path")} as own_sample
  from rules r join group_scope s on s.file_id = r.file_id and s.group_id = r.group_id
), pat_rules as (select *, {like("n")} as pat, length(n) as len from g_rules),
marked as (
  select *, path <> '' and not whole and not regexp_matches(path, '[*$?]') and not path like '%/' and last <> '' and not contains(last, '.') as open_end,
    type = 'disallow' and path <> '' and not whole and '/robots.txt' like pat escape '\' as itself,
    case when type = 'disallow' and path <> '' and star then case when low in ({_list(G.QUERY_PATTERNS)}) then 'seo.queryStringBlock' when low in ({_list(G.ASSET_DIRS)}) then 'seo.assetBlock' when regexp_matches(low, '\.(css|js)\$?$') then 'seo.cssJsBlock'
      when low in ({_list(G.IMAGE_DIRS)}) then 'seo.imageBlock' when {" or ".join(f"ends_with(low, {text(x)})" for x in G.IMAGE_FILES)} then 'seo.imageBlock' end end as broad,
    case when low in ({_list(G.QUERY_PATTERNS)}) then '/?page=2' when low in ({_list(G.ASSET_DIRS)}) then {_FILE_IN}'/app.js' when regexp_matches(low, '\.(css|js)\$?$') then own_sample when low in ({_list(G.IMAGE_DIRS)}) then {_FILE_IN}'/photo.jpg' else own_sample end as broad_path
  from pat_rules
), asks0 as (
  select file_id, scope as token, path || '-old' as asked from marked where open_end
  union select file_id, scope, '/robots.txt' from marked where itself
  union select file_id, '*', broad_path from marked where broad is not null
), asks as (select *, {norm("asked")} as n from asks0),
answers as (
  select a.file_id, a.token, a.asked, coalesce(arg_max(r.type = 'allow', {{'len': r.len, 'allow': r.type = 'allow', 'neg': -r.line}}) filter (a.n like r.pat escape '\'), true) as allowed
  from asks a left join of_token r on r.file_id = a.file_id and r.token = a.token group by 1, 2, 3
), many as (
  select file_id, token, min(line) as first from agents where token <> '' group by 1, 2 having count(distinct group_id) > 1
), sets as (
  select file_id, 0 as ord, 0 as first, cast(group_id as varchar) as part, '' as scope, type, path, line, n, pat, len from pat_rules where path <> ''
  union all select r.file_id, 1, t.first, t.token, t.token, r.type, r.path, r.line, r.n, r.pat, r.len from many t join pat_rules r on r.file_id = t.file_id and r.path <> ''
    and exists (select 1 from agents a where a.file_id = r.file_id and a.group_id = r.group_id and a.token = t.token)
), literal as (select *, right(path, 1) = '$' as anchored, {norm("case when right(path, 1) = '$' then left(path, -1) else path end")} as lit from sets where not contains(path, '*')),
beaten as (
  select b.file_id, b.ord, b.first, b.scope, b.type, b.path, b.line, b.len, max({{'len': r.len, 'allow': r.type = 'allow', 'neg': -r.line, 'path': r.path}}) as w
  from literal b join sets r on r.file_id = b.file_id and r.ord = b.ord and r.part = b.part and not (r.line = b.line and r.type = b.type and r.path = b.path) and (b.anchored or right(r.path, 1) <> '$')
    and not (r.type = b.type and r.path = b.path and r.line > b.line) and b.lit like r.pat escape '\' group by all
), judged_rules as (
  select *, case when w.allow = (type = 'allow') and w.path = path then 'seo.duplicate' when w.allow = (type = 'allow') then 'seo.redundant' when w.len > len or (w.len = len and w.allow) then 'seo.overridden' end as id from beaten
), shadow as (select * from judged_rules where id is not null qualify row_number() over (partition by file_id, line order by ord, first) = 1),
seo as (
  select m.file_id, cast(m.line as int) as line, 'seo.trailingSlash' as id, case when exists (select 1 from rules q where q.file_id = m.file_id and starts_with(q.path, m.path) and length(q.path) > length(m.path) and substr(q.path, length(m.path) + 1, 1) <> '/') then 'warning' else 'info' end as level,
    'seo-trap' as kind, m.type as variant, 'path=' || m.path as params from marked m join answers a on a.file_id = m.file_id and a.token = m.scope and a.asked = m.path || '-old' where open_end and a.allowed = (m.type = 'allow')
  union all select m.file_id, m.line, 'seo.selfBlock', 'warning', 'seo-trap', null, 'path=' || path from marked m join answers a on a.file_id = m.file_id and a.token = m.scope and a.asked = '/robots.txt' where itself and not a.allowed
  union all select file_id, line, 'seo.caseSensitive', 'info', 'seo-trap', null, 'lower=' || low_sample || ';path=' || path from marked where regexp_matches(path, '[A-Z]')
  union all select m.file_id, m.line, broad, case when broad = 'seo.imageBlock' then 'info' else 'warning' end, 'seo-trap', null, 'path=' || path from marked m join answers a on a.file_id = m.file_id and a.token = '*' and a.asked = m.broad_path where broad is not null and not a.allowed
  union all select file_id, line, 'lint.absoluteUrl', 'warning', 'seo-trap', type, 'path=' || {_NORMAL_PATH} from (select *, regexp_replace(regexp_replace({trim("path")}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '(?s)#.*', '') as rest from marked) where regexp_matches(path, '(?i)^https?://')
  union all select file_id, line, id, case when id = 'seo.overridden' then 'warning' else 'info' end, 'seo-trap', case when id = 'seo.overridden' then type end, 'by=' || -w.neg || ';path=' || path || ';scope=' || scope || ';winner=' || w.path from shadow
)
"""


MAPS = rf""", m0 as (
      select l.file_id, l.line as n, f.site_url as site, lower(split_part(l.value, ':', 1)) as scheme, lower(regexp_extract(l.value, '(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+|\[[0-9A-Fa-f:.]+\])', 1)) as host,
             regexp_extract(l.value, '(?i)^https?://[^/?#]*?:([0-9]+)(?:[/?#]|$)', 1) as port, regexp_replace(regexp_replace(l.value, '(?i)^https?:/*[^/?#]*', ''), '^$', '/') as rest,
             lower(regexp_extract(f.site_url, '(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+|\[[0-9A-Fa-f:.]+\])', 1)) as site_host
      from lines l join files f using (file_id) where l.kind = 'sitemap' and regexp_matches(l.value, '(?i)^https?:/{{0,2}}[^/\s?#\<>^|]+[^\s]*$')
    ), m1 as (
      select *, case when host <> '' then scheme || '://' || host || case when port = '' or (scheme = 'http' and port = '80') or (scheme = 'https' and port = '443') then '' else ':' || port end || case when starts_with(rest, '/') then rest else '/' || rest end end as url from m0
    ), m2 as (
      select *, case when url is not null then min(n) over (partition by file_id, url) end as first, regexp_matches(lower(site), '^https?://') and site_host <> '' and host <> '' as judge, regexp_replace(host, '^www\.', '') as bare, regexp_replace(site_host, '^www\.', '') as site_bare from m1
    ), m3 as (select *, {root("bare")} as root, {root("site_bare")} as site_root from m2),
    maps_found as (select file_id, n as line, id, level, 'sitemap' as kind from (
      select file_id, n, 'sitemap.duplicate' as id, 'info' as level from m3 where first < n
      union all select file_id, n, 'sitemap.protocolMismatch', 'warning' from m3 where not coalesce(first < n, false) and judge and starts_with(lower(site), 'https:') and starts_with(url, 'http:')
      union all select file_id, n, 'sitemap.httpsOnHttp', 'info' from m3 where not coalesce(first < n, false) and judge and starts_with(lower(site), 'http:') and starts_with(url, 'https:')
      union all select file_id, n, case when site_root <> root then 'sitemap.crossDomain' else 'sitemap.otherSubdomain' end, case when site_root <> root then 'warning' else 'info' end from m3 where not coalesce(first < n, false) and judge and bare <> site_bare
    ))
"""
_HOST = r"regexp_extract({0}, '(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+|\[[0-9A-Fa-f:.]+\])', 1)"
_PORT = r"regexp_extract({0}, '(?i)^https?://[^/?#]*?:([0-9]+)(?:[/?#]|$)', 1)"


def place(url: str) -> str:
    """Host and port of a URL, a default port left out; null without a host."""
    host, port = _HOST.format(url), _PORT.format(url)
    return f"case when {host} <> '' then lower({host}) || case when {port} = '' or (lower(split_part({url}, ':', 1)) = 'http' and {port} = '80') or (lower(split_part({url}, ':', 1)) = 'https' and {port} = '443') then '' else ':' || {port} end end"


ANSWERS = rf"""
, h as (
  select *, coalesce(status between 200 and 299, false) as ok, nullif(lower({trim("split_part(content_type, ';', 1)")}), '') as media, headers.cache_control as cc,
    list_filter(list_transform(string_split(content_type, ';')[2:], lambda p: {trim("p")}), lambda p: starts_with(p, 'charset=') or starts_with(p, 'CHARSET='))[1] as cs0,
    list_transform(string_split(coalesce(headers.cache_control, ''), ','), lambda x: {trim("x")}) as cd, {place("robots_url")} as a, {place("final_url")} as b, coalesce(redirect_limit, false) as limited,
    case when regexp_matches({trim("headers.retry_after")}, '^\+?[0-9]{{1,18}}$') then cast({trim("headers.retry_after")} as bigint) end as pause, regexp_extract(final_url, '(?i)^https?://[^/?#]*([^?#]*)', 1) as p0
  from files
), h2 as (
  select *, lower(regexp_replace(substr(cs0, 9, 200), '^"+|"+$', '', 'g')) as cs, list_filter(cd, lambda x: lower(x) = 'max-age' or starts_with(lower(x), 'max-age='))[1] as age0,
    len(list_filter(cd, lambda x: lower(x) in ('no-store', 'no-cache') or starts_with(lower(x), 'no-store=') or starts_with(lower(x), 'no-cache='))) > 0 as kept_off from h
), h3 as (select *, case when contains(age0, '=') then regexp_replace({trim("substr(age0, instr(age0, '=') + 1)")}, '^"+|"+$', '', 'g') else '' end as age from h2),
h4 as (select *, case when regexp_matches({trim("age")}, '^\+?[0-9]{{1,18}}$') then cast({trim("age")} as bigint) end as seconds from h3),
answered as (
  select file_id, cast(null as int) as line, 'fetch.warn.' || id as id, level, 'fetch' as kind, cast(null as varchar) as variant, params from (
    select file_id, case when status between 500 and 599 then 'serverError' when status = 429 then 'rateLimited' when status in (401, 403) then 'forbidden' end as id,
      case when status between 500 and 599 then 'error' when status = 429 then 'warning' else 'info' end as level, case when status = 429 then '' else 'status=' || status end as params from h4
    union all select file_id, case when media is null then 'contentTypeMissing' when media <> 'text/plain' then 'contentType' end, 'warning', case when media is null then '' else 'type=' || media end from h4 where ok
    union all select file_id, 'htmlBody', 'error', '' from h4 where ok and regexp_matches(lower(regexp_replace(left(coalesce(body, ''), 2000), '^{_SPACES}+', '')), '^(<!doctype html|<html)')
    union all select file_id, 'retryAfterLong', 'warning', 'seconds=' || pause || ';status=' || status from h4 where status in (429, 503) and pause > 86400
    union all select file_id, 'charset', 'warning', 'charset=' || cs from h4 where ok and cs not in ('utf-8', 'utf8', 'us-ascii', 'ascii')
    union all select file_id, case when kept_off or coalesce({trim("age")} = '0', false) then 'cacheNoStore' when seconds > 86400 then 'cacheTooLong' end, case when kept_off or coalesce({trim("age")} = '0', false) then 'info' else 'warning' end,
      case when kept_off or coalesce({trim("age")} = '0', false) then 'value=' || {trim("cc")} else 'maxage=' || seconds end from h4 where ok and cc is not null
    union all select file_id, 'xRobotsTag', 'info', 'value=' || {trim("headers.x_robots_tag")} from h4 where ok and {trim("headers.x_robots_tag")} <> ''
    union all select file_id, 'varyUserAgent', 'info', 'value=' || {trim("headers.vary")} from h4 where ok and len(list_filter(string_split(coalesce(headers.vary, ''), ','), lambda v: lower({trim("v")}) in ('user-agent', '*'))) > 0
    union all select file_id, 'redirectLimit', 'error', '' from h4 where limited
    union all select file_id, case when regexp_replace(a, '^www\.', '') = regexp_replace(b, '^www\.', '') then 'redirectSameSite' else 'redirectOtherHost' end,
      case when regexp_replace(a, '^www\.', '') = regexp_replace(b, '^www\.', '') then 'info' else 'warning' end, case when regexp_replace(a, '^www\.', '') = regexp_replace(b, '^www\.', '') then 'host=' || b else 'from=' || a || ';to=' || b end from h4 where not limited and a <> b
    union all select file_id, 'notRobotsPath', 'warning', 'path=' || case when p0 = '' then '/' else p0 end from h4 where not limited and a is not null and b is not null and case when p0 = '' then '/' else p0 end <> '/robots.txt'
  ) where id is not null
)
"""
LEGACY = f"""
, old_tools as (
  select file_id, arg_min(line, line) as line, 'lint.legacyBadBots' as id, 'info' as level, 'lint' as kind from (select file_id, line, lower({trim("raw")}) as name from agents) where name in ({_list([x.lower() for x in PACK["crawlers"]["legacy_tokens"]])})
  group by 1 having count(distinct name) >= {G.LEGACY_THRESHOLD}
)
"""
EVERY = BASE + NORMAL + SCOPED + SYNTAX + SEO + MAPS + ANSWERS + LEGACY + """
, every as (
  select file_id, id, level, kind from syntax union all select file_id, id, level, kind from seo union all select file_id, id, level, kind from maps_found
  union all select file_id, id, level, kind from answered union all select file_id, id, level, kind from old_tools
)
"""


SQL = {
    "semantic_flags": "with " + _PAIRS + f"select file_id, prev_run_no, run_no, {_DIRECTIVES.format('a')} is distinct from {_DIRECTIVES.format('b')} as is_changed, {_STRIP.format('a')} is distinct from {_STRIP.format('b')} as text_changed from deliveries",
    "semantic_sitemaps": _VERSIONS
    + f"""select {_KEY.format("x")}, x.value as url, case when x.file_id.side = 'b' then 'new' else 'resolved' end as side from lines x where x.kind = 'sitemap'
      and not exists (select 1 from lines y where y.kind = 'sitemap' and y.value = x.value and {_OTHER_SIDE.format("x", "y")})""",
    "semantic_flips": _VERSIONS
    + f"""select {_KEY.format("x")}, x.crawler, y.category, x.verdict as old_verdict, y.verdict as new_verdict from verdicts x join verdicts y on y.crawler = x.crawler and {_OTHER_SIDE.format("x", "y")}
      where x.file_id.side = 'a' and x.verdict <> y.verdict""",
    "normalised_paths": f"select distinct path, {norm('path')} as norm from rules where path is not null",
    "checked_access": BASE
    + NORMAL
    + rf""", own as (select file_id, group_id, arg_min(token, line) as asked from agents where token <> '' group by 1, 2),
    probes as (select distinct r.file_id, o.asked, {sample("r.path")} as path from ruled r join own o using (file_id, group_id)),
    normal_probes as (select *, case when exists (select 1 from file_tokens t where t.file_id = p.file_id and t.token = p.asked) then p.asked when exists (select 1 from file_tokens t where t.file_id = p.file_id and t.token = '*') then '*' end as token, {norm("path")} as n from probes p),
    best as (
      select q.file_id, q.asked, q.path, arg_max({{'type': r.type, 'rule': r.path, 'line': r.line}}, {{'len': r.len, 'allow': r.type = 'allow', 'neg': -r.line}}) as b
      from normal_probes q join of_token r on r.file_id = q.file_id and r.token = q.token where q.n like r.pat escape '\' group by 1, 2, 3
    )
    select q.file_id, q.asked, q.path, q.token, q.path = '/robots.txt' or coalesce(b.b.type = 'allow', true) as allowed, case when q.path <> '/robots.txt' then b.b.rule end as rule, case when q.path <> '/robots.txt' then b.b.line end as line
    from normal_probes q left join best b on b.file_id = q.file_id and b.asked = q.asked and b.path = q.path""",
    "rule_outcomes": BASE
    + NORMAL
    + rf""", named as (select file_id, group_id, bool_or(token = '*') as star, arg_min(token, line) as first from agents where token <> '' group by 1, 2),
    scopes as (select g.file_id, g.group_id, case when n.first is null or n.star then '*' else n.first end as token from groups g left join named n using (file_id, group_id)),
    others as (select distinct file_id from agents where token not in ('', '*')),
    asked as (select r.file_id, r.group_id, r.line, r.type, r.path as rule_path, {sample("r.path")} as path, s.token from ruled r join scopes s using (file_id, group_id)),
    normal_asked as (select *, {norm("path")} as n from asked),
    best as (
      select q.file_id, q.group_id, q.line, arg_max({{'type': r.type, 'line': r.line}}, {{'len': r.len, 'allow': r.type = 'allow', 'neg': -r.line}}) as b
      from normal_asked q join of_token r on r.file_id = q.file_id and r.token = q.token where q.n like r.pat escape '\' group by 1, 2, 3
    )
    select q.file_id, cast(q.group_id as int) as group_id, q.line, q.type, q.rule_path, q.path, case when b.b is null then 'open' when b.b.type = 'allow' then 'allowed' else 'blocked' end as state,
           case when q.token <> '*' then 'named' when o.file_id is not null then 'default' else 'all' end as audience, b.b.line as decided_by,
           case when q.token <> '*' then (select list(a.raw order by a.line) from agents a where a.file_id = q.file_id and a.group_id = q.group_id and a.token <> '') else [] end as names
    from normal_asked q left join best b on b.file_id = q.file_id and b.group_id = q.group_id and b.line = q.line left join others o on o.file_id = q.file_id""",
    "cleaned_paths": BASE
    + rf""", params as (
      select file_id, line, list_filter(string_split(coalesce(w[1], ''), '&'), lambda x: x <> '') as params, coalesce(w[2], '/') as path,
        len(w) <= 2 and len(list_filter(string_split(coalesce(w[1], ''), '&'), lambda x: x <> '')) > 0 and regexp_matches(coalesce(w[1], ''), '^[A-Za-z0-9_.&-]+$') and regexp_matches(coalesce(w[2], '/'), '^[/*]') as valid
      from (select *, list_filter(regexp_split_to_array(value, '\s+'), lambda x: x <> '') as w from lines where kind = 'clean-param')
    ), cps as (select file_id, params, {like("n")} as pat from (select *, {norm("path")} as n from params where valid)),
    raw_probes as (
      select file_id, {sample("path")} as path from rules where path <> '' and contains(path, '?')
      union all select file_id, unnest(['/forum/?ref=1&sort=2&vellum=3', '/a?sid=1']) from files
      union all select file_id, replace(path, '*', 'x') || '?keep=1&' || array_to_string(list_transform(params, lambda x: x || '=2'), '&') from params where valid
    ), probes0 as (select distinct file_id, path from raw_probes),
    probes as (select file_id, path as asked, case when p = '' then '/' when starts_with(p, '/') then p else '/' || p end as path from (select *, {trim("path")} as p from probes0)),
    based as (select file_id, path, {norm("split_part(path, '?', 1)")} as b from probes),
    names as (select q.file_id, q.path, list(distinct x) as names from (select q.file_id, q.path, unnest(c.params) as x from based q join cps c on c.file_id = q.file_id and q.b like c.pat escape '\') q group by 1, 2),
    parts as (select p.file_id, p.path, coalesce(n.names, []) as names, instr(p.path, '?') > 0 as has, string_split(substr(p.path, instr(p.path, '?') + 1), '&') as pairs from probes p left join names n on n.file_id = p.file_id and n.path = p.path),
    judged as (select *, list_filter(pairs, lambda x: has and list_contains(names, split_part(x, '=', 1))) as gone, list_filter(pairs, lambda x: not list_contains(names, split_part(x, '=', 1))) as kept from parts)
    select file_id, path, case when len(gone) = 0 then path when len(kept) = 0 then split_part(path, '?', 1) else split_part(path, '?', 1) || '?' || array_to_string(kept, '&') end as cleaned, list_transform(gone, lambda x: split_part(x, '=', 1)) as removed from judged""",
    "platform_scores": BASE + PLATFORMS + "select file_id, platform, kind, score, confidence from scores",
    "sensitive_paths": BASE + PLATFORMS + SECURITY + "select file_id, path, line, category, severity, reason, user_agents from security",
    "extensions": BASE
    + rf""", kinds(ext, label, category, risk, tech) as (values {_EXTS}),
    found as (select file_id, line, path, unnest({_EXT_LIST}) as ext from rules where path <> '')
    select file_id, ext, label, category, risk, tech, count(*) as n, (list(path order by line, path))[1:3] as examples from found join kinds using (ext) group by all""",
    "data_feeds": BASE
    + RULE_PATHS
    + rf"""select file_id, path, min(line) as line, arg_min(kind, line) as kind from (
      select *, {first_case("low", [(x["pattern"], text(x["label"])) for x in _D["feed_kind"]], "'feed'")} as kind from paths
      where len(list_filter(segs, lambda s: regexp_matches(s, {text(_D["feed_words"])}))) > 0
         or (regexp_matches(split_part(plain, '?', 1), {text(_D["feed_file"])}) and (regexp_matches(plain, {text(_D["feed_hint"])}) or regexp_matches(low, '\*\.(xml|csv|json|rss|atom)\$?$')))) group by 1, 2""",
    "tech_hints": BASE
    + rf""", kinds(ext, label, category, risk, tech) as (values {_EXTS}), found as (select file_id, unnest({_EXT_LIST}) as ext from rules where path <> '')
    select file_id, list_sort(list(distinct tech)) as tech from found join kinds using (ext) where tech is not null group by 1""",
    "security_categories": BASE
    + PLATFORMS
    + SECURITY
    + rf""", info(ord, category, label, advice) as (values {", ".join(f"({i}, {text(c['id'])}, {text(c['label'])}, {text(c['advice'])})" for i, c in enumerate(PACK["security"]["category"]))})
    select s.file_id, i.ord, s.category, i.label, i.advice, count(*) as n from security s join info i using (category) group by all""",
    "platform_evidence": BASE
    + PLATFORMS
    + r""", of_rules as (
      select r.file_id, p.platform, r.line, 'rule' as source, case when bool_or(p.strength = 'strong') then 'strong' else 'weak' end as strength, r.path as text
      from rules r join pack p on r.path <> '' and regexp_matches(lower(r.path), p.pattern) group by r.file_id, p.platform, r.line, r.path
    ), notes as (select file_id, line, comment_text as text from (select file_id, line, substr(TRIMMED, 1, 2000) as comment_text from lines where comment is not null) where comment_text <> '')
    select * from of_rules union all select n.file_id, p.platform, n.line, 'comment', 'comment', n.text from notes n join said_pack p on regexp_matches(lower(n.text), p.pattern)""".replace("TRIMMED", trim("substr(comment, 2)")),
    "ai_cards": BASE
    + f""", per as (
      select file_id, category, count(*) filter (verdict = 'blocked') as blocked, count(*) filter (verdict = 'partial') as partial, count(*) as total, bool_or(specific) as named, string_agg(crawler, ', ' order by ord) filter (verdict <> 'blocked') as listed
      from verdicts where category in ('ai_training', 'ai_assistant') group by 1, 2
    ), training as (select * from per where category = 'ai_training')
    select f.file_id, coalesce(string_agg(case p.category when 'ai_training' then {text(PACK["crawlers"]["labels"]["ai_training"])} else {text(PACK["crawlers"]["labels"]["ai_assistant"])} end || ': ' || p.blocked || ' of ' || p.total || ' blocked', ' · ' order by p.category desc), '') as headline,
      any_value(case when t.file_id is null then 'info' when t.blocked = t.total then 'ok' when t.blocked + t.partial = 0 then 'info' when t.blocked = 0 and not t.named then 'info' else 'warning' end) as callout,
      any_value(case when t.file_id is null then 'No crawler of this kind is known.' when t.blocked = t.total then 'All of them are blocked.' when t.blocked + t.partial = 0 then 'None of them is restricted.' when t.blocked = 0 and not t.named then 'None of them is named.' else 'Not blocked: ' || coalesce(t.listed, '') end) as callout_text,
      count(p.category) as n_groups
    from files f left join per p on p.file_id = f.file_id left join training t on t.file_id = f.file_id group by 1""",
    "ai_flips": _VERSIONS
    + f"""select {_KEY.format("x")}, x.crawler, y.category, x.verdict as old_verdict, y.verdict as new_verdict from verdicts x join verdicts y on y.crawler = x.crawler and {_OTHER_SIDE.format("x", "y")}
      where x.file_id.side = 'a' and x.verdict <> y.verdict and y.category = 'ai_training'""",
    "probe_plan": "select s.domain, c.crawler, c.ua from sites s, (select name as crawler, ua from crawlers where ua is not null and ua <> '' union all select null, 'Mozilla/5.0') c where s.domain is not null",
    "domains_of_sites": rf"select distinct d as domain from (select lower({trim('domain')}) as d, coalesce(name, '') as name from sites where domain is not null) where contains(d, '.') and not contains(d, '/') and not starts_with(ltrim(name), '#')",
    "security_changes": _VERSIONS
    + rf""", judged_paths as (
      select file_id, path, {first_case("p", _signatures())} as s
      from (select *, regexp_replace(lower(path), '\$$', '') as p from rules where type = 'disallow' and path <> '' and not regexp_matches(path, '^/\**$')) where not regexp_matches(p, {text(_IGNORED)})
    ), found as (select file_id, path, s.category as category from judged_paths where s is not null)
    select {_KEY.format("x")}, x.path, x.category, case when x.file_id.side = 'b' then 'new' else 'resolved' end as side from found x
    where not exists (select 1 from found y where y.path = x.path and y.category = x.category and {_OTHER_SIDE.format("x", "y")})""",
    "sitemap_findings": BASE + MAPS + "select file_id, line, id, level from maps_found",
    "generators": BASE
    + rf""", pack(generator, pattern) as (values {", ".join(f"({text(g['name'])}, {text('|'.join(f'(?:{x})' for x in g['comments']))})" for g in PACK["generator"])}),
    notes as (select file_id, line, substr({trim("substr(comment, 2)")}, 1, 2000) as text from lines where comment is not null and {trim("substr(comment, 2)")} <> '')
    select file_id, generator, min(line) as line, arg_min(text, line) as text from notes join pack on regexp_matches(lower(text), pattern) group by 1, 2""",
    "seo_findings": BASE + NORMAL + SCOPED + SEO + "select * from seo",
    "syntax_findings": BASE + SCOPED + SYNTAX + "select * from syntax",
    "fetch_findings": BASE + ANSWERS + "select * from answered",
    "finding_counts": EVERY + "select kind, id, level, count(*) as n from every group by all",
    "worst_levels": EVERY + "select file_id, arg_min(level, case level when 'error' then 0 when 'warning' then 1 else 2 end) as worst from every group by 1",
    "report_summary": BASE
    + SCOPED
    + SYNTAX
    + PLATFORMS
    + SECURITY
    + """, counts as (select file_id, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings, count(*) filter (level = 'info') as infos from syntax group by 1),
    sec as (select file_id, count(*) as n from security group by 1),
    ai as (select file_id, count(*) filter (verdict = 'blocked') as blocked, count(*) as total from verdicts where category = 'ai_training' group by 1)
    select f.file_id, cast(strlen(f.text) as bigint) as size, (select count(*) from groups g where g.file_id = f.file_id) as n_groups, (select count(*) from rules r where r.file_id = f.file_id) as n_rules,
      (select count(*) from lines l where l.file_id = f.file_id and l.kind = 'sitemap') as n_sitemaps, coalesce(c.errors, 0) as errors, coalesce(c.warnings, 0) as warnings, coalesce(c.infos, 0) as infos, coalesce(s.n, 0) as security_findings,
      coalesce(a.blocked, 0) as ai_training_blocked, coalesce(a.total, 0) as ai_training_total, case when t.whole and t.n_allow = 0 then 'blocked' when coalesce(t.n_disallow, 0) = 0 then 'open' else 'partial' end as policy, t.token is not null as has_star_group, p.platform
    from files f left join counts c using (file_id) left join sec s using (file_id) left join ai a using (file_id) left join primary_platform p using (file_id) left join sums t on t.file_id = f.file_id and t.token = '*'""",
    "semantic_issue_ids": _VERSIONS
    + SCOPED
    + SYNTAX
    + f"""select {_KEY.format("x")}, x.id, case when x.file_id.side = 'b' then 'new' else 'resolved' end as side from syntax x
      where not exists (select 1 from syntax y where y.id = x.id and y.variant is not distinct from x.variant and y.params = x.params and {_OTHER_SIDE.format("x", "y")})""",
    "high_impact": _VERSIONS
    + SCOPED
    + SYNTAX
    + rf""", judged_paths as (
      select file_id, path, {first_case("p", _signatures())} as s
      from (select *, regexp_replace(lower(path), '\$$', '') as p from rules where type = 'disallow' and path <> '' and not regexp_matches(path, '^/\**$')) where not regexp_matches(p, {text(_IGNORED)})
    ), found as (select file_id, path, s.category as category, s.severity as severity from judged_paths where s is not null)
    select distinct {_KEY.format("x")} from verdicts x join verdicts y on y.crawler = x.crawler and {_OTHER_SIDE.format("x", "y")} where x.verdict <> y.verdict
    union select {_KEY.format("x")} from found x where x.file_id.side = 'b' and not exists (select 1 from found y where y.path = x.path and y.category = x.category and {_OTHER_SIDE.format("x", "y")})
      and exists (select 1 from found z where z.file_id = x.file_id and z.path = x.path and z.severity = 'high')
    union select {_KEY.format("x")} from syntax x where x.file_id.side = 'b' and not exists (select 1 from syntax y where y.id = x.id and y.variant is not distinct from x.variant and y.params = x.params and {_OTHER_SIDE.format("x", "y")})
      and exists (select 1 from syntax z where z.file_id = x.file_id and z.id = x.id and z.level = 'error')""",
    "outcome_sentences": "",
    "fetch_findings_levels": "",
    "body_hashes": BASE
    + """select file_id, case when text = '' then '' else lower(lpad(to_hex(cast(list_reduce(list_prepend(cast(14695981039346656037 as uhugeint), list_transform(regexp_extract_all(hex(encode(text)), '..'),
      lambda x: cast((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1 as uhugeint))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) as ubigint)), 16, '0')) end as hash from files""",
}
del SQL["fetch_findings_levels"]
SQL["line_notes"] = (
    BASE + NORMAL + SCOPED + SYNTAX + SEO + MAPS + ANSWERS + LEGACY
    + """, placed_ids as (
      select file_id, line, id, case when id in ('parser.bom', 'parser.utf16', 'parser.serverErrorOutput', 'parser.pluginOutput', 'parser.htmlFragment') then 0 when id = 'parser.emptyGroup' then 2 else 1 end as phase from syntax where line is not null
      union all select file_id, line, id, case id when 'seo.trailingSlash' then 3 when 'seo.selfBlock' then 4 when 'seo.caseSensitive' then 5 when 'lint.absoluteUrl' then 9 when 'seo.duplicate' then 7 when 'seo.redundant' then 7 when 'seo.overridden' then 7 else 6 end from seo
      union all select file_id, line, id, 8 from maps_found union all select file_id, line, id, 10 from old_tools
    ) select file_id, line, list(id order by phase, id) as ids from placed_ids group by 1, 2"""
)
SQL["file_kib"] = r"select distinct on (fetch_id) fetch_id as file_id, regexp_replace(printf('%.1f', round(strlen(case when coalesce(status between 200 and 299, false) and not coalesce(redirect_limit, false) then coalesce(text, '') else '' end) / 102.4) / 10), '\.0$', '') as kib from fetches where fetch_id is not null"
SQL["comment_addresses"] = rf"""with found as (
      select doc_id, 'email' as kind, unnest(regexp_extract_all(text, {text(_M["email"])}, 1)) as v from documents union all select doc_id, 'ip', unnest(regexp_extract_all(text, {text(_M["ip"])}, 1)) from documents
    ) select doc_id as file_id, kind, min(v) as value, any_value(case when kind = 'ip' then case when regexp_matches(v, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') then 'private' else 'public' end end) as remark from found group by doc_id, kind, lower(v)"""
SQL["dates_in_documents"] = rf"""with words as (select doc_id, unnest(regexp_extract_all(text, {text(_M["text_date"])}, 1)) as t from documents),
    parts as (select *, lower(t) as l, list_filter(regexp_extract_all(t, '[0-9]+'), lambda x: length(x) = 4)[-1] as y, try_cast(regexp_extract_all(t, '\b([0-9]{{1,2}})\b', 1)[1] as int) as d from words),
    months as (select *, list_filter(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lambda m: contains(l, m))[1] as m from parts)
    select distinct doc_id, t, try_cast(y || '-' || lpad(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], m)::varchar, 2, '0') || '-' || lpad((case when d between 1 and 31 then d else 1 end)::varchar, 2, '0') as date) as day from months
    union select doc_id, 'created', cast(created_at as date) from documents where created_at is not null"""
SQL["crawl_record_counts"] = (
    EVERY.replace("\n, every as", PLATFORMS + SECURITY + "\n, every as")
    + """, counts as (select file_id, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings from every group by 1), sec as (select file_id, count(*) as n from security group by 1),
    ai as (select file_id, count(*) filter (verdict = 'blocked') as blocked, count(*) as total from verdicts where category = 'ai_training' group by 1),
    fr as (select distinct on (fetch_id) fetch_id, bytes, len(redirects) as redirects from fetches), hashes as (""" + SQL["body_hashes"].replace(BASE, "") + """)
    select f.file_id as record_id, f.domain, true as ok, f.status, f.final_url, r.redirects, r.bytes, x.hash, (select count(*) from groups g where g.file_id = f.file_id) as n_groups, (select count(*) from rules q where q.file_id = f.file_id) as n_rules,
      (select count(*) from lines l where l.file_id = f.file_id and l.kind = 'sitemap') as n_sitemaps, coalesce(c.errors, 0) as errors, coalesce(c.warnings, 0) as warnings, coalesce(s.n, 0) as security_findings, p.platform,
      coalesce(a.blocked, 0) as ai_training_blocked, coalesce(a.total, 0) as ai_training_total
    from files f left join counts c using (file_id) left join sec s using (file_id) left join ai a using (file_id) left join primary_platform p using (file_id) left join fr r on r.fetch_id = f.file_id left join hashes x on x.file_id = f.file_id"""
)
_WHO = "case audience when 'all' then 'every crawler' when 'default' then 'crawlers without rules of their own' else array_to_string(names[1:3], ', ') || case when len(names) > 3 then ' and ' || (len(names) - 3) || ' more' else '' end end"
SQL["outcome_sentences"] = (
    f"select file_id, group_id, line, path || case state when 'open' then ' is open to ' || {_WHO} || '.' when 'allowed' then ' is open to ' || {_WHO} || ' because of line ' || decided_by || '.' else ' is blocked for ' || {_WHO} || ' by line ' || decided_by || '.' end as sentence from ("
    + SQL["rule_outcomes"] + ")"
)
