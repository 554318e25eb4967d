"""Queries and SQL of the snapshot problem (p5)."""

from __future__ import annotations

from crawlquarry.operators.snapshots import corrected_diffs, snapshot_changes
from crawlquarry.session import table


def p5_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "site_snapshots"))


def p5_corrected_diffs(spark, sf_dir):
    return corrected_diffs(table(spark, sf_dir, "site_snapshots"), table(spark, sf_dir, "semantic_diffs"))


_STANDING = r"""
with src as (
  select run_no, domain, http_status, final_url, unavailable, html, verdicts, fetched_at, snap_id,
         list_filter(list_transform(regexp_split_to_array(coalesce(robots_txt, ''), '\r\n|\r|\n'),
                     lambda x: regexp_replace(regexp_replace(split_part(x, '#', 1), '^[\s\p{Z}\x{FEFF}]+', ''), '[\s\p{Z}]+$', '')), lambda x: x <> '') as lines
  from site_snapshots where run_no is not null and domain is not null
), standing as (
  select * from (select *, row_number() over (partition by run_no, domain order by fetched_at desc nulls last, snap_id desc) as rn from src) where rn = 1
), runs as (
  select run_no, lag(run_no) over (order by run_no) as prev from (select distinct run_no from src)
), flips as (
  select c.run_no, c.domain, count(*) as n,
         string_agg(concat_ws(':', e.k, p.verdicts[e.k], e.v), ',' order by e.k) as txt
  from (select run_no, domain, unnest(map_keys(verdicts)) as k, unnest(map_values(verdicts)) as v from standing) e
  join standing c on c.run_no = e.run_no and c.domain = e.domain
  join runs r on r.run_no = c.run_no
  join standing p on p.run_no = r.prev and p.domain = c.domain
  where list_contains(map_keys(p.verdicts), e.k) and p.verdicts[e.k] is distinct from e.v
  group by 1, 2
), pairs as (
  select c.run_no, r.prev as prev_run_no, c.domain, c.lines is distinct from p.lines as lines_differ,
         (c.http_status is distinct from p.http_status or c.final_url is distinct from p.final_url
          or c.unavailable is distinct from p.unavailable or c.html is distinct from p.html) as values_differ,
         coalesce(f.n, 0) as n, coalesce(f.txt, '') as txt, list_sort(map_entries(c.verdicts)) is distinct from list_sort(map_entries(p.verdicts)) as maps_differ
  from standing c join runs r on r.run_no = c.run_no join standing p on p.run_no = r.prev and p.domain = c.domain
  left join flips f on f.run_no = c.run_no and f.domain = c.domain
)
"""

SQL = {
    "p5_found": _STANDING
    + """
select run_no, domain, 'changed' as change_kind from pairs where lines_differ or values_differ or n > 0
union all
select c.run_no, c.domain, 'added' from standing c join runs r on r.run_no = c.run_no
where r.prev is not null and not exists (select 1 from standing p where p.run_no = r.prev and p.domain = c.domain)
union all
select r.run_no, p.domain, 'removed' from standing p join runs r on r.prev = p.run_no
where not exists (select 1 from standing c where c.run_no = r.run_no and c.domain = p.domain)
""",
    "p5_corrected_diffs": _STANDING
    + """
, reports as (
  select domain, run_no, prev_run_no, max(is_changed) as reported_is_changed, count(*) as reports from semantic_diffs where domain is not null group by all
)
select run_no, prev_run_no, domain, coalesce(c.lines_differ, false) as is_changed, cast(coalesce(c.n, 0) as int) as n_bot_changes, c.txt as bot_changes, r.reported_is_changed,
       case when r.reports is null then 'missing' when r.reported_is_changed is null then 'unknown' when r.reported_is_changed = coalesce(c.lines_differ, false) then 'agrees' else 'wrong' end as verdict_of_report
from (select * from pairs where lines_differ or values_differ or maps_differ) c full join reports r using (domain, run_no, prev_run_no)
""",
}

QUERIES = {"p5_found": p5_found, "p5_corrected_diffs": p5_corrected_diffs}
