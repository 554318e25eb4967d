"""SQL of the text-corpus queries that SQL can express."""

_TERMS = """
with v as (
  select 'token' as field, token as term, fetch_id as id from agents
  union all select 'path', path, fetch_id from rules
  union all select 'platform', platform, record_id from audit_records
), totals as (select field, count(distinct id) as n from v where term is not null and term <> '' group by 1),
counted as (
  select field, term, count(*) as occurrences, count(distinct id) as records from v where term is not null and term <> '' group by 1, 2
), marked as (
  select field, term, occurrences, records,
         case when records <= 2 then 'rare' when records * 10 > n then 'common' end as mark
  from counted join totals using (field)
)
"""

_KEYS = r"""
with k as (
  select fetch_id, array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(lower(text), '\r\n|\r|\n'),
         lambda x: regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> '')), chr(10)) as key
  from fetches where text is not null
)
"""

SQL = {
    "p3_fetch_contents": _KEYS + "select min(fetch_id) as keep_id, count(distinct fetch_id) as copies from k where key <> '' group by key",
    "p4_found": _TERMS + "select field, term, mark from marked where mark is not null",
    "p4_term_counts": _TERMS + "select field, term, occurrences, records, mark from marked",
}
