"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

_RULES = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
l as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
n as (select doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n from l),
c as (select *, len(regexp_extract_all(line, '[|>»•]')) as sep, len(regexp_extract_all(line, '[#*$%&|<>]')) as sym,
        len(regexp_extract_all(line, '[!?]{2,}')) as shout, len(regexp_extract_all(line, '[.!?:;,]')) as marks from n),
v as (select doc_id, line, n, n > 0 and ((sep >= 2 and sep * 4 >= n) or sym * 4 >= n or (shout >= 2 and shout * 4 >= n)
        or (n >= 40 and marks * 40 < n)
        or regexp_matches(lower(line), 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|cookie settings|accept cookies|accept all cookies|enable javascript|skip to content|skip to main content|sign up for our newsletter|click here to|subscribe now|subscribe to our|licensed under the ')) as bad
      from c),
lines as (select doc_id, sum(case when bad then length(line) else 0 end) as lost,
        count(line) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines from v group by doc_id),
p as (select doc_id, unnest(range(1, len(w) - 3)) as i, w from w where len(w) >= 5),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) as k from p),
r as (select doc_id, count(distinct i + o) as n_repeat from g, range(5) as o(o) where k > 1 group by doc_id),
m as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
        coalesce(n_repeat, 0)::bigint as n_repeat_words, lost, length(t) as chars
      from w join lines using (doc_id) left join r using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (lost * 100 > 50 * chars) as kept
from m
"""

_LINES = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, owner is not null and owner <> doc_id as gone from k left join o using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""



def _crc32(ascii_text: str) -> str:
    """CRC-32 of an expression whose text is ASCII, bit by bit."""
    byte = "xor(r >> 1, 3988292384::ubigint * (r & 1::ubigint))"
    return f"""xor(list_reduce(list_transform(string_split({ascii_text}, ''), lambda c: ascii(c)::ubigint),
      lambda h, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::ubigint[], lambda r, i: {byte}, xor(h, b)),
      4294967295::ubigint), 4294967295::ubigint)::bigint"""


_TRIE = rf"""
with given as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x
    from conversations where conv_id is not null),
told as (select *, sha256(strlen(r)::varchar || ':' || r || x) as h,
    len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words from given),
own as (select *, row_number() over (partition by c order by turn nulls first, h) - 1 as i from told),
ids as (select distinct c, {_crc32("c::varchar")} % 4 as heads from own),
built as (
  select ids.c, 0 as part, i, h, words from ids join own on own.c = ids.c - ids.c % 20 and i < heads
  union all
  select ids.c, 1, i, h, words from ids join own on own.c = ids.c and i >= heads),
placed as (select *, row_number() over (partition by c order by part, i) as d from built),
prefix as (
  select c, d, words, sha256(array_to_string(list(h) over (partition by c order by d), ',')) as k from placed
  union all
  select c, 0, 0, 'root' from ids),
linked as (select *, lag(k) over (partition by c order by d) as up, max(d) over (partition by c) as n from prefix),
nodes as (select k, d, up, words, min(c) as conv_id, count(*) as n_convs,
    string_agg(case when d = n then c::varchar end, ',' order by c) as ends from linked group by k, d, up, words),
kids as (select up as k, count(*) as n_children from nodes where up is not null group by up),
whole as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (k)),
sums as (
  select a.k, sum((w.n_children = 0)::int) as n_leaves, sum((w.n_convs - 1) * w.words) as saved
  from whole w join linked a on a.c = w.conv_id and a.d <= w.d group by a.k)
select w.conv_id, w.d::bigint as depth, p.conv_id as parent_conv_id, w.n_convs::bigint as n_convs,
  w.n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens,
  sha256(coalesce(w.ends, '')) as ends_sha256
from whole w join sums on sums.k = w.k left join whole p on p.k = w.up
"""

_REPAIR = rf"""
with recursive coded as (select conv_id as c, turn as t, coalesce(role, ' ') as r, coalesce(text, ' ') as x,
    {_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code from conversations),
damaged as (select c, t, case when code = 4 then 'user' else r end as r,
    case code when 1 then '' when 2 then translate(x, '.!?', '') else x end as x,
    unnest(range(case when code = 3 then 2 else 1 end)) as copy from coded where code <> 0),
told as (select *, row_number() over (partition by c order by t nulls first, r, x, copy) as i,
    rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from damaged),
seen as (select *, row_number() over (partition by c, r, x order by i) as nth,
    lag(r[1]) over (partition by c order by i) || r[1] as pair from told),
faulty as (select *, case when body = '' then 'blank' when nth > 1 then 'duplicate'
    when body[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault from seen),
talks as (select distinct conv_id as c from conversations),
facts as (select talks.c, count(i) as n, coalesce(max(t) - min(t) + 1 - count(distinct t), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from talks left join faulty on faulty.c is not distinct from talks.c group by talks.c),
-- states: 0 nothing, 1 after s, 2 after u, 3 after a
step(q, s, q2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
named(s, name) as (values ('u', 'user'), ('a', 'assistant')),
one as (select q, q2, chr(10) || name || ':' as rows from step join named using (s)),
put as (select q, q as q2, 0 as cost, '' as edits, '' as rows from (select distinct q from step)
  union all select q, q2, 5, 'I', rows from one
  union all select a.q, b.q2, 10, 'II', a.rows || b.rows from one a join one b on a.q2 = b.q),
edits as (
  select c, i, 'D' as e, null as s, 2 as cost, '' as rows from faulty
  union all
  select c, i, 'K', r[1], case when fault = '' then 0 else 5 end, chr(10) || r || ':' || x
    from faulty where fault in ('', 'truncated')
  union all
  select c, i, 'R', s, case when fault = '' then 1 else 6 end, chr(10) || name || ':' || x
    from faulty, named where fault in ('', 'truncated')),
moves as (select c, i, e, edits.cost, rows, q, q2 from edits join step using (s)
  union all select c, i, e, cost, rows, q, q from edits, (select distinct q from step) where e = 'D'),
way(c, i, q, cost, audit, rows) as (
  select c, 0::bigint, 0, 0, '', '' from talks
  union all
  (with tried as (select w.c, w.i + 1 as i, m.q2 as q, w.cost + put.cost + m.cost as cost,
      w.audit || put.edits || m.e as audit, w.rows || put.rows || m.rows as rows
    from way w join put on put.q = w.q
    join moves m on m.c is not distinct from w.c and m.i = w.i + 1 and m.q = put.q2)
   select c, i, q, cost, audit, rows from tried
   qualify row_number() over (partition by c, q order by cost, audit) = 1)
),
done as (select f.*, w.cost + put.cost as cost, w.audit || put.edits as audit, w.rows || put.rows as rows
  from facts f join way w on w.c is not distinct from f.c and w.i = f.n join put on put.q = w.q
  where put.q2 in (0, 3)
  qualify row_number() over (partition by f.c order by w.cost + put.cost, w.audit || put.edits) = 1)
select c as conv_id, gaps::bigint as gaps, blank::bigint as blank, duplicate::bigint as duplicate,
  truncated::bigint as truncated, illegal::bigint as illegal, cost::bigint as cost, audit,
  sha256(substr(rows, 2)) as repaired_sha256
from done
"""

ORACLES = {
    "op4_quality_rules": _RULES,
    "op10_line_dedup": _LINES,
    "op11_prefix_trie": _TRIE,
    "op12_role_repair": _REPAIR,
}
