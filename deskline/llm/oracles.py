"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from deskline.llm.license_rules import COMMENT, HINT, LICENCES, NOISE, ONLY_ALONE, SENTENCE_END, SENTENCES, TOPIC

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def op1_ngram_join() -> str:
    return f"""
with recursive w as (
  select doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select distinct doc_id, hash(array_to_string(w[i:i + 4], ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
k as (select doc_id, n, list(g order by g) as gs from s join n using (doc_id) group by doc_id, n),
c as (select min(doc_id) as rep, n, gs from k group by n, gs),
f as (select rep, n, unnest(gs) as g from c),
shared as (select a.rep as x, b.rep as y, count(*) as together from f a join f b on a.g = b.g and a.rep < b.rep group by 1, 2),
links as (
  select x, y from shared join c a on a.rep = x join c b on b.rep = y where 100 * together >= 75 * (a.n + b.n - together)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select rep as x, rep as y from c union select r.x, l.y from reach r join both_ways l on r.y = l.x),
component as (select x, min(y) as low from reach group by x)
select d.doc_id, coalesce(k.n, 0) as n_shingles, coalesce(component.low, d.doc_id) as component_id
from documents d left join k on k.doc_id = d.doc_id
left join c on c.n = k.n and c.gs = k.gs left join component on component.x = c.rep"""


def op4_license_scan() -> str:
    """The same rules in order.  RE2 has no look-ahead: a gap over lines is the shortest one instead."""
    marked = "s"
    for name, pattern in SENTENCES:
        one = re.sub(r"(?<!\\)\.", "[^\\\\n\\\\x01]", pattern)
        over = "|".join("[^\\x01]*?".join(re.sub(r"(?<!\\)\.", "[^\\\\x01]", p).replace(" ", "[ \\n]") for p in way.split(".*")) for way in pattern.split("|"))
        for p in (one, over):
            marked = f"regexp_replace({marked}, '(?m)^[^\\n\\x01]*(?:{p})[^\\n\\x01]*$', chr(1) || '{name}' || chr(1), 'g')"
    lines = f"list_filter(list_transform(regexp_split_to_array(s, '[\\r\\n]+'), lambda x: trim(regexp_replace(x, '{NOISE}', ' ', 'g'))), lambda x: x <> '')"
    comment = COMMENT.replace("'", "''")
    steps = [f"r0 as (select *, ',' || replace(identifiers, ',', ',,') || ',' as rest, '' as found from i)"]
    for k, (name, pattern) in enumerate(LICENCES):
        p = pattern.replace(",", ",+")
        hit = f"regexp_matches(rest, '{p}')" + (" and found = ''" if name in ONLY_ALONE else "")
        steps.append(
            f"r{k + 1} as (select doc_id, n_sentences, identifiers, case when {hit} then regexp_replace(rest, '{p}', ',', 'g') else rest end as rest, "
            f"case when {hit} then found || ',{name}' else found end as found from r{k})"
        )
    return f"""
with a as (
  select row_number() over () as r, doc_id,
    case when regexp_matches(text, '{HINT}') then list_filter(regexp_split_to_array(regexp_replace(text, '{comment}', '', 'g'), '{SENTENCE_END}'),
      lambda s: regexp_matches(s, '{HINT}')) else [] end as about
  from (select doc_id, coalesce(text, '') as text from documents)),
n as (
  select r, k, lower(regexp_replace(array_to_string({lines}, chr(10)), '[. \\n]+$', '')) as s
  from (select r, unnest(about) as s, unnest(range(len(about))) as k from a)),
m as (select r, k, regexp_matches(replace(s, chr(10), ' '), '{TOPIC}') as topic, regexp_extract_all({marked}, '\\x01([^\\x01]+)\\x01', 1) as names from n),
j as (
  select r, count(*) as n_sentences, array_to_string(flatten(list(names order by k)), ',') as identifiers
  from m where topic or len(names) > 0 group by r),
i as (
  select cast(doc_id as bigint) as doc_id, coalesce(n_sentences, 0) as n_sentences, coalesce(identifiers, '') as identifiers
  from a left join j using (r)),
{', '.join(steps)}
select doc_id, n_sentences, identifiers, coalesce(found[2:], '') as licences from r{len(LICENCES)}"""


def op8_line_dedup() -> str:
    space = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    return f"""
with l as (
  select doc_id, unnest(x) as line, unnest(range(len(x))) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
k as (select *, translate(trim(line, {space}), '{_UPPER}', '{_LOWER}') as key from l),
h as (
  select key, count(distinct doc_id) as docs, max(doc_id) as last from k where length(key) >= 20 group by key),
r as (
  select k.*, coalesce(h.docs >= 3 and h.last <> k.doc_id, false) as gone
  from k left join h on h.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from r group by doc_id"""


def op9_decontamination() -> str:
    words = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select doc_id, {words} as w from documents),
b as (select cast(item_id as varchar) as item, {words} as w from benchmark),
p as (
  select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as run
  from (select item, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
sizes as (select distinct n from p),
runs as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as run
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d join sizes on len(w) >= n)),
hits as (select doc_id, i, runs.n, item from runs join p on p.run = runs.run and p.n = runs.n),
covered as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)"""


def op12_conversation_repair() -> str:
    space = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
    checksum = """xor(4294967295, list_reduce(
      list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ord(x) as bigint)),
      lambda c, b: list_reduce([cast(k as bigint) for k in range(8)], lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, xor(c, b)),
      4294967295))"""
    return f"""
with recursive
raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {checksum} % 20 as fate from conversations),
r as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when fate = 3 then [0, 1] else [0] end) as copy
  from raw where fate <> 0),
o as (
  select *, i > min(i) over (partition by conv_id, role, text) as seen, trim(text, {space}) as body
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from r)),
k as (
  select *, case when body = '' then 'blank' when seen then 'duplicate' when right(body, 1) in ('.', '!', '?') then '' else 'truncated' end as fault,
    left(role, 1) as x, lead(left(role, 1)) over (partition by conv_id order by i) as next_x
  from o),
pre(f, s, c, a, line) as (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:')),
ways(s, letter, t, c, x, as_role) as (values (0, 'D', 0, 2, '', ''), (1, 'D', 1, 2, '', ''), (2, 'D', 2, 2, '', ''), (3, 'D', 3, 2, '', ''),
  (0, 'K', 1, 0, 's', ''), (0, 'K', 2, 0, 'u', ''), (1, 'K', 2, 0, 'u', ''), (3, 'K', 2, 0, 'u', ''), (2, 'K', 3, 0, 'a', ''),
  (0, 'R', 2, 1, '', 'user'), (1, 'R', 2, 1, '', 'user'), (3, 'R', 2, 1, '', 'user'), (2, 'R', 3, 1, '', 'assistant')),
step(conv_id, i, s, best) as (
  select distinct conv_id, cast(0 as bigint), 0, {{'cost': 0, 'audit': '', 'lines': ''}} from conversations
  union all
  select p.conv_id, p.i + 1, w.t, min({{
    'cost': p.best.cost + q.c + w.c + case when w.letter <> 'D' and k.fault = 'truncated' then 5 else 0 end,
    'audit': p.best.audit || q.a || w.letter,
    'lines': p.best.lines || q.line || case w.letter when 'D' then '' when 'K' then chr(10) || k.role || ':' || k.text else chr(10) || w.as_role || ':' || k.text end}})
  from step p join pre q on q.f = p.s join k on k.conv_id is not distinct from p.conv_id and k.i = p.i + 1
    join ways w on w.s = q.s and (w.letter = 'D' or (k.fault not in ('blank', 'duplicate') and (w.letter = 'R' or w.x = k.x)))
  group by p.conv_id, p.i, w.t),
size as (
  select conv_id, count(*) as n, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where next_x is not null and x || next_x not in ('su', 'ua', 'au')) as illegal,
    coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps
  from k group by conv_id),
every as (select distinct conv_id from conversations),
last as (
  select e.conv_id, min({{'cost': s.best.cost + case s.s when 1 then 10 when 2 then 5 else 0 end, 'audit': s.best.audit || case s.s when 1 then 'II' when 2 then 'I' else '' end,
    'lines': s.best.lines || case s.s when 1 then chr(10) || 'user:' || chr(10) || 'assistant:' when 2 then chr(10) || 'assistant:' else '' end}}) as best
  from every e left join size z on z.conv_id is not distinct from e.conv_id
    join step s on s.conv_id is not distinct from e.conv_id and s.i = coalesce(z.n, 0)
  group by e.conv_id)
select l.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, cast(best.cost as bigint) as cost, best.audit as audit, sha256(best.lines[2:]) as repaired_sha256
from last l left join size z on z.conv_id is not distinct from l.conv_id"""


def op13_substring_dedup() -> str:
    return """
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (
  select r, doc_id, i, array_to_string(w[i:i + 49], ' ') as s
  from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
low as (select s, min(doc_id) as first from win group by s),
hit as (select r, i from win join low using (s) where first < doc_id),
gone as (select r, list(distinct j) as js from (select r, unnest(range(i, i + 50)) as j from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(cast(len(js) as bigint), 0) as n_removed,
  sha256(array_to_string(case when js is null then w
    else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(js, k)), lambda k: w[k]) end, ' ')) as kept_sha256
from d left join gone using (r)"""


def all_oracles() -> dict[str, str]:
    found: dict[str, Callable[[], str]] = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return {name: f() for name, f in found.items()}
