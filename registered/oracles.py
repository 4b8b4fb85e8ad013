"""Plain SQL for every registered query, for DuckDB over the same tables."""

from __future__ import annotations

from deskline import constants as C
from registered import queries as Q
from registered import views as V

_VIEWS = {
    "tickets": V.TICKETS,
    "corrections": V.CORRECTIONS,
    "feedback_rows": V.FEEDBACK,
    "intake": V.INTAKE,
    "vectors": V.VECTORS,
    "requests": V.REQUESTS,
    "user_requests": V.USER_REQUESTS,
    "memo": V.MEMO,
    "answers": V.ANSWERS,
}


def _with(names: str, body: str, more: str = "", recursive: bool = False) -> str:
    parts = [f"{n} as ({V.for_duckdb(_VIEWS[n])})" for n in names.split()]
    if more:
        parts.append(more)
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CATEGORY_LIST = ", ".join(_text(c) for c in C.CATEGORIES)

# ---- shared pieces ---------------------------------------------------------------

_FULL_TEXT = "case when coalesce(title, '') <> '' then title || '. ' || description else description end"
_STORED_TITLE = "case when coalesce(title, '') <> '' then title else substr(description, 1, 100) end"
_PROBLEM = """case when length(title) > 255 then 'title too long' when description is null then 'description missing'
  when length(description) < 10 then 'description too short'
  when length(description) > 5000 then 'description too long' end"""


def _key(text: str) -> str:
    return f"'classify:' || substr(sha256(trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))), 1, 32)"


def _keyword_ctes(source: str, text: str, rules: dict) -> str:
    """kw: id, category, confidence, key_indicators (a text) by the given words."""
    names = list(rules)
    found = ",\n".join(
        "list_filter(["
        + ", ".join(f"case when contains(low, {_text(w)}) then {_text(w)} end" for w in rules[n])
        + f"], lambda x: x is not null) as f{i}"
        for i, n in enumerate(names)
    )
    counts = [f"len(f{i})" for i in range(len(names))]
    best = f"greatest({', '.join(counts)})"
    total = f"({' + '.join(counts)})"
    pick = " ".join(f"when {c} = {best} then {_text(n)}" for c, n in zip(counts, names))
    words = " ".join(f"when {c} = {best} then f{i}" for i, c in enumerate(counts))
    return f"""kw_found as (select id, {found} from (select id, lower({text}) as low from {source})),
kw as (select id, case {pick} end as category,
  case when {total} > 0 then round(least(0.4::double + {best}::double / {total}::double * 0.4::double, 0.7::double), 2)
    else 0.3::double end as confidence,
  array_to_string(list_slice(case {words} end, 1, 3), ',') as key_indicators from kw_found)"""


def _pct1(part: str, whole: str) -> str:
    return f"case when {whole} > 0 then round_even({part}::double / {whole}::double * 100.0::double, 1) else 0.0::double end"


_MISSES = """miss(key, ts) as (
  select key, min(ts) from requests group by key
  union all
  select m.key, min(r.ts) from miss m join requests r on r.key = m.key and r.ts >= m.ts + interval '7' day
  group by m.key, m.ts)"""
_FLAGGED = f"""{_MISSES},
flagged as (select r.*, m.key is null as hit from requests r left join miss m on m.key = r.key and m.ts = r.ts)"""

_VALID = f"""valid as (select * from corrections where corrected_category in ({_CATEGORY_LIST})
  and (feedback is null or length(feedback) <= 1000))"""
_LATEST = f"""{_VALID},
latest as (select * from (select *, row_number() over (partition by ticket_id order by corrected_at desc, correction_id desc) as rn
  from valid) where rn = 1)"""
_APPLIED = """select t.id, t.title, t.description, t.predicted_category,
  coalesce(l.corrected_category, t.actual_category) as actual_category, t.confidence_score, t.reasoning,
  case when l.ticket_id is not null then 'corrected' else t.status end as status, t.created_at,
  case when l.ticket_id is not null then l.corrected_at else t.updated_at end as updated_at
from tickets t left join latest l on l.ticket_id = t.id"""

_SIM = "list_cosine_similarity({a}::double[], {b}::double[])"


def _nearest(k: int, on: str, id_type: str = "bigint") -> str:
    return _with(
        "vectors",
        f"""select query_id, rank, id, category, least(greatest(sim, 0.0::double), 1.0::double) as similarity from (
  select *, row_number() over (partition by query_id order by sim desc, id) as rank from (
    select cast(q.id as {id_type}) as query_id, cast(c.id as {id_type}) as id, c.category,
      round({_SIM.format(a='q.embedding', b='c.embedding')}, 9) as sim
    from vectors q join vectors c on {on})) where rank <= {k}""",
    )


_LISTED = """cast(id as varchar) as id, title, description, predicted_category, actual_category, confidence_score,
  reasoning, status, created_at, updated_at"""
_FILTER = f"status = '{Q.STATUS}' and predicted_category = '{Q.CATEGORY}'"

_PERIOD = """select cast(date_trunc('{p}', created_at) as date) as period_start, count(*) as tickets,
  count(actual_category) as reviewed, count(*) filter (where predicted_category = actual_category) as correct
from tickets group by 1"""

# ---- classification ------------------------------------------------------------------

_READ = f"""read as (select ticket_id, json_type(j) = 'OBJECT' and (json_type(j, '$.confidence') is null or conf is not null) as usable,
    coalesce(j->>'$.category', '') as cat,
    case when json_type(j, '$.confidence') is null then 0.5::double else least(greatest(conf, 0.0::double), 1.0::double) end as confidence,
    j->>'$.reasoning' as reasoning,
    coalesce(array_to_string(cast(json_extract(j, '$.key_indicators') as varchar[]), ','), '') as key_indicators
  from (select *, try_cast(j->>'$.confidence' as double) as conf
    from (select ticket_id, case when json_valid(raw) then raw::json end as j from answers))),
repaired as (select ticket_id, coalesce(usable, false) as usable, confidence, reasoning, key_indicators,
    case when cat in ({_CATEGORY_LIST}) then cat
      {' '.join(f"when contains(lower(cat), {_text(c.lower())}) then {_text(c)}" for c in C.CATEGORIES)}
      else 'General Question' end as category from read)"""

_JUDGED = f"""asked as (select i.id, i.created_at, i.title, i.description, {_FULL_TEXT} as full_text, e.embedding
  from intake i left join embeddings e on e.vec_id = i.id where {_PROBLEM} is null),
{_keyword_ctes('asked', 'full_text', C.KEYWORDS)},
{_READ},
judged as (select a.*, {_key('a.full_text')} as memo_key, coalesce(r.usable, false) as usable,
    case when r.usable then r.category else k.category end as category,
    case when r.usable then r.confidence else k.confidence end as confidence,
    case when r.usable then r.reasoning else {_text(C.KEYWORD_REASONING)} end as reasoning,
    case when r.usable then r.key_indicators else k.key_indicators end as key_indicators
  from asked a join kw k on k.id = a.id left join repaired r on r.ticket_id = a.id)"""

_REMEMBERED = f"""{_JUDGED},
wrote(key, ts) as (
  select memo_key, min(created_at) from judged where usable group by memo_key
  union all
  select w.key, min(j.created_at) from wrote w join judged j on j.memo_key = w.key and j.usable
    and j.created_at >= w.ts + interval '7' day group by w.key, w.ts),
linked as (select j.*, s.id as source_id, o.id is not null as writes from judged j
  left join wrote w on w.key = j.memo_key and w.ts < j.created_at and j.created_at < w.ts + interval '7' day
  left join judged s on s.memo_key = w.key and s.created_at = w.ts
  left join wrote own on own.key = j.memo_key and own.ts = j.created_at
  left join judged o on o.id = j.id and own.key is not null),
decided as (select l.id, l.created_at, l.title, l.description, l.embedding, l.memo_key, l.usable, l.writes, l.source_id,
    l.source_id is not null as cached,
    case when l.source_id is null then l.category else s.category end as category,
    case when l.source_id is null then l.confidence else s.confidence end as confidence,
    case when l.source_id is null then l.reasoning else s.reasoning end as reasoning,
    case when l.source_id is null then l.key_indicators else s.key_indicators end as key_indicators
  from linked l left join judged s on s.id = l.source_id)"""

# The batch's own tickets and the given vectors, as they stand in the store.
_STORED = f"""{_REMEMBERED},
stored as (select cast(id as varchar) as id, category, embedding, created_at from decided
  union all select 'v' || cast(id as varchar), category, embedding, created_at from vectors)"""

_PREVIEWED = f"""{_JUDGED},
decided as (select *, false as writes, cast(null as bigint) as source_id, false as cached from judged)"""


def _outcome(decided: str, corpus: str) -> str:
    return f"""{decided},
pairs as (select q.id as query_id, c.id, c.category, round({_SIM.format(a='q.embedding', b='c.embedding')}, 9) as sim,
    epoch_us(c.created_at) as stored_at
  from decided q join {corpus} c on c.created_at < q.created_at
  where q.embedding is not null and c.embedding is not null and q.usable and not q.cached),
refs as (select query_id, string_agg(cast(id as varchar) || ':' || coalesce(category, 'None') || ':'
    || cast(round_even(least(greatest(sim, 0.0::double), 1.0::double), 2) as varchar), ';' order by rank) as refs
  from (select *, row_number() over (partition by query_id order by sim desc, stored_at, id) as rank from pairs)
  where rank <= 3 group by query_id),
outcome as (select d.*, coalesce(case when d.cached then s.refs when d.usable then o.refs end, '') as similar_tickets,
    not d.cached and d.usable and o.refs is not null as rag_used, not d.cached and not d.usable as fallback
  from decided d left join refs o on o.query_id = d.id left join refs s on s.query_id = d.source_id)"""


_OUTCOME_COLUMNS = """select id, memo_key, category, confidence, reasoning, key_indicators, similar_tickets,
  cached, rag_used, fallback from outcome"""


def _classified(decided: str, corpus: str, body: str) -> str:
    return _with("intake vectors answers", body, _outcome(decided, corpus), recursive=True)


_CONTEXT = f"""near as (select query_id, category, document, sim, row_number() over (partition by query_id order by sim desc, stored_at, id) as rank
  from (select q.id as query_id, c.id, c.category, c.document, epoch_us(c.created_at) as stored_at,
      round({_SIM.format(a='q.embedding', b='c.embedding')}, 9) as sim
    from (select i.id, i.created_at, v.embedding from intake i join vectors v on v.id = i.id) q
    join vectors c on c.created_at < q.created_at)),
lines as (select query_id, string_agg('- [' || coalesce(category, 'None') || '] "' || substr(coalesce(document, 'None'), 1, 80)
    || '..." (similarity: ' || cast(cast(round_even(least(greatest(sim, 0.0::double), 1.0::double) * 100.0::double, 0) as bigint) as varchar)
    || '%)', chr(10) order by rank) as lines from near where rank <= 3 group by query_id)"""


def all_oracles() -> dict[str, str]:
    kw_columns = "select id, category, confidence, key_indicators, 'classified' as status from kw"
    texts = f"texts as (select *, {_FULL_TEXT} as full_text from intake)"
    return {
        "accuracy_metrics": _with(
            "tickets",
            """select count(actual_category) as total_reviewed,
  count(*) filter (where predicted_category = actual_category) as correct_predictions,
  case when count(actual_category) > 0
    then round(count(*) filter (where predicted_category = actual_category) * 100.0::double / count(actual_category), 2)
    else 0.0::double end as accuracy_percentage from tickets""",
        ),
        "category_distribution": _with(
            "tickets",
            """select predicted_category as category, count(*) as ticket_count,
  round(count(*) * 100.0::double / (select count(*) from tickets where predicted_category is not null), 2) as percentage
from tickets where predicted_category is not null group by predicted_category order by ticket_count desc""",
        ),
        "category_counts": _with(
            "tickets",
            """select predicted_category as category, count(*) as ticket_count from tickets
where predicted_category is not null group by 1""",
        ),
        "api_distribution": _with(
            "tickets",
            f"""select predicted_category as category, count(*) as count,
  {_pct1('count(*)', '(select count(*) from tickets)')} as percentage
from tickets where predicted_category is not null group by predicted_category""",
        ),
        "overview": _with(
            "tickets requests vectors",
            f"""select count(*) as total_tickets, count(actual_category) as total_reviewed,
  count(*) filter (where predicted_category = actual_category) as correct_predictions,
  {_pct1('count(*) filter (where predicted_category = actual_category)', 'count(actual_category)')} as accuracy_percentage,
  (select string_agg(c || '=' || cast(n as varchar) || '=' || printf('%.1f', p), ';' order by c) from (
    select predicted_category as c, count(*) as n, {_pct1('count(*)', '(select count(*) from tickets)')} as p
    from tickets where predicted_category is not null group by 1)) as categories,
  round_even(coalesce(avg(confidence_score), 0.0::double) * 100.0::double, 1) as avg_confidence,
  (select {_pct1('count(*) filter (where hit)', 'count(*)')} from flagged) as cache_hit_rate,
  (select count(*) from vectors) as vector_store_count from tickets""",
            _FLAGGED,
            recursive=True,
        ),
        "overview_kept": _with(
            "tickets requests vectors",
            f"""select count(*) as total_tickets, count(actual_category) as total_reviewed,
  count(*) filter (where predicted_category = actual_category) as correct_predictions,
  {_pct1('count(*) filter (where predicted_category = actual_category)', 'count(actual_category)')} as accuracy_percentage,
  (select string_agg(c || '=' || cast(n as varchar) || '=' || printf('%.1f', p), ';' order by c) from (
    select predicted_category as c, count(*) as n, {_pct1('count(*)', '(select count(*) from tickets)')} as p
    from tickets where predicted_category is not null group by 1)) as categories,
  round_even(coalesce(avg(confidence_score), 0.0::double) * 100.0::double, 1) as avg_confidence,
  (select {_pct1('count(*) filter (where hit)', 'count(*)')} from flagged) as cache_hit_rate,
  (select count(*) from vectors) as vector_store_count from tickets""",
            _FLAGGED,
            recursive=True,
        ),
        "accuracy_by_week": _with(
            "tickets",
            f"select *, {_pct1('correct', 'reviewed')} as accuracy from ({_PERIOD.format(p='week')})",
        ),
        "accuracy_by_day": _with(
            "tickets", f"select *, {_pct1('correct', 'reviewed')} as accuracy from ({_PERIOD.format(p='day')})"
        ),
        "accuracy_trend": _with(
            "tickets",
            """select *, case when change > 0 then 'up' when change < 0 then 'down' else 'stable' end as trend from (
  select *, round_even(current - previous, 1) as change from (
    select period_start, accuracy as current, lag(accuracy) over (order by period_start) as previous from weeks))""",
            f"weeks as (select *, {_pct1('correct', 'reviewed')} as accuracy from ({_PERIOD.format(p='week')}))",
        ),
        "feedback_confusion": _with(
            "feedback_rows", "select old_label, new_label, count(*) as corrections from feedback_rows group by 1, 2"
        ),
        "feedback_matrix": _with(
            "feedback_rows",
            "select old_label, "
            + ", ".join(
                f"count(*) filter (where new_label = {_text(c)}) as {c.lower().replace(' ', '_')}" for c in C.CATEGORIES
            )
            + " from feedback_rows group by 1",
        ),
        "vector_stats": _with(
            "vectors",
            """select coalesce(category, 'unknown') as category, count(*) as count,
  (select count(*) from vectors) as total from vectors group by 1""",
        ),
        "list_page": _with(
            "tickets",
            f"""select {_LISTED} from (select * from tickets where {_FILTER}
  order by created_at desc, cast(id as varchar) limit {Q.LIMIT} offset {(Q.PAGE - 1) * Q.LIMIT})""",
        ),
        "list_page_deep": _with(
            "tickets",
            f"""select {_LISTED} from (select *, row_number() over (order by created_at desc, cast(id as varchar)) as n, count(*) over () as total from tickets)
where n > total // 2 // {Q.DEEP_LIMIT} * {Q.DEEP_LIMIT} and n <= total // 2 // {Q.DEEP_LIMIT} * {Q.DEEP_LIMIT} + {Q.DEEP_LIMIT}""",
        ),
        "list_page_after": _with(
            "tickets",
            f"""select {_LISTED} from (select * from tickets where status = '{Q.STATUS}'
    and (created_at < timestamp '{Q.ALIVE_AT}' or (created_at = timestamp '{Q.ALIVE_AT}' and cast(id as varchar) > '0'))
  order by created_at desc, cast(id as varchar) limit {Q.LIMIT})""",
        ),
        "page_totals": _with(
            "tickets",
            f"""select count(*) as total, {Q.PAGE}::bigint as page, {Q.LIMIT}::bigint as limit,
  greatest(1, cast(ceil(count(*) / {Q.LIMIT}.0) as bigint))::bigint as pages from tickets where {_FILTER}""",
        ),
        "recent_feed": _with(
            "tickets",
            f"select {_LISTED} from (select * from tickets order by created_at desc, cast(id as varchar) limit 5)",
        ),
        "ticket_by_id": _with("tickets", f"select {_LISTED} from tickets where id = {Q.LOOKUP_ID}"),
        "intake_valid": _with("intake", f"select * from intake where {_PROBLEM} is null"),
        "intake_rejects": _with(
            "intake", f"select id, {_PROBLEM} as problem from intake where {_PROBLEM} is not null"
        ),
        "intake_texts": _with(
            "intake",
            f"""select id, {_STORED_TITLE} as stored_title, {_FULL_TEXT} as full_text,
  {_STORED_TITLE} || '. ' || description as vector_text from intake""",
        ),
        "memo_keys": _with("intake", f"select id, {_key(_FULL_TEXT)} as memo_key from intake"),
        "support_keywords": _with(
            "intake", kw_columns, texts + ",\n" + _keyword_ctes("texts", "full_text", C.KEYWORDS)
        ),
        "keyword_classify": _with(
            "intake", kw_columns, texts + ",\n" + _keyword_ctes("texts", "full_text", V.LANGUAGE_RULES)
        ),
        "similar_topk": _nearest(5, "c.id <> q.id"),
        "similar_topk_filtered": _nearest(5, "c.id <> q.id and c.category = 'label_3'"),
        "similar_stored": _nearest(5, "c.id <> q.id", "varchar"),
        "similar_asof": _nearest(3, "c.id < q.id"),
        "neighbour_vote": _with(
            "vectors",
            f"""select query_id, category, votes, round(coalesce(weight / nullif(whole, 0), 0.0::double), 2) as confidence from (
  select *, row_number() over (partition by query_id order by round(weight, 9) desc, category) as place, sum(weight) over (partition by query_id) as whole
  from (select query_id, category, sum(similarity) as weight, count(*) as votes from (
    select query_id, category, least(greatest(sim, 0.0::double), 1.0::double) as similarity,
      row_number() over (partition by query_id order by sim desc, stored, id) as rank
    from (select q.id as query_id, c.id, c.id as stored, c.category, round({_SIM.format(a='q.embedding', b='c.embedding')}, 9) as sim
      from vectors q join vectors c on c.id < q.id)) where rank <= 3 and category is not null group by 1, 2)) where place = 1""",
        ),
        "prompt_context": _with(
            "intake vectors",
            f"""select id, context, {_text(C.PROMPT_HEAD + C.CATEGORY_DEFINITIONS + C.PROMPT_NEIGHBOURS)} || context
  || {_text(C.PROMPT_TITLE)} || case when coalesce(title, '') <> '' then title else {_text(C.NO_TITLE_TEXT)} end
  || {_text(C.PROMPT_DESCRIPTION)} || description || {_text(C.PROMPT_TAIL)} as prompt
from (select i.id, i.title, i.description, coalesce(l.lines, {_text(C.NO_NEIGHBOURS_TEXT)}) as context
  from intake i left join lines l on l.query_id = i.id)""",
            _CONTEXT,
        ),
        "vector_upsert": _with(
            "vectors",
            """select cast(id as varchar) as id, document, category, origin, embedding[1]::double as first_value from (
  select *, row_number() over (partition by id order by batch desc, turn desc) as rn from (
    select id, document, category, 'none' as origin, embedding, 0 as batch, 0 as turn from vectors
    union all
    select vec_id + 250, 'revised ' || cast(vec_id as varchar) || '.' || cast(turn as varchar), case when label > 4 then 'revised' end,
      'import', embedding, case when turn = 1 then 2 else 1 end, turn
    from embeddings, (select unnest([0, 1, 2]) as turn)
    where turn = 0 or (turn = 2 and label % 2 = 1) or (turn = 1 and label < 3))) where rn = 1""",
        ),
        "vector_delete": _with(
            "vectors",
            """select cast(id as varchar) as id, case when again then 'again' else document end as document, category, 'none' as origin, embedding[1]::double as first_value
from (select *, id in (select doc_id from labels where quality = 1 and toxic = 0) as again from vectors)
where again or id not in (select doc_id from labels)""",
        ),
        "category_examples": _with(
            "vectors",
            """select category, id, document from (select *, row_number() over (partition by category order by id) as rn
  from vectors where category is not null) where rn <= 3""",
        ),
        "category_examples_one": _with(
            "vectors",
            "select category, id, document from (select * from vectors where category = 'label_3' order by id limit 3)",
        ),
        "corrections_applied": _with("tickets corrections", _APPLIED, _LATEST),
        "feedback_log": _with(
            "tickets corrections",
            """select v.correction_id as id, v.ticket_id, t.predicted_category as old_label, v.corrected_category as new_label,
  v.feedback, v.corrected_at as created_at from valid v join tickets t on t.id = v.ticket_id""",
            _VALID,
        ),
        "corrections_refused": _with(
            "tickets corrections",
            f"""select correction_id, ticket_id, corrected_category, problem from (
  select *, case when corrected_category not in ({_CATEGORY_LIST}) then 'unknown category'
    when length(feedback) > 1000 then 'feedback too long'
    when ticket_id not in (select id from tickets) then 'ticket not found' end as problem from corrections)
where problem is not null""",
        ),
        "cascade_delete": _with(
            "tickets feedback_rows", "select * from feedback_rows where ticket_id in (select id from tickets)"
        ),
        "feedback_orphans": _with(
            "tickets feedback_rows", "select * from feedback_rows where ticket_id not in (select id from tickets)"
        ),
        "memo_hits": _with("requests", "select request_id, key, ts, hit from flagged", _FLAGGED, recursive=True),
        "memo_lookup": _with(
            "user_requests memo",
            """select request_id, key, ts, hit, case when hit then written_at end as written_at, case when hit then label end as label
from (select r.*, m.written_at, m.label, coalesce(r.ts < m.written_at + interval '7' day, false) as hit
  from user_requests r asof left join memo m on r.key = m.key and r.ts >= m.written_at)""",
        ),
        "memo_invalidate": _with(
            "memo",
            """select key, written_at, label from memo where key not in (
  select cast(user_id as varchar) from events where event_type = 'error' and value > 150)""",
        ),
        "memo_text": _with(
            "memo", "select key, written_at, cast(to_json({'label': label}) as varchar) as result from memo"
        ),
        "memo_live": _with(
            "memo",
            f"""select key, written_at, label from (
  select *, row_number() over (partition by key order by written_at desc) as rn from memo
  where written_at <= timestamp '{Q.ALIVE_AT}') where rn = 1 and timestamp '{Q.ALIVE_AT}' < written_at + interval '7' day""",
        ),
        "memo_hit_rate": _with(
            "requests",
            f"""select count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses,
  {_pct1('count(*) filter (where hit)', 'count(*)')} as hit_rate,
  (select count(*) from (select key, max(ts) as ts from miss where ts <= timestamp '{Q.ALIVE_AT}' group by key)
   where timestamp '{Q.ALIVE_AT}' < ts + interval '7' day) as keys from flagged""",
            _FLAGGED,
            recursive=True,
        ),
        "answers_repaired": _with(
            "answers",
            """select ticket_id, usable, case when usable then category end as category,
  case when usable then confidence end as confidence, case when usable then reasoning end as reasoning,
  case when usable then key_indicators end as key_indicators from repaired""",
            _READ,
        ),
        "classify_end_to_end": _classified(_REMEMBERED, "vectors", _OUTCOME_COLUMNS),
        "classify_preview": _classified(_PREVIEWED, "vectors", _OUTCOME_COLUMNS),
        "stored_tickets": _classified(
            _STORED,
            "stored",
            f"""select cast(id as varchar) as id, {_STORED_TITLE} as title, description, category as predicted_category,
  cast(null as varchar) as actual_category, confidence as confidence_score, reasoning, 'classified' as status,
  created_at, created_at as updated_at from outcome""",
        ),
        "stored_vectors": _classified(
            _STORED,
            "stored",
            f"""select cast(id as varchar) as id, {_STORED_TITLE} || '. ' || description as document, category from outcome
union all select 'v' || cast(id as varchar), document, category from vectors""",
        ),
        "stored_memo": _classified(
            _STORED,
            "stored",
            """select memo_key as key, created_at as written_at, category, confidence, similar_tickets
from outcome where writes""",
        ),
        "stored_refused": _with(
            "intake",
            f"""select 'ticket' as kind, cast(id as varchar) as id, problem, title from (select *, {_PROBLEM} as problem from intake)
where problem is not null""",
        ),
        "ticket_records": _classified(
            _STORED,
            "stored",
            f"""select cast(id as varchar) as id, {_STORED_TITLE} as title, 'classified' as status, category, cached,
  cast(case when similar_tickets = '' then 0 else length(similar_tickets) - length(replace(similar_tickets, ';', '')) + 1 end as bigint) as n_similar
from outcome""",
        ),
        "stream_intake": _with(
            "intake",
            f"""select t.id, {_key('t.full_text')} as memo_key, k.category, k.confidence, 'classified' as status
from texts t join kw k on k.id = t.id""",
            f"texts as (select *, {_FULL_TEXT} as full_text from intake where {_PROBLEM} is null),\n"
            + _keyword_ctes("texts", "full_text", V.LANGUAGE_RULES),
        ),
        "stream_corrections": _with("tickets corrections", f"select * replace (cast(id as varchar) as id) from ({_APPLIED})", _LATEST),
        "stream_refused": _with(
            "tickets corrections",
            f"""select 'correction' as kind, correction_id, cast(ticket_id as varchar) as ticket_id, problem from (
  select *, case when corrected_category not in ({_CATEGORY_LIST}) then 'unknown category'
    when length(feedback) > 1000 then 'feedback too long'
    when ticket_id not in (select id from tickets) then 'ticket not found' end as problem from corrections)
where problem is not null""",
        ),
        "stream_memo": _with("requests", "select request_id, key, ts, hit from flagged", _FLAGGED, recursive=True),
        "stream_dedup": _with(
            "requests",
            """select key, period_start, min(ts) as ts
from (select key, ts, time_bucket(interval '7 days', ts, timestamp '1970-01-01') as period_start from requests) group by all""",
        ),
        "stream_window": _with("tickets", _PERIOD.format(p="week")),
        "stream_totals": _with(
            "tickets",
            """select predicted_category as category, count(*) as tickets, round(avg(confidence_score), 9) as mean_confidence
from tickets group by 1""",
        ),
    }
