"""DuckDB twins of the queries that SQL can express, built from the same tables of fixed values."""

from __future__ import annotations

from stallwise.llm import chat, licenses, quality, warc

_WS = r"[ \x09-\x0D]+"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chars(x: str) -> str:
    return f"length(x.text) - length(translate(x.text, {_quoted(x)}, ''))"


def quality_sql() -> str:
    stops = ", ".join(_quoted(x) for x in dict.fromkeys(quality.STOP_WORDS))
    broken = []
    for r in quality.RULES:
        outside = " or ".join(f"{r.metric} {op} {v}" for op, v in (("<", r.low), (">", r.high)) if v is not None)
        broken.append(f"(({outside}) and n_words >= {r.min_words})")
    return f"""
with x as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda w: w <> '') as w from documents),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\x09-\\x0D]')) as l from x),
windows as (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from x)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windows) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2)) as t(k) group by doc_id),
m as (
  select x.doc_id, len(w)::bigint as n_words, length(replace(array_to_string(w, ''), ' ', ''))::bigint as word_chars,
    ({_chars(quality.SYMBOLS)})::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda v: lower(v) in ({stops}))) as stops, {_chars('!')} as bangs, {_chars('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} as uppers
  from x join lines using (doc_id) left join covered using (doc_id)),
r as (
  select *, case when n_words > 0 then n_repeat_words / n_words else 0 end as repeat_ratio, case when n_words > 0 then n_symbols / n_words else 0 end as symbol_ratio,
    case when n_words > 0 then bangs / n_words else 0 end as exclamation_ratio, case when n_words > 0 then stops / n_words else 0 end as stop_word_ratio,
    case when n_words > 0 then word_chars / n_words else 0 end as mean_word_length, case when word_chars > 0 then uppers / word_chars else 0 end as upper_ratio,
    case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_ratio
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, not ({" or ".join(broken)}) as kept
from r"""


def licence_sql() -> str:
    plain = {licenses._plain(s): name for name, s in licenses.SENTENCES.items()}
    table = "map {" + ", ".join(f"{_quoted(s)}: {_quoted(n)}" for s, n in plain.items()) + "}"
    low, high = min(map(len, plain)), max(map(len, plain))
    cases = ", ".join(f"case when contains(line, {_quoted(chr(10) + chr(10).join(r.sentences) + chr(10))}) then {_quoted(r.licence)} end" for r in licenses.RULES)
    hidden = "hits"
    for longer, shorter in licenses.HIDES.items():
        hidden = f"case when list_contains({hidden}, {_quoted(longer)}) then list_filter({hidden}, lambda h: h <> {_quoted(shorter)}) else {hidden} end"
    return f"""
with parts as (select doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), lambda p: length(p) >= {low}) as p from documents),
plain as (select doc_id, list_filter(list_transform(p, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: length(s) between {low} and {high}) as p from parts),
ids as (select doc_id, list_filter(list_transform(p, lambda s: {table}[s]), lambda s: s is not null) as ids from plain),
lines as (select doc_id, ids, chr(10) || array_to_string(ids, chr(10)) || chr(10) as line from ids),
found as (select doc_id, ids, list_sort(list_distinct(list_filter([{cases}], lambda h: h is not null))) as hits from lines)
select doc_id, len(ids)::bigint as n_licence_sentences, coalesce(array_to_string(ids, ','), '') as sentence_ids, coalesce(array_to_string({hidden}, ','), '') as licences from found"""


def revisit_sql(lag: int) -> str:
    return f"""
with bare as (select page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') as b from pages),
parts as (
  select page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\\.', '') as host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '(/|/index\\.html|\\.html)$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '{warc.TRACKING}'))) as query
  from bare),
u as (select page_id, html, host || path || case when len(query) > 0 then '?' || array_to_string(query, '&') else '' end as canonical_url from parts),
b as (
  select q.page_id, q.canonical_url, md5(q.html) as tag, length(q.html) as n, q.page_id % 4 as kind, max(p.page_id) as base_page_id
  from u q left join u p on p.canonical_url = q.canonical_url and 2 * p.page_id < 2 * q.page_id + {lag} group by all),
j as (select b.*, p.html, md5(p.html) as base_tag, length(p.html) as base_n, p.page_id % 4 as base_kind from b left join u p on p.page_id = b.base_page_id),
o as (
  select *, case when base_page_id is null then 'missing'
    when kind < 2 and base_kind < 2 then case when tag = base_tag then 'resolved' else 'mismatch' end
    when kind in (1, 2) and base_kind <> 0 then case when n = base_n then 'resolved' else 'mismatch' end else 'unchecked' end as outcome,
    case when kind < 2 then 'etag=W/"' || tag || '"' end as own_tag, case when kind in (1, 2) then 'last-modified=length ' || n end as own_modified,
    case when base_kind < 2 then 'etag="' || base_tag || '"' end as old_tag, case when base_kind <> 0 then 'last-modified=length ' || base_n end as old_modified
  from j)
select page_id, canonical_url, base_page_id, outcome,
  case when outcome in ('resolved', 'unchecked') then concat_ws(';', 'content-type=text/html', 'date=later', coalesce(own_tag, old_tag), coalesce(own_modified, old_modified))
    else concat_ws(';', 'date=later', own_tag, own_modified, 'server=x') end as headers,
  case when outcome in ('resolved', 'unchecked') then base_n end as payload_chars, case when outcome in ('resolved', 'unchecked') then base_tag end as payload_md5
from o"""


JACCARD_SQL = """
with recursive x as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from x where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from both_ join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 85 * (p.n + q.n - k)),
reach as (select doc_id, doc_id as root from x union select l.b, r.root from reach r join links l on l.a = r.doc_id),
copies as (select doc_id, count(*) over (partition by w4) as n_class from (select doc_id, list_sort(list(s)) as w4 from s group by doc_id))
select x.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, coalesce(n_class, 1)::bigint as n_class
from x join (select doc_id, min(root) as component_id from reach group by doc_id) c using (doc_id) left join n using (doc_id) left join copies using (doc_id)"""


#: Phrases of 2 to 5 words with 100 or more occurrences in a language.
COLLOCATION_SQL = r"""
with p as (
  select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') as w from p),
g as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from w, generate_series(1, 5) as t(k) where len(w) >= k)),
total as (select lang, sum(len(w))::bigint as n from w group by lang),
f as (select lang, k, phrase, count(*)::bigint as f from g group by all having count(*) >= 100),
words as (select *, string_split(phrase, ' ') as w from f),
cuts as (
  select lang, k, phrase, f as a, cut, array_to_string(w[1 : cut], ' ') as head, array_to_string(w[cut + 1 :], ' ') as tail
  from words, generate_series(1, 4) as t(cut) where cut < k),
scored as (
  select c.lang, c.k, c.phrase, c.a, x.f as l, y.f as r, total.n, c.cut, ((1000::hugeint * c.a * total.n) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.head join f y on y.lang = c.lang and y.phrase = c.tail join total on total.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
around as (
  select lang, phrase, max(f) as f
  from (select lang, f, array_to_string(w[i : i + m - 1], ' ') as phrase from words, generate_series(2, 4) as s(m), generate_series(1, 4) as t(i) where m < k and i + m - 1 <= k)
  group by all),
kept as (select best.* from best left join around on around.lang = best.lang and around.phrase = best.phrase where around.f is null or 100 * around.f < 100 * best.a)
select * from (
  select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint as rank, phrase, a, l, r, n, score from kept)
where rank <= 2000
"""


def chat_sql(planted: list[tuple]) -> str:
    template = chat.Template()
    text = lambda c: f"regexp_replace({c}, '{_one(template)}', '\\1\\2\\4\\5\\\\\\3\\6', 'g')"
    around = " ".join(f"when role = {_quoted(name)} then {len(m.open + m.close)}" for name, m in template.roles.items())
    other = len(template.role.open + template.role.close + template.other.open + template.other.close)
    rows = ", ".join(f"({c}, {t}, {_quoted(role)}, {_quoted(x)})" for c, t, role, x in planted)
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all select * from (values {rows}) as p(conv_id, turn, role, text))),
e as (
  select *, length({text('text')}) + case {around} else {other} + length({text('role')}) end as chars,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as left_over
  from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  ({len(template.begin)} + sum(chars))::bigint as formatted_chars,
  bool_and(case role when 'system' then before is null when 'user' then before is null or before in ('system', 'assistant') when 'assistant' then before is not distinct from 'user' else false end
    and (left_over > 1 or role = 'assistant')) as valid
from e group by conv_id
"""


def _one(template: chat.Template) -> str:
    return "|".join(chat.mark_patterns(template))
