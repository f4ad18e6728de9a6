"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, quality, secrets
from .contamination import NEAR, SLACK

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"[x for x in regexp_split_to_array({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']"

_WHITE = "[x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> '']"
_WHITE_LOW = f"[x for x in regexp_split_to_array({_LOW}, '[\\x20\\x09-\\x0D]+') if x <> '']"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    listed = ", ".join(map(quoted, quality.LISTED))
    without = lambda regex: f"length(t) - length(regexp_replace(t, '{regex}', '', 'g'))"
    white, symbols = "[\\x20\\x09-\\x0D]", "[#*$%&|<>]"
    js = lambda p, q: f"sqrt(greatest(0, list_sum([(case when x[1] > 0 then x[1] * log2(x[1] / ((x[1] + x[2]) / 2)) else 0 end) + (case when x[2] > 0 then x[2] * log2(x[2] / ((x[1] + x[2]) / 2)) else 0 end) for x in [[{p}[i], {q}[i]] for i in range(1, len({p}) + 1)]]) / 2))"
    mean = lambda name, source: f"""{name} as (select lang, (select list(v order by i) from (select i, avg(pc[i]) as v from {source} y, range(1, 8) r(i) where y.lang = x.lang group by i)) as qc,
  (select list(v order by i) from (select i, avg(pw[i]) as v from {source} y, range(1, {len(quality.LISTED) + 2}) r(i) where y.lang = x.lang group by i)) as qw from (select distinct lang from {source}) x)"""  # noqa: E731
    return f"""
with d as (select doc_id, lang, coalesce(text, '') as t, {_WHITE} as w from documents),
c as (select *, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as filled, translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lw,
  {without('[a-z]')} as n_lower, {without('[A-Z]')} as n_upper, {without('[0-9]')} as n_digit, {without(white)} as n_white, {without(symbols)} as n_symbols, {without('[^\\x00-\\x7F]')} as n_other from d),
tri as (select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, g) as k from tri) where k > 1) group by doc_id),
m as (select doc_id, lang, len(w) as n_words, length(t) - n_white as word_chars, n_symbols, len(filled) - len(list_distinct(filled)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  [n_lower, n_upper, n_digit, n_white, n_symbols, length(t) - n_other - n_lower - n_upper - n_digit - n_white - n_symbols, n_other] as cc, string_split(lw, ' ') as lws, w from c left join rep using (doc_id)),
f as (select *, [len([x for x in lws if x = k]) for k in [{listed}]] as cw, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
p as (select * exclude (cc, cw, lws, w), [x / greatest(1, list_sum(cc)) for x in cc] as pc, [x / greatest(1, n_words) for x in list_append(cw, n_words - list_sum(cw))] as pw from f),
fit as (select * from p where not base_failed and n_words >= {quality.MIN_WORDS} and lang in ({', '.join(map(quoted, quality.COMMON_WORDS))})),
{mean('first', 'fit')},
own as (select fit.*, ceil({js('pc', 'qc')} * {quality.STEPS}) as sc, ceil({js('pw', 'qw')} * {quality.STEPS}) as sw from fit join first using (lang)),
edge_c as (select lang, min(sc) as ec from (select lang, sc, count(*) over (partition by lang order by sc) as seen, count(*) over (partition by lang) as total from own) where seen >= {1 - quality.TRIM} * total group by lang),
edge_w as (select lang, min(sw) as ew from (select lang, sw, count(*) over (partition by lang order by sw) as seen, count(*) over (partition by lang) as total from own) where seen >= {1 - quality.TRIM} * total group by lang),
near as (select own.* from own join edge_c using (lang) join edge_w using (lang) where sc <= ec and sw <= ew),
{mean('trimmed', 'near')},
refs as (select f.lang, coalesce(t.qc, f.qc) as qc, coalesce(t.qw, f.qw) as qw from first f left join trimmed t using (lang)),
lim as (select *, sqrt((log2(2 / (1 + qw[-1])) + (case when qw[-1] > 0 then qw[-1] * log2(2 * qw[-1] / (1 + qw[-1])) else 0 end) + 1 - qw[-1]) / 2) as bare from refs),
dist as (select p.doc_id, lim.lang as language_seen, {js('pc', 'qc')} as c, {js('pw', 'qw')} as x, case when bare > 0.1 then {quality.WORD_SHARE} * bare else 1 end as most from p, lim),
best as (select * from (select *, row_number() over (partition by doc_id order by c + x, language_seen) as k from dist) where k = 1)
select p.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(n_words >= {quality.MIN_WORDS} and (lang is null or lang in (select lang from refs)) and (c > {quality.MAX_CHAR_DISTANCE} or x > most), false) as kept,
  language_seen, round(c, 6) as char_distance, round(x, 6) as word_distance
from p left join best using (doc_id)"""


def licenses_sql() -> str:
    templates = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in sorted(licenses.TEMPLATES.items()))
    phrases = ", ".join(f"({quoted(p)}, {quoted(x)})" for p, x in licenses.PHRASES.items())
    k = licenses.K
    return f"""
with d as (select doc_id, {_WORDS} as w from documents),
phrase(p, label) as (values {phrases}),
place as (select doc_id, i - 1 as x, label from (select doc_id, w, p, label, string_split(p, ' ') as q, unnest(range(1, len(w) + 1)) as i from d, phrase where contains(array_to_string(w, ' '), p)) where w[i:i + len(q) - 1] = q),
base as (select doc_id, count(*) as n_base, min(x) as first_word, max(x) as last_word, string_agg(distinct label, ',' order by label) as base_labels from place group by doc_id),
temp(label, text) as (values {templates}),
tw as (select label, {_WORDS} as w from temp),
tg as (select label, len(w) - {k - 1} as n_grams, i - 1 as y, array_to_string(w[i:i + {k - 1}], ' ') as g from (select label, w, unnest(range(1, len(w) - {k - 2})) as i from tw)),
dg as (select doc_id, i - 1 as pos, array_to_string(w[i:i + {k - 1}], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {k - 2})) as i from d where len(w) >= {k})),
hit as (select doc_id, label, n_grams, pos, y, pos - y as diagonal from dg join tg using (g)),
new as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, label order by diagonal) <= {licenses.SLACK} then 0 else 1 end as new from (select distinct doc_id, label, diagonal from hit)),
run as (select *, sum(new) over (partition by doc_id, label order by diagonal) as run from new),
span as (select doc_id, label, n_grams, run, max(pos) + {k} - min(pos) as width, count(distinct y) as votes from hit join run using (doc_id, label, diagonal) group by all),
good as (select doc_id, label, votes / n_grams as coverage from span where votes / n_grams >= {licenses.COVERAGE} and width <= 2 * (n_grams + {k})),
found as (select doc_id, max(coverage) as coverage from good group by doc_id),
named as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from good union all select doc_id, label from place) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  greatest(coalesce(coverage, 0), case when n_base > 0 then 0.5e0 else 0 end) as score
from d left join base using (doc_id) left join found using (doc_id) left join named using (doc_id)"""


def secrets_sql() -> str:
    def rule(n: int, r: secrets.Rule) -> str:
        regex = quoted(r.regex)
        return f"""select doc_id, {n} as kind, {quoted(r.kind)} as name, unnest([struct_pack(
  s := list_sum([length(x) for x in gaps[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0), n := length(m[i]), part := length(parts[i])) for i in range(1, len(m) + 1)]) as x, {r.least} as least
  from (select doc_id, regexp_extract_all(t, {regex}) as m, regexp_extract_all(t, {regex}, {r.group}) as parts, string_split_regex(t, {regex}) as gaps from d where regexp_matches(t, {regex}))"""

    rules = " union all ".join(rule(n, r) for n, r in enumerate(secrets.RULES))
    kinds = ", ".join(f"coalesce(count(*) filter (where kind = {n}), 0) as n_{r.kind}" for n, r in enumerate(secrets.BASE_RULES))
    said = "name || ':' || s || ':' || (s + n)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as ({rules}),
span as (select doc_id, kind, name, x.s as s, x.n as n from found where x.part >= least),
told as (select doc_id, {kinds}, sha256(coalesce(string_agg({said}, ',' order by s, kind) filter (where kind < {len(secrets.BASE_RULES)}), '')) as base_sha256, string_agg({said}, ',' order by s, kind, n) as spans from span group by doc_id)
select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in secrets.BASE_RULES)}, coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans from d left join told using (doc_id)"""


#: The table of CRC-32 by its polynomial, and the checksum of a string's UTF-8 bytes with it.
_CRC_TABLE = "(select [list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) for i in range(256)] as crc_table)"


def crc32_sql(text: str) -> str:
    octets = f"[('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::bigint for i in range(octet_length(encode({text})))]"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


def prefix_trie_sql() -> str:
    words = "len([x for x in regexp_split_to_array(node[-1].x, '[\\x20\\x09-\\x0D]+') if x <> ''])"
    return f"""
with t as (select conv_id, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} as said, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 20 as base, {crc32_sql('conv_id::varchar')} % 4 as h from (select distinct conv_id from t), {_CRC_TABLE}),
b as (select c.conv_id, k, said from c join t on t.conv_id = c.base and k <= h union all select c.conv_id, k, said from c join t using (conv_id) where k > h),
p as (select conv_id, coalesce(list(said order by k) filter (where k is not null), []) as p from c left join b using (conv_id) group by conv_id),
m as (select conv_id, p[1:d] as node, d, len(p) = d as ends from (select conv_id, p, unnest(range(len(p) + 1)) as d from p)),
n as (select node, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from m group by node, d),
kids as (select node[1:d - 1] as node, count(*) as n_children from n where d > 0 group by 1),
w as (select n.*, coalesce(n_children, 0) as n_children, case when d > 0 then (n_convs - 1) * {words} else 0 end as saved from n left join kids using (node)),
s as (select node[1:e] as node, sum(saved)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from (select *, unnest(range(d + 1)) as e from w) group by 1)
select w.conv_id, w.d as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
from w join s using (node) left join n u on u.node = w.node[1:w.d - 1] and w.d > 0"""


def spelling_sql() -> str:
    run = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with r as (select doc_id, {run} as w, count(*) as k from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents) group by 1, 2),
h as (select w, k, {crc32_sql("coalesce(doc_id::varchar, '') || ':' || w")} as h from r, {_CRC_TABLE}),
v as (select word, sum(k)::bigint as n from (select case when h % 97 = 0 then substring(w, 1, (h % length(w))::int) || substring(w, (h % length(w))::int + 2) else w end as word, k from h) group by 1 having n >= 3 and length(word) >= 5),
i as (select word, n, unnest(range(length(word))) as i from v),
wild as (select word, n, substring(word, 1, i::int) || '*' || substring(word, i::int + 2) as g from i),
cut as (select distinct word, n, substring(word, 1, i::int) || substring(word, i::int + 2) as g from i),
link as (select a.word, b.word as near, b.n as k from wild a join wild b on a.g = b.g and a.word <> b.word
  union select cut.word, v.word, v.n from cut join v on v.word = g union select v.word, cut.word, cut.n from cut join v on v.word = g),
best as (select word, count(*) as n_near, first(near order by k desc, near) as near, max(k) as k from link group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when k >= 2 * v.n then near end as form, case when k >= 2 * v.n then k end as form_n from v left join best using (word)),
up as (with recursive s as (select word, word as at from f union all select s.word, f.form from s join f on f.word = s.at where f.form is not null)
  select s.word, s.at as root from s join f on f.word = s.at where f.form is null)
select f.*, root from f join up using (word)"""


def line_dedup_sql() -> str:
    key = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with l as (select doc_id, line, i, {key} as key from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
c as (select key, max(doc_id) as last from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
g as (select doc_id, line, i, coalesce(doc_id <> last, false) as gone from l left join c using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from g group by doc_id"""


SQL = {
    "op1_url_filter": """
with parsed as (
  select page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages),
rules(rule, rh, rp, verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
select page_id, host, path,
  (select rule from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rule) desc limit 1) as rule,
  coalesce((select verdict from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) order by length(rule) desc limit 1), 'allow') as verdict
from parsed""",
    "op8_chat_format": """
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, replace(replace(role, '\\', '\\b'), '|', '\\p') as r, replace(replace(text, '\\', '\\b'), '<|', '<\\p') as t from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(2 + length(r) + 2 + length(t) + 7)::bigint as formatted_chars
from marked group by conv_id""",
    "op9_contamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
win as (
  select row_number() over () as k, item, terms, len(terms) as n from (
    select distinct item, case when len(w) < 10 then w else w[i:i + 9] end as terms
    from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from b where len(w) > 0))),
placed as (select doc_id, p - 1 as pos, w[p] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
counts as (select term, count(*) as c from placed group by term),
spread as (select k, i - 1 as off, terms[i] as term from (select k, terms, unnest(range(1, n + 1)) as i from win)),
ranked as (select k, off, term, row_number() over (partition by k order by c, off) as r from spread join counts using (term)),
cand as (select distinct doc_id, r.k, pos - off as start from ranked r join placed using (term) where r = 1),
nexts as (select c.doc_id, c.k, c.start, max(case when abs(p.pos - (c.start + r.off)) <= {SLACK} then 1 else 0 end) as met, count(r.k) as asked
  from cand c left join ranked r on r.k = c.k and r.r in (2, 3) left join placed p on p.doc_id = c.doc_id and p.term = r.term and p.pos between c.start + r.off - {SLACK} and c.start + r.off + {SLACK} group by all),
held as (select doc_id, k, item, start, n, terms, w from nexts join win using (k) join d using (doc_id) where met = 1 or asked = 0),
seen as (select doc_id, item, start, n, start >= 0 and w[start + 1:start + n] = terms as exact,
  len(list_intersect(list_distinct(terms), w[greatest(0, start - {SLACK}) + 1:start + n + {SLACK}])) >= {NEAR} * len(list_distinct(terms)) as near from held),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(start, start + n)) as p from seen where exact) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from seen where exact) group by doc_id),
nearly as (select doc_id, string_agg(item, ',' order by item) as near_items from (select distinct doc_id, item from seen where near) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(near_items, '') as near_items
from d left join words using (doc_id) left join named using (doc_id) left join nearly using (doc_id)""",
    "op4_near_duplicates": f"""
with recursive d as (select doc_id, {_WHITE_LOW} as w from documents),
s as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i + 3], ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
edge as (select a, b from link union select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from d union select reach.doc_id, edge.b from reach join edge on edge.a = reach.r)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from (select doc_id, min(r) as component_id from reach group by doc_id) left join n using (doc_id)""",
    "op3_quality": quality_sql(),
    "op7_licenses": licenses_sql(),
    "op10_secrets": secrets_sql(),
    "op11_prefix_trie": prefix_trie_sql(),
    "op12_spelling_variants": spelling_sql(),
    "op13_line_dedup": line_dedup_sql(),
}
