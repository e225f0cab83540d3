"""DuckDB SQL for the queries that SQL can express."""

_REPEATS = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
e as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
f as (select g, min(doc_id) as m from e group by g),
c as (select distinct doc_id, unnest(range(i, i + 13)) as j from e join f using (g) where m < doc_id),
x as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from w),
k as (select doc_id, string_agg(word, ' ' order by j) as kept from x anti join c using (doc_id, j) group by doc_id),
n as (select doc_id, count(*) as gone from c group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (doc_id) left join n using (doc_id)
"""

_HITS = r"""
with a as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
t as (select distinct item_id, n, array_to_string(ws[i : i + n - 1], ' ') as g from (select item_id, ws, least(len(ws), 13) as n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as i from b where len(ws) > 0)),
d as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as g from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from a, (select distinct n from t) where len(ws) >= n)),
h as (select doc_id, i, n, item_id from d join t using (n, g)),
c as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as j from h) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from h) group by doc_id)
select a.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from a left join c using (doc_id) left join s using (doc_id)
"""

_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '###', '\#\#\#'), '</turn>', '<\/turn>')"

_CHAT = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
cast(sum(14 + length(replace({_ESCAPED.format("role")}, ':', '\c')) + length({_ESCAPED.format("text")})) as bigint) as formatted_chars
from t group by conv_id
"""

ORACLES: dict[str, str] = {"op3_debruijn_substrings": _REPEATS, "op8_chat_formatting": _CHAT, "op10_winnowing": _HITS}
