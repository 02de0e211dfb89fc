"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .line_dedup import DIGEST_SQL
from .merkle import PARAGRAPH, PASSAGE, SECTION, SHORT

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array({_FOLD}, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), shingles as (
  select distinct doc_id, unnest(case len(w) when 0 then []::varchar[] when 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words
), sizes as (
  select doc_id, count(*) as n from shingles group by 1
), links as (
  select x.doc_id as a, y.doc_id as b from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id join sizes m on m.doc_id = x.doc_id join sizes k on k.doc_id = y.doc_id
  group by 1, 2 having 100 * count(*) >= 80 * (max(m.n) + max(k.n) - count(*))
), ends as (
  select a, b from links union all select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join ends e on r.other = e.a
), least as (
  select doc_id, min(other) as component_id from reach group by 1
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d left join sizes using (doc_id) join least using (doc_id)
"""

CONTAMINATION = rf"""
with split as (
  select *, list_filter(regexp_split_to_array({_FOLD}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from (select doc_id, null as item_id, text from documents union all select null, item_id, text from benchmark)
), windows as (
  select distinct item_id, least(len(w), 13) as k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) as s from split where item_id is not null and len(w) > 0
), places as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) as p, w from split, (select distinct k from windows) where doc_id is not null and len(w) >= k
), hits as (
  select doc_id, p, l.k, item_id from (select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') as s from places) l join windows o on l.k = o.k and l.s = o.s
), runs as (
  select doc_id, min(q) as a, max(q) as b, count(*) as n from (
    select *, q - row_number() over (partition by doc_id order by q) as g from (select distinct doc_id, unnest(range(p, p + k)) as q from hits)
  ) group by doc_id, g
), gaps as (
  select doc_id, w, regexp_extract_all(text, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') as g, cast(regexp_matches(text, '^[\x00-\x2F\x3A-\x60\x7B-\x7F]') as int) as lead
  from (select s.doc_id, w, {_FOLD} as text from split s semi join runs r on s.doc_id = r.doc_id)
), ends as (
  select doc_id, n, list_sum(list_transform(w[1 : a - 1] || g[1 : a - 1 + lead], lambda x: length(x))) as x, list_sum(list_transform(w[1 : b] || g[1 : b - 1 + lead], lambda x: length(x))) as y from runs join gaps using (doc_id)
), covered as (
  select doc_id, sum(n) as n_hit, string_agg(cast(coalesce(x, 0) as bigint) || ':' || cast(y as bigint), ',' order by y) as spans from ends group by 1
), items as (
  select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct doc_id, item_id from hits) group by 1
)
select s.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(spans, '') as spans
from split s left join covered c on c.doc_id = s.doc_id left join items i on i.doc_id = s.doc_id where s.doc_id is not null
"""

FINGERPRINTS = rf"""
with texts as (
  select doc_id, coalesce(text, '') as text from documents
), nexts as (
  select doc_id, text, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc rows between unbounded preceding and unbounded following)) as next,
    coalesce(lead(doc_id) over (order by doc_id desc), max(doc_id) over ()) as next_id from texts
), edits as (
  select *, substring(text, 1, length(text) - length(text) // 3) || substring(next, 1, length(text) // 3) as edited from nexts
), trees as (
  select doc_id, kind, list_transform(regexp_extract_all(x, '{SECTION}', 0), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}', 0), lambda p: list_transform(regexp_extract_all(p, '{PASSAGE}', 0), lambda l: md5(l)))) as t
  from (select doc_id, 'own' as kind, text as x from edits union all select doc_id, 'edited', edited from edits)
), prints as (
  select doc_id, kind, sha256(array_to_string(list_transform(t, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))), '')) || ':'
    || array_to_string(list_transform(t, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda h: h[1:{SHORT}]), '.')), ',')), ';') as f,
    list_distinct(list_transform(flatten(flatten(t)), lambda h: h[1:{SHORT}])) as leaves, t from trees
)
select e.doc_id, length(e.text) as n_chars, sha256(edited) as edited_sha256, o.f as fingerprint, d.f as edited_fingerprint,
  case when o.f = d.f then 1.0 else coalesce(2.0 * len(list_intersect(o.leaves, d.leaves)) / nullif(len(o.leaves) + len(d.leaves), 0), 0.0) end::double as near_edited,
  case when o.f = x.f then 1.0 else coalesce(2.0 * len(list_intersect(o.leaves, x.leaves)) / nullif(len(o.leaves) + len(x.leaves), 0), 0.0) end::double as near_next,
  array_to_string(flatten(list_transform(range(1, greatest(len(o.t), len(d.t)) + 1), lambda i: case when o.t[i] is not distinct from d.t[i] then []::varchar[] else list_filter(
    list_transform(range(1, greatest(coalesce(len(o.t[i]), 0), coalesce(len(d.t[i]), 0)) + 1), lambda j: case when o.t[i][j] is distinct from d.t[i][j] then (i - 1) || ':' || (j - 1) end),
    lambda x: x is not null) end)), ',') as edited_places
from edits e join prints o on o.doc_id = e.doc_id and o.kind = 'own' join prints d on d.doc_id = e.doc_id and d.kind = 'edited' join prints x on x.doc_id = e.next_id and x.kind = 'own'
"""

ORACLES = {"op1_minhash": NEAR_DUPLICATES, "op4_line_dedup": DIGEST_SQL, "op8_decontaminate": CONTAMINATION, "op10_merkle": FINGERPRINTS}
