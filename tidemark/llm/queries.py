"""The registered queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from .decontamination import op6_decontamination
from .fingerprints import op3_fingerprints
from .jaccard import op4_jaccard
from .language import op9_language
from .packing import op1_packing
from .periodicity import op12_periodicity
from .personal import op13_pii
from .quality import op8_quality
from .scoring import op2_scoring
from .secrets import op5_secrets
from .sharding import op7_sharding
from .suffixes import op10_suffixes
from .whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_scoring, op3_fingerprints, op4_jaccard, op5_secrets, op6_decontamination, op7_sharding, op8_quality, op9_language, op10_suffixes, op11_whitening, op12_periodicity, op13_pii)
}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SETS = f"""w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_distinct([array_to_string(words[i : i + 4], ' ') for i in range(1, len(words) - 3)]) end as shingles from w)"""
_BENCH = f"""d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select item_id::varchar as item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
p as (select distinct item_id, least(len(words), 10) as n, hash(array_to_string(words[i : i + least(len(words), 10) - 1], ' ')) as h from b, range(1, greatest(len(words) - 9, 1) + 1) as r(i) where len(words) > 0),
k as (select doc_id, n, i, hash(array_to_string(words[i : i + n - 1], ' ')) as h from d, (select distinct n from p), range(1, len(words) - n + 2) as r(i)),
m as (select doc_id, i, k.n, item_id from k join p on p.h = k.h and p.n = k.n),
t as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from m) group by 1),
e as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from m) group by 1)"""
#: SQL of what it can express, for unique ids: links and components, benchmark windows, repeated passages. The others give no SQL and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": f"""with recursive {_SETS}, x as materialized (select doc_id, hash(unnest(shingles)) as h from s), z as (select doc_id, len(shingles) as n from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from x as a join x as b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from c join z as u on u.doc_id = a join z as v on v.doc_id = b where 100 * common >= 75 * (u.n + v.n - common)),
g as materialized (select a, b from l union all select b, a from l),
r as (select a as node, a as reached from g union select r.node, g.b from r join g on g.a = r.reached)
select z.doc_id, z.n as n_shingles, coalesce(least(min(reached), z.doc_id), z.doc_id) as component_id from z left join r on r.node = z.doc_id group by z.doc_id, z.n""",
    "op6_decontamination": f"""with {_BENCH} select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join t using (doc_id) left join e using (doc_id)""",
    "op10_suffixes": """with d as (select doc_id, hex(coalesce(text, '')) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
w as (select doc_id, i, hash(substr(x, 2 * i + 1, 100)) as h from d, range(0, n - 49) as r(i)),
m as (select h, min(doc_id) as least from w group by 1),
s as (select doc_id, i, coalesce(i - lag(i) over (partition by doc_id order by i) > 50, true)::int as new from w join m using (h) where least < doc_id),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as span from s),
p as (select doc_id, span, min(i) as a, max(i) + 50 as b from g group by 1, 2),
k as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as lo, a as hi from p union all select doc_id, max(b), null from p group by 1),
t as (select k.doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (coalesce(hi, n) - lo)), '' order by lo) as kept from k join d using (doc_id) group by 1),
c as (select doc_id, sum(b - a) as removed, count(*) as spans from p group by 1)
select d.doc_id, n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256 from d left join c using (doc_id) left join t using (doc_id)""",
}
