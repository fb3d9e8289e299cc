"""DuckDB SQL for the queries that SQL can express."""

from farglass.llm.mixing import SEED
from farglass.llm.secret_scan import BASE, EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS, VARIETY

_SOLID = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_DRAW = f"(('0x' || substr(md5('{SEED}:' || name), 1, 8))::bigint / 4294967296.0)"

MIX = rf"""
with sizes as (select doc_id, coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, ''))) as name, source, len(regexp_extract_all(coalesce(text, ''), '{_SOLID}'))::bigint as size from documents),
sources as (
  select source, sum(size)::bigint as source_size, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w
  from sizes group by source),
caps as (select *, source_size * 2.0::double as cap from sources),
levels as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over low, 0.0)) / (sum(w) over () - coalesce(sum(w) over low, 0.0)) as level
  from caps window low as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
tops as (select *, max(case when cap > level * w then level end) over () as top from levels),
targets as (select source, source_size, coalesce(least(cap, w * top), cap) as target from tops),
rates as (select *, coalesce(least(target / nullif(source_size, 0), 2.0::double), 0.0::double) as rate from targets)
select d.doc_id, d.size, r.source_size, r.target, (d.size * (floor(r.rate) + case when {_DRAW} < r.rate - floor(r.rate) then 1 else 0 end))::bigint as taken
from sizes d join rates r on d.source is not distinct from r.source
"""

WARC = """
with rows as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as sha from pages),
kept as (select *, max(page_id) over (partition by sha) as keeper from rows)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4),
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, g * 5 + 1, 5))::bigint) // (1 << (15 - 5 * b))::bigint) % 32 + 1)::int, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id = keeper then null else keeper end as refers_to
from kept
"""

DECONTAMINATE = rf"""
with items as (select item_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from benchmark),
wins as (
  select distinct item_id, k, array_to_string(w[s + 1 : s + k], ' ') as win
  from (select item_id, w, least(13, len(w)) as k, unnest(range(0, greatest(len(w) - 13, 0) + 1)) as s from items where len(w) > 0)),
docs as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
grams as (
  select doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') as win
  from (select doc_id, w, k, unnest(range(0, len(w) - k + 1)) as s from docs, (select distinct k from wins) where len(w) >= k)),
found as (select doc_id, item_id, s, grams.k from grams join wins using (k, win)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from found) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from found) group by doc_id),
counts as materialized (select term, count(*) as n from (select unnest(w) as term from docs) group by term),
parts as (select win, ww, unnest(ww) as term, generate_subscripts(ww, 1) - 1 as off from (select distinct win, string_split(win, ' ') as ww from wins where k = 13)),
ranked as (select parts.*, coalesce(n, 0) as n, row_number() over (partition by win order by coalesce(n, 0), off) as r from parts left join counts using (term)),
probe as materialized (select a.win, a.ww, a.term as t1, a.off as o1, b.term as t2, b.off as o2 from ranked a join ranked b using (win) where a.r = 1 and b.r = 2 and a.n > 0),
firsts as materialized (select doc_id, term, p from (select doc_id, unnest(w) as term, generate_subscripts(w, 1) - 1 as p from docs) where term in (select t1 from probe)),
near as (
  select doc_id, count(*) as n_near from firsts join probe on term = t1 and p >= o1 join docs using (doc_id)
  where list_contains(w[greatest(p - o1 + o2 - 3, 0) + 1 : p - o1 + o2 + 4], t2) and w[p - o1 + 1 : p - o1 + 13] <> ww
    and len(list_intersect(list_distinct(ww), w[greatest(p - o1 - 3, 0) + 1 : least(greatest(p - o1 - 3, 0) + 19, p + 16)])) >= 0.8 * len(list_distinct(ww))
  group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near, 0)::bigint as n_near
from docs left join words using (doc_id) left join named using (doc_id) left join near using (doc_id)
"""

_CRC32 = """xor(4294967295::bigint, list_reduce(range(1, len(conv_id::varchar) + 1), lambda crc, i:
    list_reduce(range(0, 8), lambda c, b: case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end, xor(crc, ascii(substr(conv_id::varchar, i::int, 1))::bigint)), 4294967295::bigint))"""

TRIE = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, strlen(coalesce(text, ''))::bigint as b, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as t
  from conversations where conv_id is not null),
own as (
  select conv_id, list(t order by turn nulls first, role, t) as ts, list(b order by turn nulls first, role, t) as bs, {_CRC32} % 9 as h
  from turns group by conv_id),
spliced as (
  select o.conv_id, list_concat(coalesce(s.ts[1 : o.h], []), o.ts[o.h + 1 :]) as ts, list_concat(coalesce(s.bs[1 : o.h], []), o.bs[o.h + 1 :]) as bs
  from own o left join own s on s.conv_id = o.conv_id - o.conv_id % 5),
members as (
  select conv_id, d, ts[1 : d] as p, d = len(ts) as ends, coalesce(bs[d], 0) as b
  from (select *, unnest(range(0, len(ts) + 1)) as d from spliced)),
nodes as (
  select p, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(b) as b, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ends
  from members group by p),
family as (select p[1 : len(p) - 1] as p, count(*) as n_children from nodes where len(p) > 0 group by 1),
counted as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join family using (p)),
sums as (
  select p[1 : k] as p, sum((n_children = 0)::int)::bigint as n_leaves, sum((n_convs - 1) * b)::bigint as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as k from counted) group by 1)
select c.conv_id, c.depth, up.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, sha256(c.ends) as ends_sha256
from counted c join sums s using (p) left join nodes up on c.depth > 0 and up.p = c.p[1 : c.depth - 1]
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = rf"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') as w from documents),
sums as (select count(*) filter (len(w) > 0)::bigint as n_docs, sum(len(w))::bigint as n_terms from docs),
asked as (select i, item_id, unnest(list_distinct(w)) as term from (select row_number() over () as i, item_id, regexp_extract_all({_LOWER}, '{_TERM}') as w from benchmark)),
postings as (
  select r, term, count(*)::bigint as tf from (select r, unnest(w) as term from docs) where term in (select term from asked) group by r, term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from postings, sums group by term, n_docs),
scores as (
  select i, item_id, r, doc_id, sum(weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(docs.w) * n_docs) // n_terms))))::bigint as score
  from asked join postings using (term) join weights using (term) join docs using (r), sums group by i, item_id, r, doc_id),
ranked as (select *, row_number() over (partition by i order by score desc, doc_id nulls last)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""



def _matches(no: int, kind: str, pattern: str, group: int) -> str:
    """Matches of one kind; a match's start is the length of what stands between and in the matches before."""
    q = pattern.replace("'", "''")
    return f"""select r, {no} as k, '{kind}' as kind, regexp_extract(m, '{q}', {group}) as value, len(m) as n,
      sum(len(gap) + len(m)) over (partition by r order by i)::bigint - len(m) as s
    from (select r, unnest(regexp_extract_all(text, '{q}')) as m, unnest(string_split_regex(text, '{q}')) as gap, generate_subscripts(string_split_regex(text, '{q}'), 1) as i from docs) where m is not null"""


def _added(no: int) -> str:
    """Spans of an added kind that meet none found before."""
    test = "and regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[0-9]')" if list(KINDS)[no] == "mixed" else ""
    return f"k{no} as (select * from k{no - 1} union all select * from good g where k = {no} {test} and not exists (select 1 from k{no - 1} o where o.r = g.r and o.s < g.s + g.n and g.s < o.s + o.n))"


_LEAST = "case kind " + " ".join(f"when '{kind}' then {least}" for kind, (_, _, least) in KINDS.items()) + " end"
_VARIED = "case kind " + " ".join(f"when '{kind}' then {n}" for kind, n in VARIETY.items()) + " end"

SECRETS = f"""
with docs as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
hits as ({" union all ".join(_matches(no, kind, pattern, group) for no, (kind, (pattern, group, _)) in enumerate(KINDS.items()))}),
good as materialized (select * from hits where len(value) >= {_LEAST}),
k{len(BASE) - 1} as (select * from good where k < {len(BASE)}),
{", ".join(_added(no) for no in range(len(BASE), len(KINDS)))},
found as (select k{len(KINDS) - 1}.*, doc_id, source, len(list_distinct(string_split(value, ''))) >= {_VARIED} as varied from k{len(KINDS) - 1} join docs using (r)),
owners as (
  select value, count(distinct coalesce('=' || source, '')) >= {EXAMPLE_OWNERS} or count(distinct coalesce('=' || doc_id, '')) >= {EXAMPLE_REPOSITORIES} as example
  from found group by value),
spans as (select *, varied and not example as live, kind || ':' || s || ':' || (s + n) as name from found join owners using (value) where k < {len(BASE)} or (varied and not example)),
named as (
  select r, {", ".join(f"count(*) filter (kind = '{kind}') as n_{kind}" for kind in BASE)}, string_agg(name, ',' order by s, k) filter (k < {len(BASE)}) as base,
    string_agg(name, ',' order by s, k) as spans, count(*) filter (live) as n_live, count(*) filter (example) as n_examples
  from spans group by r)
select doc_id, {", ".join(f"coalesce(n_{kind}, 0)::bigint as n_{kind}" for kind in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0)::bigint as n_live, coalesce(n_examples, 0)::bigint as n_examples
from docs left join named using (r)
"""

ORACLES = {"op2_mix_sources": MIX, "op5_warc": WARC, "op7_decontaminate": DECONTAMINATE, "op11_prefix_trie": TRIE, "op12_secret_scan": SECRETS, "op13_ranked_search": SEARCH}
