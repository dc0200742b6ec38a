"""DuckDB SQL of the operators that SQL can express."""

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {_WORDS} as w from DOCS where doc_id is not null),
s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.shingle = y.shingle and x.doc_id < y.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
l as (select a, b from e union select b, a from e),
r as (select doc_id, doc_id as root from w union select l.b, r.root from r join l on l.a = r.doc_id and r.root < l.b)
select doc_id, min(root) as class_id from r group by doc_id
"""

NEAREST_VECTORS = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, rank, vec_id, score from (
  select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 20
"""

URL_VERDICTS = r"""
with u as (select page_id, coalesce(url, '') as url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select *, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (select page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
r as (select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
  case PATTERNS end as pattern from p)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when pattern is not null then 'block' else 'allow' end as verdict, pattern from r
"""

WARC_ROUND_TRIP = """
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest from p),
h as (select *, max(page_id) over (partition by payload_digest) as head from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < head then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < head then head end as refers_to, true as intact from h
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i::int, 1))::bigint)"
    return f"xor(list_reduce({codes}, lambda c, b: {bits}, 4294967295::bigint), 4294967295::bigint)"


def _encoded(value: str) -> str:
    return f"case when {value} is null then '-' else strlen(({value})::varchar) || ':' || ({value})::varchar end"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_UP = "sha256(case when w.idx % 2 = 1 then s.d else '' end || w.acc || case when w.idx % 2 = 0 then coalesce(s.d, '') else '' end)"

MERKLE_MANIFEST = f"""
with recursive leaf as (
  select doc_id, lang, {_leaf('n_chars')} as leaf,
    case when n_chars is not null and {_crc32('doc_id::varchar')} % 7 = 0 then {_leaf('n_chars + 1')} else {_leaf('n_chars')} end as start from documents),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as size from leaf),
lv as (
  select 0 as k, lang, idx, size, leaf as d from placed
  union all
  select k + 1, lang, idx // 2, (size + 1) // 2, sha256(string_agg(d, '' order by idx)) from lv where size > 1 group by k, lang, idx // 2, size),
sub as (
  select lang, d, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as size from lv where size = 1),
tp as (
  select 0 as k, idx, size, d from sub
  union all
  select k + 1, idx // 2, (size + 1) // 2, sha256(string_agg(d, '' order by idx)) from tp where size > 1 group by k, idx // 2, size),
walk as (
  select doc_id, leaf, lang, 0 as k, idx, size, '' as proof, start as acc from placed
  union all
  select w.doc_id, w.leaf, w.lang, w.k + 1, w.idx // 2, (w.size + 1) // 2, w.proof || coalesce(s.d, ''), {_UP}
  from walk w left join lv s on s.k = w.k and s.lang is not distinct from w.lang and s.idx = xor(w.idx, 1) where w.size > 1),
high as (
  select w.doc_id, w.leaf, sub.d as subroot, 0 as k, sub.idx, sub.size, w.proof, w.acc from walk w join sub on sub.lang is not distinct from w.lang where w.size = 1
  union all
  select w.doc_id, w.leaf, w.subroot, w.k + 1, w.idx // 2, (w.size + 1) // 2, w.proof || coalesce(s.d, ''), {_UP}
  from high w left join tp s on s.k = w.k and s.idx = xor(w.idx, 1) where w.size > 1)
select h.doc_id, h.leaf, h.subroot, r.d as root, sha256(h.proof) as proof_sha256, h.acc as folded_root, h.acc = r.d as verified
from high h join (select d from tp where size = 1) r on h.size = 1
"""

CONVERSATION_TRIE = rf"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''),
      md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k
  from conversations where conv_id is not null),
c as (select conv_id, {_crc32('conv_id::varchar')} % 4 as h from (select distinct conv_id from t)),
r as (
  select c.conv_id, 0 as src, t.k, t.role, t.text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.k <= c.h
  union all
  select c.conv_id, 1, t.k, t.role, t.text from c join t on t.conv_id = c.conv_id and t.k > c.h),
s as (
  select conv_id, row_number() over (partition by conv_id order by src, k) as d, md5(strlen(role) || ':' || role || text) as id,
    len(regexp_extract_all(text, '[^ 	-]+')) as words from r),
p as (
  select conv_id, d, string_agg(id, '') over (partition by conv_id order by d) as key, words from s
  union all select conv_id, 0, '', 0 from c),
m as (select *, max(d) over (partition by conv_id) = d as last from p),
n as (
  select key, d, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256 from m group by key, d),
kids as (select substr(key, 1, length(key) - 32) as key, count(*) as n_children from n where d > 0 group by 1),
full_n as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (key)),
under as (select distinct a.key as top, b.key from p a join p b on a.conv_id = b.conv_id and b.d >= a.d),
sums as (
  select top, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * words)::bigint as saved_tokens from under join full_n using (key) group by top)
select f.conv_id, f.d as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, sums.n_leaves, sums.saved_tokens, f.ends_sha256
from full_n f join sums on sums.top = f.key left join n up on f.d > 0 and up.key = substr(f.key, 1, length(f.key) - 32)
"""
