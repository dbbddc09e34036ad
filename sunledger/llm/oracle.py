"""SQL twins of the corpus queries that SQL can state over whole tables."""

from __future__ import annotations

from sunledger.llm import url_filters
from sunledger.llm.url_filters import URL_RULES

#: every query row against all other rows, by exact integer products
_TOPK = """
with quantised as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from quantised q join quantised c on q.vec_id <> c.vec_id
  where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r
  from scored
)
select query_id, r::int as rank, vec_id, score from ranked where r <= 20
"""

#: windows of ten words (or the whole of a shorter item) found by equality of joined words
_WINDOWS = r"""
with doc_words as (
  select row_number() over () as row_no, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item_words as (
  select coalesce(item_id::varchar, '') as item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), item_at as (
  select item_id, w, least(10, len(w)) as n, unnest(range(1, greatest(len(w) - 8, 2))) as i
  from item_words where len(w) > 0
), item_windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as body from item_at
), lengths as (
  select distinct n from item_windows
), doc_at as (
  select row_no, w, n, unnest(range(1, len(w) - n + 2)) as i
  from doc_words, lengths where len(w) >= n
), doc_windows as (
  select row_no, n, i, array_to_string(w[i:i + n - 1], ' ') as body from doc_at
), found as (
  select d.row_no, d.n, d.i, t.item_id from doc_windows d join item_windows t using (n, body)
), hit as (
  select row_no, count(distinct word) as n_hit from (
    select row_no, unnest(range(i, i + n)) as word
    from (select distinct row_no, n, i from found)) group by row_no
), items as (
  select row_no, count(distinct item_id) as n_items,
         string_agg(distinct item_id, ',' order by item_id) as ids from found group by row_no
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from doc_words left join hit using (row_no) left join items using (row_no)
"""

#: every window of 200 bytes by its digest; what is left is joined as hexadecimal digits
_REPEATS = """
with bytes as (
  select row_number() over () as row_no, doc_id, encode(coalesce(text, '')) as b
  from documents
), windows as (
  select row_no, i, md5_number(b[i + 1:i + 200]) as m
  from (select row_no, b, unnest(range(0, octet_length(b) - 199)) as i from bytes
        where octet_length(b) >= 200)
), often as (
  select m from windows group by m having count(*) > 1
), marked as (
  select row_no, i, lag(i) over (partition by row_no order by i) as before
  from windows semi join often using (m)
), stretches as (
  select row_no, i, sum(case when before is null or i > before + 200 then 1 else 0 end)
    over (partition by row_no order by i) as span from marked
), spans as (
  select row_no, span, min(i) as lo, max(i) + 200 as hi from stretches group by row_no, span
), gaps as (
  select row_no, lo, hi, coalesce(lag(hi) over (partition by row_no order by lo), 0) as kept_from
  from spans
), rest as (
  select g.row_no, count(*) as n_spans, sum(g.hi - g.lo) as n_removed, max(g.hi) as tail,
         string_agg(hex(t.b[g.kept_from + 1:g.lo]), '' order by g.lo) as kept
  from gaps g join bytes t using (row_no) group by g.row_no
)
select doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
       coalesce(n_spans, 0)::bigint as n_spans,
       sha256(case when n_spans is null then b
                   else unhex(kept || hex(b[tail + 1:])) end) as kept_sha256
from bytes left join rest using (row_no)
"""

#: crc32 of a decimal number: the table of the reversed polynomial, then its digits one by one
_CRC = """
  select list(list_reduce([i::ubigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, _: case
    when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) order by i) as t
  from range(256) r(i)
"""


def _crc(number: str) -> str:
    return (f"xor(4294967295::ubigint, list_reduce([4294967295::ubigint] || list_transform("
            f"string_split({number}::varchar, ''), lambda c: ascii(c)::ubigint), "
            f"lambda a, c: xor(a >> 8, t[(1 + (xor(a, c) & 255))::bigint])))")


def _url_terms() -> str:
    """The terms of a URL with their weights, each between other characters than letters and
    digits; host and path by pattern; the longest fitting rule."""
    words = url_filters.Vocabulary()
    terms = ", ".join(f"('{t}', {w})" for t, w in words.weights.items())
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)
    return f"""
with terms(term, weight) as (values {terms}),
rules(rule_host, rule_path, verdict) as (values {rules}),
urls as (
  select row_number() over () as row_no, page_id,
         coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')
           as low,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest
  from pages
), split as (
  select *, regexp_extract(rest, '^[^/?#]*') as host_raw from urls
), parts as (
  select row_no, page_id, low,
         translate(host_raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(host_raw) + 1), '^[^?#]*') as path
  from split
), fitting as (
  select row_no, rule_host || rule_path as rule, rules.verdict, row_number() over (
    partition by row_no order by length(rule_host || rule_path) desc, rules.verdict desc,
    rule_host || rule_path) as r
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host))
    and starts_with(path, rule_path)
), hits as (
  select row_no, term, weight, len(regexp_split_to_array(
    regexp_replace(low, '([^\\p{{L}}\\p{{N}}])', '\\1\\1', 'g'),
    '(^|[^\\p{{L}}\\p{{N}}])' || term || '([^\\p{{L}}\\p{{N}}]|$)')) - 1 as n
  from parts, terms where contains(low, term)
), found as (
  select row_no, sum(n) filter (weight >= {words.limit}) as n_strict,
         sum(n) filter (weight < {words.limit}) as n_soft, sum(weight) as weight,
         string_agg(term, ',' order by term) as terms
  from hits where n > 0 group by row_no
)
select page_id, host, path, fitting.rule as rule,
       coalesce(fitting.verdict, case when weight >= {words.limit} then 'block' else 'allow' end)
         as verdict,
       coalesce(n_strict, 0)::bigint as n_strict, coalesce(n_soft, 0)::bigint as n_soft,
       coalesce(weight, 0)::double as weight, coalesce(terms, '') as terms
from parts left join found using (row_no)
left join fitting on fitting.row_no = parts.row_no and fitting.r = 1
"""


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value} end"


def _leaf(n_chars: str) -> str:
    values = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(f'({_field(v)})' for v in values)})"


#: all nodes by level; a leaf's siblings are the neighbours of its ancestors
_MERKLE = f"""
with recursive crc_table as ({_CRC}),
hashed as (
  select doc_id, lang, {_leaf("n_chars")} as leaf,
         case when doc_id is not null and {_crc("doc_id")} % 7 = 0
              then {_leaf("(n_chars + 1)")} end as changed
  from documents, crc_table
), langs as (
  select lang, row_number() over (order by lang nulls first) - 1 as g
  from (select distinct lang from documents)
), leaves as (
  select row_number() over () as row_no, doc_id, leaf, changed, g,
         row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx,
         count(*) over (partition by g) as n
  from hashed join langs on hashed.lang is not distinct from langs.lang
), nodes(g, lvl, idx, n, digest) as (
  select g, 0, idx, n, leaf from leaves
  union all
  select g, lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' order by idx))
  from nodes where n > 1 group by g, lvl, idx // 2
), tops(lvl, idx, n, digest) as (
  select 0, g, (select count(*) from langs), digest from nodes where n = 1
  union all
  select lvl + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(digest, '' order by idx))
  from tops where n > 1 group by lvl, idx // 2
), heights as (
  select g, max(lvl) as height from nodes group by g
), steps as (
  select row_no, 0 as part, l.lvl, leaves.idx >> l.lvl as own, s.digest
  from leaves join heights using (g), lateral (select unnest(range(height)) as lvl) l
  left join nodes s on s.g = leaves.g and s.lvl = l.lvl and s.idx = xor(leaves.idx >> l.lvl, 1)
  union all
  select row_no, 1, l.lvl, leaves.g >> l.lvl, s.digest
  from leaves, (select unnest(range(coalesce(max(lvl), 0))) as lvl from tops) l
  left join tops s on s.lvl = l.lvl and s.idx = xor(leaves.g >> l.lvl, 1)
), paths as (
  select row_no, string_agg(coalesce(digest, ''), '' order by part, lvl) as siblings,
         list(case when digest is null then 'N' when own % 2 = 1 then 'L' || digest
                   else 'R' || digest end order by part, lvl) as path
  from steps group by row_no
), folded as (
  select leaves.*, coalesce(siblings, '') as siblings, list_reduce(
    [coalesce(changed, leaf)] || coalesce(path, []::varchar[]),
    lambda a, s: sha256(case s[1] when 'L' then s[2:] || a when 'R' then a || s[2:] else a end))
    as folded_root
  from leaves left join paths using (row_no)
)
select doc_id, leaf, r.digest as subroot, t.digest as root, sha256(siblings) as proof_sha256,
       folded_root, folded_root = t.digest as verified
from folded join nodes r on r.g = folded.g and r.n = 1, tops t where t.n = 1
"""

#: prefixes as texts of joined digests; a node's subtree are the prefixes that begin with it
_TRIE = f"""
with crc_table as ({_CRC}),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first,
           coalesce(role, ''), k) as pos, k, bytes
  from (select *, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '')
                         || coalesce(text, '')) as k, strlen(coalesce(text, '')) as bytes
        from conversations where conv_id is not null)
), convs as (
  select conv_id, conv_id - conv_id % 5 as family, ({_crc("conv_id")} % 9)::bigint as h
  from (select distinct conv_id from turns), crc_table
), parts as (
  select c.conv_id, 0 as part, t.pos, k, bytes
  from convs c join turns t on t.conv_id = c.family and t.pos <= h
  union all
  select c.conv_id, 1, t.pos, k, bytes from convs c join turns t using (conv_id) where t.pos > h
), numbered as (
  select conv_id, row_number() over w as depth, string_agg(k, '') over w as prefix, bytes
  from parts window w as (partition by conv_id order by part, pos)
), paths as (
  select conv_id, depth, prefix, bytes from numbered
  union all select conv_id, 0, '', 0 from convs
), lasting as (
  select *, max(depth) over (partition by conv_id) as total from paths
), nodes as (
  select prefix, min(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs,
         (count(*) - 1) * max(bytes) as saved, bool_and(depth = total) as childless,
         string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = total) as ends
  from lasting group by prefix
), sums as (
  select left(prefix, 64 * d) as prefix, count(*) filter (childless) as n_leaves,
         sum(saved) as saved_tokens, count(*) filter (depth = d + 1) as n_children
  from (select *, unnest(range(depth + 1)) as d from nodes) group by 1
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs,
       s.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens,
       sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join sums s using (prefix)
left join nodes p on n.depth > 0 and p.prefix = left(n.prefix, 64 * (n.depth - 1))
"""

LLM_ORACLE: dict[str, str] = {
    "op3_norm_bucket_topk": _TOPK,
    "op4_aho_corasick": _WINDOWS,
    "op9_run_length_index": _REPEATS,
    "op11_url_vocabulary": _url_terms(),
    "op12_slot_pivot_manifest": _MERKLE,
    "op13_prefix_slots": _TRIE,
}
