"""DuckDB SQL for the operators that SQL can express, written from their definitions.

The other queries (a trained network, tokenizers, multipart links, the turn-taking table) are held
against plain Python in ``tests/llm``.
"""

from __future__ import annotations

ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SPACED = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = f"""
with recursive d as (select doc_id, {SPACED.format(f"translate(coalesce(text, ''), {ABC})")} as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
             else list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) end as g from d),
u as (select doc_id, len(g) as n, unnest(g) as g from s),
pairs as (select a.doc_id as a, b.doc_id as b from u a join u b on a.g = b.g and a.doc_id <> b.doc_id
          group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, r) as (select doc_id, doc_id from s union select reach.doc_id, pairs.b from reach join pairs on reach.r = pairs.a),
c as (select doc_id, min(r) as component_id from reach group by doc_id)
select s.doc_id, len(s.g)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept from s join c using (doc_id)
"""

OP3 = f"""
with d as (select doc_id, {SPACED.format("coalesce(text, '')")} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i+12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
f as (select g, min(doc_id) as first from g group by g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from g join f using (g) where first < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
r as (select words.doc_id, count(*) as n, count(gone.i) as n_gone, string_agg(case when gone.i is null then word end, ' ' order by words.i) as kept
      from words left join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join r using (doc_id)
"""

ITEM_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), {}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')".format(ABC)
OP7 = f"""
with d as (select doc_id, {ITEM_WORDS} as w from documents),
b as (select item_id, {ITEM_WORDS} as w from benchmark),
items as (select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') as g
          from (select item_id, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from items),
g as (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, g.n, item_id from g join items on g.n = items.n and g.g = items.g),
h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
          from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join found using (doc_id)
"""

# Exponents: for the entropy by 60 halvings; for the repetition in closed form.
OP1 = r"""
with recursive d as (select doc_id, coalesce(source, '') as source,
  len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as n_tokens from documents),
s as (select source, sum(n_tokens)::double as t, count(*) as n from d group by source),
p as (select source, t, t / (select sum(t) from s) as p from s where t > 0),
halving(i, low, high) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when h.entropy >= 0.9 * h.most then (low + high) / 2 else low end, case when h.entropy >= 0.9 * h.most then high else (low + high) / 2 end
  from halving, lateral (select ln(sum(exp(ln(p) * (low + high) / 2))) - (low + high) / 2 * sum(exp(ln(p) * (low + high) / 2) * ln(p)) / sum(exp(ln(p) * (low + high) / 2)) as entropy,
                         ln(count(*)) as most from p) h
  where i < 60),
shares as (select -sum(p * ln(p)) >= 0.9 * ln(count(*)) as enough, min(p) as least, max(p) as most from p),
alpha as (select greatest(0, case when enough then 1 else (select low from halving where i = 60) end,
                 case when most / least <= 2 then 0 else 1 - ln(2) / ln(most / least) end) as a, most from shares),
w as (select source, t, exp(ln(p) * a) / (select sum(exp(ln(p) * a)) from p, alpha) as weight from p, alpha),
budget as (select (select sum(t) from s) * most / exp(a * ln(most)) * (select sum(exp(ln(p) * a)) from p, alpha) as tokens from alpha),
k as (select s.source, case when s.t > 0 then floor(round(weight * tokens) / s.t) else 1 end::bigint as whole,
             case when s.t > 0 then round(weight * tokens) - floor(round(weight * tokens) / s.t) * s.t else 0 end as rest
      from s left join w using (source), budget),
ranked as (select d.*, whole, rest, md5(source || '/' || whole || '/' || coalesce(doc_id::varchar, '')) as part from d join k using (source)),
cut as (select *, rest > sum(n_tokens) over (partition by source order by part rows unbounded preceding) - n_tokens as inside from ranked),
taken as (select doc_id, source, n_tokens, unnest(range(whole + case when inside and rest > 0 then 1 else 0 end)) as block from cut)
select doc_id, source, n_tokens, block, md5(source || '/' || block || '/' || coalesce(doc_id::varchar, '')) as rank from taken
"""


def _op5() -> str:
    # the rule's own constants, stated again: lists and limits of the engine do not reach this SQL
    common_words = {
        "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
        "en": "the of and to in a is that it was for on are as with his they at be this".split(),
        "es": "de la que el en y a los se del las un por con no una su para es al".split(),
        "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec".split(),
    }
    classes = {
        "lower": "[a-z]+", "space": "[\\x20\\x09-\\x0D]+", "upper": "[A-Z]+", "accented": "[\\p{L}\\p{M}]+", "digit": "[0-9]+",
        "symbol": "[#*$%&|<>]+", "mark": "[.,;:!?'\"()-]+", "bracket": "[\\[\\]{}=_/\\\\@~^`+]+",
    }
    # each class is counted among the characters that earlier classes leave
    steps, last = [], "text"
    for name, pattern in classes.items():
        steps.append((name, f"regexp_replace({last}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')", last))
        last = f"rest_{name}"
    chain, source = [], "w"
    for name, made, before in steps:
        chain.append(f"r_{name} as (select *, {made} as rest_{name}, length({before}) - length({made}) as n_{name} from {source})")
        source = f"r_{name}"
    bins = [n for n in classes if n != "space"]
    hist = ", ".join(f"n_{n}::double / greatest(word_chars, 1)" for n in bins) + f", length({last})::double / greatest(word_chars, 1)"
    words = "case " + " ".join(
        "when lang = '{}' then [{}]".format(k, ", ".join(f"len(list_filter(lw, lambda x: x = '{w}'))::double" for w in ws)) for k, ws in common_words.items()) + " end"
    distance = "sqrt(greatest(list_sum([case when {p}[i] > 0 then {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) else 0 end / 2 + case when {q}[i] > 0 then {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) else 0 end / 2 for i in range(1, len({p}) + 1)]), 0))"
    means = lambda col, n: "[" + ", ".join(f"avg({col}[{i}])" for i in range(1, n + 1)) + "]"
    known = ", ".join(f"'{k}'" for k in common_words)
    n_words = max(map(len, common_words.values())) + 1
    prior = "[" + ", ".join(["0.2::double / 20"] * 20 + ["0.8::double"]) + "]"
    smooth = lambda mean, q, n: f"[(m * {mean}[i] + 20 * {q}[i]) / (m + 20) for i in range(1, {n + 1})]"
    prior_none = "[" + ", ".join(["0.0::double"] * 20 + ["1.0::double"]) + "]"
    return f"""
with d as (select doc_id, lang, coalesce(text, '') as text from documents),
w as (select *, {SPACED.format("text")} as w from d),
{", ".join(chain)},
c as (select *, (length(text) - n_space)::bigint as word_chars, [translate(x, {ABC}) for x in w] as lw from {source}),
g as (select doc_id, i, array_to_string(w[i:i+2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3)),
twice as (select doc_id, g from g group by doc_id, g having count(*) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 3)) as p from g join twice using (doc_id, g)) group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
      where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
h as (select c.doc_id, lang, len(w)::bigint as n_words, word_chars, n_symbol::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines,
             coalesce(rep.n, 0)::bigint as n_repeat_words, [{hist}] as pc, {words} as common
      from c left join l using (doc_id) left join rep using (doc_id)),
p as (select *, case when common is not null then list_concat([x / greatest(n_words, 1) for x in common], [(n_words - list_sum(common)) / greatest(n_words, 1)]) end as pw from h),
every as (select {means("pc", len(bins) + 1)} as rc from p where n_words > 0),
means as (select lang, count(*) as m, {means("pc", len(bins) + 1)} as mc, {means("pw", n_words)} as mw from p where n_words > 0 and lang in ({known}) group by lang),
ref as (select lang, {smooth("mc", "every.rc", len(bins) + 1)} as rc, {smooth("mw", prior, n_words)} as rw from means, every),
without as (select lang, rc, rw, {prior_none} as p0 from ref),
far as (select lang, rc, rw, 0.9 * {distance.format(p="p0", q="rw")} as most from without),
j as (select p.*, coalesce(far.rc, every.rc) as rc, far.rw as rw, far.most from p left join far using (lang), every),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             case when word_chars >= 200 then {distance.format(p="pc", q="rc")} else 0 end as dc,
             case when n_words >= 100 and rw is not null then {distance.format(p="pw", q="rw")} <= most else true end as near from j)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and dc <= 0.35 and near as kept from m
"""


def _op11() -> str:
    def framed(c: str) -> str:
        return f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"

    def siblings(nodes: str, tree: str) -> str:
        """Digests on either side of each node, in its run of three."""
        return f"""select a.lv, {tree} a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx < a.idx), '') as lft, coalesce(string_agg(b.h, '' order by b.idx) filter (b.idx > a.idx), '') as rgt
  from {nodes} a left join {nodes} b on a.lv = b.lv {"and a.source is not distinct from b.source" if tree else ""} and a.idx // 3 = b.idx // 3 and a.idx <> b.idx
  where a.n > 1 group by a.lv, {tree} a.idx"""

    values = " || ".join(map(framed, ("doc_id", "source", "lang", "n_chars")))
    return f"""
with recursive bits(i, k, v) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
tab as (select list(v order by i) as t from bits where k = 8),
d as (select doc_id, source, sha256({values} || {framed("text")}) as leaf, sha256({values} || {framed("replace(text, chr(10), '')")}) as cut,
             xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 as tampered
      from documents, tab),
low as (select *, row_number() over (partition by source order by doc_id) - 1 as idx, count(*) over (partition by source) as n from d),
nodes(lv, source, idx, n, h) as (
  select 0, source, idx, n, leaf from low
  union all select lv + 1, source, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from nodes where n > 1 group by lv, source, idx // 3, n),
subs as (select source, h as subroot, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops(lv, idx, n, h) as (
  select 0, idx, n, subroot from subs
  union all select lv + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from tops where n > 1 group by lv, idx // 3, n),
sib as ({siblings("nodes", "a.source,")}),
topsib as ({siblings("tops", "")}),
steps as (
  select low.doc_id, 0 as phase, lv, lft, rgt from low join sib on low.source is not distinct from sib.source and sib.idx = low.idx // pow(3, lv)::bigint
  union all
  select low.doc_id, 1, lv, lft, rgt from low join subs on low.source is not distinct from subs.source join topsib on topsib.idx = subs.idx // pow(3, lv)::bigint),
proof as (select doc_id, sha256(string_agg(lft || rgt, '' order by phase, lv)) as proof, list(lft || '|' || rgt order by phase, lv) as path from steps group by doc_id),
r as (select low.doc_id, leaf, subroot, tops.h as root, coalesce(proof, sha256('')) as proof_sha256,
             list_reduce(list_concat([case when tampered then cut else leaf end], coalesce(path, [])), lambda a, e: sha256(split_part(e, '|', 1) || a || split_part(e, '|', 2))) as folded_root
      from low join subs on low.source is not distinct from subs.source join tops on tops.n = 1 left join proof using (doc_id))
select *, folded_root = root as verified from r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_near_duplicates": OP2, "op3_substring_dedup": OP3, "op5_quality": _op5(), "op7_decontamination": OP7, "op11_merkle": _op11()}
