r"""DuckDB SQL of the queries that SQL can express over whole tables.

The others (Markov and Kneser-Ney models, SimHash classes, minimax cuts, diagonal voting, SentencePiece) are held
against brute force in tests/llm.
"""

from __future__ import annotations

from tremora.llm import quality
from tremora.llm.decontaminate import SLACK
from tremora.llm.urls import RULES

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words.split()}))
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_EMPTY_SHA = "sha256('')"

CHAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|<\|'))
  + len(regexp_extract_all(text, '\[/?INST\]')) as written from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<s>[INST] ') + length(role) + 1 + written + length(' [/INST]</s>')) as bigint) as formatted_chars,
  cast(0 as bigint) as n_attachments, cast(0 as bigint) as expanded_tokens
from e group by conv_id
"""

QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
g as (select doc_id, i, w[i:i + 4] as win from d, unnest(range(1, len(w) - 3)) r(i)),
twice as (select doc_id, unnest(list(i)) as i from g group by doc_id, win having count(*) > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(5) o(k) group by doc_id),
m as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(regexp_extract_all(text, '!{{2,}}')) as n_shouts,
  len(list_filter(w, lambda x: lower(x) in ({_STOPS}))) as n_stops, len(lines) as n_lines,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from d left join covered using (doc_id)),
r as (select *, n_words > 0 as some, word_chars / nullif(n_words, 0)::double as mean_word_chars, n_repeat_words / nullif(n_words, 0)::double as repeat_ratio,
  n_symbols / nullif(n_words, 0)::double as symbol_ratio, n_shouts / nullif(n_words, 0)::double as shout_ratio,
  (n_stops + 1) / nullif(n_words, 0)::double as stop_ratio, n_dup_lines / nullif(n_lines, 0)::double as dup_line_ratio from m),
f as (select *, array_to_string(list_filter([{", ".join(
    f"case when coalesce({rule.metric}, 0) {op} {bound} then '{rule.metric}' end"
    for rule in quality.RULES
    for op, bound in (("<", rule.low), (">", rule.high))
    if bound is not None
)}], lambda x: x is not null), ',') as failed_rules, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules = '' as kept, failed_rules from f
"""

DECONTAMINATION = rf"""
with b as (select cast(item_id as varchar) as item, {_PLAIN} as w from benchmark),
bw as (select distinct item, w[i:i + 9] as g from b, unnest(range(1, greatest(1, len(w) - 9) + 1)) r(i) where len(w) > 0),
sizes as (select distinct len(g) as n from bw),
d as (select doc_id, {_PLAIN} as w from documents),
dw as (select doc_id, i, n, w[i:i + n - 1] as g from d, sizes, unnest(range(1, len(w) - n + 2)) r(i)),
hits as (select doc_id, i, n, item from dw join bw using (g)),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as joined from (select distinct doc_id, item from hits) group by doc_id),
sought as (select g, len(g) as n, list_distinct(g) as terms from (select distinct g from bw)),
having_all as (select doc_id, g from (select distinct doc_id, unnest(w) as term from d) join (select g, len(terms) as k, unnest(terms) as term from sought) using (term)
  group by doc_id, g, k having count(*) = k),
tried as (select h.doc_id, h.g, d.w[i:i + n + {SLACK} - 1] as stretch, terms from having_all h join sought using (g) join d using (doc_id),
  unnest(range(1, greatest(1, len(d.w) - n - {SLACK} + 1) + 1)) r(i)),
close as (select doc_id, count(distinct item) as n_near_items from (select distinct doc_id, g from tried where list_has_all(stretch, terms)) join bw using (g) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(sha256(joined), {_EMPTY_SHA}) as items_sha256, n_hit is not null as contaminated, coalesce(n_near_items, 0) as n_near_items
from d left join places using (doc_id) left join items using (doc_id) left join close using (doc_id)
"""


def _url_sql() -> str:
    """Rules alone decide here: no page of the table names a canonical address or refreshes to one, so none spreads."""
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ordered]
    rules = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, ordered))
    verdicts = " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, ordered))
    return rf"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages)
select page_id, host, path, case {rules} end as rule, case {verdicts} else 'allow' end as verdict from u
"""


LEXICAL = rf"""
with d as (select doc_id, {_PLAIN} as w from documents), held as (select * from d where len(w) > 0),
total as (select count(*) as docs, cast(sum(len(w)) as bigint) as tokens from held),
tf as (select doc_id, len, term, count(*) as tf from (select doc_id, len(w) as len, unnest(w) as term from held) group by all),
df as (select term, count(*) as df from tf group by term),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_PLAIN}) as term from benchmark) group by all),
w as (select item_id, term, times * cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * df + 1))) as bigint) as weight
  from q join df using (term), total),
s as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len * docs) // tokens)))) as bigint) as score
  from w join tf using (term), total group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score from
  (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) where rank <= 10
"""

NEGATIVES = r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, cast(list_dot_product(a.v, r.v) as bigint) as score
  from e a join e r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
p as (select * from (select anchor_id, vec_id as positive_id, score as positive_score,
  row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5),
n as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
  row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

MINHASH = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from d),
s as (select doc_id, unnest(g) as shingle from g), n as (select doc_id, len(g) as n from g),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from n union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, n as n_shingles, least as component_id, doc_id = least as kept
  from n join (select a, min(b) as least from reach group by a) on a = doc_id
"""

ORACLES: dict[str, str] = {
    "op1_chat_format": CHAT,
    "op5_quality_rules": QUALITY,
    "op7_decontamination": DECONTAMINATION,
    "op9_url_filter": _url_sql(),
    "op11_lexical_search": LEXICAL,
    "op12_hard_negatives": NEGATIVES,
    "op13_minhash": MINHASH,
}
