"""SQL of the queries that SQL can express: written from their contracts, not from the code."""

#: Words as SQL lists them; 8-word windows by position, repeats by count over the window's words.
OP1 = r"""
with w as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos, len(ws) as n from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents where text is not null)),
win as (select doc_id, pos, n, list(word) over (partition by doc_id order by pos rows between current row and 7 following) as k from w),
twice as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, k) as c from win where pos + 8 <= n) where c > 1),
rep as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(pos, pos + 8)) as p from twice) group by 1),
ls as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null),
dup as (select doc_id, count(*) filter (r > 1) as n_dup_lines, count(*) as n_text_lines from (select doc_id, row_number() over (partition by doc_id, line order by pos) as r from ls where regexp_matches(line, '[^\x20\x09-\x0D]')) group by 1),
runs as (select doc_id, count(*) filter (word = prev) as n_run_words, count(*) filter (word = '|') as n_pipe_words, count(*) as n_words, sum(length(word))::bigint as word_chars from (select doc_id, word, lag(word) over (partition by doc_id order by pos) as prev from w) group by 1),
m as (
  select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars, coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0)::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_text_lines, 0) as n_text_lines, coalesce(n_run_words, 0) as n_run_words, coalesce(n_pipe_words, 0) as n_pipe_words,
         coalesce(length(regexp_replace(text, '[^A-Z\x{C0}-\x{DE}]', '', 'g')), 0) as n_upper, coalesce(length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')), 0) as n_letters, coalesce(length(regexp_replace(text, '[^!]', '', 'g')), 0) as n_bang
  from documents d left join runs using (doc_id) left join rep using (doc_id) left join dup using (doc_id)),
b as (
  select *, ((n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (n_symbols > 0.10 * n_words)::bigint + 8 * (n_upper > 0.30 * n_letters)::bigint + 16 * (n_bang > 0.10 * n_words)::bigint
    + 32 * (n_pipe_words > 0.10 * n_words)::bigint + 64 * (n_dup_lines > 0.30 * n_text_lines)::bigint + 128 * (word_chars < 2 * n_words)::bigint + 256 * (word_chars > 20 * n_words)::bigint
    + 512 * (n_letters < 0.50 * word_chars)::bigint + 1024 * (n_run_words > 0.30 * n_words)::bigint)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       (fail_bits & 1983) = 0 as kept, fail_bits, 2::int as policy_version from b
"""

#: Rules and masks of the two policies, written out; a row per policy and rule against bit patterns.
ABLATIONS = OP1[: OP1.index("select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20")].rstrip() + """,
pol(policy_version, mask, rule, bit) as (values (1, 3, 'few_words', 1), (1, 3, 'repeated_windows', 2), (2, 1983, 'few_words', 1), (2, 1983, 'repeated_windows', 2), (2, 1983, 'symbols', 4), (2, 1983, 'capitals', 8), (2, 1983, 'exclamation', 16),
  (2, 1983, 'table_cells', 32), (2, 1983, 'short_words', 128), (2, 1983, 'long_words', 256), (2, 1983, 'no_letters', 512), (2, 1983, 'stuttered_words', 1024))
select policy_version::int as policy_version, rule, count(*) filter (fail_bits & mask <> 0) as rejected, count(*) filter (fail_bits & bit <> 0) as by_rule, count(*) filter (fail_bits & mask = bit) as by_rule_alone,
       count(*) filter (fail_bits & mask & ~bit <> 0) as without_rule, bit_or(fail_bits) filter (fail_bits & mask <> 0) as bits_seen from b, pol group by 1, 2
"""

OP8 = r"""
with low as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
dw as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos, len(ws) as n from (select doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from low where t is not null)),
bw as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null),
items as (select item_id, ws, least(10, len(ws)) as k from bw where len(ws) > 0),
q as (select item_id, k, a, ws[a + 1 : a + k] as win from (select item_id, ws, k, unnest(range(len(ws) - k + 1)) as a from items)),
sizes as (select distinct k from q),
dwin as (select doc_id, pos, 10 as k, list(word) over (partition by doc_id order by pos rows between current row and 9 following) as win, n from dw),
dk as (select doc_id, pos, s.k, win[1 : s.k] as win from dwin, sizes s where pos + s.k <= n),
hits as (select d.doc_id, d.pos, q.item_id, q.a, q.k from dk d join q on d.k = q.k and d.win = q.win),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(pos, pos + k)) as p from hits) group by 1),
runs as (select doc_id, max(pos + k) - min(pos) as len from (select *, pos - row_number() over (partition by doc_id, item_id, pos - a order by pos) as g from hits) group by doc_id, item_id, pos - a, g),
longest as (select doc_id, max(len) as longest_match from runs group by 1),
found as (select doc_id, count(item_id) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hits) group by 1),
sized as (select doc_id, count(*) as n_words from dw group by 1)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest_match, 0)::bigint as longest_match
from documents d left join sized using (doc_id) left join covered using (doc_id) left join found using (doc_id) left join longest using (doc_id)
"""


def _blank(name: str, source: str, pattern: str, least: str = "true") -> str:
    """Texts with spaces for the matches that `least` (of ms[i] and gs[i]) holds for."""
    return f"""{name} as (select doc_id, array_to_string(list_transform(range(1, len(ps) + 1), lambda i: ps[i] || case when i > len(ms) then '' when {least} then repeat(' ', length(ms[i])) else ms[i] end), '') as t
  from (select doc_id, string_split_regex(t, '{pattern}') as ps, regexp_extract_all(t, '{pattern}', 0) as ms, regexp_extract_all(t, '{pattern}', {2 if "gs" in least else 0}) as gs from {source}))"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0{8}|0123456789|1234567890|abcdefgh|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha(?:1|256|384|512)-[A-Za-z0-9+/=]+"

#: Matches and the pieces between them give places; a candidate's windows are unnested and their entropies counted anew.
OP3 = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
{_blank("b1", "d", "(?:[A-Za-z]{2,}[/_-]){3}")},
{_blank("b2", "b1", _ASSIGN, "length(gs[i]) >= 8")},
{_blank("b3", "b2", "AKIA[A-Z0-9]+", "length(ms[i]) >= 16")},
{_blank("b4", "b3", "[0-9a-f]+", "length(ms[i]) >= 32")},
{_blank("b5", "b4", _ALLOWED)},
pat(rank, kind, least) as (values (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32), (3, 'word', 20)),
raw as (
  select doc_id, rank, kind, least,
    case rank when 0 then regexp_extract_all(d.t, '{_ASSIGN}', 0) when 1 then regexp_extract_all(d.t, 'AKIA[A-Z0-9]+', 0) when 2 then regexp_extract_all(d.t, '[0-9a-f]+', 0) else regexp_extract_all(b5.t, '[A-Za-z0-9+/_=-]+', 0) end as ms,
    case rank when 0 then string_split_regex(d.t, '{_ASSIGN}') when 1 then string_split_regex(d.t, 'AKIA[A-Z0-9]+') when 2 then string_split_regex(d.t, '[0-9a-f]+') else string_split_regex(b5.t, '[A-Za-z0-9+/_=-]+') end as ps,
    case rank when 0 then regexp_extract_all(d.t, '{_ASSIGN}', 2) end as gs
  from d join b5 using (doc_id), pat),
each as (select doc_id, rank, kind, least, unnest(ms) as m, unnest(coalesce(gs, ms)) as g, unnest(ps[1 : len(ms)]) as p, unnest(range(len(ms))) as i from raw where len(ms) > 0),
placed as (select doc_id, rank, kind, least, m, g, sum(length(p) + length(m)) over (partition by doc_id, rank order by i)::bigint as stop from each),
spans as (select doc_id, rank, kind, m, stop - length(m) as start, stop from placed where length(g) >= least),
cand as (
  select doc_id, m, start, case when regexp_full_match(m, '[0-9a-f]+') or regexp_full_match(m, '[0-9A-F]+') then 3.0 when regexp_full_match(m, '[0-9a-z/_=+-]+') or regexp_full_match(m, '[0-9A-Z/_=+-]+') then 3.6 else 3.7 end as bits
  from spans where rank = 3 and regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')),
win as (select doc_id, start, bits, i, substring(m, i + 1, 20) as w from (select *, unnest(range(length(m) - 19)) as i from cand)),
chars as (select doc_id, start, bits, i, unnest(string_split(w, '')) as c from win),
ent as (select doc_id, start, bits, i, -sum(n / 20.0 * log2(n / 20.0)) as h from (select doc_id, start, bits, i, c, count(*) as n from chars group by all) group by 1, 2, 3, 4),
hot as (select doc_id, start, start + i as a, sum(fresh) over (partition by doc_id, start order by i) as g from (select *, case when i - lag(i) over (partition by doc_id, start order by i) <= 20 then 0 else 1 end as fresh from ent where h >= bits)),
added as (select doc_id, min(a) as start, max(a) + 20 as stop from hot h group by doc_id, h.start, g),
allspans as (select doc_id, rank, kind, start, stop from spans where rank < 3 union all select doc_id, 3, 'entropy', start, stop from added),
agg as (
  select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, count(*) filter (rank = 3) as n_entropy,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3), '') as b, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans
  from allspans group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_entropy, 0)::bigint as n_entropy
from d left join agg using (doc_id)
"""
