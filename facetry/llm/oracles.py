"""DuckDB statements for the registered queries, written independently of the operators."""

from __future__ import annotations

from . import decontaminate, hard_negatives, infilling, near_dedup, permutation, quality, quotes, repeats, secrets, sharding


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


UPPER, LOWER = quoted(decontaminate.UPPER), quoted(decontaminate.LOWER)
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ROWS = "select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents"


def quality_sql(p: quality.QualityParams = quality.QualityParams()) -> str:
    powers = "[" + ", ".join(str(x) for x in quality.multipliers().tolist()) + "]"
    m, b, r = quality.PRIME, p.buckets, p.repeat_window
    return f"""
with d as materialized ({ROWS}),
w as materialized (select rid, {WORDS.format('t')} as w, {WORDS.format(f"translate(t, {UPPER}, {LOWER})")} as lw from d),
vocab as materialized (select lw, list_sum(list_transform(range(1, length(lw) + 1), lambda i: unicode(lw[i])::bigint * {powers}[((i - 1) % {quality.PERIOD}) + 1] % {m}))::bigint % {m} as h
  from (select distinct unnest(lw) as lw from w)),
tok as materialized (select rid, i, h from (select rid, unnest(lw) as lw, generate_subscripts(lw, 1) as i from w) join vocab using (lw)),
grams as materialized (select rid, h % {b} as bucket from tok union all
  select rid, (h * {quality.PAIR} + n) % {m} % {b} from (select rid, h, lead(h) over (partition by rid order by i) as n from tok) where n is not null),
good as (select doc_id from labels where doc_id is not null group by 1 having min(quality) = 1 and coalesce(max(toxic), 0) = 0),
counts as (select bucket, count(*) as raw, count(*) filter (rid in (select rid from d join good using (doc_id))) as target from grams group by 1),
sums as (select sum(raw)::double as raw, sum(target)::double as target from counts),
weights as materialized (select bucket, case when sums.target = 0 then 0 else round(1e6 * ln(((c.target + {p.smoothing}) / (sums.target + {p.smoothing * b}))
  / ((c.raw + {p.smoothing}) / (sums.raw + {p.smoothing * b}))))::bigint end as weight from counts c, sums),
scored as (select rid, count(*) as n_grams, sum(weight)::bigint as score_micro from grams join weights using (bucket) group by 1),
wins as materialized (select rid, i, array_to_string(w[i:i + {r - 1}], ' ') as win from (select rid, w, unnest(range(1, len(w) - {r - 2})) as i from w)),
twice as (select rid, win from wins group by 1, 2 having count(*) > 1),
again as (select rid, count(distinct spot) as n from (select rid, unnest(range(i, i + {r})) as spot from wins join twice using (rid, win)) group by 1),
lines as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
base as (select d.rid, doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(again.n, 0) as n_repeat_words, coalesce(n_grams, 0) as n_grams, coalesce(score_micro, 0) as score_micro
  from d join w using (rid) join lines using (rid) left join again using (rid) left join scored using (rid)),
judged as (select *, n_words < {p.least_words} or 100 * n_repeat_words > {p.repeat_percent} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and score_micro >= {p.threshold} * n_grams as kept, n_grams, score_micro from judged
"""


def crc_table() -> list[int]:
    """Remainders of all bytes for the reversed polynomial of CRC-32."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def shards_sql(p: sharding.ShardParams = sharding.ShardParams()) -> str:
    table = "[" + ", ".join(map(str, crc_table())) + "]"
    crc = (f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::bigint)), "
           f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])))")

    def permuted(source: str, column: str) -> str:
        inner = f"select number, a, b, n, {column} // b as l, {column} % b as r from {source}"
        for i, (m, c, f) in enumerate(permutation.Grid(1, p.seed).keys()):
            of, to, side = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
            new = f"({to} + ((({of} * {m} + {c}) % {permutation.P1} * {f}) % {permutation.P2}) // 8) % {side} as {to}"
            inner = f"select number, a, b, n, {of}, {new} from ({inner})"
        return f"select number, a, b, n, l * b + r as place from ({inner})"

    return f"""
with recursive d as materialized (select doc_id, t, (octet_length(encode(t)) + 1)::bigint as size, {crc}::bigint as text_crc32 from ({ROWS})),
ranked as materialized (select *, row_number() over (order by doc_id nulls first, text_crc32, size) - 1 as number, count(*) over () as n from d),
grid as (select number, n, greatest(1, ceil(sqrt(n)))::bigint as a, ((n + greatest(1, ceil(sqrt(n)))::bigint - 1) // greatest(1, ceil(sqrt(n)))::bigint) as b from ranked),
walk(number, a, b, n, place) as ({permuted('grid', 'number')} union all {permuted('(select * from walk where place >= n)', 'place')})
select doc_id, size, text_crc32, 'rows' as law, (place % {p.shards})::int as shard, (place // {p.shards})::bigint as slot, null::int as grown_shard
from ranked join (select number, place from walk where place < n) using (number)
"""


def near_sql(p: near_dedup.NearParams = near_dedup.NearParams()) -> str:
    k = p.width
    return f"""
with recursive w as materialized (select doc_id, {WORDS.format(f"translate(coalesce(text, ''), {UPPER}, {LOWER})")} as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + {k - 1}], ' ') as sh
  from (select doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) as i from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by 1),
both_in as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2),
links as materialized (select a, b from both_in join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * c >= {p.percent} * (na.n + nb.n - c)),
reach(a, b) as (select doc_id, doc_id from w union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from least left join n using (doc_id)
"""


def secrets_sql(p: secrets.SecretParams = secrets.SecretParams()) -> str:
    def part(pattern: str, order: int, check: str = "true") -> str:
        q = quoted(pattern)
        return f"""(select rid, {order} as ord, s, s + length(m[i]) as e, m[i] as whole, v[i] as value from (
  select rid, m, v, i, (list_sum(list_transform(q[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as s
  from (select rid, m, q, v, unnest(range(1, len(m) + 1)) as i from (
    select rid, regexp_extract_all(t, {q}) as m, string_split_regex(t, {q}) as q, regexp_extract_all(t, {q}, {2 if order == 0 else 0}) as v
    from d where regexp_matches(t, {q})))) where {check})"""

    free = lambda name, *taken: " and ".join(
        f"not exists (select 1 from {o} o where o.rid = {name}.rid and o.s < {name}.e and {name}.s < o.e)" for o in taken)
    near = lambda other: (f"exists (select 1 from {other} o where o.rid = x.rid and o.scope = x.scope "  # noqa: E731
                          f"and o.s <= x.e + {p.reach} and x.s <= o.e + {p.reach})")
    names = "[" + ", ".join(quoted(k) for k in secrets.KINDS) + "]"
    listed = f"string_agg({names}[ord + 1] || ':' || s || ':' || e, ',' order by s, ord)"
    return f"""
with d as materialized ({ROWS}),
base as materialized (select * from {part(secrets.ASSIGN, 0, f"length(value) >= {secrets.LEAST_VALUE}")} union all
  select * from {part(secrets.ACCESS, 1)} union all select * from {part(secrets.HEX, 2)}),
ids as materialized (select * from {part(secrets.WEAK_ID, 3)} p where {free('p', 'base')}),
urls as materialized (select * from {part(secrets.ADDRESS, 5)} p where {free('p', 'base')}),
runs as materialized (select * from {part(secrets.RUN, 4, "regexp_matches(whole, '[0-9]') and regexp_matches(whole, '[A-Za-z]')")} p where {free('p', 'base', 'ids', 'urls')}),
breaks as materialized (select rid, s from {part(secrets.BLANK_LINE, 9)}),
parts as materialized (select *, (select count(*) from breaks b where b.rid = x.rid and b.s < x.s) as scope
  from (select * from base union all select * from ids union all select * from urls union all select * from runs) x),
named as materialized (select * from parts where ord in (1, 3)),
keyed as materialized (select * from parts where ord in (0, 2, 4)),
told as (select * from base union all
  select x.* exclude (scope) from parts x where (ord = 3 and {near('keyed')}) or (ord = 4 and {near('named')}) or (ord = 5 and {near('named')} and {near('keyed')})),
b as (select rid, count(*) filter (ord = 0) as n_assign, count(*) filter (ord = 1) as n_access, count(*) filter (ord = 2) as n_hex, {listed} as spans from base group by 1),
a as (select rid, {listed} as spans from told group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(b.spans, '')) as base_sha256, coalesce(a.spans, '') as spans
from d left join b using (rid) left join a using (rid)
"""


def contamination_sql(p: decontaminate.BenchmarkParams = decontaminate.BenchmarkParams()) -> str:
    words = lambda t: f"regexp_extract_all(translate({t}, {UPPER}, {LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as materialized (select rid, doc_id, {words('t')} as w from ({ROWS})),
items as (select item_id, w, least(len(w), {p.window}) as n from (select item_id, {words("coalesce(text, '')")} as w from benchmark) where len(w) > 0),
iw as materialized (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as i from items)),
lens as (select distinct n from iw),
dw as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as win from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hits as materialized (select rid, i, n, win from dw semi join iw using (n, win)),
words_hit as (select rid, count(distinct spot) as n_hit from (select rid, unnest(range(i, i + n)) as spot from hits) group by 1),
found as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct rid, item_id::varchar as item from hits join iw using (n, win) where item_id is not null) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join words_hit using (rid) left join found using (rid)
"""


def quotes_sql() -> str:
    marks, announced = quoted(quotes.MARKS), quoted(quotes.ANNOUNCED)
    return f"""
with recursive m as materialized (select row_number() over (order by conv_id, turn) as mid, conv_id, turn, role, text from conversations),
x as (select mid, unnest(l) as x, generate_subscripts(l, 1) as i from (
  select mid, string_split(replace(replace(coalesce(text, ''), chr(1), ' '), chr(13), ''), chr(10)) as l from m)),
y as (select mid, i, x, regexp_extract(x, {marks}) as mk from x),
z as (select mid, i, length(regexp_replace(mk, '[^>]', '', 'g')) as level, substr(x, length(mk) + 1) as body from y),
ln as materialized (select *, level > 0 or (regexp_matches(body, {announced}) and coalesce(lead(level) over (partition by mid order by i), 0) > 0) as dropped from z),
own as (select mid, regexp_replace(string_agg(body, chr(10) order by i), '^\\s+|\\s+$', '', 'g') as t from ln where not dropped group by 1),
used as (select *, case when lag(i) over w = i - 1 and lag(level) over w = level then 0 else 1 end as head
  from ln where regexp_matches(body, '\\S') and (level > 0 or not dropped) window w as (partition by mid order by i)),
numbered as (select *, sum(head) over (partition by mid order by i) as k from used),
passages as materialized (select mid, k, min(level) as level, lower(trim(regexp_replace(string_agg(body, ' ' order by i), '\\s+', ' ', 'g'))) as body from numbered group by 1, 2),
said as materialized (select p.*, conv_id, turn from passages p join m using (mid)),
originals as (select conv_id, body, min({{'turn': turn, 'mid': mid}}) as f from said where level = 0 group by 1, 2),
links as materialized (select s.mid, s.level, o.f from said s join originals o on s.conv_id is not distinct from o.conv_id and s.body = o.body
  where s.level > 0 and o.f < {{'turn': s.turn, 'mid': s.mid}}),
parents as materialized (select mid, max({{'l': -level, 'f': f}}).f.mid as parent, count(*) as n_linked from links group by 1),
walk(mid, path) as (select mid, [{{'turn': turn, 'mid': mid}}] from m where mid not in (select mid from parents)
  union all select m.mid, list_append(w.path, {{'turn': m.turn, 'mid': m.mid}}) from walk w join parents p on p.parent = w.mid join m on m.mid = p.mid)
select m.conv_id, m.turn, m.role, row_number() over (partition by m.conv_id order by path) - 1 as pos, (len(path) - 1)::int as depth,
  up.turn as parent_turn, coalesce(q.n, 0) as n_quoted, coalesce(p.n_linked, 0) as n_linked,
  case when m.text is null then null else coalesce(own.t, '') end as text
from m join walk using (mid) left join parents p using (mid) left join m up on up.mid = p.parent left join own using (mid)
left join (select mid, count(*) as n from passages where level > 0 group by 1) q using (mid)
"""


def repeats_sql(p: repeats.RepeatParams = repeats.RepeatParams()) -> str:
    k = p.window
    return f"""
with d as materialized (select rid, doc_id, {WORDS.format('t')} as w from ({ROWS})),
wins as (select rid, doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') as win from (select *, unnest(range(1, len(w) - {k - 2})) as i from d where len(w) >= {k})),
again as (select rid, i from (select rid, i, row_number() over (partition by win order by doc_id nulls first, rid, i) as place from wins) where place > 1),
gone as (select rid, list(distinct spot) as spots from (select rid, unnest(range(i, i + {k})) as spot from again) group by 1),
kept as (select rid, string_agg(word, ' ' order by spot) as text from (select rid, unnest(w) as word, generate_subscripts(w, 1) as spot from d) words
  anti join (select rid, unnest(spots) as spot from gone) cut using (rid, spot) group by 1)
select doc_id, len(w) as n_words, coalesce(len(spots), 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join gone using (rid) left join kept using (rid)
"""


def negatives_sql(p: hard_negatives.MiningParams = hard_negatives.MiningParams()) -> str:
    return f"""
with v as materialized (select row_number() over () as rid, vec_id, case when vec_id % {p.moved_step} = 0 then (label + 1) % {p.labels} else label end as label,
    list_transform(embedding, lambda x: floor(x::double * {p.scale})::hugeint) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
wide as (select greatest(max(len(e)), 1) as n from v),
a as materialized (select * from v where vec_id % {p.anchor_step} = 0),
s as materialized (select a.rid as arid, a.vec_id as anchor_id, v.rid, v.vec_id, a.label = v.label as same,
    coalesce(list_sum(list_transform(range(1, least(len(a.e), len(v.e)) + 1), lambda i: a.e[i] * v.e[i])), 0)::bigint as score from a, v where a.rid <> v.rid),
pos as (select arid, anchor_id, vec_id as positive_id, score as positive_score, place from
  (select *, row_number() over (partition by arid order by score desc, vec_id, rid) as place from s where same) where place <= {p.positives}),
neg as (select pos.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by pos.arid, place order by s.score desc, s.vec_id) as rank
  from pos join s on s.arid = pos.arid and not s.same and {p.low_percent} * positive_score <= 100 * s.score and 100 * s.score <= {p.high_percent} * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from neg where rank <= {p.negatives}
"""


def infilling_sql(p: infilling.FillParams = infilling.FillParams()) -> str:
    marks = infilling.PREFIX, infilling.SUFFIX, infilling.MIDDLE
    held = " or ".join(f"contains(t, '{m}')" for m in marks)
    h = [f"('0x' || substr(h, {8 * k + 1}, 8))::bigint" for k in range(4)]
    join = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return f"""
with d as (select doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u,
  sha256('{p.seed}:' || coalesce(doc_id::varchar, '')) as h from ({ROWS})),
c as (select *, len(u) as n, least({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) as a, greatest({h[0]} % (len(u) + 1), {h[1]} % (len(u) + 1)) as b,
  case when t = '' or {held} or {h[2]} % 100 >= {p.percent} then 'plain' when {h[3]} % 100 < {p.spm_percent} then 'spm' else 'psm' end as form from d),
parts as (select *, {join('1', 'a')} as pre, {join('a + 1', 'b')} as mid, {join('b + 1', 'n')} as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{marks[0]}' || pre || '{marks[1]}' || suf || '{marks[2]}' || mid
    else '{marks[1]}' || suf || '{marks[0]}' || pre || '{marks[2]}' || mid end) as output_sha256, sha256(t) as restored_sha256 from parts
"""
