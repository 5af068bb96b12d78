"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {}

ORACLE["op1_url_filter"] = r"""
with rules(rule, r_host, r_path, v) as (values
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select row_number() over () as n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (select n, rule, v, row_number() over (partition by n order by length(rule) desc) as k
    from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parts left join fits on parts.n = fits.n and k = 1
"""

ORACLE["op6_substring_dedup"] = rf"""
with w as (select row_number() over () as n, doc_id, {WORDS} as ws from documents),
win as (select n, p, md5(array_to_string(list_slice(ws, p, p + 34), ' ')) as h
    from (select n, ws, unnest(generate_series(1, len(ws) - 34)) as p from w where len(ws) >= 35)),
hit as (select n, p from win where h in (select h from win group by h having count(*) > 1)),
gone as (select distinct n, unnest(generate_series(p, p + 34)) as p from hit),
kept as (select n, string_agg(word, ' ' order by p) as t, count(*) as k from (
    select n, unnest(ws) as word, unnest(generate_series(1, len(ws))) as p from w where len(ws) > 0) anti join gone using (n, p)
    group by n)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (n)
"""

ORACLE["op9_mixing"] = rf"""
with d as (select doc_id, source, len({WORDS})::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 9))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as r from d group by source),
sw as (select *, ([5, 2, 1])[((r - 1) % 3 + 1)::int] as w from s),
lv as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))::double
        / (sum(w) over () - coalesce(sum(w) over before, 0))::double as level, row_number() over (order by source_size::double / w, r) as place
    from sw window before as (order by source_size::double / w, r rows between unbounded preceding and 1 preceding)),
lam as (select arg_min(level, place) as l from lv where level * w <= 3 * source_size),
t as (select source, r, source_size, least(coalesce(l * w, 3.0 * source_size), 3.0 * source_size)::double as target from lv, lam),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t),
run as (select doc_id, size, b.*, row_number() over o as place, sum(size) over (o rows unbounded preceding) as upto, target - whole * b.source_size as budget
    from d join b on d.source is not distinct from b.source window o as (partition by b.r order by h, size)),
cut as (select r, min(place) as th, arg_min(size <= 2 * (budget - (upto - size)), place) as eq from run where size > 0 and upto > budget group by r)
select doc_id, size, source_size, target,
    (size * (whole + case when place < th or (place = th and eq) then 1 else 0 end))::bigint as taken
from run left join cut using (r)
"""

# The verdict in terms of windows: words in repeats of 10 words are the words in 10-word windows found
# twice, and a repeat longer than 100 words is a 101-word window found twice.
ORACLE["op10_quality_rules"] = rf"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text, {WORDS} as ws from documents),
win as (select n, k, p, md5(array_to_string(list_slice(ws, p, p + k - 1), ' ')) as h
    from (select n, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as p from d, (values (5), (10), (101)) as t(k) where len(ws) >= k)),
twice as (select n, k, unnest(ps) as p from (select n, k, h, list(p) as ps from win group by n, k, h having count(*) > 1)),
cov as (select n, k, count(distinct q) as c from (select n, k, unnest(generate_series(p, p + k - 1)) as q from twice) group by n, k),
lines as (select n, sum(c - 1)::bigint as dup from (select n, line, count(*) as c
    from (select n, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by n, line) group by n),
base as (select doc_id, n, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(dup, 0)::bigint as n_dup_lines,
    coalesce((select c from cov where cov.n = d.n and k = 5), 0)::bigint as n_repeat_words,
    coalesce((select c from cov where cov.n = d.n and k = 10), 0) as c10,
    coalesce((select c from cov where cov.n = d.n and k = 101), 0) as c101 from d left join lines using (n))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
    not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * c10 <= 15 * n_words and c101 = 0 as kept from base
"""

ORACLE["op11_secret_scan"] = r"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
rules(no, kind, rx, grp, least) as (values
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', '()()AKIA[A-Z0-9]+', 0, 18), (2, 'hex', '()()[0-9a-f]+', 0, 16),
  (3, 'private', '()()-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----', 0, 1),
  (4, 'jwt', '()()eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0, 1),
  (5, 'forge', '()()gh[opsu]_[A-Za-z0-9]{36,}', 0, 1), (6, 'chat', '()()xox[abprs]-[A-Za-z0-9-]{20,}', 0, 1),
  (7, 'cloud', '()()AIza[A-Za-z0-9_-]{35}', 0, 1), (8, 'payment', '()()[rs]k_live_[A-Za-z0-9]{20,}', 0, 1),
  (9, 'login', '()()://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D:@/]{6,}@', 0, 1)),
m as (select n, no, kind, least, unnest(regexp_split_to_array(text, rx)) as gap, unnest(regexp_extract_all(text, rx, 0)) as hit,
    unnest(case when grp = 2 then regexp_extract_all(text, rx, 2) else regexp_extract_all(text, rx, 0) end) as val,
    unnest(generate_series(1, len(regexp_split_to_array(text, rx)))) as i from d, rules),
placed as (select *, sum(length(gap) + length(hit)) over (partition by n, no order by i) as e from m where hit is not null),
s as (select n, no, kind, (e - length(hit))::bigint as b, e::bigint as e from placed where length(val) >= least),
l as (select n, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access, count(*) filter (no = 2) as n_hex,
    string_agg(kind || ':' || b || ':' || e, ',' order by b, no) filter (no < 3) as base, string_agg(kind || ':' || b || ':' || e, ',' order by b, no) as spans from s group by n)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join l using (n)
"""

ORACLE["op12_phrase_collocations"] = r"""
with t as (select row_number() over () as d, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
pc as (select d, lang, row_number() over () as p, piece from (select d, lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) as piece from t)),
ws as (select lang, p, regexp_extract_all(piece, '[^\x20\x09]+') as w from pc),
tot as (select lang, sum(len(w))::bigint as n from ws group by lang),
g as (select lang, k, gram, count(*)::bigint as f from (
    select lang, k, list_slice(w, i, i + k - 1) as gram from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from ws, (values (1), (2), (3), (4), (5)) as s(k) where len(w) >= k))
    group by lang, k, gram having count(*) >= 100),
cuts as (select g.lang, g.gram, g.k, g.f as a, c, x.f as l, y.f as r, n, (1000::hugeint * g.f * n) // (x.f::hugeint * y.f) as score
    from (select *, unnest(generate_series(1, k - 1)) as c from g where k > 1) g join tot using (lang)
    join g x on x.lang = g.lang and x.gram = list_slice(g.gram, 1, c) join g y on y.lang = g.lang and y.gram = list_slice(g.gram, c + 1, g.k)),
weak as (select * from cuts qualify row_number() over (partition by lang, gram order by score, c) = 1),
inside as (select distinct lang, list_slice(gram, i, i + m - 1) as gram, f from (
    select lang, gram, f, m, unnest(generate_series(1, k - m + 1)) as i from (select lang, gram, f, k, unnest(generate_series(2, k - 1)) as m from g where k > 2))),
kept as (select * from weak where not exists (select 1 from inside where inside.lang = weak.lang and inside.gram = weak.gram and 100 * inside.f >= 100 * weak.a)),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(gram, ' ')) as rank,
    array_to_string(gram, ' ') as phrase, a, l, r, n, score::bigint as score from kept)
select * from ranked where rank <= 2000
"""

# Integer components are exact as doubles, and so are their products here.
ORACLE["op13_hard_negatives"] = r"""
with e as (select row_number() over () as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as v from embeddings
    where label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
a as (select * from e where vec_id % 100 = 0),
s as (select a.n as an, a.vec_id as anchor_id, e.n as cn, e.vec_id, a.label = e.label as same, list_inner_product(a.v, e.v)::bigint as score from a, e where a.n <> e.n),
p as (select an, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by an order by score desc, vec_id) as k from s where same qualify k <= 5),
w as (select p.*, s.vec_id as negative_id, s.score as negative_score,
    (row_number() over (partition by p.an, p.k order by s.score desc, s.vec_id))::int as rank
    from p join s on p.an = s.an and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score qualify rank <= 10)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from w
"""
