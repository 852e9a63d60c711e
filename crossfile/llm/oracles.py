"""DuckDB SQL for the rows of the queries that SQL can express. They are for small tables: windows are written out as text."""

WORD = r"[^\x20\x09-\x0D]+"

#: Sets of shingles as sorted lists of text; classes of equal sets are joined on every shingle they share.
NGRAM_JOIN = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') w from documents),
s as (select doc_id, case when len(w) >= 3 then list_sort(list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)])) when len(w) > 0 then [array_to_string(w, ' ')] else [] end x from d),
named as (select doc_id, len(x) n, case when len(x) > 0 then md5(array_to_string(x, chr(10))) end name, x from s),
classes as (select name, any_value(n) n, any_value(x) x, count(*) class_size from named where name is not null group by name),
held as (select name, n, unnest(x) x from classes),
met as (select a.name a, b.name b, any_value(a.n) na, any_value(b.n) nb, count(*) c from held a join held b on a.x = b.x and a.name < b.name group by 1, 2),
links as (select a, b from met where 100 * c >= 90 * (na + nb - c)), both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select name, name from classes union select r.a, t.b from reach r join both_ways t on r.b = t.a),
least as (select r.a name, min(m.doc_id) component_id from reach r join named m on m.name = r.b group by 1),
degree as (select a name, count(*) n_links from both_ways group by 1)
select m.doc_id, cast(m.n as bigint) n_shingles, coalesce(l.component_id, m.doc_id) component_id, coalesce(g.n_links, 0) n_links, coalesce(c.class_size, 1) class_size
from named m left join least l on l.name = m.name left join degree g on g.name = m.name left join classes c on c.name = m.name"""

_GRAMS = (5, 6, 7, 8, 9, 10)
_LIMITS = (0.15, 0.14, 0.13, 0.12, 0.11, 0.10)

REPETITION = rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
words as (select r, len(w) n_words, coalesce(list_sum([length(x) for x in w]), 0) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols from d),
lines as (select r, line, count(*) k from (select r, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '{WORD}') group by 1, 2),
by_line as (select r, sum(k - 1) n_dup_lines, sum(case when k > 1 then k * length(line) else 0 end) dup_chars, sum(k * length(line)) line_chars from lines group by 1),
grams as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') g from d, unnest([{", ".join(map(str, _GRAMS))}]) a(k), unnest(range(1, len(w) - k + 2)) b(i)),
twice as (select r, k, i from (select *, count(*) over (partition by r, k, g) n from grams) where n > 1),
covered as (select distinct r, k, i + j pos from twice, unnest(range(k)) c(j)),
shares as (select c.r, {", ".join(f"sum(case when k = {k} then length(w[pos]) else 0 end) gram{k}" for k in _GRAMS)}, count(*) filter (k = 8) n_repeat_words from covered c join d on d.r = c.r group by 1),
m as (select d.doc_id, w.*, coalesce(l.n_dup_lines, 0) n_dup_lines, coalesce(s.n_repeat_words, 0) n_repeat_words, coalesce(l.dup_chars, 0) / greatest(coalesce(l.line_chars, 0), 1) line_share,
{", ".join(f"coalesce(s.gram{k}, 0) / greatest(w.word_chars, 1) gram{k}_share" for k in _GRAMS)}
from d join words w using (r) left join by_line l using (r) left join shares s using (r)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
not base_failed and line_share <= 0.2 and {" and ".join(f"gram{k}_share <= {x}" for k, x in zip(_GRAMS, _LIMITS, strict=True))} kept, {", ".join(f"gram{k}_share" for k in _GRAMS)}, line_share from f"""

RECOMPRESSION = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') k from d, unnest(range(1, len(w) - 11)) a(i)),
least as (select k, min(doc_id) first from windows group by 1),
gone as (select distinct doc_id, i + j pos from windows join least using (k), unnest(range(13)) b(j) where first < doc_id),
words as (select doc_id, unnest(range(1, len(w) + 1)) pos, unnest(w) word from d),
kept as (select w.doc_id, count(*) n, string_agg(word, ' ' order by w.pos) t from words w left join gone g on g.doc_id = w.doc_id and g.pos = w.pos where g.pos is null group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(len(w) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED_SEARCH = rf"""
with words as (select doc_id, row_number() over () r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') w from documents),
d as (select doc_id, r, len(w) n from words where len(w) > 0), c as (select count(*) docs, sum(n)::bigint terms from d),
tf as (select r, t, count(*) tf from (select r, unnest(w) t from words) group by all), df as (select t, count(*) df from tf group by t),
asked as (select item_id, t, count(*) times from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) t from benchmark) group by all),
weights as (select item_id, t, times, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) weight from asked join df using (t), c),
scores as (select item_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint score from weights join tf using (t) join d using (r), c group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) "rank" from scores join d using (r) where score > 0)
select item_id, cast("rank" as int) "rank", doc_id, score from ranked where "rank" <= 10"""

ORACLES: dict[str, str] = {"op1_ngram_join": NGRAM_JOIN, "op3_repetition": REPETITION, "op5_recompression": RECOMPRESSION, "op13_ranked_search": RANKED_SEARCH}
