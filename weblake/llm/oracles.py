"""SQL (DuckDB) for the queries of this subpackage that SQL can express."""

from __future__ import annotations

# Words [^\x20\x09-\x0D]+ of a text.
_WORDS = "list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""with d as (select doc_id, {_WORDS.format(text="text")} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 18)) as start from d where len(w) >= 20),
windows as (select doc_id, start, sha256(array_to_string(w[start:start + 19], ' ')) as path from starts),
ranked as (select doc_id, start, row_number() over (partition by path order by doc_id, start) as nth from windows),
gone as (select distinct doc_id, start + j as pos from ranked, unnest(range(0, 20)) as t(j) where nth > 1),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
kept as (select words.doc_id, string_agg(word, ' ' order by pos) as text, count(*) as n
 from words anti join gone on gone.doc_id = words.doc_id and gone.pos = words.pos group by words.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
 sha256(coalesce(text, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id"""

MINHASH_JOIN = f"""with recursive d as (select doc_id, {_WORDS.format(text=_LOWER)} as w from documents),
sets as (select doc_id, case when len(w) >= 3
  then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from d),
shingles as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id
 group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from d
 union select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.other),
lowest as (select doc_id, min(other) as component_id from reach group by doc_id)
select sets.doc_id, cast(len(s) as bigint) as n_shingles, component_id, sets.doc_id = component_id as kept
from sets join lowest on lowest.doc_id = sets.doc_id"""


# crc32 of a text's UTF-8: the register starts full; each byte enters once and is shifted out bit by bit.
_CRC32 = """xor(list_reduce(list_concat([cast(4294967295 as bigint)], flatten(list_transform(range(1, length(hex(encode({text}))), 2),
 lambda i: [cast(16 * (instr('0123456789ABCDEF', substr(hex(encode({text})), i, 1)) - 1)
  + instr('0123456789ABCDEF', substr(hex(encode({text})), i + 1, 1)) - 1 as bigint), 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"""

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Inserts lead from p to q; other edits follow.
CONVERSATION_REPAIR = f"""with recursive t as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
 coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
drawn as (select *, {_CRC32.format(text="name")} % 20 as draw from t),
damaged as (select conv_id, turn, case draw when 4 then 'user' else role end as role,
 case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
 unnest(case draw when 0 then [] when 3 then [1, 2] else [1] end) as copy from drawn),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as place,
 rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by place) as nth,
 lag(left(role, 1)) over (partition by conv_id order by place) as before from placed),
faults as (select *, case when trimmed = '' then 'b' when nth > 1 then 'd' when right(trimmed, 1) not in ('.', '!', '?') then 't' else 'k' end
 as fault from seen),
inserts(p, q, i) as (values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
edits(p, q, edit, initial) as (values (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'),
 (1, 2, 'K', 'u'), (2, 3, 'K', 'a'), (3, 2, 'K', 'u'), (0, 2, 'R', ''), (1, 2, 'R', ''), (2, 3, 'R', ''), (3, 2, 'R', '')),
paths(conv_id, place, state, best) as (
 select distinct conv_id, cast(0 as bigint), 0, {{'cost': cast(0 as bigint), 'audit': '', 'lines': cast([] as varchar[])}} from faults
 union all
 select paths.conv_id, paths.place + 1, edits.q, min({{'cost': best.cost + 3 * i + case edit when 'D' then 4 when 'R' then 3 else 0 end
   + case when edit <> 'D' and fault = 't' then 3 else 0 end,
  'audit': best.audit || repeat('I', i) || edit,
  'lines': list_concat(best.lines, case when i = 0 then [] when i = 2 then ['user:', 'assistant:'] when inserts.q = 2 then ['user:'] else ['assistant:'] end,
   case edit when 'D' then [] when 'K' then [role || ':' || text] else [case edits.q when 2 then 'user:' else 'assistant:' end || text] end)}})
 from paths join faults on faults.conv_id is not distinct from paths.conv_id and faults.place = paths.place + 1
 join inserts on inserts.p = state join edits on edits.p = inserts.q
  and (edit = 'D' or fault in ('k', 't') and (edit = 'R' or initial = left(role, 1)))
 group by paths.conv_id, paths.place, edits.q),
sizes as (select conv_id, max(place) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
 count(*) filter (fault = 'b') as blank, count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
 count(*) filter (before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal from faults group by conv_id),
ends as (select paths.conv_id, min({{'cost': best.cost + 3 * i, 'audit': best.audit || repeat('I', i),
  'lines': list_concat(best.lines, case when i = 0 then [] when i = 2 then ['user:', 'assistant:'] else ['assistant:'] end)}}) as best
 from paths join sizes on sizes.conv_id is not distinct from paths.conv_id and n = paths.place join inserts on inserts.p = state
 where inserts.q = 3 or inserts.q = 0 group by paths.conv_id),
names as (select distinct conv_id from conversations)
select names.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
 coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit,
 sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from names left join sizes on sizes.conv_id is not distinct from names.conv_id left join ends on ends.conv_id is not distinct from names.conv_id"""

SPELLING = f"""with recursive runs as (select coalesce(cast(doc_id as varchar), '') || ':' as prefix,
 unnest(regexp_extract_all(coalesce({_LOWER}, ''), '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
counted as (select prefix, run, count(*) as n from runs where length(run) >= 7 group by prefix, run),
hashed as (select run, n, {_CRC32.format(text="prefix || run")} as h from counted),
damaged as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2)
 else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from damaged where length(word) >= 7 group by word having sum(n) >= 2),
cuts as (select word, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) as rest
 from (select word, unnest(range(1, length(word) + 1)) as pos from words)),
links as (select a.word, b.word as near from cuts a join cuts b on a.pos = b.pos and a.rest = b.rest and a.word <> b.word
 union select cuts.word, rest from cuts join words on words.word = rest
 union select rest, cuts.word from cuts join words on words.word = rest),
ranked as (select links.word, near, near_words.n as near_n, count(*) over (partition by links.word) as n_near,
 row_number() over (partition by links.word order by near_words.n desc, near) as nth
 from links join words near_words on near_words.word = near),
forms as (select words.word, words.n, coalesce(n_near, 0) as n_near,
 case when near_n >= 10 * words.n then near end as form, case when near_n >= 10 * words.n then near_n end as form_n
 from words left join ranked on ranked.word = words.word and nth = 1),
follow(word, root) as (select word, word from forms union all
 select follow.word, form from follow join forms on forms.word = root where form is not null)
select forms.word, form, root, n, n_near, form_n
from forms join (select follow.word, root from follow join forms on forms.word = root where form is null) f on f.word = forms.word"""


def statements() -> dict[str, str]:
    return {
        "op5_substring_dedup": SUBSTRING_DEDUP,
        "op8_minhash_join": MINHASH_JOIN,
        "op11_conversation_repair": CONVERSATION_REPAIR,
        "op12_spelling_variants": SPELLING,
    }
