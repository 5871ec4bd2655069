"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

from __future__ import annotations

from scorekit.llm import collocations, licences, repetition

SQL: dict[str, str] = {}

SQL["op3_mixing"] = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
per_source as (
  select source, sum(size)::bigint as source_size, 3 * sum(size)::bigint as cap,
    ((row_number() over (order by source nulls last) - 1) % 3 + 1)::double as weight
  from sized group by source),
-- Sources in the order in which they reach their limit; those in front of a level are full at it.
filled as (
  select *, coalesce(sum(cap) over w, 0)::double as full_before,
    (sum(weight) over () - coalesce(sum(weight) over w, 0)) as open_weight,
    (select sum(size) from sized)::double as total
  from per_source window w as (order by cap / weight, source rows between unbounded preceding and 1 preceding)),
levels as (select *, (total - full_before) / open_weight as level from filled),
level as (select arg_min(level, (cap / weight, source)) filter (level * weight <= cap) as level from levels),
target as (
  select source, source_size, case when l.level is null or l.level * weight > cap then cap::double else l.level * weight end as target
  from levels, level l),
budget as (select *, least(floor(target + 0.5)::bigint, 3 * source_size) as budget from target),
placed as (
  select s.doc_id, s.size, b.source_size, b.target, b.budget,
    (sum(s.size) over (partition by s.source order by md5(coalesce(s.doc_id::varchar, '')), s.doc_id
      rows between unbounded preceding and current row) - s.size) as start
  from sized s join budget b on s.source is not distinct from b.source)
select doc_id, size, source_size, target,
  (case when source_size = 0 then 0 else
    (budget // source_size) * size + greatest(0, least(size, budget % source_size - start)) end)::bigint as taken
from placed
"""

SQL["op8_exact_dedup"] = r"""
with rows as (
  select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  row_number() over w = 1 as kept, sha256(norm) as text_sha256
from rows window w as (partition by norm order by n desc, doc_id rows between unbounded preceding and unbounded following)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _licences() -> str:
    known = ", ".join(f"({_text(sentence)}, {_text(name)})" for sentence, name in licences.KNOWN.items())
    used_up = "ids"
    for licence, pattern in licences.RULES:
        used_up = f"regexp_replace({used_up}, {_text(pattern)}, {_text('{' + licence + '}')}, 'g')"
    return rf"""
with known(sentence, name) as (values {known}),
views as (
  select doc_id, 0 as wrapped, regexp_replace(coalesce(text, ''), '\n', chr(1), 'g') as body from documents
  union all
  select doc_id, 1, regexp_replace(coalesce(text, ''), '\n[\x09-\x0D\x20]*\n', chr(1), 'g') from documents),
cut as (
  select doc_id, wrapped, unnest(parts) as part, generate_subscripts(parts, 1) as n
  -- A point between v and its number ends no sentence.
  from (select *, string_split(replace(regexp_replace(
      regexp_replace(body, '\b([vV])\.([\x09-\x0D\x20]+[^A-Za-z0-9.\x01]*[0-9])', '\1' || chr(2) || '\2', 'g'),
      '([.!?;:])[\x09-\x0D\x20]+', '\1' || chr(1), 'g'), chr(2), '.'), chr(1)) as parts from views)),
normal as (
  select doc_id, wrapped, n, trim(regexp_replace(regexp_replace(
    translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', '\1', 'g'), ' ') as sentence
  from cut),
identified as (
  select doc_id, wrapped, n, case when k.name is not null then '<' || k.name || '>' else '<copyright>' end as id
  from normal left join known k using (sentence)
  where k.name is not null or (regexp_matches(sentence, '^(copyright( c)?|c copyright) (19|20)[0-9][0-9]\b'))),
sequences as (
  select doc_id, string_agg(id, '' order by n) filter (wrapped = 0) as lines, string_agg(id, '' order by n) filter (wrapped = 1) as wrapped
  from identified group by doc_id),
matched as (
  select doc_id, lines, wrapped, {used_up.replace("ids", "coalesce(lines, '')", 1)} as lines_found,
    {used_up.replace("ids", "coalesce(wrapped, '')", 1)} as wrapped_found
  from sequences),
lists as (
  select doc_id,
    regexp_extract_all(coalesce(lines, ''), '<([^>]*)>', 1) || regexp_extract_all(coalesce(wrapped, ''), '<([^>]*)>', 1) as s,
    regexp_extract_all(lines_found, '\{{([^}}]*)\}}', 1) || regexp_extract_all(wrapped_found, '\{{([^}}]*)\}}', 1) as l,
    regexp_extract_all(lines_found, '<([^>]*)>', 1) || regexp_extract_all(wrapped_found, '<([^>]*)>', 1) as u
  from matched)
select doc_id,
  coalesce(array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ' '), '') as sentences,
  coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' '), '') as licences,
  coalesce(array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ' '), '') as unmatched
from documents left join lists using (doc_id)
"""


SQL["op4_licences"] = _licences()


def _repetition() -> str:
    """Windows as texts, counted one by one."""
    windows, inside, sums, limits = [], [], [], [f"100 * dup_line_chars > {repetition.LINE_LIMIT} * word_chars"]
    for n, limit in repetition.LIMITS.items():
        windows.append(
            f"case when pos + {n - 1} <= n_words then string_agg(w, ' ') over (partition by r order by pos rows between "
            f"current row and {n - 1} following) end as w{n}"
        )
        inside.append(
            f"coalesce(max(again{n}) over (partition by r order by pos rows between {n - 1} preceding and current row), 0) as in{n}"
        )
        sums.append(f"coalesce(sum(length(w)) filter (in{n} = 1), 0)::bigint as dup_{n}_chars")
        limits.append(f"100 * dup_{n}_chars > {limit} * word_chars")
    again = [
        f"case when w{n} is not null and row_number() over (partition by r, w{n} order by pos) > 1 then 1 else 0 end as again{n}"
        for n in repetition.LIMITS
    ]
    base = repetition.BASE_LENGTH
    names = ", ".join(f"dup_{n}_chars" for n in repetition.LIMITS)
    return rf"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
words as (
  select r, unnest(ws) as w, generate_subscripts(ws, 1) as pos, len(ws) as n_words from docs),
windows as (select *, {", ".join(windows)} from words),
marked as (
  select *, {", ".join(again)},
    case when w{base} is not null and count(*) over (partition by r, w{base}) > 1 then 1 else 0 end as twice from windows),
covered as (
  select *, {", ".join(inside)},
    max(twice) over (partition by r order by pos rows between {base - 1} preceding and current row) as in_twice from marked),
per_doc as (
  select r, count(*) as n_words, sum(length(w))::bigint as word_chars, sum(in_twice)::bigint as n_repeat_words, {", ".join(sums)}
  from covered group by r),
lines as (
  select r, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) as chars,
    row_number() over (partition by r, line) > 1 as again
  from (select r, unnest(string_split(text, chr(10))) as line from docs)),
per_line as (
  select r, count(*) as n_dup_lines, sum(chars)::bigint as dup_line_chars from lines where again and chars > 0 group by r),
measured as (
  select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(dup_line_chars, 0)::bigint as dup_line_chars,
    {", ".join(f"coalesce({m.strip()}, 0)::bigint as {m.strip()}" for m in names.split(","))}
  from docs left join per_doc using (r) left join per_line using (r)),
judged as (
  select *, n_words < {repetition.LEAST_WORDS} or 100 * n_repeat_words > {repetition.BASE_LIMIT} * n_words as base_failed
  from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(limits)}) as kept, dup_line_chars, {names}
from judged
"""


SQL["op13_repetition"] = _repetition()


def _collocations() -> str:
    """Phrases of each length counted one by one."""
    longest, least = collocations.LONGEST, collocations.LEAST
    leads = ", ".join(f"lead(w, {k}) over (partition by r, piece order by pos) as w{k + 1}" for k in range(1, longest))
    every = " union all ".join(
        f"select lang, {k} as size, concat_ws(' ', {', '.join(f'w{i}' for i in range(1, k + 1))}) as phrase, count(*) as f "
        f"from leads where w{k} is not null group by all having count(*) >= {least}"
        for k in range(1, longest + 1)
    )
    return rf"""
with docs as (
  select row_number() over () as r, coalesce(lang, '{collocations.UNKNOWN}') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (
  select r, lang, unnest(p) as body, generate_subscripts(p, 1) as piece
  from (select r, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') as p from docs)),
words as (
  select r, lang, piece, unnest(ws) as w1, generate_subscripts(ws, 1) as pos
  from (select r, lang, piece, regexp_extract_all(body, '[^\x20\x09]+') as ws from pieces)),
leads as (select lang, w1, {leads.replace("lead(w,", "lead(w1,")} from words),
totals as (select lang, count(*) as n from words group by lang),
phrases as ({every}),
candidates as (select *, string_split(phrase, ' ') as ws from phrases where size >= 2),
cuts as (
  select lang, phrase, f as a, k, array_to_string(ws[1:k], ' ') as first, array_to_string(ws[k + 1:], ' ') as rest
  from (select *, unnest(range(1, size)) as k from candidates)),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n,
    ((1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join phrases x on x.lang = c.lang and x.phrase = c.first join phrases y on y.lang = c.lang and y.phrase = c.rest
    join totals t on t.lang = c.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_parts as (
  select lang, f, array_to_string(ws[i:i + m - 1], ' ') as phrase
  from (select *, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from candidates))),
covered as (select lang, phrase, max(f) as f from inner_parts group by all),
kept as (
  select * from lowest where not exists (
    select 1 from covered c where c.lang = lowest.lang and c.phrase = lowest.phrase and 100 * c.f >= {collocations.INSIDE} * lowest.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= {collocations.TOP}
"""


SQL["op11_collocations"] = _collocations()
