"""The SQL that must give the same rows, for operators that SQL can express."""

from __future__ import annotations

# n_repeat_words: positions in a 3-word window that stands twice or more in its text.
QUALITY_RULES = r"""
with words as (
    select row_number() over () as row_id, doc_id, source, coalesce(text, '') as text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), windows as (
    select row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram
    from (select row_id, w, unnest(range(1, len(w) - 1)) as i from words)
), often as (
    select row_id, i from (select row_id, i, count(*) over (partition by row_id, gram) as n from windows) where n > 1
), inside as (
    select row_id, count(distinct i + j) as n_repeat_words
    from often, (select unnest([0, 1, 2]) as j) group by row_id
), lines as (
    select row_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
    from (select row_id, unnest(string_split(text, chr(10))) as line from words)
    where regexp_matches(line, '[^\x20\x09-\x0D]') group by row_id
), counted as (
    select doc_id, source, len(w) as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
        coalesce(n_repeat_words, 0) as n_repeat_words
    from words left join lines using (row_id) left join inside using (row_id)
), failed as (
    select *, n_words < 50 as f1, 100 * n_repeat_words > 50 * n_words as f2, 10 * n_symbols > n_words as f3,
        10 * n_dup_lines > 3 * n_lines as f4, word_chars < 3 * n_words or word_chars > 10 * n_words as f5
    from counted
), tall as (
    select source, unnest([1, 2, 3, 4, 5]) as rule, unnest([f1, f2, f3, f4, f5]) as f from failed
), hosts as (
    select source, rule, count(*) as n, count(*) filter (f) as k from tall group by all
), means as (
    select rule, sum(n) as docs, count(*) as hosts, sum(k) / sum(n) as m from hosts group by rule
), prior as (
    select rule, m, case when beyond > 0 then least(greatest(m * (1 - m) / beyond - 1, 1), 10000) else 10000 end as weight
    from (
        select rule, m, sum(n * (k / n - m) ** 2) / docs - m * (1 - m) * means.hosts / docs as beyond
        from hosts join means using (rule) group by rule, m, docs, means.hosts
    )
), bad as (
    select source, bool_or(rule = 1) as b1, bool_or(rule = 2) as b2, bool_or(rule = 3) as b3,
        bool_or(rule = 4) as b4, bool_or(rule = 5) as b5
    from hosts join prior using (rule) where (k + m * weight) / (n + weight) >= 0.3 group by source
)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, f1 or f2 as base_failed,
    not (f1 or f2 or (coalesce(b1, false) and f1) or (coalesce(b2, false) and f2) or (coalesce(b3, false) and f3)
        or (coalesce(b4, false) and f4) or (coalesce(b5, false) and f5)) as kept
from failed left join bad on failed.source is not distinct from bad.source
"""

# The inverted demands of the three schedules, solved by hand.
MIXING = r"""
with sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
        md5(coalesce(doc_id::varchar, '')) as place, md5(coalesce(text, '')) as digest
    from documents
), sources as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as r
    from sized group by source
), weighted as (
    select *, [3, 1, 2][1 + r % 3] as weight, r % 3 as cycle, 2 * source_size as top from sources
), filled as (
    select *, 1.5 * sum(source_size) over () - coalesce(sum(top) over (
            order by top / weight, r rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(weight) over (order by top / weight, r rows between current row and unbounded following) as units
    from weighted
), level as (
    select rest::double as rest, units::double as units from filled
    where weight * rest::double / units::double <= top order by top / weight, r limit 1
), goals as (
    select source, source_size, cycle, case when weight * level.rest / level.units > top then top::double
        else weight * level.rest / level.units end as target
    from weighted left join level on true
), placed as (
    select *, coalesce(sum(size) over (partition by source order by place, doc_id, size, digest
        rows between unbounded preceding and 1 preceding), 0) as begin
    from sized
), taken as (
    select doc_id, size, source_size, target, cycle, begin, begin + source_size as again_begin,
        greatest(least(begin + size, floor(target)) - begin, 0)::bigint as first,
        greatest(least(begin + source_size + size, floor(target)) - begin - source_size, 0)::bigint as again
    from placed join goals on placed.source is not distinct from goals.source
), shares as (
    select *, (begin + first / 2) / target as u, (again_begin + again / 2) / target as v from taken
)
select doc_id, size, source_size, target, first + again as taken,
    case when first > 0 then round(case cycle when 0 then 2 * u / (1.5 + sqrt(2.25 - 2 * u))
        when 1 then 2 * u / (0.5 + sqrt(0.25 + 2 * u)) else u end, 6) end as position,
    case when again > 0 then round(case cycle when 0 then 2 * v / (1.5 + sqrt(2.25 - 2 * v))
        when 1 then 2 * v / (0.5 + sqrt(0.25 + 2 * v)) else v end, 6) end as again_position
from shares
"""

CHAT = r"""
with turns as (
    select conv_id, turn, coalesce(role, 'unknown') as role, replace(coalesce(text, ''), '<|', '< |') as body,
        md5(coalesce(text, '')) as digest
    from conversations
), speakers as (
    select distinct conv_id, role as speaker from turns where role <> 'system'
), shown as (
    select turns.*, speaker, body || '<|end|>' || chr(10) as said,
        case when role = 'system' then '<|system|>' when role = speaker then '<|assistant|>'
            else '<|user name=' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' end || chr(10) as head
    from turns join speakers on turns.conv_id is not distinct from speakers.conv_id
), placed as (
    select *, coalesce(sum(length(head) + length(said)) over (partition by conv_id, speaker
        order by turn nulls first, role, digest rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from shown
), parts as (
    select *, start // 262144 as part, min(start) over (partition by conv_id, speaker, start // 262144) as origin
    from placed
)
select conv_id, speaker, part, count(*) as n_messages,
    string_agg(head || said, '' order by start, turn nulls first, role, digest) as text,
    coalesce(string_agg((start - origin + length(head)) || '-' || (start - origin + length(head) + length(said) - 1),
        ',' order by start) filter (role = speaker), '') as mask
from parts group by conv_id, speaker, part
"""
