"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS13 = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = rf"""with items as (select cast(item_id as varchar) as item, {WORDS13} as w from benchmark),
    windows as (select distinct item, least(len(w), 13) as size, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') as win
        from (select item, w, unnest(range(1, greatest(len(w) - 11, 2))) as k from items where len(w) > 0)),
    docs as (select row_number() over () as r, doc_id, {WORDS13} as w from documents),
    places as (select r, size, k, array_to_string(w[k : k + size - 1], ' ') as win from (select r, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) as k
        from docs, (select distinct size from windows))),
    hits as (select r, k, p.size, item from places p join windows using (size, win)),
    covered as (select r, count(distinct place) as n_hit from (select r, unnest(range(k, k + size)) as place from hits) group by r),
    found as (select r, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as names from hits group by r)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from docs left join covered using (r) left join found using (r)"""

# Five hexadecimal digits are four of base 32.
FIVE = "list_sum(list_transform(range(0, 5), lambda j: (instr('0123456789abcdef', substr(digest, g * 5 + j + 1, 1)) - 1) * (1 << (4 * (4 - j)))))"
FOUR = f"list_transform([{FIVE}], lambda v: array_to_string(list_transform(range(0, 4), lambda r: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (cast(v as bigint) >> (15 - 5 * r)) % 32 + 1, 1)), ''))[1]"
BASE32 = f"array_to_string(list_transform(range(0, 8), lambda g: {FOUR}), '')"

WARC = f"""with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as digest from pages),
    named as (select *, min(page_id) over (partition by body) as first from p)
    select page_id, cast(strlen(body) as bigint) as payload_bytes, {BASE32} as payload_digest, case when page_id <> first then 'revisit' else 'response' end as record_type,
        case when page_id <> first then first end as refers_to from named"""

QUALITY = r"""with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
    w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
    thirds as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from (select r, words, unnest(range(1, greatest(len(words) - 1, 1))) as i from w)),
    twice as (select r, i from (select *, count(*) over (partition by r, g) as c from thirds) where c > 1),
    covered as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from twice) group by r),
    counts as (select doc_id, source, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, len(lines) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        coalesce(n, 0) as n_repeat_words from w left join covered using (r)),
    judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        3 * n_symbols > n_words or 10 * n_dup_lines > 3 * n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words as soft_failed from counts),
    hosts as (select source, cast(count(*) as double) as n, cast(count(*) filter (base_failed or soft_failed) as double) as f from judged group by source),
    sums as (select count(*) as hosts, sum(n) as docs, sum(f) / sum(n) as m, sum(f * f / n) as rates, sum(n * n) as squares from hosts),
    spread as (select *, m * (1 - m) as spread, docs - squares / docs as scale, rates - docs * m * m - (hosts - 1) * m * (1 - m) as more from sums),
    prior as (select m, case when hosts < 2 then 5 when spread = 0 or scale <= 0 or more <= 0 then 1e6 else greatest(5, least(1e6, spread / (more / scale) - 1)) end as strength from spread),
    verdicts as (select source, (f + m * strength) / (n + strength) > 0.5 as poor from hosts, prior)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (poor and soft_failed) as kept, poor as host_poor
    from judged j join verdicts v on j.source is not distinct from v.source"""

# One step of the table of CRC-32, whose polynomial is a fixed value.
CRC_TABLE = "list_transform(range(0, 256), lambda b: list_reduce(list_concat([cast(b as bigint)], list_transform(range(0, 8), lambda k: cast(k as bigint))), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))"
ROLE_NEXT = [("u", 0, 2), ("u", 1, 2), ("u", 3, 2), ("a", 2, 3)]


def _insert(cells: list[str]) -> list[str]:
    """Cells of the states after one more insertion: each the least of itself and its forerunner's."""
    def more(cell, role):
        return f"{{'cost': {cell}.cost + 3, 'audit': {cell}.audit || 'I', 'lines': {cell}.lines || ['{role}:']}}"
    return [cells[0], cells[1], _least([cells[2], *(more(cells[k], "user") for k in (0, 1, 3))]), _least([cells[3], more(cells[2], "assistant")])]


def _least(cells: list[str]) -> str:
    return f"list_min(list_filter([{', '.join(cells)}], lambda x: x.cost is not null))"


def _edit(k: int) -> str:
    """The least cell of state k after one row: deleted, or emitted from a state before."""
    def cell(old, cost, edit, lines):
        return f"{{'cost': {cost}, 'audit': {old}.audit || '{edit}', 'lines': {old}.lines || {lines}}}"
    options = [cell(f"c{k}", f"c{k}.cost + 4", "D", "cast([] as varchar[])")]
    for initial, start, goal in [*ROLE_NEXT, ("s", 0, 1)]:
        if goal == k:
            keep = f"case when not dead and initial = '{initial}' then c{start}.cost + late end"
            options.append(cell(f"c{start}", keep, "K", "[role || ':' || t]"))
            if initial != "s":
                name = "user" if initial == "u" else "assistant"
                options.append(cell(f"c{start}", f"case when not dead then c{start}.cost + 3 + late end", "R", f"['{name}:' || t]"))
    return _least(options)


def _inserted(step: str, source: str, kept: str) -> str:
    """Two queries, each with one more insertion."""
    for number in (1, 2):
        cells = ", ".join(f"{cell} as c{k}" for k, cell in enumerate(_insert([f"c{k}" for k in range(4)])))
        step = f"(select {kept}, {cells} from {step if number > 1 else source})"
    return step


NOTHING = "{'cost': cast(null as bigint), 'audit': cast(null as varchar), 'lines': cast(null as varchar[])}"
CONVERSATIONS = rf"""with recursive crc as (select {CRC_TABLE} as steps),
    given as (select row_number() over () as r, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as t,
        coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
    marked as (select *, xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(name, ''), lambda x: cast(ascii(x) as bigint))),
        lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 20 as fault from given, crc),
    damaged as (select r, copy, conv_id, turn, case when fault = 4 then 'user' else role end as role,
        case when fault = 1 then '' when fault = 2 then regexp_replace(t, '[.!?]', '', 'g') else t end as t
        from (select *, unnest(case when fault = 0 then [] when fault = 3 then [0, 1] else [0] end) as copy from marked)),
    ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(t), role, r, copy) as i, substr(role, 1, 1) as initial from damaged),
    faults as (select *, case when not regexp_matches(t, '[^\x20\x09-\x0D]') then 'blank'
        when row_number() over (partition by conv_id, role, t order by i) > 1 then 'duplicate'
        when not regexp_matches(t, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
        lag(initial) over (partition by conv_id order by i) || initial as pair from ordered),
    ids as (select row_number() over () as c, conv_id from (select distinct conv_id from conversations)),
    numbered as (select c, i, role, t, initial, fault in ('blank', 'duplicate') as dead, case when fault = 'truncated' then 3 else 0 end as late
        from faults join ids on ids.conv_id is not distinct from faults.conv_id),
    sums as (select c, count(fault) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
        count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
        from ids left join faults on ids.conv_id is not distinct from faults.conv_id group by c),
    walk as (select c, cast(0 as bigint) as i, {{'cost': cast(0 as bigint), 'audit': '', 'lines': cast([] as varchar[])}} as c0, {NOTHING} as c1, {NOTHING} as c2, {NOTHING} as c3 from ids
        union all select c, i, {', '.join(f'{_edit(k)} as c{k}' for k in range(4))}
        from {_inserted('', '(select w.c, n.i, role, t, initial, dead, late, c0, c1, c2, c3 from walk w join numbered n on n.c = w.c and n.i = w.i + 1)', 'c, i, role, t, initial, dead, late')}),
    ends as (select c, {_least(['c0', 'c3'])} as best from {_inserted('', '(select w.c, w.i, c0, c1, c2, c3 from walk w join sums s on s.c = w.c and s.n = w.i)', 'c, i')})
    select conv_id, gaps, blank, duplicate, truncated, illegal, best.cost as cost, best.audit as audit, sha256(array_to_string(best.lines, chr(10))) as repaired_sha256
    from ids join sums using (c) join ends using (c)"""

TERMS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = rf"""with docs as (select row_number() over () as r, doc_id, {TERMS} as w from documents),
    items as (select row_number() over () as q, item_id, {TERMS} as w from benchmark),
    sums as (select count(*) filter (len(w) > 0) as n, sum(len(w)) as l from docs),
    counts as (select r, term, count(*) as tf from (select r, unnest(w) as term from docs) group by all),
    asked as (select q, term, count(*) as times from (select q, unnest(w) as term from items) group by all),
    weights as (select term, cast(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) as bigint) as weight from counts, sums group by term, n),
    lengths as (select r, doc_id, 75 + cast((25 * len(w) * n) // l as bigint) as m from docs, sums),
    scores as (select q, r, any_value(doc_id) as doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
        from asked join counts using (term) join weights using (term) join lengths using (r) group by q, r),
    ranked as (select *, cast(row_number() over (partition by q order by score desc, doc_id nulls last) as int) as rank from scores where score > 0)
    select item_id, rank, doc_id, score from ranked join items using (q) where rank <= 20"""

EXACT = """with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    g as (select *, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
        row_number() over (partition by t order by doc_id desc nulls last, r) as place from d)
    select doc_id, keep_id, group_size, place = 1 as kept, sha256(t) as text_sha256 from g"""

SQL = {"op11_ranked_search": SEARCH, "op6_decontaminate": DECONTAMINATE, "op7_warc": WARC, "op8_quality": QUALITY, "op12_exact_groups": EXACT, "op13_repair_conversations": CONVERSATIONS}
