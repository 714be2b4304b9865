"""SQL with the same result as the registered queries, where SQL can express it."""

from __future__ import annotations

_URL = """
    with parts as (
        select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
    ), hosts as (
        select page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw, coalesce(rest, '') as rest from parts
    ), judged as (
        select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
        from hosts
    ), rules(rule_host, rule_path, verdict) as (
        values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    )
    select page_id, host, path,
        (select rule_host || rule_path from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
         order by length(rule_host || rule_path) desc limit 1) as rule,
        coalesce((select verdict from rules where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
         order by length(rule_host || rule_path) desc limit 1), 'allow') as verdict
    from judged
"""

_EXACT = """
    with bodies as (
        select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body, length(coalesce(text, '')) as chars from documents
    ), ranked as (
        select *, first_value(doc_id) over (partition by body order by chars desc, doc_id) as keep_id, count(*) over (partition by body) as group_size from bodies
    )
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from ranked
"""

_LEAKS = """
    with doc_lists as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
        from documents
    ), item_lists as (
        select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
        from benchmark
    ), item_starts as (
        select item_id, words, least(10, len(words)) as n, unnest(range(1, greatest(1, len(words) - 9) + 1)) as s from item_lists where len(words) > 0
    ), item_windows as (
        select distinct item_id, n, array_to_string(words[s:s + n - 1], ' ') as w from item_starts
    ), sizes as (select distinct n from item_windows
    ), doc_starts as (
        select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as s from doc_lists, sizes where len(words) >= n
    ), found as (
        select doc_id, s, d.n, item_id from (select doc_id, s, n, array_to_string(words[s:s + n - 1], ' ') as w from doc_starts) d
        join item_windows i on d.n = i.n and d.w = i.w
    ), hits as (
        select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from found) group by doc_id
    ), items as (
        select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
        from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
    )
    select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
        sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from doc_lists left join hits using (doc_id) left join items using (doc_id)
"""

_WINDOWS = """
    with lists as (
        select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
    ), starts as (
        select doc_id, words, unnest(range(1, len(words) - 33)) as s from lists where len(words) >= 35
    ), windows as (
        select doc_id, s, array_to_string(words[s:s + 34], ' ') as w from starts
    ), often as (
        select w from windows group by w having count(*) > 1
    ), gone as (
        select distinct doc_id, unnest(range(s, s + 35)) as p from windows semi join often using (w)
    ), gone_lists as (
        select doc_id, list(p) as ps from gone group by doc_id
    ), kept as (
        select doc_id, len(words) as n, coalesce(len(ps), 0) as removed, words, ps from lists left join gone_lists using (doc_id)
    ), left_over as (
        select doc_id, string_agg(word, ' ' order by p) as body
        from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from lists) anti join gone using (doc_id, p) group by doc_id
    )
    select doc_id, cast(n as bigint) as n_words, cast(removed as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
    from kept left join left_over using (doc_id)
"""

_NOTICES = """
    with known(licence, form) as (
        values ('MIT', 'released under the mit license'), ('MIT', 'licensed under the mit license'),
            ('Apache-2.0', 'licensed under the apache license version 2 0'),
            ('GPL-3.0-only', 'this work is licensed under the gnu general public license version 3'),
            ('CC-BY-NC-4.0', 'licensed under cc by nc 4 0'), ('CC-BY-4.0', 'licensed under cc by 4 0'), ('CC-BY-SA-4.0', 'licensed under cc by sa 4 0'),
            ('CC0-1.0', 'released under cc0 1 0'), ('BSD-3-Clause', 'licensed under the bsd 3 clause license')
    ), lines as (
        select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, false as entire from documents
        union all select doc_id, coalesce(text, ''), true from documents
    ), forms as (
        select doc_id, entire, trim(regexp_replace(regexp_replace(
            lower(line), '(?m)^[^\\p{L}\\p{N}\\n]*(copyright\\b|\\(c\\)|©)[^\\n]*$', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) as form
        from lines where not contains(line, '&')
    ), found as (
        select doc_id, entire, licence from (
            select doc_id, entire, trim(replace(replace(replace(replace(
                ' ' || form || ' ', ' licence ', ' license '), ' licenced ', ' licensed '), ' non commercial ', ' noncommercial '), ' ver ', ' version ')) as form
            from forms) join known using (form)
    ), named as (
        select doc_id, max(licence) filter (entire) as whole, count(*) filter (not entire) as n_lines, string_agg(distinct licence, ',' order by licence) as licences
        from found group by doc_id
    )
    select doc_id, whole, coalesce(n_lines, 0) as n_lines, coalesce(licences, '') as licences from documents left join named using (doc_id)
"""

_HOSTS = """
    with lists as (
        select doc_id, coalesce(source, '') as host, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents
    ), windows as (
        select doc_id, s, array_to_string(words[s:s + 4], ' ') as w
        from (select doc_id, words, unnest(range(1, len(words) - 3)) as s from lists where len(words) >= 5)
    ), often as (
        select doc_id, w from windows group by all having count(*) > 1
    ), covered as (
        select doc_id, count(distinct p) as n_repeat_words
        from (select doc_id, unnest(range(s, s + 5)) as p from windows semi join often using (doc_id, w)) group by doc_id
    ), lines as (
        select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
        from (select doc_id, unnest(string_split(body, chr(10))) as line from lists) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id
    ), measured as (
        select doc_id, host, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
            cast(len(regexp_extract_all(body, '[#*$%&|<>]')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
            coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines
        from lists left join covered using (doc_id) left join lines using (doc_id)
    ), failures as (
        select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measured
    ), by_rule as (
        select host, rule, count(*) as n, sum(cast(failed as int)) as k
        from (select host, unnest(['base', 'symbols', 'lines', 'lengths']) as rule,
            unnest([base_failed, 100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 30 * n_lines, word_chars < 2 * n_words or word_chars > 12 * n_words]) as failed from failures)
        group by host, rule
    ), totals as (
        select rule, count(*) as h, sum(n) as sn, sum(n * n) as snn, sum(k) as sk, sum(cast(k as double) * k / n) as skk, cast(sum(k) as double) / sum(n) as rate from by_rule group by rule
    ), priors as (
        select rule, rate, coalesce(least(1, greatest(0, (skk - sk * rate - (h - 1) * rate * (1 - rate)) / nullif(rate * (1 - rate) * (sn - cast(snn as double) / sn - (h - 1)), 0))), 0) as rho
        from totals
    ), rejected as (
        select distinct host from by_rule join priors using (rule) where (rho * k + (1 - rho) * rate) / (rho * n + 1 - rho) > 0.5
    )
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and host not in (from rejected) as kept, n_lines, host in (from rejected) as host_rejected
    from failures
"""

_DIVERGENCE = """
    with docs as (
        select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as body from documents
    ), terms as (
        select r, lang, source, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs
    ), kept as (
        select lang, term, count(*) as lc from terms group by lang, term having count(distinct r) >= 10
    ), counts as (
        select lang, source, term, count(*) as gc from terms semi join kept using (lang, term) group by all
    ), langs as (
        select lang, count(*) as v, sum(lc) as n_lang from kept group by lang
    ), groups as (
        select * from (select distinct lang, source from docs) left join langs using (lang) left join (select lang, source, sum(gc) as n from counts group by all) using (lang, source)
    ), rated as (
        select g.lang, g.source, k.term, coalesce(c.gc, 0) as gc, 1 + (1000000000::hugeint * (coalesce(c.gc, 0) + 2)) // (coalesce(n, 0) + 2 * v) as p,
            1 + (1000000000::hugeint * (lc + 2)) // (n_lang + 2 * v) as q
        from groups g join kept k using (lang) left join counts c on g.lang = c.lang and g.source = c.source and k.term = c.term
    ), pairs as (
        select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
        from rated a join rated b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
    ), all_pairs as (
        select a.lang, a.source, b.source as item, coalesce(value, 0) as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
    ), of_terms as (
        select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from rated where gc > 0 and p > q
    ), ranked as (
        select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from all_pairs
        union all
        select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from of_terms qualify rank <= 10
    )
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked
"""

# crc32 bit by bit: every character enters with its first bit
_TRIE = """
    with turns as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
    ), numbered as (
        select conv_id, role, text, row_number() over (
            partition by conv_id order by turn nulls first, substr(sha256(length(role) || ':' || role || text), 1, 32)) as place from turns
    ), owned as (
        select conv_id, count(*) as own, (xor(list_reduce(list_prepend(4294967295::bigint,
            flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: [ord(ch)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
            lambda crc, x: xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1))), 4294967295)) % 6 as h
        from numbered group by conv_id
    ), convs as (
        select c.conv_id, c.h, c.conv_id - c.conv_id % 100 as base, least(c.h, coalesce(b.own, 0)) as given from owned c left join owned b on b.conv_id = c.conv_id - c.conv_id % 100
    ), rebuilt as (
        select conv_id, given + place - h as depth, role, text from convs join numbered using (conv_id) where place > h
        union all select c.conv_id, place, role, text from convs c join numbered n on n.conv_id = base where place <= given
    ), paths as (
        select conv_id, depth, length(text) as chars,
            string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by depth) as key from rebuilt
        union all select conv_id, 0, 0, '' from convs
    ), linked as (
        select *, lag(key) over (partition by conv_id order by depth) as parent, depth = max(depth) over (partition by conv_id) as ends from paths
    ), nodes as (
        select depth, key, min(conv_id) as conv_id, count(*) as n_convs, min(chars) as chars, min(parent) as parent,
            coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as listed from linked group by depth, key
    ), children as (
        select depth - 1 as depth, parent as key, count(*) as n_children from nodes where depth > 0 group by all
    ), counted as (
        select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (depth, key)
    ), under as (
        select distinct a.depth, a.key, b.depth as low, b.key as below from paths a join paths b on a.conv_id = b.conv_id and b.depth >= a.depth
    ), sums as (
        select u.depth, u.key, count(*) filter (n_children = 0) as n_leaves, cast(sum((n_convs - 1) * chars) as bigint) as saved_tokens
        from under u join counted c on c.depth = low and c.key = below group by u.depth, u.key
    )
    select cast(c.conv_id as bigint) as conv_id, cast(c.depth as bigint) as depth, cast(p.conv_id as bigint) as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, sha256(c.listed) as ends_sha256
    from counted c join sums using (depth, key) left join nodes p on p.depth = c.depth - 1 and p.key = c.parent
"""

ORACLE: dict[str, str] = {
    "op2_url_filter": _URL,
    "op3_exact_dedup": _EXACT,
    "op4_decontaminate": _LEAKS,
    "op6_licences": _NOTICES,
    "op10_substring_dedup": _WINDOWS,
    "op11_host_rules": _HOSTS,
    "op12_conversation_trie": _TRIE,
    "op13_source_divergence": _DIVERGENCE,
}
