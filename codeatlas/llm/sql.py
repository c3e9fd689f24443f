"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from . import phrases, pii, quality, spelling, warc

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys([*quality.STOP_WORDS, *[w.capitalize() for w in quality.STOP_WORDS]]))

_RULES = " or ".join(
    f"coalesce({' or '.join(part)}, false)"
    for r in quality.RULES
    for part in [[f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None)]
)

QUALITY = rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (select rid, unnest(range(1, len(words) - 6)) as i, words from d where len(words) >= 8),
repeated as (
  select rid, unnest(places) as i from (
    select rid, array_to_string(words[i:i+7], ' ') as w, list(i) as places from windows group by rid, w having count(*) > 1)),
covered as (select rid, count(distinct i + k) as n from repeated, range(0, 8) r(k) group by rid),
m as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(len(array_to_string(words, '')) as bigint) as word_chars,
    cast(len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, len(lines) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    len(list_filter(words, lambda w: w in ({_STOP}))) as n_stop_words, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from d left join covered c using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not ({_RULES}) as kept
from m
"""


def _pii() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    code = "replace(m, ' ', '')"
    luhn = (
        f"list_sum(list_transform(range(0, len({digits})), lambda i: case when i % 2 = 0 then cast({digits}[len({digits}) - i] as int)"
        f" when cast({digits}[len({digits}) - i] as int) > 4 then cast({digits}[len({digits}) - i] as int) * 2 - 9"
        f" else cast({digits}[len({digits}) - i] as int) * 2 end)) % 10 = 0"
    )
    turned = f"({code}[5:] || {code}[1:4])"
    value = f"regexp_replace(array_to_string(list_transform(string_split({turned}, ''), lambda c: case when c >= 'A' then cast(ascii(c) - 55 as varchar) else c end), ''), '[^0-9]', '', 'g')"
    mod97 = f"list_reduce(list_prepend(0, list_transform(string_split({value}, ''), lambda c: cast(c as bigint))), lambda n, c: (n * 10 + c) % 97) = 1"
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255)) = 0",
        "card": f"case when len({digits}) between 14 and 19 then {luhn} else false end",
        "phone": f"len({digits}) between 10 and 15",
        "iban": f"case when len({code}) between 15 and 34 then {mod97} else false end",
    }
    parts = []
    for rank, (kind, pattern) in enumerate(plain.items()):
        parts.append(f"""
  select rid, {rank} as rank, '{kind}' as kind, start, start + len(m) as stop from (
    select rid, unnest(hits) as m, unnest(list_transform(range(1, len(hits) + 1), lambda i:
        coalesce(list_sum(list_transform(gaps[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: len(h))), 0))) as start
    from (select rid, regexp_extract_all(t, '{pattern}') as hits, regexp_split_to_array(t, '{pattern}') as gaps from d)
  ) where {valid[kind]}""")
    local = next(k for k in pii.KINDS if k.name == "local_phone")
    shape, near = r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}", local.near
    parts.append(f"""
  select rid, 5 as rank, 'local_phone' as kind, start, stop from (
    select rid, start, start + len(m) as stop, t, m from (
      select rid, t, unnest(hits) as m, unnest(list_transform(range(1, len(hits) + 1), lambda i:
        coalesce(list_sum(list_transform(gaps[1:i], lambda g: len(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: len(h))), 0))) as start
      from (select rid, t, regexp_extract_all(t, '{shape}') as hits, regexp_split_to_array(t, '{shape}') as gaps from d)))
  where not regexp_matches(t[start:start], '[0-9+(]') and not regexp_matches(t[stop+1:stop+1], '[0-9]')
    and regexp_matches(t[greatest(start - {pii.CONTEXT}, 0) + 1:start], '{near}')""")
    spans = "\n  union all".join(parts)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
s as ({spans}),
g as (
  select rid, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
    count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank) filter (rank < 4) as base,
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, rank) as spans
  from s group by rid)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (rid)
"""


WARC = f"""
select page_id, cast(strlen(t) as bigint) as payload_bytes, sha256(t) as payload_digest,
  case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
from (
  select page_id, t, first, strlen(t) >= {warc.LEAST} and place > 1 as again from (
    select page_id, t, min(page_id) over (partition by t) as first,
      row_number() over (partition by t order by page_id nulls last, url nulls last) as place
    from (select page_id, url, coalesce(html, '') as t from pages)))
"""

PHRASES = rf"""
with w as (
  select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from (
    select coalesce(lang, 'und') as lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents)),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i+k-1], ' '))) as phrase from w, range(1, {phrases.LONGEST + 1}) s(k)),
f as (select lang, phrase, k, count(*) as a from g group by all having a >= {phrases.LEAST}),
t as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where k >= 2),
inner_ as (select distinct lang, a, array_to_string(ws[i:i+m-1], ' ') as phrase from c, range(2, {phrases.LONGEST}) x(m), range(1, {phrases.LONGEST}) y(i) where m < k and i <= k - m + 1),
kept as (select * from c anti join (select lang, phrase, max(a) as longer from inner_ group by all) i on c.lang = i.lang and c.phrase = i.phrase and 100 * i.longer >= 100 * c.a),
cuts as (
  select kept.*, cut, h.a as l, e.a as r, n, cast((1000::hugeint * kept.a * n) // (h.a::hugeint * e.a) as bigint) as score
  from kept, range(1, {phrases.LONGEST}) x(cut), f h, f e, t
  where cut < kept.k and h.lang = kept.lang and e.lang = kept.lang and t.lang = kept.lang
    and h.phrase = array_to_string(kept.ws[1:cut], ' ') and e.phrase = array_to_string(kept.ws[cut+1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best qualify rank <= {phrases.REPORT}
"""

ORACLES = {"op4_quality_rules": QUALITY, "op7_pii": _pii(), "op11_warc": WARC, "op13_phrases": PHRASES}
