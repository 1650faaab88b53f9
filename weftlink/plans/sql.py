"""DuckDB SQL for the rows of the queries, with all fixed values stated here again; nothing is taken from the library."""

from __future__ import annotations

# Patterns, words, weights and grids of the definitions.
_DOMAIN = r"\b(www\.|https?://|\.com|\.in|\.org|\.net|\.co|\.fr)\b"
_LEGAL = r"\b(pvt|ltd|limited|private|inc|incorporated|corp|corporation|llc|llp|sarl|sas|sasu|sa|eurl|sci|snc|co|company|enterprises|enterprise|industries|industry|services|service|associates|group|holdings)\b"
_COMPOUND = r"\b[A-Za-z0-9]+[-/][A-Za-z0-9/-]+\b"
_GENERIC_WORDS = "road rd street st avenue ave lane ln drive dr block near opp floor unit apt suite building bldg rue boulevard blvd terrace court ct highway hwy parkway pkwy way place null none"
_NAME_WEIGHTS = {"tok": 3.5, "wp": 5.0, "sn": 5.5, "cmp": 5.0, "sh": 1.0, "ph": 1.5}
_ADDRESS_WEIGHTS = {"cpd": 6.0, "npc": 4.5, "nat": 4.0, "pcn": 3.5, "at2": 3.0, "pn": 5.0}
_MATCH, _SINGLETON, _CAP = "0.70, 0.75, 0.80, 0.85, 0.88, 0.90, 0.92, 0.95", "0.60, 0.70, 0.75, 0.80, 0.85", "4, 5, 6, 8"

_BASE = """base as (select c_custkey k, split_part(p_name, ' ', 1) w1, split_part(p_name, ' ', 2) w2, lower(c_mktsegment) seg,
  cast(100 + (c_custkey * 37) % 900 as varchar) num, lower(replace(n_name, '_', ' ')) nat, cast(10000 + (c_custkey * 7919) % 80000 as varchar) pc,
  case c_nationkey % 3 when 0 then 'US' when 1 then 'India' else 'France' end country, cast((c_custkey * 31) % 9973 as varchar) tag
  from customer join part on p_partkey = c_custkey join nation on n_nationkey = c_nationkey),
s1 as (select 'S1-' || k entity_id, w1 || ' ' || w2 || ' ' || seg || ' ' || tag || case when k % 6 = 0 then ' L.L.C.' else ' Pvt Ltd' end business_name,
  case when k % 12 = 0 then 'Plot ' || num || '-' || (k % 50) || '/2, ' else num || ' ' end || seg || ' Road, ' || nat || ' ' || pc business_address, country from base),
s2 as (select 'S2-' || k entity_id, case when k % 10 = 1 then replace(w2, 'e', 'é') else w2 end || ' ' || w1 || ' ' || seg || ' ' || tag || ' Limited' business_name,
  case when k % 5 = 0 then '' else num || ' ' || seg || ' Rd ' || nat end business_address, country from base where k % 4 <> 0),
s3 as (select 'S3-' || k entity_id, case when k % 9 = 0 then 'www.' else '' end || w1 || case when k % 2 = 0 then ' ' else '' end || replace(w2, 'a', 'aa') || ' ' || seg || ' ' || tag business_name,
  'Near ATM ' || num || '-' || (k % 50) || '/2 ' || nat || ' ' || pc business_address, country from base where k % 3 = 0),
targets as (select * from s2 union all select * from s3),
everyone as (select * from s1 union all select * from targets),
truth as (select 'S1-' || k s1_id, concat_ws(',', case when k % 4 <> 0 then 'S2-' || k end, case when k % 3 = 0 then 'S3-' || k end) ids from base),
links as (select distinct s1_id, unnest(string_split(ids, ',')) tgt_id from truth where ids <> '')"""


def _collapse(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{c}+', '{c}', 'g')"
    return x


def _fold(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\b([a-z])\\.([a-z])\\.([a-z])\\b', '\\1\\2\\3', 'g'), '\\b([a-z])\\.([a-z])\\b', '\\1\\2', 'g')"


def _domains(x: str) -> str:
    return f"regexp_replace({x}, '{_DOMAIN}', ' ', 'g')"


_PLAIN = "strip_accents(replace(text, 'ß', 'ss'))"


def _norm(x: str) -> str:
    y = _collapse(f"regexp_replace({_domains(_fold(f'lower(strip_accents({x}))'))}, '{_LEGAL}', ' ', 'g')")
    y = f"trim(regexp_replace(regexp_replace({y}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"case when {x} is null or {x} in ('', 'nan', 'None') then '' else {y} end"


_GENERIC = ", ".join(f"'{w}'" for w in _GENERIC_WORDS.split())
_MISSING = "(business_address is null or business_address in ('', 'nan', 'None'))"

_RECORDS = f"""clean as (select *, {_norm("business_name")} as name, {_norm("business_address")} as address from everyone),
rec as (select entity_id, country, name, address, {_MISSING} is_empty,
  list_filter(string_split(name, ' '), lambda t: length(t) >= 2) tokens,
  case when {_MISSING} then [] else list_filter(regexp_extract_all(business_address, '[0-9]+'), lambda n: length(n) <= 6)[1:3] end numbers,
  nullif(regexp_extract(address, '\\b[0-9]{{5,6}}\\b'), '') postal,
  list_filter(string_split(address, ' '), lambda t: length(t) >= 3 and t not in ({_GENERIC}) and not regexp_full_match(t, '[0-9]+')) addr_tokens,
  list_filter(list_transform(regexp_extract_all(business_address, '{_COMPOUND}'), lambda m: lower(m)), lambda m: regexp_matches(m, '[0-9]')) compounds
  from clean)"""

_SHINGLES = """list_sort(list_distinct(list_concat(
  list_transform(list_filter(tokens, lambda t: length(t) >= 3), lambda t: t[1:3]), list_transform(list_filter(tokens, lambda t: length(t) >= 4), lambda t: t[1:4]),
  case when length(replace(name, ' ', '')) >= 4 then [replace(name, ' ', '')[1:4]] else [] end, case when length(replace(name, ' ', '')) >= 5 then [replace(name, ' ', '')[1:5]] else [] end)))"""

_KEYS = {
    "tok": "tokens",
    "wp": "case when len(tokens) between 2 and 4 then flatten(list_transform(list_sort(list_distinct(tokens)), lambda x, i: list_transform(list_sort(list_distinct(tokens))[i + 1:], lambda y: 'wp:' || x || '_' || y))) else [] end",
    "sn": "case when len(tokens) >= 2 then ['sn:' || array_to_string(list_sort(tokens), ' ')] else [] end",
    "cmp": "case when length(replace(name, ' ', '')) >= 4 then ['cmp:' || replace(name, ' ', '')] else [] end",
    "sh": _SHINGLES,
    "cpd": "list_transform(compounds[1:2], lambda c: 'cpd:' || c)",
    "npc": "case when postal is not null then list_transform(numbers, lambda n: 'npc:' || n || '_' || postal) else [] end",
    "nat": "flatten(list_transform(numbers, lambda n: list_transform(addr_tokens[1:4], lambda t: 'nat:' || n || '_' || t)))",
    "pcn": "case when postal is not null and len(tokens) > 0 then ['pcn:' || postal || '_' || tokens[1][1:3]] else [] end",
    "ph": "phonetic",
    "pn": "flatten(list_transform(numbers[1:2], lambda n: list_transform(phonetic[1:2], lambda p: 'pn:' || p || '_' || n)))",
    "at2": "flatten(list_transform(addr_tokens[1:3], lambda x, i: list_transform(addr_tokens[1:3][i + 1:], lambda y: 'at2:' || least(x, y) || '_' || greatest(x, y))))",
}
_CUTOFF = "case when channel in ('tok', 'wp', 'sn', 'cmp') then 3000 when channel = 'sh' then 1500 when channel = 'ph' then 400 else 2000 end"
_WEIGHT = "case channel " + " ".join(f"when '{c}' then {w} / log2(2 + n)" for c, w in _NAME_WEIGHTS.items()) + " " + " ".join(f"when '{c}' then {w}" for c, w in _ADDRESS_WEIGHTS.items()) + " end"


_NAMES = ", ".join(f"'{c}'" for c in _NAME_WEIGHTS)


def _scoring(channels, records: str = "rec") -> str:
    index = " union all ".join(f"select country, entity_id, '{c}' channel, unnest(list_distinct({_KEYS[c]})) as key from {records} where entity_id not like 'S1-%'" for c in channels)
    probe = " union all ".join(f"select country, entity_id, '{c}' channel, unnest({f'list_distinct({_KEYS[c]})' if c in _NAME_WEIGHTS else _KEYS[c]}) as key from {records} where entity_id like 'S1-%'" for c in channels)
    return f"""idx as ({index}), probe as ({probe}),
freq as (select country, channel, key, count(*) n from idx group by all having count(*) <= {_CUTOFF}),
scored as (select p.entity_id s1_id, i.entity_id tgt_id,
  round(coalesce(sum(case when channel in ({_NAMES}) then {_WEIGHT} end), 0), 9) name_score,
  round(coalesce(sum(case when channel not in ({_NAMES}) then {_WEIGHT} end), 0), 9) addr_score
  from probe p join freq using (country, channel, key) join idx i using (country, channel, key) group by 1, 2)"""


_FINAL = """final as (select *, round(case when name_score > 0 and addr_score > 0 then (name_score + addr_score) * 3 + name_score * addr_score
  when name_score > 0 then name_score * 1.5 else addr_score end, 9) score from scored)"""
_TOP = """placed as (select *, row_number() over (partition by s1_id order by score desc, tgt_id) rf,
  row_number() over (partition by s1_id order by (name_score > 0) desc, name_score desc, tgt_id) rn from final),
bucketed as (select *, case when rf <= 19 then 0 when name_score > 0 and rn <= 6 then 1 else 2 end bucket from placed),
ranked as (select * from (select s1_id, tgt_id, cast(row_number() over (partition by s1_id order by bucket, case when bucket = 1 then rn else rf end) as int) "rank", score from bucketed) where "rank" <= 25)"""
_FEATURES = """paired as (select r.*, a.name a_name, b.name b_name, a.address a_address, b.address b_address, a.is_empty or b.is_empty no_address, a.postal a_postal, b.postal b_postal,
  len(list_intersect(a.numbers, b.numbers)) n_both, len(list_distinct(list_concat(a.numbers, b.numbers))) n_union,
  list_filter(string_split(a.name, ' '), lambda t: t <> '') a_all, list_filter(string_split(b.name, ' '), lambda t: t <> '') b_all
  from ranked r join rec a on a.entity_id = s1_id join rec b on b.entity_id = tgt_id),
features as (select s1_id, tgt_id, "rank", a_name, b_name, a_address, b_address, no_address, cast(abs(length(a_name) - length(b_name)) as double) name_len_diff,
  case when a_name <> '' and a_name = b_name then 1.0 else 0.0 end name_exact_match, case when a_all[1] = b_all[1] then 1.0 else 0.0 end first_token_match,
  cast(len(list_intersect(a_all, b_all)) as double) shared_token_count, case when no_address or n_union = 0 then 0.0 else n_both / n_union end addr_num_jaccard,
  case when not no_address and n_both > 0 then 1.0 else 0.0 end addr_num_exact, case when a_postal = b_postal then 1.0 when a_postal is not null and b_postal is not null then -1.0 else 0.0 end postal_match,
  case when a_postal[1:3] = b_postal[1:3] then 1.0 else 0.0 end postal_prefix_match, case when no_address then 1.0 else 0.0 end is_tgt_addr_empty from paired)"""
_PROB = """probs as (select s1_id, tgt_id, "rank", round(least(1.0, greatest(0.0, cast(0.1 as double) + shared_token_count * cast(0.12 as double) + cast(first_token_match as double) * cast(0.1 as double) + cast(name_exact_match as double) * cast(0.2 as double) + cast(postal_match as double) * cast(0.1 as double)
  + cast(addr_num_jaccard as double) * cast(0.2 as double) - "rank" * cast(0.01 as double))), 6) prob from features)"""
_MARKED = """marked as (select *, row_number() over (partition by s1_id order by prob desc, "rank") place, max(prob) over (partition by s1_id) best from probs)"""
_DECIDED = """decided as (select s1_id, tgt_id, prob, cast(place as int) "rank" from marked where best >= 0.6 and prob >= 0.55 and place <= 2)"""
_ENTITY = """entity as (select t.s1_id, cast(case when ids = '' then 0 else len(string_split(ids, ',')) end as int) n_true,
  (select count(*) from decided d where d.s1_id = t.s1_id) n_pred, (select count(*) from decided d join links l using (s1_id, tgt_id) where d.s1_id = t.s1_id) tp from truth t),
entity_f as (select *, case when n_true = 0 and n_pred = 0 then 1.0 when n_true = 0 or n_pred = 0 or tp = 0 then 0.0
  else 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) end f05 from entity)"""

_FAULTY = """once as (select k line, case when k % 43 = 0 then 'S1-' || k || 'x' else 'S1-' || k end s1,
  ids || case when k % 50 = 1 then ',S2-' || k when k % 50 = 2 then ',S1-7' when k % 50 = 3 then ',X9' when k % 50 = 4 then ',' when k % 50 = 5 then ',S3-999999999' else '' end list
  from base join truth on s1_id = 'S1-' || k where k % 41 <> 40),
faulty as (select line, s1, case when trim(list) = '' then [] else string_split(list, ',') end ids from once
  union all select line + 1000000000, s1, ['S2-1'] from once where line % 47 = 1),
listed as (select distinct unnest(ids) item from faulty)"""



def _soundex(t: str) -> str:
    """Letters as digits (vowels and digits 0), h and w gone behind the first, runs collapsed, zeros gone; the first letter keeps its own name."""
    code = f"translate({t}, 'abcdefghijklmnopqrstuvwxyz123456789', '01230127022455012623017202000000000')"
    x = f"{code}[1] || replace({code}[2:], '7', '')"
    for digit in "123456":
        x = f"regexp_replace({x}, '{digit}+', '{digit}', 'g')"
    return f"case when regexp_matches({t}, '^[a-z]') then upper({t}[1]) || rpad(replace(({x})[2:], '0', ''), 3, '0')[1:3] else {t} end"


_VOWELS, _SOFT = "('a', 'e', 'i', 'o', 'u')", "('e', 'i', 'y')"

# a letter s[3] with two before it and four behind, blanks beyond the word
_LETTER = f"""case when s[3] = s[2] and s[3] <> 'c' then ''
  when s[3] in {_VOWELS} then case when s[2] = ' ' then upper(s[3]) else '' end
  when s[3] = 'b' then case when s[2] = 'm' and s[4] = ' ' then '' else 'B' end
  when s[3] = 'c' then case when s[4] = 'h' and s[2] = 's' then 'K' when s[4] = 'h' or s[4:5] = 'ia' then 'X' when s[4] in {_SOFT} then case when s[2] = 's' then '' else 'S' end else 'K' end
  when s[3] = 'd' then case when s[4] = 'g' and s[5] in {_SOFT} then 'J' else 'T' end
  when s[3] = 'g' then case when s[2] = 'd' and s[1] <> 'd' and s[4] in {_SOFT} then '' when s[4] = 'h' and s[5] <> ' ' and s[5] not in {_VOWELS} then ''
    when s[4:5] = 'n ' or s[4:7] = 'ned ' then '' when s[4] in {_SOFT} then 'J' else 'K' end
  when s[3] = 'h' then case when s[4] in {_VOWELS} and s[2] not in ('c', 'g', 'p', 's', 't') then 'H' else '' end
  when s[3] = 'k' then case when s[2] = 'c' then '' else 'K' end
  when s[3] = 'p' then case when s[4] = 'h' then 'F' else 'P' end
  when s[3] = 'q' then 'K'
  when s[3] = 's' then case when s[4] = 'h' or s[4:5] in ('io', 'ia') then 'X' else 'S' end
  when s[3] = 't' then case when s[4] = 'h' then '0' when s[4:5] in ('ia', 'io') then 'X' when s[4:5] = 'ch' then '' else 'T' end
  when s[3] = 'v' then 'F' when s[3] in ('w', 'y') then case when s[4] in {_VOWELS} then upper(s[3]) else '' end
  when s[3] = 'x' then 'KS' when s[3] = 'z' then 'S' else upper(s[3]) end"""


def _metaphone(t: str) -> str:
    bare = f"regexp_replace({t}, '[^a-z]', '', 'g')"
    begun = "case when w[1:2] in ('kn', 'gn', 'pn', 'wr', 'ae') then w[2:] when w[1] = 'x' then 's' || w[2:] when w[1:2] = 'wh' then 'w' || w[3:] else w end"
    return f"""list_transform(list_transform([{bare}], lambda w: {begun}), lambda w: array_to_string(list_transform(list_transform(range(1, length(w) + 1), lambda i: ('  ' || w || '    ')[i:i + 6]), lambda s: {_LETTER}), ''))[1]"""


_HEARD = f"""coded as (select *, flatten(list_transform(list_filter(tokens, lambda t: length(t) >= 3 and not regexp_full_match(t, '[0-9]+')),
  lambda t: list_filter(['sx:' || {_soundex('t')}, 'mp:' || {_metaphone('t')}], lambda k: k[1:3] = 'sx:' or length(k) >= 5))) codes from rec),
heard as (select *, list_filter(codes, lambda c, i: list_position(codes, c) = i) phonetic from coded)"""

_EVERY = tuple(_KEYS)
_ALL = tuple(c for c in _EVERY if c not in ("ph", "pn"))


def _with(*parts: str) -> str:
    return "with " + ",\n".join((_BASE, *parts)) + "\n"


def _sweep(grid: str, cell: str, keep: str, order: str) -> str:
    return (
        _with(_RECORDS, _scoring(_ALL), _FINAL, _TOP, _FEATURES, _PROB, _MARKED)
        + f""", grid as ({grid}),
picked as (select {cell}, m.s1_id, count(*) n_pred, count(l.tgt_id) tp from marked m cross join grid left join links l on l.s1_id = m.s1_id and l.tgt_id = m.tgt_id where {keep} group by all),
cells as (select {", ".join("g." + c.strip() for c in cell.split(","))}, round(avg(case when t.ids = '' and p.n_pred is null then 1.0 when t.ids = '' or p.n_pred is null or p.tp = 0 then 0.0
  else 1.25 * (p.tp / p.n_pred) * (p.tp / len(string_split(t.ids, ','))) / (0.25 * (p.tp / p.n_pred) + p.tp / len(string_split(t.ids, ','))) end), 6) macro_f05
  from grid g cross join truth t left join picked p on p.s1_id = t.s1_id and {" and ".join(f"p.{c.strip()} = g.{c.strip()}" for c in cell.split(","))} group by {", ".join("g." + c.strip() for c in cell.split(","))})
select *, row_number() over (order by macro_f05 desc, {order}) = 1 best from cells"""
    )


def oracle_sql() -> dict[str, str]:
    ranked = _with(_RECORDS, _scoring(_ALL), _FINAL, _TOP)
    probs = _with(_RECORDS, _scoring(_ALL), _FINAL, _TOP, _FEATURES, _PROB)
    decided = _with(_RECORDS, _scoring(_ALL), _FINAL, _TOP, _FEATURES, _PROB, _MARKED, _DECIDED)
    rec = _with(_RECORDS)
    faulty = _with(_FAULTY)
    sampled = _with("sampled as (select * from (select *, row_number() over (partition by country order by entity_id) n from s1 where country in ('US', 'India')) where n <= 120)")
    sql = {
        "filter_country": _with() + "select entity_id, business_name from everyone where country = 'India'",
        "union_targets": _with() + "select * from targets",
        "semi_join": _with() + "select * from s2 where entity_id in (select tgt_id from links)",
        "limit_per_order": _with() + "select * from targets order by entity_id limit 100",
        "distinct_entities": _with() + "select entity_id, min(business_name) business_name from (select entity_id, business_name from targets union all select entity_id, upper(business_name) from targets) group by 1",
        "distinct_countries": _with() + "select distinct country from everyone",
        "explode_links": _with() + "select * from links",
        "singleton_flags": _with() + "select s1_id, ids = '' is_singleton from truth",
        "id_lines": "select distinct 'c' || conv_id entity_id from conversations",
        "normalize_name": rec + "select entity_id, name as clean from rec",
        "normalize_documents": f"select doc_id, {_norm('x')} as clean from (select doc_id, {_PLAIN} x from documents)",
        "transliterate": f"select doc_id, lower({_PLAIN}) ascii_text from documents",
        "fold_acronyms": _with() + f"select entity_id, {_fold('lower(business_name)')} folded from everyone",
        "strip_domains": f"select page_id, {_domains('lower(url)')} bare from pages",
        "collapse_letters": f"select p_partkey, {_collapse('lower(p_name)')} collapsed from part",
        "token_sorted_name": rec + "select entity_id, array_to_string(list_sort(list_filter(string_split(name, ' '), lambda t: t <> '')), ' ') sorted_name from rec",
        "compressed_name": rec + "select entity_id, replace(name, ' ', '') fused from rec",
        "name_tokens": rec + "select entity_id, array_to_string(tokens, '|') tokens from rec",
        "prefix_shingles": rec + f"select entity_id, array_to_string({_SHINGLES}, '|') shingles from rec",
        "soundex_keys": rec + f"select entity_id, array_to_string(list_transform(list_filter(tokens, lambda t: length(t) >= 3 and not regexp_full_match(t, '[0-9]+')), lambda t: 'sx:' || {_soundex('t')}), '|') as keys from rec",
        "address_anchors": rec + "select entity_id, array_to_string(numbers, '|') numbers, postal postal_code, array_to_string(addr_tokens, '|') words, is_empty from rec",
        "compound_numbers": rec + "select entity_id, array_to_string(compounds, '|') compounds from rec",
        "key_frequencies": _with(_RECORDS, _scoring(_ALL)) + "select * from freq",
        "dual_evidence": _with(_RECORDS, _scoring(_ALL), _FINAL) + "select s1_id, tgt_id, round(score, 5) score from final",
        "topk_candidates": ranked + 'select s1_id, tgt_id, "rank", round(score, 5) score from ranked',
        "candidate_lists": ranked + """select s.entity_id source1_entity_id, coalesce(string_agg(tgt_id, ',' order by "rank"), '') candidate_entity_ids from s1 s left join ranked on s1_id = s.entity_id group by 1""",
        "plain_features": probs + ", ".join(["select s1_id", "tgt_id", '"rank"', *[f"round(cast({c} as double), 6) {c}" for c in ("name_len_diff", "name_exact_match", "first_token_match", "shared_token_count", "addr_num_jaccard", "addr_num_exact", "postal_match", "postal_prefix_match", "is_tgt_addr_empty")]]) + " from features",
        "jaro_winkler_features": probs + """select s1_id, tgt_id, round(jaro_winkler_similarity(a_name, b_name), 6) name_jaro_winkler, round(case when no_address then 0.0 else jaro_winkler_similarity(a_address, b_address) end, 6) addr_jaro_winkler from features""",
        "labelled_pairs": ranked + 'select s1_id, tgt_id, "rank", cast((l.tgt_id is not null) as int) as label from ranked left join links l using (s1_id, tgt_id)',
        "sample_counts": ranked + "select count(*) n_pairs, cast(count(l.tgt_id) as bigint) n_positive, count(distinct s1_id) n_entities from ranked left join links l using (s1_id, tgt_id)",
        "group_split": ranked + """, dealt as (select s1_id, cast('0x' || md5('42:' || s1_id)[1:8] as bigint) % 100 as place from ranked)
select case when place < 60 then 'train' when place < 80 then 'valid' else 'test' end part, count(*) n, count(distinct s1_id) n_groups from dealt group by 1""",
        "threshold_matches": probs + "select * from probs where prob >= 0.70",
        "decide_by_default": probs + f", {_MARKED} " + 'select s1_id, tgt_id, prob, cast(place as int) "rank" from marked where best >= 0.6 and prob >= 0.7 and place <= 8',
        "decide_matches": decided + "select * from decided",
        "match_lists": decided + """select s.entity_id source1_entity_id, coalesce(string_agg(tgt_id, ',' order by "rank"), '') matched_entity_ids from s1 s left join decided on s1_id = s.entity_id group by 1""",
        "entity_scores": decided + f", {_ENTITY} select s1_id, n_true, n_pred, tp, round(cast(f05 as double), 6) f05 from entity_f",
        "macro_f05": decided + f", {_ENTITY} select round(avg(f05), 6) macro_f05, count(*) n_entities from entity_f",
        "candidate_recall": ranked + "select (select count(*) from links) n_links, (select count(*) from links join ranked using (s1_id, tgt_id)) n_recalled, round(100.0 * (select count(*) from links join ranked using (s1_id, tgt_id)) / (select count(*) from links), 6) recall_pct, round((select count(*) from ranked) / (select count(*) from truth), 6) avg_candidates",
        "country_recall": ranked + "select country, count(*) n_links, count(r.tgt_id) n_recalled, round(100.0 * count(r.tgt_id) / count(*), 6) recall_pct from links l join s1 on s1.entity_id = l.s1_id left join ranked r on r.s1_id = l.s1_id and r.tgt_id = l.tgt_id group by 1",
        "roc_auc": probs + """, labelled as (select prob, cast((l.tgt_id is not null) as int) y from probs left join links l using (s1_id, tgt_id)),
ordered as (select y, rank() over (order by prob) + (count(*) over (partition by prob) - 1) / 2.0 r from labelled)
select round((sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) auc, cast(sum(y) as bigint) pos, cast(count(*) - sum(y) as bigint) neg from ordered""",
        "threshold_sweep": _sweep("select i / 100 threshold from range(40, 100, 5) r(i)", "threshold", "prob >= threshold", "threshold"),
        "grid_sweep": _sweep(
            f"select m.v \"match\", s.v singleton, cast(c.v as int) cap from (select cast(unnest([{_MATCH}]) as double) v) m, (select cast(unnest([{_SINGLETON}]) as double) v) s, (select unnest([{_CAP}]) v) c",
            '"match", singleton, cap',
            'best >= singleton and prob >= "match" and place <= cap',
            '"match", singleton, cap',
        ),
        "validator_duplicate_rows": faulty + "select s1 item from faulty group by 1 having count(*) > 1",
        "validator_repeated_ids": faulty + "select distinct s1 item from faulty where len(ids) <> len(list_distinct(ids))",
        "validator_self_matches": faulty + "select item from listed where item like 'S1-%'",
        "validator_wrong_prefixes": faulty + "select item from listed where not regexp_matches(item, '^S[123]-')",
        "validator_unknown_ids": faulty + "select item from listed where regexp_matches(item, '^S[23]-') and item not in (select entity_id from targets)",
        "validator_missing_rows": faulty + "select entity_id item from s1 where entity_id not in (select s1 from faulty)",
        "validator_extra_rows": faulty + "select distinct s1 item from faulty where s1 not in (select entity_id from s1)",
        "validator_outside_candidates": faulty + """, last as (select s1, unnest(ids) id from faulty qualify row_number() over (partition by s1 order by line desc) = 1)
select distinct s1 item from last where not exists (select 1 from truth where s1_id = s1 and list_contains(string_split(ids, ','), id))""",
        "validator_findings": faulty + """, lists as (select 'matching' file, line, s1, ids from faulty union all select 'candidate', 1, s1_id, string_split(ids, ',') from truth),
items as (select distinct file, unnest(ids) item from lists),
last as (select s1, unnest(ids) id from faulty qualify row_number() over (partition by s1 order by line desc) = 1),
broken as (select file, 'entity on several rows' rule, 'error' severity, s1 item from lists group by file, s1 having count(*) > 1
  union all select distinct file, 'id repeated in a list', 'error', s1 from lists where len(ids) <> len(list_distinct(ids))
  union all select file, 'source-1 id in a list', 'error', item from items where item like 'S1-%'
  union all select file, 'id without S2- or S3-', 'error', item from items where not regexp_matches(item, '^S[123]-')
  union all select file, 'unknown id', 'error', item from items where regexp_matches(item, '^S[23]-') and item not in (select entity_id from targets)
  union all select f.file, 'required entity missing', 'error', r.entity_id from s1 r, (select distinct file from lists) f where not exists (select 1 from lists l where l.file = f.file and l.s1 = r.entity_id)
  union all select distinct file, 'entity not asked for', 'error', s1 from lists where s1 not in (select entity_id from s1)
  union all select distinct 'matching', 'match is no candidate', 'warning', s1 from last where not exists (select 1 from truth where s1_id = s1 and list_contains(string_split(ids, ','), id)))
select file, rule, severity, count(*) n, array_to_string(list_sort(list(item))[1:5], '|') examples from broken group by 1, 2, 3
union all select file, 'rows', 'info', count(*), '' from lists group by 1
union all select file, 'empty rows', 'info', count(*), '' from lists where len(ids) = 0 group by 1""",
        "validator_counts": faulty + "select count(*) n_rows, cast(count(*) filter (len(ids) = 0) as bigint) n_empty, cast(count(*) filter (len(ids) > 0) as bigint) n_listed from faulty",
        "validation_sample": sampled + "select entity_id, business_name, business_address, country from sampled",
        "sampled_truth": sampled + "select s1_id source1_entity_id, ids matched_entity_ids from truth where s1_id in (select entity_id from sampled)",
        "sampled_targets": sampled + "select * from targets where entity_id in (select tgt_id from links where s1_id in (select entity_id from sampled)) union select * from (select * from targets order by entity_id limit 200)",
    }
    sql["metaphone_keys"] = rec + f"select entity_id, array_to_string(list_transform(tokens, lambda t: {_metaphone('t')}), '|') as keys from rec"
    sql["candidates_with_phonetics"] = _with(_RECORDS, _HEARD, _scoring(_EVERY, "heard"), _FINAL, _TOP) + 'select s1_id, tgt_id, "rank", round(score, 5) score from ranked'
    for c in _EVERY:
        records = (_RECORDS, _HEARD, _scoring((c,), "heard")) if c in ("ph", "pn") else (_RECORDS, _scoring((c,)))
        sql[f"score_channel_{c}"] = _with(*records) + "select s1_id, tgt_id, round(name_score, 6) name_score, round(addr_score, 6) addr_score from scored"
    return sql
