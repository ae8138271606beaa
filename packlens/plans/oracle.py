"""The same queries as plain SQL with common table expressions, for an engine with RE2 patterns.

Relations take the place of arrays: pairs of regions come from a self-join, fused values from grouping, facts from
joins. Only the wordings that both sides must share are taken from the operators.
"""

from __future__ import annotations

from ..functions import extract as x
from ..functions.text import ADDRESS_WORDS
from ..operators import inspection, recovery, rules, spatial
from . import fixtures


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''").replace("(?iU)", "(?i)") + "'"


def group(t: str, pattern: str, n: int) -> str:
    return f"regexp_extract({t}, {q(pattern)}, {n})"


def some(t: str, pattern: str, n: int) -> str:
    return f"nullif({group(t, pattern, n)}, '')"


def has(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)})"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def compact(t: str, n: int = 220) -> str:
    spaced = rf"regexp_replace({t}, '\s+', ' ', 'g')"
    return f"left({strip(spaced)}, {n})"


def line(t: str, pattern: str) -> str:
    before = group(t, "(?is)^(.*?)(?:" + pattern.removeprefix("(?i)") + ")", 1)
    return compact(rf"regexp_extract({before}, '[^\n]*$') || split_part(substr({t}, length({before}) + 1), chr(10), 1)")


def address(t: str) -> str:
    words = "|".join(ADDRESS_WORDS)
    return rf"({has(t, chr(92) + 'b' + chr(92) + 'd{6}' + chr(92) + 'b')} or length({t}) - length(replace({t}, ',', '')) >= 2 or {has(t, f'(?i){chr(92)}b(?:{words}){chr(92)}b')})"


def normal(t: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(replace({t}, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def truth(condition: str) -> str:
    return f"case when {condition} then 'true' else 'false' end"


VIEWS = f"views as ({fixtures.plain(fixtures.VIEWS)}), n as (select *, {normal('ocr_text')} as t from views)"
CONTEXTS = f"ctx as ({fixtures.plain(fixtures.CONTEXTS)})"


def _piece(u: str) -> str:
    return f"case when lower({u}) in ('pc','pcs','piece','pieces','n') then 'pc' else lower({u}) end"


def _year(y: str) -> str:
    return f"case when length({y}) = 2 then '20' || {y} else {y} end"


def _month(m: str) -> str:
    return f"lpad(cast(list_position(['{chr(39).join([chr(39) + ',' + chr(39)]).join(x._MONTHS)}'], lower(left({m}, 3))) as varchar), 2, '0')"


def _options() -> dict[str, list[tuple]]:
    """For each kind (condition, value, evidence, confidence, attributes), in the order in which they are tried."""
    t, out = "t", {}
    maker = lambda p: (has(t, p), strip(group(t, p, 2)), line(t, p))
    out["manufacturer"] = [
        (*maker(p), c, {"role": f"lower({group(t, p, 1)})", "address_detected": truth(address(strip(group(t, p, 2))))})
        for p, c in zip(x._MAKER, (0.92, 0.86), strict=True)
    ]
    trimmed = lambda p: f"regexp_replace({group(t, p, 1)}, '^[ .,-]+|[ .,-]+$', '', 'g')"
    out["country_origin"] = [(has(t, p), trimmed(p), line(t, p), c, {"country": trimmed(p)}) for p, c in zip(x._ORIGIN, (0.95, 0.9), strict=True)]
    out["commodity_name"] = [(has(t, x._NAME), strip(group(t, x._NAME, 1)), line(t, x._NAME), 0.92, {})]
    amount, unit = group(t, x._NET, 1), _piece(group(t, x._NET, 2))
    out["net_quantity"] = [(has(t, x._NET), f"{amount} || ' ' || {unit}", line(t, x._NET), 0.94, {"amount": amount, "unit": unit})]
    p = x._MADE_NUMBER
    number = (f"lpad({group(t, p, 1)}, 2, '0')", _year(group(t, p, 2)))
    name = (_month(group(t, x._MADE_NAME, 1)), group(t, x._MADE_NAME, 2))
    out["month_year"] = [
        (has(t, k), f"{m} || '/' || {y}", line(t, k), c, {"month": m, "year": y})
        for k, c, (m, y) in ((p, 0.94, number), (x._MADE_NAME, 0.9, name))
    ]
    before = strip(group(t, x._BEFORE, 1))
    out["best_before"] = [(has(t, x._BEFORE), before, line(t, x._BEFORE), 0.92, {"declaration": before})]
    gap, out["mrp"] = r"[ \t]*(?::|-)?[ \t]*", []
    for coin, conf in ((r"(?:₹|rs\.?|inr)[ \t]*", 0.95), ("", 0.84)):
        for label in x._PRICE_LABELS:
            p = rf"(?i){label}{gap}{coin}{x._AMOUNT}"
            value, known = group(t, p, 1), "'INR'" if coin else "null"
            said = f"'INR ' || {value}" if coin else value
            out["mrp"].append((has(t, p), said, line(t, p), conf, {"amount": value, "currency": known, "tax_inclusive_phrase": truth(has(line(t, p), x.TAX))}))
    size = strip(rf"regexp_replace({group(t, x._SIZE, 1)}, '\s+', ' ', 'g')")
    out["dimensions"] = [(has(t, x._SIZE), size, line(t, x._SIZE), 0.9, {"dimensions": size})]
    row = f"list_filter(string_split(t, chr(10)), lambda l: {has('l', x._CARE)} and ({has('l', x.EMAIL)} or {has('l', x._PHONE)}))[1]"
    email, phone, lone = some("care", x.EMAIL, 0), some("care", x._PHONE, 1), group(t, x._CARE_EMAIL, 0)
    out["consumer_care"] = [
        ("care is not null", f"concat_ws(' | ', {email}, {phone})", compact("care"), 0.94, {"email": email, "phone": phone, "address_detected": truth(address("care"))}),
        (has(t, x._CARE_EMAIL), lone, compact(lone), 0.82, {"email": lone, "address_detected": "'false'"}),
    ]
    out["_care"] = row
    p = x._UNIT_PRICE
    low = f"lower({group(t, p, 4)})"
    per, unit = f"coalesce({some(t, p, 3)}, '1')", f"case when {low} in ('piece','pc','number','unit') then 'pc' else {low} end"
    out["unit_sale_price"] = [
        (has(t, p), f"'INR ' || {group(t, p, 2)} || ' / ' || {per} || ' ' || {unit}", line(t, p), 0.93,
         {"currency": "'INR'", "amount": group(t, p, 2), "reference_quantity": per, "reference_unit": unit})
    ]
    return out


_ATTRS = "role address_detected country amount unit currency tax_inclusive_phrase month year declaration dimensions email phone reference_quantity reference_unit".split()
_ALL = _options()
_CARE_LINE = _ALL.pop("_care")


def _rows(key: str, relation: str = "n") -> str:
    options = _ALL[key]
    pick = lambda at: "case " + " ".join(f"when {o[0]} then {at(o)}" for o in options) + " end"
    columns = [f"{pick(lambda o: o[1])} as value", f"{pick(lambda o: o[2])} as evidence", f"{pick(lambda o: str(o[3]))}::double as confidence"]
    columns += [f"cast({pick(lambda o, a=a: o[4].get(a, 'null'))} as varchar) as {a}" for a in _ATTRS]
    source = f"(select *, {_CARE_LINE} as care from {relation})" if key == "consumer_care" else relation
    return f"select package_id, view_no, image_id, file_name, '{key}' as key, {', '.join(columns)} from {source} where {' or '.join(o[0] for o in options)}"


def _extractor(key: str, shown: str) -> str:
    names = "".join(f", {a}" for a in shown.split())
    return f"with {VIEWS}, d as ({_rows(key)}) select package_id, view_no, value, evidence, round(confidence, 6) as confidence{names} from d"


DECLARATIONS = f"{VIEWS}, decl as ({' union all '.join(_rows(k) for k in _ALL)})"

_FUSE = f"""item as (select *, '[' || file_name || '] ' || evidence as said,
  case when key = 'mrp' and try_cast(amount as double) is not null then coalesce(currency, '') || '|' || try_cast(amount as double)
       when key = 'net_quantity' and try_cast(amount as double) is not null then try_cast(amount as double) || '|' || coalesce(unit, '')
       else regexp_replace(lower(value), '\\s+', ' ', 'g') end as same,
  row_number() over (partition by package_id, key, value order by view_no) as nth_value,
  row_number() over (partition by package_id, key, email order by view_no) as nth_email,
  row_number() over (partition by package_id, key, phone order by view_no) as nth_phone from decl),
fused as (select package_id, key, count(*) as n_views, max(confidence) as confidence, count(distinct same) > 1 as conflict,
  string_agg(said, ' || ' order by view_no) as evidence, string_agg(image_id, ',' order by view_no) as images,
  string_agg(value, ' | ' order by view_no) filter (nth_value = 1) as all_values,
  string_agg(email, ' | ' order by view_no) filter (nth_email = 1 and email is not null) as emails,
  string_agg(phone, ' | ' order by view_no) filter (nth_phone = 1 and phone is not null) as phones,
  count(distinct email) as n_emails, count(distinct phone) as n_phones, bool_or(coalesce(address_detected = 'true', false)) as any_address,
  first(value order by confidence desc, view_no) as value,
  {', '.join(f"first({a} order by confidence desc, view_no) as {a}" for a in _ATTRS)} from item group by package_id, key)"""
FUSED = f"{DECLARATIONS}, {_FUSE}"

TEXTS = """texts as (select package_id, string_agg('--- ' || file_name || ' ---' || chr(10) || regexp_replace(ocr_text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) order by view_no) as raw_text
  from views where regexp_matches(ocr_text, '\\S') group by package_id)"""

_POINTER = rf"(?i){recovery.LABEL}[\s\S]{{0,180}}?{recovery.POINTER}"
_LOCATORS = "case {0} when 'seam' then 'seal' when 'crimp' then 'seal' when 'base' then 'bottom' when 'cap' then 'top' when 'lid' then 'top' when 'neck' then 'top' else {0} end"
HINTS = f"""hint as (select package_id, view_no, {_LOCATORS.format('lower(' + group('ocr_text', _POINTER, 1) + ')')} as locator,
  {compact(group('ocr_text', _POINTER, 0), 260)} as evidence,
  {has(compact(group('ocr_text', _POINTER, 0), 260), '(?i)' + recovery.TAX)} as tax_inclusive_phrase from views where {has('ocr_text', _POINTER)})"""


READINGS = f"reading as ({fixtures.plain(fixtures.READINGS)})"
_P = rf"(?i){recovery.PRICE}\s*(?:/\-)?"
_AMOUNT = lambda t: f"case when try_cast(translate({t}, 'Oo', '00') as decimal(18,6)) is null then translate({t}, 'Oo', '00') else regexp_replace(regexp_replace(cast(try_cast(translate({t}, 'Oo', '00') as decimal(18,6)) as varchar), '0+$', ''), '\\.$', '') end"
PARSED = f"""{READINGS}, masked as (select *, regexp_replace(text, {q(recovery.RATE)}, ' ', 'g') as m from reading),
parsed as (select package_id, obs_ord, family, confidence, case when {has('m', _P)} or {has('text', recovery.BEFORE_RATE)} then 'INR' end as currency,
  case when {has('m', _P)} then {_AMOUNT(group('m', _P, 2))} when {has('text', recovery.BEFORE_RATE)} then {_AMOUNT(group('text', recovery.BEFORE_RATE, 1))} end as amount,
  case when {has('m', _P)} then {compact(group('m', _P, 0), 260)} when {has('text', recovery.BEFORE_RATE)}
    then {compact(f"regexp_replace({group('text', recovery.BEFORE_RATE, 0)}, '^[^0-9Oo]', '')", 260)} end as evidence from masked)"""


def _votes(source: str, by: str) -> str:
    return f"""select {by}, currency, amount, count(distinct family) as families, count(*) as votes, avg(confidence) as mean_confidence,
  row_number() over (partition by {by} order by count(distinct family) desc, count(*) desc, round(avg(confidence), 9) desc, min(obs_ord)) as rank_no
from {source} where currency is not null group by {by}, currency, amount"""


def _won(source: str, by: str) -> str:
    return f"""select * from (select *, lead(families) over (partition by {by} order by rank_no) as f2, lead(votes) over (partition by {by} order by rank_no) as v2,
  lead(round(mean_confidence, 9)) over (partition by {by} order by rank_no) as m2 from {source})
where rank_no = 1 and (f2 is null or families > f2 or (families = f2 and votes > v2) or (families = f2 and votes = v2 and round(mean_confidence, 9) > m2))
  and (families >= 2 or votes >= 3 or (votes >= 2 and mean_confidence >= 0.86) or (votes = 1 and mean_confidence >= 0.96))"""


WON = f"{PARSED}, votes as ({_votes('parsed', 'package_id')}), won as ({_won('votes', 'package_id')})"
_WON_CONF = "least(0.96, greatest(0.68, 0.58 + 0.05 * families + 0.20 * mean_confidence))"


def _fact(key: str, names: str) -> str:
    columns = ", ".join(f"{n} as {key[:3]}_{n}" for n in names.split())
    return f"left join (select package_id, {columns} from known where key = '{key}') using (package_id)"


_POINTS = f"(?i){recovery.POINTER}"


def _places(name: str, pattern: str, views: str) -> str:
    """Matches of a pattern in views that point somewhere: their number i, place and text."""
    return f"""{name} as (select package_id, view_no, t, i, ms[i] as said,
  cast(coalesce(list_sum(list_transform(string_split_regex(t, {q(pattern)})[1:i], lambda z: length(z))), 0)
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0) as bigint) as place
  from (select *, unnest(range(1, len(ms) + 1)) as i from (select package_id, view_no, ocr_text as t,
    regexp_extract_all(ocr_text, {q(pattern)}, 0) as ms from {views} where {has('ocr_text', _POINTS)})))"""


def _around(before: int, after: int) -> str:
    return f"substr(t, greatest(0, lb - {before}) + 1, le + {after} - greatest(0, lb - {before}))"


_TAX = "(?i)" + recovery.TAX
_APART = compact(f"{compact(_around(28, 110), 150)} || ' ... ' || {compact('said', 90)}", 260)
def _references(views: str) -> str:
    return f"""{_places('direct', _POINTER, views)}, {_places('pointer', _POINTS, views)}, {_places('label', '(?i)' + recovery.LABEL, views)},
near as (select p.package_id, p.view_no, p.t, p.i, p.said, l.place as lb, l.place + length(l.said) as le,
    row_number() over (partition by p.package_id, p.view_no, p.i order by abs(l.place - p.place), l.place) as n
  from pointer p join label l on l.package_id = p.package_id and l.view_no = p.view_no
  where not exists (select 1 from direct d where d.package_id = p.package_id and d.view_no = p.view_no
    and abs(d.place + length(d.said) - p.place - length(p.said)) <= 4)),
said as (select package_id, view_no, 0 as apart, i, {group('said', _POINTER, 1)} as word, {compact('said', 260)} as evidence,
    {has(compact('said', 260), _TAX)} as tax_inclusive_phrase from direct
  union all select package_id, view_no, 1, i, {group('said', _POINTS, 1)}, {_APART}, {has(_around(180, 180), _TAX)} or {has(_APART, _TAX)} from near where n = 1),
reference as (select package_id, view_no, apart, i, {_LOCATORS.format('lower(word)')} as locator, evidence, tax_inclusive_phrase from said
  qualify row_number() over (partition by package_id, view_no, {_LOCATORS.format('lower(word)')} order by apart, i) = 1)"""


REFERENCES = _references("views")

_SAME_VIEW = "{0}.package_id = {1}.package_id and {0}.view_no = {1}.view_no"
_SAME_PLACE = _SAME_VIEW + " and {0}.locator = {1}.locator"
_SHOWS = lambda r: f"(regexp_matches(replace(lower({r}_text), '.', ''), 'rs|r5|inr') or contains({r}_text, '₹') or contains({r}_text, amount))"
_TURN = "case when explicit then list_position(['wide', 'attention', 'direct'], stage) else list_position(['direct', 'wide', 'attention'], stage) end"


def _parsed(name: str, relation: str) -> str:
    """The price in the texts of readings: currency, amount and evidence; null if there is none."""
    return f"""{name} as (select *, case when {has('m', _P)} or {has('text', recovery.BEFORE_RATE)} then 'INR' end as currency,
  case when {has('m', _P)} then {_AMOUNT(group('m', _P, 2))} when {has('text', recovery.BEFORE_RATE)} then {_AMOUNT(group('text', recovery.BEFORE_RATE, 1))} end as amount,
  case when {has('m', _P)} then {compact(group('m', _P, 0), 260)} when {has('text', recovery.BEFORE_RATE)}
    then {compact(f"regexp_replace({group('text', recovery.BEFORE_RATE, 0)}, '^[^0-9Oo]', '')", 260)} end as evidence
from (select *, regexp_replace(text, {q(recovery.RATE)}, ' ', 'g') as m from {relation}))"""


#: What views point to, and what close-ups there came to: work (a row for each place), won, and done with the outcome of each place.
WORK = f"""views0 as ({fixtures.plain(fixtures.VIEWS)}), n0 as (select *, {normal('ocr_text')} as t from views0), price0 as ({_rows('mrp', 'n0')}),
{_references('views0')},
hinted as (select package_id, view_no, row_number() over (partition by package_id, view_no order by apart, i) as hint_ord, locator, evidence, tax_inclusive_phrase as tax, true as explicit from reference),
work as (select * from hinted union all select v.package_id, v.view_no, 1, 'seal', {q(inspection.UNASKED)}, {has('ocr_text', _TAX)}, false
  from views0 v left join price0 p on {_SAME_VIEW.format('p', 'v')}
  where not exists (select 1 from hinted h where {_SAME_VIEW.format('h', 'v')}) and not coalesce(p.currency = 'INR' and p.amount <> '', false)
    and {has('ocr_text', f'(?i){recovery.LABEL}|{recovery.TAX}')}),
closeup as (select * replace ({strip('text')} as text) from ({fixtures.plain(fixtures.CLOSEUPS)})), {_parsed('seen0', 'closeup')},
seen as (select s.package_id, s.view_no, s.locator, s.stage, s.obs_ord, s.family, s.text, s.n_regions, s.r1_text, s.r1_confidence, s.r2_text, s.r2_confidence, s.sx, s.sy, s.sw, s.sh,
    s.currency, s.amount, s.evidence, {_TURN} as turn, case when n_regions = 0 then 0 when amount is null then greatest(r1_confidence, r2_confidence)
    when {_SHOWS('r1')} and not {_SHOWS('r2')} then r1_confidence when {_SHOWS('r2')} and not {_SHOWS('r1')} then r2_confidence else greatest(r1_confidence, r2_confidence) end as confidence
  from seen0 s join work w on {_SAME_PLACE.format('s', 'w')}),
turns as (select seen.*, upto from seen join (values (1), (2), (3)) a(upto) on turn <= upto),
polls as ({_votes('turns', 'package_id, view_no, locator, upto')}), agreed as ({_won('polls', 'package_id, view_no, locator, upto')}),
won as (select * from agreed qualify row_number() over (partition by package_id, view_no, locator order by upto) = 1),
backing as (select s.*, w.families, w.votes, w.mean_confidence, row_number() over (partition by s.package_id, s.view_no, s.locator order by turn, obs_ord) as nth
  from seen s join won w on {_SAME_PLACE.format('s', 'w')} and turn <= upto and s.currency = w.currency and s.amount = w.amount),
backed as (select package_id, view_no, locator, any_value(families) as families, any_value(votes) as votes, any_value(mean_confidence) as mean_confidence, any_value(currency) as currency,
    any_value(amount) as amount, arg_min(evidence, nth) as price_evidence, bool_or(stage = 'direct') as direct from backing group by all),
quoted as (select package_id, view_no, locator, string_agg(text, chr(10) || '---' || chr(10) order by nth) as texts from
  (select * from backing where text <> '' qualify row_number() over (partition by package_id, view_no, locator order by nth) <= 4) group by all),
tried as (select w.*, b.currency, b.amount, b.families, b.votes, round({_WON_CONF}, 9) as won_confidence, b.price_evidence, b.direct, quoted.texts, b.locator is not null as is_won,
    p.value as own_value, p.evidence as own_evidence, p.confidence as own_confidence, p.amount as own_amount, p.currency as own_currency, p.tax_inclusive_phrase as own_tax,
    coalesce(p.currency = 'INR' and p.amount <> '', false) as complete
  from work w left join backed b on {_SAME_PLACE.format('b', 'w')} left join quoted on {_SAME_PLACE.format('quoted', 'w')} left join price0 p on {_SAME_VIEW.format('p', 'w')}),
first_won as (select package_id, view_no, min(hint_ord) as k from tried where is_won and not complete group by all),
known0 as (select t.*, f.k, s.tax as k_tax, s.currency || ' ' || s.amount as k_value, {compact("s.evidence || ' -> ' || s.price_evidence", 260)} as k_evidence, s.won_confidence as k_confidence, s.amount as k_amount, s.currency as k_currency
  from tried t left join first_won f on {_SAME_VIEW.format('f', 't')} left join tried s on {_SAME_VIEW.format('s', 't')} and s.hint_ord = f.k),
done as (select *, case when complete then case when tax and coalesce(own_tax, '') <> 'true' then 'enriched' else 'kept' end
    when hint_ord = k then 'recovered' when hint_ord > k then case when tax and not k_tax then 'enriched' else 'kept' end when explicit then 'unresolved' else 'nothing' end as outcome from known0),
more as (select package_id, view_no, hint_ord as src, outcome, case when outcome = 'unresolved' then 'mrp_reference' else 'mrp' end as key,
    case outcome when 'unresolved' then 'See ' || locator when 'recovered' then currency || ' ' || amount else case when complete then own_value else k_value end end as value,
    case outcome when 'unresolved' then evidence when 'recovered' then {compact("evidence || ' -> ' || price_evidence", 260)}
      else {compact("(case when complete then own_evidence else k_evidence end) || ' -> ' || evidence", 260)} end as evidence,
    case outcome when 'unresolved' then 0.82 when 'recovered' then won_confidence else least(0.96, greatest(case when complete then own_confidence else k_confidence end, 0.90)) end as confidence,
    case outcome when 'unresolved' then null when 'recovered' then amount else case when complete then own_amount else k_amount end end as amount,
    case outcome when 'unresolved' then null when 'recovered' then currency else case when complete then own_currency else k_currency end end as currency,
    case outcome when 'enriched' then 'true' else cast(tax as varchar) end as tax_inclusive_phrase, locator
  from done where outcome in ('unresolved', 'recovered', 'enriched'))"""

#: Views with the text that close-ups added, the declarations of each view, and those of a package.
INSPECTED = f"""{WORK}, added as (select package_id, view_no, string_agg({q(inspection.HEADER.partition('{')[0])} || locator || ']' || chr(10) || texts, chr(10) order by hint_ord) as added
  from done where outcome = 'recovered' and texts is not null group by all),
views as (select v.package_id, v.view_no, image_id, file_name, case when added is null then ocr_text else {strip("ocr_text || chr(10) || added")} end as ocr_text
  from views0 v left join added a on {_SAME_VIEW.format('a', 'v')}), n as (select *, {normal('ocr_text')} as t from views),
decl0 as ({' union all '.join(_rows(k) for k in _ALL)}),
decl as (select * exclude (src) from (select *, 0 as src from decl0 union all by name
    select m.* exclude (outcome, locator), v.image_id, v.file_name from more m join views v on {_SAME_VIEW.format('m', 'v')})
  qualify row_number() over (partition by package_id, view_no, key order by confidence desc, src) = 1),
{_FUSE}"""

_GRAMS = "case net_unit when 'mg' then net_a / 1000 when 'kg' then net_a * 1000 when 'l' then net_a * 1000 when 'cl' then net_a * 10 else net_a end"
FACTS = f"""{INSPECTED}, {TEXTS}, {CONTEXTS},
known as (select * from fused where key <> 'mrp_reference'), open_hint as (select package_id, value as locator, evidence from fused where key = 'mrp_reference'),
wide as (select *, try_cast(net_amount as decimal(18,6)) as net_a, try_cast(mrp_amount as decimal(18,6)) as mrp_a,
    coalesce(net_conflict, false) as nc, coalesce(mrp_conflict, false) as mc from ctx left join texts using (package_id)
  {_fact('net_quantity', 'amount unit conflict')} {_fact('mrp', 'amount conflict')}),
base as (select *, case when not nc and net_a is not null and net_unit <> '' then cast({_GRAMS} as decimal(18,6)) end as grams,
    case when not nc and net_a is not null then case net_unit when 'mg' then 'g' when 'kg' then 'g' when 'l' then 'ml' when 'cl' then 'ml' else net_unit end end as gu from wide),
unit as (select *, case when gu in ('g','ml') and grams >= 1000 then cast(grams / 1000 as decimal(18,6)) when gu in ('g','ml','pc') then grams end as bq,
    case when gu = 'g' and grams >= 1000 then 'kg' when gu = 'ml' and grams >= 1000 then 'l' when gu in ('g','ml','pc') then gu end as bu,
    coalesce(commodity_class = 'general' and gu in ('g','ml') and grams <= 10, false) as small_package from base),
facts as (select *, coalesce(bq = 1 and mrp_a is not null and not mc, false) as price_is_unit_price from unit)"""

_NEEDED = """case rule_key when 'country_origin' then imported_product when 'best_before' then may_become_unfit
  when 'dimensions' then dimensions_relevant when 'unit_sale_price' then not alcoholic_beverage and package_form = 'single' else true end"""
_RULES = "rule(rule_ord, rule_id, rule_key, weight) as (values " + ", ".join(f"({n}, '{r.rule_id}', '{r.key}', {r.weight})" for n, r in enumerate(rules.RULES)) + ")"

CHECKS = f"""{FACTS}, {_RULES},
pair as (select f.*, rule.*, d.value, d.evidence, d.confidence as dc, d.conflict, d.address_detected, d.currency, d.tax_inclusive_phrase, d.email, d.phone,
    d.emails, d.phones, d.any_address, d.all_values, try_cast(d.amount as decimal(18,6)) as amt, try_cast(d.reference_quantity as decimal(18,6)) as rq, d.reference_unit,
    d.key is not null as there, h.evidence as hint_evidence, h.locator is not null as hinted, {_NEEDED} as needed
  from facts f cross join rule left join known d on d.package_id = f.package_id and d.key = rule_key
  left join open_hint h on h.package_id = f.package_id and rule_key = 'mrp'),
care as (select *, case when rule_key = 'consumer_care' then concat_ws(',', case when phones is null then 'phone' end, case when emails is null then 'email' end,
    case when not any_address then 'address' end) else '' end as lacking from pair),
coded as (select *, case when small_package then 'na_small_pack'
    when rule_key = 'unit_sale_price' and needed and price_is_unit_price then 'na_usp_equals_mrp'
    when not needed then case rule_key when 'country_origin' then 'na_not_imported' when 'best_before' then 'na_not_perishable' when 'dimensions' then 'na_no_dimensions'
      else case when alcoholic_beverage then 'na_alcohol' else 'na_package_form' end end
    when not there then case when hinted then 'mrp_unresolved_ref' else 'missing' end
    when conflict and rule_key <> 'consumer_care' then 'conflict'
    when rule_key = 'manufacturer' and address_detected <> 'true' then 'no_address'
    when rule_key = 'mrp' and currency is null and coalesce(tax_inclusive_phrase, '') <> 'true' then 'mrp_no_currency_no_tax'
    when rule_key = 'mrp' and currency is null then 'mrp_no_currency'
    when rule_key = 'mrp' and coalesce(tax_inclusive_phrase, '') <> 'true' then 'mrp_no_tax'
    when lacking <> '' then 'care_incomplete:' || lacking
    when rule_key = 'unit_sale_price' then case when nc or mc then 'usp_conflict' when bq is null or mrp_amount is null or amt is null or rq is null then 'usp_unverifiable'
      when rq <> 1 or reference_unit <> bu then 'usp_wrong_basis' when mrp_a is null or bq <= 0 then 'usp_unchecked'
      when floor((2 * cast(mrp_a * 100 as bigint) * 1000000 + cast(bq * 1000000 as bigint)) / (2 * cast(bq * 1000000 as bigint))) <> cast(amt * 100 as bigint) then 'usp_mismatch' else 'ok' end
    else 'ok' end as code0 from care),
rated as (select *, case when starts_with(code0, 'na_') then 'not_applicable' when code0 in ('missing', 'usp_wrong_basis', 'usp_mismatch') then 'fail'
    when code0 = 'ok' then 'pass' else 'warning' end as status0,
  case when starts_with(code0, 'na_') then 0 when code0 = 'ok' then 100 when code0 in ('conflict', 'usp_conflict') then 45 when code0 in ('no_address') or starts_with(code0, 'care') then 62
    when code0 = 'usp_unchecked' then 70 when code0 = 'mrp_unresolved_ref' then 25 when code0 in ('missing', 'usp_wrong_basis', 'usp_mismatch') then 0 else 55 end as percent,
  case when starts_with(code0, 'na_') then 1.0 when code0 = 'missing' then case when trim(coalesce(raw_text, '')) = '' then 0.0 else 0.88 end
    when code0 = 'mrp_unresolved_ref' then 0.72 else least(dc, case when code0 = 'conflict' then 0.70 when code0 = 'no_address' or starts_with(code0, 'care') then 0.76
      when starts_with(code0, 'mrp_no') then 0.74 when code0 = 'usp_conflict' then 0.68 when code0 = 'usp_unverifiable' then 0.72 when code0 = 'usp_unchecked' then 0.75 else 1.0 end) end as conf0,
  length(regexp_replace(coalesce(raw_text, ''), '\\W+', '', 'g')) < 40 as short from coded),
checks as (select *, case when short and status0 = 'fail' then 'warning' else status0 end as status,
  case when short and status0 = 'fail' then 'low_text' else code0 end as message_code,
  case when short and status0 = 'fail' then least(conf0, 0.35) else conf0 end as confidence,
  case when status0 = 'not_applicable' then 'not_applicable' else 'required' end as applicability,
  case when rule_key = 'consumer_care' then all_values else value end as shown,
  case when rule_key = 'mrp' and not there and not small_package then hint_evidence else evidence end as said from rated)"""

#: The same checks without close-ups, and of packages that are their front's text alone.
_HEAD = CHECKS[: CHECKS.index("wide as (")]
_NO_HINTS = "known as (select * from fused), open_hint as (select 0 as package_id, '' as locator, '' as evidence where false),\n"
_DIRECT_CHECKS = f"{FUSED}, {TEXTS}, {CONTEXTS}, {_NO_HINTS}" + CHECKS.removeprefix(_HEAD)
_MANUAL_CHECKS = f"""{DECLARATIONS.replace("views as (", "views as (select * from (").replace("), n as (", ") where view_no = 1), n as (", 1)}, texts as (select package_id, ocr_text as raw_text from views), {CONTEXTS},
fused as (select package_id, key, confidence, false as conflict, evidence, value as all_values, email as emails, phone as phones, coalesce(address_detected = 'true', false) as any_address,
  value, {', '.join(_ATTRS)} from decl), {_NO_HINTS}""" + CHECKS.removeprefix(_HEAD)

SUMMARY = f"""{CHECKS}, summary as (select package_id,
  case when sum(weight) filter (status <> 'not_applicable') > 0 then cast(round_even(sum(weight * percent) filter (status <> 'not_applicable') / (sum(weight) filter (status <> 'not_applicable'))::double, 0) as integer) end as score,
  case when count(*) filter (status <> 'not_applicable') = 0 then 'not_applicable' when count(*) filter (status = 'fail') > 0 then 'fail'
    when count(*) filter (status = 'warning') > 0 then 'warning' else 'pass' end as status,
  count(*) filter (status = 'pass') as passed, count(*) filter (status = 'warning') as warnings, count(*) filter (status = 'fail') as failed,
  count(*) filter (status = 'not_applicable') as not_applicable from checks group by package_id)"""

REGIONS = f"region as ({fixtures.plain(fixtures.REGIONS)})"


def _label(t: str) -> str:
    return f"regexp_replace(lower({t}), '[^a-z0-9₹]+', '', 'g')"


def _strength(strong: list[str] | tuple[str, ...], short: tuple[str, ...], weak: float) -> str:
    some_of = " or ".join(f"contains(label, '{s}')" for s in strong)
    return f"case when {some_of} then 1.0 when label in ({', '.join(q(s) for s in short)}) then {weak} else 0 end"


def _spatial(strength: str, where: str, a: str, b: str, reach: float, base: str, ka: float, kb: float, value: str, columns: str) -> str:
    return f"""with {REGIONS}, r as (select *, {_label('text')} as label, x + w / 2 as cx, y + h / 2 as cy from region where regexp_matches(text, '\\S')),
l as (select *, {strength} as s from r), v as (select *, {a} as va, {b} as vb from r where {where}),
p as (select l.package_id, l.id as lid, v.id as vid, l.text as lt, v.text as vt, l.confidence as lc, v.confidence as vc, va, vb, l.cx as lx, l.cy as ly, l.label as ll,
    row_number() over (partition by l.package_id order by 2 * s + 0.35 * l.confidence + 0.45 * v.confidence + 1.6 * (1 - sqrt((l.cx - v.cx) * (l.cx - v.cx) + (l.cy - v.cy) * (l.cy - v.cy)) / {reach}) + 0.35 desc, l.region_ord, v.region_ord) as n
  from l join v on l.package_id = v.package_id and l.id <> v.id and s > 0 and sqrt((l.cx - v.cx) * (l.cx - v.cx) + (l.cy - v.cy) * (l.cy - v.cy)) <= {reach}
    and (abs(l.cy - v.cy) <= greatest(0.035, 1.5 * greatest(l.h, v.h)) or abs(l.cx - v.cx) <= greatest(0.035, 1.5 * greatest(l.w, v.w)))),
b as (select * from p where n = 1), c as (select *, coalesce(nullif(vb, ''), case when contains(lt, '₹') or ends_with(ll, 'rs') or contains(ll, 'inr') then 'INR' end) as code from b)
select package_id, {value} as value, left({strip('lt')} || ' | ' || {strip('vt')}, 220) as evidence, round(least(0.98, {base} + {ka} * lc + {kb} * vc), 6) as confidence,
  lid || ',' || vid as region_ids, {columns} from c"""


_PRICED = group("text", spatial.PRICE, 1)
_TAXED = "exists (select 1 from r where r.package_id = c.package_id and sqrt((r.cx - lx) * (r.cx - lx) + (r.cy - ly) * (r.cy - ly)) <= 0.22 and (contains(r.label, 'inclusiveofalltaxes') or contains(r.label, 'inclofalltaxes')))"
_DATE_A = f"case when {has('text', spatial.NUMBER_DATE)} then lpad({group('text', spatial.NUMBER_DATE, 1)}, 2, '0') else {_month(group('text', spatial.NAME_DATE, 1))} end"
_DATE_B = f"case when {has('text', spatial.NUMBER_DATE)} then {_year(group('text', spatial.NUMBER_DATE, 2))} else {_year(group('text', spatial.NAME_DATE, 2))} end"

SQL: dict[str, str] = {}


def _fill() -> None:
    from .queries import SHOWN

    for key, names in SHOWN.items():
        SQL[f"x_{key}"] = _extractor(key, names)
    raw = f"with raw as ({fixtures.plain(fixtures.RAW_VIEWS)})"
    SQL["norm_text"] = f"{raw} select package_id, view_no, {normal('ocr_text')} as normal from raw"
    SQL["address_flag"] = f"with {VIEWS} select package_id, view_no, {address('ocr_text')} as address from views"
    SQL["emails_in_documents"] = f"select doc_id, {group('text', x.EMAIL, 0)} as email from documents where {has('text', x.EMAIL)}"
    SQL["combined_text"] = f"with {VIEWS}, {TEXTS} select * from texts"
    SQL["size_limits"] = """with f as (select cast(floor(doc_id / 7) as bigint) as package_id, doc_id as view_no, n_chars, doc_id % 31 = 5 as plain from documents)
select package_id, view_no, case when count(*) over (partition by package_id) > 6 then 'too_many_files' when plain then 'not_an_image' when n_chars > 9000 then 'file_too_large'
  when sum(n_chars) over (partition by package_id order by view_no rows unbounded preceding) > 20000 then 'total_too_large' end as reject_reason from f"""
    SQL["fuse_declarations"] = f"""with {FUSED} select package_id, key, value, evidence, round(confidence, 6) as confidence, n_views, images,
  case when n_views > 1 and not conflict then 'true' end as confirmed from fused where key <> 'consumer_care'"""
    SQL["fuse_conflicts"] = f"with {FUSED} select package_id, key, value, all_values as candidate_values from fused where conflict and key <> 'consumer_care'"
    SQL["fuse_consumer_care"] = f"""with {FUSED} select package_id, all_values as value, evidence, round(confidence, 6) as confidence,
  split_part(emails, ' | ', 1) as email, split_part(phones, ' | ', 1) as phone, case when n_emails > 1 then emails end as email_candidates,
  case when n_phones > 1 then phones end as phone_candidates, {truth('any_address')} as address_detected, {truth('n_views > 1')} as multi_image_fused
from fused where key = 'consumer_care'"""
    SQL["rule_applicability"] = f"with {CONTEXTS}, {_RULES} select package_id, rule_id, {_NEEDED} as applies from ctx cross join rule"
    SQL["unit_basis"] = f"""with {FACTS} select package_id, cast(grams * 1000 as bigint) as thousandths, gu as base_unit, cast(bq * 1000 as bigint) as basis_thousandths,
  bu as basis_unit, small_package, price_is_unit_price from facts"""
    SQL["checks"] = f"with {CHECKS} select package_id, rule_id, applicability, status, shown as value, said as evidence, round(confidence, 6) as confidence, message_code from checks"
    SQL["usp_arithmetic"] = f"with {CHECKS} select package_id, status, message_code, value from checks where rule_key = 'unit_sale_price'"
    SQL["summary"] = f"with {SUMMARY} select * from summary"
    SQL["score_tone"] = f"with {SUMMARY} select package_id, case when score is null then 'neutral' when score >= 85 and failed = 0 then 'good' when score >= 55 then 'warn' else 'bad' end as tone from summary"
    SQL["rule_profile"] = f"with {CHECKS} select rule_ord, rule_id, rule_key as key, weight, status, count(*) as packages from checks group by all"
    quantity = (group("text", spatial.QUANTITY, 1), _piece(group("text", spatial.QUANTITY, 2)))
    SQL["spatial_net_quantity"] = _spatial(
        _strength(spatial.NET_LABELS, spatial.NET_MISREAD, 0.82), f"{has('text', spatial.QUANTITY)} and try_cast({quantity[0]} as double) > 0", *quantity,
        0.16, "0.82", 0.08, 0.08, "va || ' ' || vb", "va as amount, vb as unit",
    )
    SQL["spatial_month_year"] = _spatial(
        _strength(spatial.DATE_LABELS, spatial.DATE_SHORT, 0.86), f"{has('text', spatial.NUMBER_DATE)} or {has('text', spatial.NAME_DATE)}", _DATE_A, _DATE_B,
        0.18, "0.80", 0.08, 0.09, "va || '/' || vb", "va as month, vb as year",
    )
    SQL["spatial_mrp"] = _spatial(
        "case when starts_with(label, 'mrp') or contains(label, 'maximumretailprice') then 1.0 else 0 end",
        f"{has('text', spatial.PRICE)} and try_cast({group('text', spatial.PRICE, 2)} as double) > 0", group("text", spatial.PRICE, 2),
        f"case when {_PRICED} <> '' then 'INR' end", 0.16, "(case when code is null then 0.76 else 0.84 end)", 0.06, 0.07, "concat_ws(' ', code, va)",
        f"va as amount, code as currency, {truth(_TAXED)} as tax_inclusive_phrase",
    )
    key = lambda t: f"trim(regexp_replace(lower({t}), '[^a-z0-9₹]+', ' ', 'g'))"
    linked = f"""{FUSED}, {REGIONS}, k as (select package_id, key, {key('evidence')} as ek from fused where key in ('net_quantity', 'mrp')),
rk as (select package_id, region_ord, id, {key('text')} as rt from region), link as (select k.package_id, key, id, region_ord from k join rk using (package_id)
  where rt <> '' and (contains(ek, rt) or contains(rt, ek) or len(list_intersect(string_split(ek, ' '), string_split(rt, ' '))) / len(list_distinct(string_split(rt, ' '))) >= 0.6))"""
    SQL["evidence_regions"] = f"""with {linked} select package_id, k.key, coalesce(ids, '') as region_ids from k
  left join (select package_id, key, string_agg(id, ',' order by region_ord) as ids from link group by all) using (package_id, key)"""
    SQL["finding_regions"] = f"""with {CHECKS}, {linked.removeprefix(FUSED + ', ')} select package_id, id as region_id, arg_max(rule_id, rule_ord) as rule_id, arg_max(status, rule_ord) as status
  from link join checks using (package_id) where link.key = rule_key and status <> 'not_applicable' group by package_id, id"""
    SQL["parse_price"] = f"with {PARSED} select package_id, obs_ord, currency, amount, evidence from parsed"
    SQL["vote_price"] = f"with {WON} select package_id, currency, amount, families, votes, round(mean_confidence, 6) as mean_confidence, rank_no from votes"
    SQL["consensus_price"] = f"with {WON} select package_id, currency || ' ' || amount as value, round({_WON_CONF}, 6) as confidence, votes, families from won"
    SQL["merge_supplemental"] = f"""with {DECLARATIONS}, {WON}, both_ as (select package_id, value, confidence, null as ensemble_votes, 0 as src from decl where key = 'mrp' and view_no = 1
  union all select package_id, currency || ' ' || amount, {_WON_CONF}, cast(votes as varchar), 1 from won)
select package_id, value, round(confidence, 6) as confidence, ensemble_votes from both_ qualify row_number() over (partition by package_id order by confidence desc, src) = 1"""
    SQL["staged_price"] = f"""with {PARSED}, seen as (select p.*, s.stage from parsed p join (values (0), (1), (2)) s(stage) on (obs_ord - 1) % 3 <= s.stage),
votes as ({_votes('seen', 'package_id, stage')}), won as ({_won('votes', 'package_id, stage')})
select package_id, stage::bigint as stage, currency, amount, families, votes from won qualify row_number() over (partition by package_id order by stage) = 1"""
    SQL["best_readings"] = f"""with {PARSED}, a as (select p.*, r.text from parsed p join reading r using (package_id, obs_ord)),
o as (select *, row_number() over (partition by package_id order by (currency is not null)::int desc, confidence desc, length(text) desc, obs_ord) as n, count(*) over (partition by package_id) as attempts from a)
select package_id, text as best_text, attempts from o where n = 1"""
    SQL["direct_hints"] = f"with {VIEWS}, {HINTS} select * from hint"
    SQL["unresolved_reference"] = f"""with {VIEWS}, {HINTS}, {WON} select package_id, locator as value, evidence, 0.82::double as confidence from hint
  where package_id not in (select package_id from won)"""
    SQL["staged_price_fallback"] = f"""with {PARSED}, seen as (select p.*, s.stage from parsed p join (values (0), (1), (2)) s(stage) on ((obs_ord - 1) % 3 + 1) % 3 <= s.stage),
votes as ({_votes('seen', 'package_id, stage')}), won as ({_won('votes', 'package_id, stage')})
select package_id, stage::bigint as stage, currency, amount, families, votes from won qualify row_number() over (partition by package_id order by stage) = 1"""
    SQL["reading_attempts"] = f"""with {WON} select p.package_id, obs_ord, family, p.currency, p.amount,
  coalesce(p.currency = won.currency and p.amount = won.amount, false) as agrees from parsed p left join won on won.package_id = p.package_id"""
    SQL["reference_hints"] = f"with {VIEWS}, {REFERENCES} select package_id, view_no, locator, evidence, tax_inclusive_phrase from reference"
    SQL["recovery_outcome"] = f"""with {FUSED}, {TEXTS}, {REFERENCES}, {WON},
h as (select * from reference qualify row_number() over (partition by package_id order by view_no, apart, i) = 1),
agreeing as (select p.package_id, p.obs_ord, r.text from parsed p join won on won.package_id = p.package_id and p.currency = won.currency and p.amount = won.amount
  join reading r on r.package_id = p.package_id and r.obs_ord = p.obs_ord qualify row_number() over (partition by p.package_id order by p.obs_ord) <= 4),
added as (select package_id, '--- close-up ---' || chr(10) || string_agg(text, chr(10) || '---' || chr(10) order by obs_ord) as added_text from agreeing group by package_id),
w as (select t.package_id, h.locator, h.tax_inclusive_phrase as tax, f.confidence, f.currency, f.amount, f.tax_inclusive_phrase as own_tax,
    coalesce(f.currency = 'INR' and f.amount <> '', false) as complete, h.package_id is not null as explicit from texts t left join h on h.package_id = t.package_id
  left join fused f on f.package_id = t.package_id and f.key = 'mrp' where h.package_id is not null
    or not coalesce(f.currency = 'INR' and f.amount <> '', false) and {has('raw_text', f'(?i){recovery.LABEL}|{recovery.TAX}')}),
o as (select w.*, won.amount as won_amount, {_WON_CONF} as won_confidence, case when complete and coalesce(tax, false) and coalesce(own_tax, '') <> 'true' then 'enriched'
    when complete then 'kept' when won.package_id is not null then 'recovered' when explicit then 'unresolved' else 'nothing' end as outcome
  from w left join won on won.package_id = w.package_id)
select o.package_id, outcome, case outcome when 'recovered' then 'INR ' || won_amount when 'unresolved' then locator when 'nothing' then null else concat_ws(' ', currency, amount) end as value,
  round(case outcome when 'enriched' then least(0.96, greatest(confidence, 0.90)) when 'kept' then confidence when 'recovered' then won_confidence when 'unresolved' then 0.82 end, 6) as confidence,
  case when outcome = 'recovered' then added_text end as added_text from o left join added on added.package_id = o.package_id"""
    SQL["spatial_first"] = f"""with {DECLARATIONS}, placed as (
  {" union all ".join(f"select package_id, '{k}' as key, value, evidence, confidence from ({SQL[f'spatial_{k}']}) {k}_s" for k in ('net_quantity', 'month_year', 'mrp'))})
select package_id, key, value, evidence, confidence, 'spatial_label_value' as extraction_strategy from placed
union all select package_id, key, value, evidence, round(confidence, 6), null from decl
where view_no = 1 and not exists (select 1 from placed where placed.package_id = decl.package_id and placed.key = decl.key)"""
    SQL["evidence_facts"] = f"with {FUSED} select package_id, key, value, evidence, round(confidence, 6) as confidence, n_views from fused where key <> 'consumer_care'"
    SQL["crop_nms"] = f"""with recursive c as ({fixtures.plain(fixtures.CROPS)}), o as (select *, row_number() over (partition by package_id order by score desc, ord) as n from c),
both_ as (select a.package_id, a.n, b.n as m, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as shared,
    a.w * a.h + b.w * b.h as areas from o a join o b on a.package_id = b.package_id and b.n < a.n),
hit as (select package_id, n, list(m) as hits from both_ where shared / (areas - shared)::double >= 0.6 group by package_id, n),
step as (select o.package_id, o.n, o.label, coalesce(hits, []) as hits from o left join hit on hit.package_id = o.package_id and hit.n = o.n),
kept as (select distinct package_id, 0::bigint as n, []::bigint[] as ns, ''::varchar as labels from c
  union all select k.package_id, s.n, case when len(k.ns) >= 3 or list_has_any(s.hits, k.ns) then k.ns else list_append(k.ns, s.n) end,
    case when len(k.ns) >= 3 or list_has_any(s.hits, k.ns) then k.labels when k.labels = '' then s.label else k.labels || ',' || s.label end
  from kept k join step s on s.package_id = k.package_id and s.n = k.n + 1)
select package_id, labels as kept from kept qualify row_number() over (partition by package_id order by n desc) = 1"""
    SQL["attention_tiles"] = """with p as (select p_partkey as package_id, cast(100 + p_partkey * 13 % 3000 as integer) as line_width from part),
w as (select *, cast(least(greatest(320, least(680, round_even(line_width * 0.36::double, 0))), line_width) as integer) as w from p where line_width >= 420),
s as (select *, cast(greatest(160, round_even(w * 0.55::double, 0)) as integer) as step, line_width - w as last from w),
t as (select *, list_sort(list_distinct(list_append(range(0, last + 1, step), last))) as starts from s),
k as (select *, case when len(starts) <= 5 then starts else list_sort(list_distinct(list_transform([0, 1, 2, 3, 4],
    lambda i: starts[cast(round_even(i * (len(starts) - 1) / 4.0::double, 0) as integer) + 1]))) end as picked from t),
e as (select *, unnest(range(1, len(picked) + 1)) as n from k)
select package_id, line_width, n - 1 as n, picked[n]::bigint as start, w::bigint as w from e"""
    text = lambda name, c: f"""case when {c} is null then '' else '"{name}":' || cast(to_json({c}) as varchar) || ',' end"""
    SQL["report_json"] = f"""with {SUMMARY}, body as (select package_id, string_agg('{{"rule_ord":' || rule_ord || ',"rule_id":"' || rule_id || '","key":"' || rule_key || '","weight":' || weight
  || ',"applicability":"' || applicability || '","status":"' || status || '",' || {text('value', 'shown')} || {text('evidence', 'said')} || '"confidence":' || cast(to_json(confidence::double) as varchar)
  || ',"message_code":"' || message_code || '","percent":' || percent || '}}', ',' order by rule_ord) as checks from checks group by package_id)
select s.package_id, '{{"package_id":' || s.package_id || ',"summary":{{' || {text('score', 'score')} || '"status":"' || s.status || '","passed":' || passed || ',"warnings":' || warnings
  || ',"failed":' || failed || ',"not_applicable":' || not_applicable || '}},"checks":[' || body.checks || ']}}' as report from summary s join body on body.package_id = s.package_id"""
    SQL["recovery_plan"] = f"""with {DECLARATIONS}, {HINTS}, m as (select * from decl where key = 'mrp' and view_no = 1)
select hint.package_id, not coalesce(m.currency = 'INR' and m.amount <> '', false) as needs_recovery,
  case when coalesce(m.currency = 'INR' and m.amount <> '', false) and hint.tax_inclusive_phrase and coalesce(m.tax_inclusive_phrase, '') <> 'true'
    then round(least(0.96, greatest(m.confidence, 0.90)), 6) end as enriched_confidence from hint left join m on m.package_id = hint.package_id"""
    SQL["crop_select"] = f"""with c as ({fixtures.plain(fixtures.CROPS)}), o as (select *, row_number() over (partition by package_id order by score desc, ord) as n,
  lead(score) over (partition by package_id order by score desc, ord) as nxt from c), s as (select package_id, case when score >= greatest(0.30, 1.30 * nxt) then 1 else 2 end as k from o where n = 1)
select package_id, string_agg(label, ',' order by n) as chosen from o join s using (package_id) where n <= k group by package_id"""
    SQL["remap_polygon"] = f"""with {REGIONS} select package_id, id, round(least(1, greatest(0, 0.25 + x * 0.9)), 6) as x0, round(least(1, greatest(0, 0.5 + y * 0.7)), 6) as y0,
  round(least(1, greatest(0, 0.25 + (x + w) * 0.9)), 6) as x1, round(least(1, greatest(0, 0.5 + (y + h) * 0.7)), 6) as y1 from region where region_ord in (2, 5, 9)"""
    SQL["payload_regions"] = f"""with {REGIONS}, b as (select *, least(1, greatest(0, (x * 1000 - 300) / 1000)) as a, least(1, greatest(0, (x + w) * 1000 / 1000)) as c,
  least(1, greatest(0, y * 600 / 600)) as d, least(1, greatest(0, (y + h) * 900 / 600)) as e,
  row_number() over (partition by package_id order by region_ord) as row_number from region)
select package_id, 'r' || row_number as region_id, {strip('text')} as text, round(case when region_ord = 3 then 0 when region_ord = 5 then 1 else confidence end, 6) as confidence,
  round(least(a, c), 6) as x, round(least(d, e), 6) as y, round(abs(c - a), 6) as w, round(abs(e - d), 6) as h from b where regexp_matches(text, '\\S')"""
    SQL["place_consensus"] = f"""with {WORK} select w.package_id, w.view_no, w.locator, upto as turn, w.currency, w.amount, w.families, w.votes,
  round(w.mean_confidence, 6) as mean_confidence, price_evidence as evidence, direct from won w join backed b on {_SAME_PLACE.format('b', 'w')}"""
    SQL["lazy_stages"] = f"""with {WORK}, asked as (select w.*, a.turn from work w join (values (1), (2), (3)) a(turn) on true left join won on {_SAME_PLACE.format('won', 'w')} where upto is null or a.turn <= upto)
select a.package_id, a.view_no, a.locator, a.turn, count(s.package_id) as read, coalesce(any_value(won.upto) = a.turn, false) as settled
from asked a left join won on {_SAME_PLACE.format('won', 'a')} left join seen s on {_SAME_PLACE.format('s', 'a')} and s.turn = a.turn group by a.package_id, a.view_no, a.locator, a.turn"""
    SQL["hint_outcomes"] = f"""with {WORK} select d.package_id, d.view_no, d.hint_ord, d.locator, d.explicit, d.outcome, m.value, m.evidence, round(m.confidence, 6) as confidence, m.tax_inclusive_phrase
from done d left join more m on {_SAME_VIEW.format('m', 'd')} and m.src = d.hint_ord"""
    SQL["second_extraction"] = f"with {INSPECTED} select d.package_id, d.view_no, key, value, evidence, round(confidence, 6) as confidence from decl d join added a on {_SAME_VIEW.format('a', 'd')}"
    corners = lambda r, y, h: f"{r}_text as text, {r}_confidence as confidence, 0.1 as x, {y} as y, 0.4 as w, {h} as h"
    inside = lambda v: f"round(least(1, greatest(0, {v})), 6)"
    SQL["recovered_regions"] = f"""with {WORK}, b as (select s.*, {_SHOWS('r1')} as s1, {_SHOWS('r2')} as s2 from backing s
  join work w on {_SAME_PLACE.format('w', 's')} join first_won f on {_SAME_VIEW.format('f', 's')} and w.hint_ord = f.k),
e as (select package_id, view_no, nth, sx, sy, sw, sh, 1 as o, {corners('r1', 0.2, 0.3)} from b where s1 or not s2 union all
  select package_id, view_no, nth, sx, sy, sw, sh, 2, {corners('r2', 0.6, 0.2)} from b where s2 or not s1)
select package_id, view_no, 't' || row_number() over (partition by package_id, view_no order by nth, o) as id, text, round(confidence, 6) as confidence,
  {inside('sx + x * sw')} as x0, {inside('sy + y * sh')} as y0, {inside('sx + (x + w) * sw')} as x1, {inside('sy + (y + h) * sh')} as y1 from e"""
    lines = f"""lines as (select package_id, view_no, image_id, i, ls[i] as text, {key('ls[i]')} as rt from (select *, unnest(range(1, len(ls) + 1)) as i from (select *, string_split(ocr_text, chr(10)) as ls from {{}})))"""
    half = "contains(ek, rt) or len(list_intersect(string_split(ek, ' '), string_split(rt, ' '))) / len(list_distinct(string_split(rt, ' '))) >= 0.5"
    SQL["hint_regions"] = f"""with {WORK}, {lines.format('views0')}, h as (select *, {key('evidence')} as ek from hinted),
l as (select h.package_id, h.view_no, h.locator, string_agg('r' || i, ',' order by i) as ids from h join lines r on {_SAME_VIEW.format('r', 'h')} where rt <> '' and ({half}) group by all)
select h.package_id, h.view_no, h.locator, coalesce(ids, '') as region_ids from h left join l on {_SAME_PLACE.format('l', 'h')}"""
    SQL["view_finding_regions"] = f"""with {_DIRECT_CHECKS}, {lines.format('views')}, k as (select *, {key('evidence')} as ek from decl),
link as (select k.package_id, k.key, k.image_id || ':r' || i as id from k join lines r on {_SAME_VIEW.format('r', 'k')} where rt <> '' and evidence <> ''
  and (contains(ek, rt) or contains(rt, ek) or len(list_intersect(string_split(ek, ' '), string_split(rt, ' '))) / len(list_distinct(string_split(rt, ' '))) >= 0.6))
select package_id, id as region_id, arg_max(rule_id, rule_ord) as rule_id, arg_max(status, rule_ord) as status from link join checks using (package_id)
where link.key = rule_key and status <> 'not_applicable' group by package_id, id"""
    SQL["manual_inspection"] = f"""with {_MANUAL_CHECKS} select package_id, rule_id, status, value, evidence, round(confidence, 6) as confidence, message_code from checks"""


_fill()
