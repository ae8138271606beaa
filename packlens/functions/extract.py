"""Declarations in the text of a view: one struct column for each kind, made of regular expressions.

All searches ignore case; the first match wins, and an earlier pattern goes before an earlier place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import compact, currency, found, is_address, key_text, line_of, normal_text, once, settled, strip

#: All attributes a declaration can have.
ATTRIBUTES = (
    "role address_detected country amount unit tax_inclusive_phrase currency month year declaration dimensions email"
    " phone reference_quantity reference_unit extraction_strategy source_file source locator reference_evidence"
    " recovery_strategy ensemble_votes ensemble_families email_candidates phone_candidates multi_image_fused"
    " multi_image_conflict candidate_values multi_image_confirmed"
).split()

#: Kinds of declarations in their order, with their labels.
LABELS = {
    "manufacturer": "Manufacturer / Packer / Importer",
    "country_origin": "Country of Origin / Manufacture / Assembly",
    "commodity_name": "Common / Generic Name",
    "net_quantity": "Net Quantity",
    "month_year": "Month & Year of Manufacture / Packing / Import",
    "best_before": "Best Before / Use By",
    "mrp": "Maximum Retail Price (MRP)",
    "dimensions": "Size / Dimensions",
    "consumer_care": "Consumer Care Details",
    "unit_sale_price": "Unit Sale Price",
}

#: The wording of each kind on labels.
_MAKER = (
    r"(?i)(manufactured|mfd|packed|marketed|imported)\s+by\s*[:\-]?\s*([^\n]{4,})",
    r"(?i)(manufacturer|packer|importer)\s*[:\-]?\s*([^\n]{4,})",
)
_ORIGIN = (
    r"(?i)(?:country\s+of\s+(?:origin|manufacture|assembly)|origin)\s*[:\-]?\s*([A-Za-z][A-Za-z .'-]{1,48})",
    r"(?i)(?:made|manufactured|assembled)\s+in\s+([A-Za-z][A-Za-z .'-]{1,48})",
)
_NAME = r"(?i)(?:product|commodity|generic)\s+name\s*[:\-]?\s*([^\n]{3,})"
_NET = (
    r"(?i)(?:net\s*(?:qty|quantity|wt|weight)|contents?)\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*"
    r"(kg|g|mg|l|ml|cl|pcs?|pieces?|n)\b"
)
_PRICE_LABELS = (r"(?:\bmrp\b|m\.?r\.?p\.?)", r"maximum\s+retail\s+price")
_AMOUNT = r"(\d{1,7}(?:\.\d{1,2})?)"
_MADE = r"(?:mfg|mfd|manufactured|packed|imported)"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MADE_NUMBER = rf"(?i){_MADE}\s*(?:date|on)?\s*[:\-]?\s*(0?[1-9]|1[0-2])[/\-.]((?:20)?\d{{2}})"
_MADE_NAME = rf"(?i){_MADE}[^\n]{{0,20}}({'|'.join(_MONTHS)})[a-z]*\s*[,]?\s*(20\d{{2}})"
_BEFORE = r"(?i)(?:best\s+before|use\s+by|use\s+before|expiry|exp\.?\s*date)\s*[:\-]?\s*([^\n]{2,80})"
_SIZE = (
    r"(?i)(?:dimensions?|size)\s*[:\-]?\s*(\d+(?:\.\d+)?\s*(?:cm|mm|m)?\s*[x×]\s*\d+(?:\.\d+)?"
    r"(?:\s*(?:cm|mm|m)?\s*[x×]\s*\d+(?:\.\d+)?)?\s*(?:cm|mm|m)?)"
)
_CARE = r"(?i)consumer\s*(?:care|complaint|helpline)"
EMAIL = r"(?iU)[\w.+-]+@[\w.-]+\.[a-z]{2,}"
_PHONE = r"(?:\+?91[\s-]?)?([6-9]\d{9})\b"
_CARE_EMAIL = r"(?iU)(?:care|support|consumer)[\w.+-]*@[\w.-]+\.[a-z]{2,}"
_UNIT_PRICE = (
    r"(?i)(?:unit\s*(?:sale\s*)?price|usp)\s*[:\-]?\s*(₹|rs\.?|inr)\s*(\d+(?:\.\d+)?)\s*(?:/|per)\s*"
    r"(?:(\d+(?:\.\d+)?)\s*)?(g|kg|ml|l|piece|pc|number|unit)\b"
)
TAX = r"(?i)(?:inclusive\s+of\s+all\s+taxes|incl\.?\s+of\s+all\s+taxes)"


def attributes(**given: Column) -> Column:
    """The attribute struct; what isn't given is null."""
    none = F.lit(None).cast("string")
    return F.struct(*(given[a].cast("string").alias(a) if a in given else none.alias(a) for a in ATTRIBUTES))


def candidate(value: Column, evidence: Column, confidence: float | Column, **attrs: Column) -> Column:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        value.alias("value"), evidence.alias("evidence"), conf.cast("double").alias("confidence"), attributes(**attrs).alias("attrs")
    )


def flag(c: Column) -> Column:
    """'true' or 'false'."""
    return F.coalesce(c, F.lit(False)).cast("string")


class Found:
    """What patterns find in a text: whether, groups of the first match, and the line in which it begins."""

    def __init__(self, text: Column) -> None:
        self.text = text

    def has(self, pattern: str) -> Column:
        return self.text.rlike(pattern)

    def group(self, pattern: str, n: int) -> Column:
        return F.regexp_extract(self.text, pattern, n)

    def line(self, pattern: str) -> Column:
        return line_of(self.text, pattern)


class _Settled(Found):
    """The same from columns that hold each pattern's first match and its line: a text is searched once for each pattern.

    A match alone has the same groups as in its text, since no pattern looks beyond its match but for word boundaries.
    """

    def has(self, pattern: str) -> Column:
        return F.col(f"_m{PATTERNS.index(pattern)}") != ""

    def group(self, pattern: str, n: int) -> Column:
        return F.regexp_extract(F.col(f"_m{PATTERNS.index(pattern)}"), pattern, n)

    def line(self, pattern: str) -> Column:
        return F.col(f"_l{PATTERNS.index(pattern)}")


def _found(t: Column | Found) -> Found:
    return t if isinstance(t, Found) else Found(t)


def _first(t: Found, *options: tuple[str, Column]) -> Column:
    out = None
    for pattern, made in options:
        out = F.when(t.has(pattern), made) if out is None else out.when(t.has(pattern), made)
    return out


def manufacturer(t: Column | Found) -> Column:
    t = _found(t)

    def made(p: str, conf: float) -> tuple[str, Column]:
        value = strip(t.group(p, 2))
        return p, candidate(value, t.line(p), conf, role=F.lower(t.group(p, 1)), address_detected=flag(is_address(value)))

    return _first(t, made(_MAKER[0], 0.92), made(_MAKER[1], 0.86))


def country_origin(t: Column | Found) -> Column:
    t = _found(t)

    def made(p: str, conf: float) -> tuple[str, Column]:
        value = F.regexp_replace(t.group(p, 1), r"^[ .,-]+|[ .,-]+$", "")
        return p, candidate(value, t.line(p), conf, country=value)

    return _first(t, made(_ORIGIN[0], 0.95), made(_ORIGIN[1], 0.90))


def commodity_name(t: Column | Found) -> Column:
    t = _found(t)
    return _first(t, (_NAME, candidate(strip(t.group(_NAME, 1)), t.line(_NAME), 0.92)))


def piece_unit(unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low.isin("pc", "pcs", "piece", "pieces", "n"), "pc").otherwise(low)


def net_quantity(t: Column | Found) -> Column:
    t = _found(t)
    amount, unit = t.group(_NET, 1), piece_unit(t.group(_NET, 2))
    return _first(t, (_NET, candidate(F.concat_ws(" ", amount, unit), t.line(_NET), 0.94, amount=amount, unit=unit)))


_GAP = r"[ \t]*(?::|-)?[ \t]*"
_PRICES = tuple(rf"(?i){label}{_GAP}(₹|rs\.?|inr)[ \t]*{_AMOUNT}" for label in _PRICE_LABELS)
_BARE_PRICES = tuple(rf"(?i){label}{_GAP}{_AMOUNT}" for label in _PRICE_LABELS)


def mrp(t: Column | Found) -> Column:
    t, options = _found(t), []
    for p in _PRICES:
        code, amount, line = currency(t.group(p, 1)), t.group(p, 2), t.line(p)
        made = candidate(
            F.concat_ws(" ", code, amount), line, 0.95, amount=amount, currency=code, tax_inclusive_phrase=flag(line.rlike(TAX))
        )
        options.append((p, made))
    for p in _BARE_PRICES:
        amount, line = t.group(p, 1), t.line(p)
        options.append((p, candidate(amount, line, 0.84, amount=amount, tax_inclusive_phrase=flag(line.rlike(TAX)))))
    return _first(t, *options)


def full_year(year: Column) -> Column:
    return F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*(F.lit(m) for m in _MONTHS)), F.left(F.lower(name), F.lit(3)))
    return F.lpad(at.cast("string"), 2, "0")


def month_year(t: Column | Found) -> Column:
    t = _found(t)
    month, year = F.lpad(t.group(_MADE_NUMBER, 1), 2, "0"), full_year(t.group(_MADE_NUMBER, 2))
    named, in_year = month_number(t.group(_MADE_NAME, 1)), t.group(_MADE_NAME, 2)
    return _first(
        t,
        (_MADE_NUMBER, candidate(F.concat_ws("/", month, year), t.line(_MADE_NUMBER), 0.94, month=month, year=year)),
        (_MADE_NAME, candidate(F.concat_ws("/", named, in_year), t.line(_MADE_NAME), 0.90, month=named, year=in_year)),
    )


def best_before(t: Column | Found) -> Column:
    t = _found(t)
    value = strip(t.group(_BEFORE, 1))
    return _first(t, (_BEFORE, candidate(value, t.line(_BEFORE), 0.92, declaration=value)))


def dimensions(t: Column | Found) -> Column:
    t = _found(t)
    value = strip(F.regexp_replace(t.group(_SIZE, 1), r"\s+", " "))
    return _first(t, (_SIZE, candidate(value, t.line(_SIZE), 0.90, dimensions=value)))


def consumer_care(t: Column | Found) -> Column:
    t = _found(t)
    lines = F.filter(F.split(t.text, r"[\n\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: x.rlike(_CARE) & (x.rlike(EMAIL) | x.rlike(_PHONE)))

    def made(line: Column) -> Column:
        email, phone = found(line, EMAIL, 0), found(line, _PHONE, 1)
        value, place = F.concat_ws(" | ", email, phone), flag(is_address(line))
        return candidate(value, compact(line), 0.94, address_detected=place, email=email, phone=phone)

    full = F.get(F.transform(F.slice(lines, 1, 1), made), F.lit(0))  # the line is found once
    lone = F.nullif(t.group(_CARE_EMAIL, 0), F.lit(""))
    alone = candidate(lone, compact(lone), 0.82, email=lone, address_detected=F.lit("false"))
    return F.coalesce(full, F.when(lone.isNotNull(), alone))


def unit_sale_price(t: Column | Found) -> Column:
    t = _found(t)
    code, amount = currency(t.group(_UNIT_PRICE, 1)), t.group(_UNIT_PRICE, 2)
    quantity = F.coalesce(F.nullif(t.group(_UNIT_PRICE, 3), F.lit("")), F.lit("1"))
    low = F.lower(t.group(_UNIT_PRICE, 4))
    unit = F.when(low.isin("piece", "pc", "number", "unit"), "pc").otherwise(low)
    value = F.concat(code, F.lit(" "), amount, F.lit(" / "), quantity, F.lit(" "), unit)
    made = candidate(
        value, t.line(_UNIT_PRICE), 0.93, currency=code, amount=amount, reference_quantity=quantity, reference_unit=unit
    )
    return _first(t, (_UNIT_PRICE, made))


PRICE_PATTERNS = (*_PRICES, *_BARE_PRICES)
#: The patterns that each kind is searched by in whole texts.
PATTERNS_OF = {
    "manufacturer": _MAKER, "country_origin": _ORIGIN, "commodity_name": (_NAME,), "net_quantity": (_NET,), "mrp": PRICE_PATTERNS, "month_year": (_MADE_NUMBER, _MADE_NAME),
    "best_before": (_BEFORE,), "dimensions": (_SIZE,), "consumer_care": (_CARE_EMAIL,), "unit_sale_price": (_UNIT_PRICE,),
}
PATTERNS = sum(PATTERNS_OF.values(), ())


def searched(views: DataFrame, patterns: tuple[str, ...] = PATTERNS, text: str = "ocr_text") -> tuple[DataFrame, Found]:
    """Adds ``_text`` (normal) and what the patterns find in it, each searched once in its row; the second is for the extractors."""
    rows = settled(views, _text=normal_text(F.col(text)))
    rows = settled(rows, **{f"_m{PATTERNS.index(p)}": F.regexp_extract("_text", p, 0) for p in patterns})
    lined = [p for p in patterns if p != _CARE_EMAIL]
    lines = {f"_l{PATTERNS.index(p)}": F.when(F.col(f"_m{PATTERNS.index(p)}") != "", line_of(F.col("_text"), p)) for p in lined}
    return settled(rows, **lines), _Settled(F.col("_text"))


EXTRACTORS: dict[str, Callable[[Column | Found], Column]] = {
    f.__name__: f
    for f in (
        manufacturer, country_origin, commodity_name, net_quantity, month_year, best_before, mrp, dimensions, consumer_care,
        unit_sale_price,
    )
}


def linked_regions(evidence: Column, regions: Column, share: float = 0.60, either_way: bool = True) -> Column:
    """Ids of the regions that belong to an evidence: one contains the other, or enough of a region's words are in it."""
    key = key_text(evidence)
    words = lambda k: F.array_distinct(F.filter(F.split(k, " "), lambda w: w != ""))

    def linked(said: Column, own: Column) -> Column:
        key = said["key"]
        mine = F.array_distinct(F.split(own, " "))
        shared = once(mine, lambda m: F.size(F.array_intersect(said["words"], m)) / F.greatest(F.lit(1), F.size(m)))
        inside = F.contains(key, own) | F.contains(own, key) if either_way else F.contains(key, own)
        return (own != "") & (inside | (shared >= share))

    # keys and words of the evidence are made once, a region's key once for the evidence
    said = once(key, lambda k: F.struct(k.alias("key"), words(k).alias("words")))
    ids = once(said, lambda e: F.transform(F.filter(regions, lambda r: once(key_text(r["text"]), lambda own: linked(e, own))), lambda r: r["id"]))
    some = evidence.isNotNull() & (evidence != "") if either_way else F.size(words(key)) > 0
    return F.when(some, ids).otherwise(F.array().cast("array<string>"))


def declarations(views: DataFrame, spatial: Callable[[str], Column | None] = lambda key: None) -> DataFrame:
    """A row for each declaration of each view: the view's columns, key_no, key, value, evidence, confidence, attrs.

    ``spatial``: gives for a kind the column that, where it isn't null, goes before the text's. Each view is handled in
    its own row; nothing is shuffled.
    """
    rows, t = searched(views)
    columns = []
    for n, (key, extractor) in enumerate(EXTRACTORS.items()):
        made, placed = extractor(t), spatial(key)
        both = made if placed is None else F.coalesce(placed, made)
        columns.append(F.struct(F.lit(n).alias("key_no"), F.lit(key).alias("key"), both.alias("d")))
    rows = rows.select(*views.columns, F.explode(F.array(*columns)).alias("x")).where("x.d is not null")
    return rows.select(*views.columns, "x.key_no", "x.key", "x.d.*")
