"""Labels and values that stand apart on a page, paired by place.

All regions of a view are one array in its row, so pairing is done inside the row: every label with every value, the
best score wins, and of equal ones the first label and then the first value. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import candidate, currency, full_year, month_number, piece_unit
from ..functions.text import compact_label, decimal, joined_evidence, settled

#: Labels as they are read, without spaces.
NET_LABELS, NET_MISREAD = ("netquantity", "netqty", "netweight", "netwt"), ("new", "newt", "netw", "netwt")
DATE_LABELS = (
    "mthofpack monthofpack monthofpacking packingdate packedon dateofpacking mfgdate mfddate dateofmanufacture dateofmanufacturing"
).split()
DATE_SHORT = ("mfd", "mfg", "packed", "packing")
TAX_LABELS = ("inclusiveofalltaxes", "inclofalltaxes")
QUANTITY = r"(?i)^\s*(\d{1,6}(?:\.\d{1,3})?)\s*(kg|mg|g|ml|cl|l|pcs?|pieces?|n)\.?\s*$"
NUMBER_DATE = r"(?i)^\s*(0?[1-9]|1[0-2])\s*[/\-.]\s*((?:20)?\d{2})\s*$"
NAME_DATE = (
    r"(?i)^\s*(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    r"|nov(?:ember)?|dec(?:ember)?)\s*[/\-. ]+\s*((?:20)?\d{2})\s*$"
)
PRICE = r"(?i)^\s*(₹|rs\.?|inr)?\s*[:\-]?\s*(\d{1,7}(?:\.\d{1,2})?)\s*(?:/\-)?\s*$"

#: What a value region yields: two texts, of which the second may be null.
PAYLOAD = "struct<a string, b string>"


def _any(label: Column, parts: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(label, F.lit(p))
    return out


def net_strength(text: Column) -> Column:
    label = compact_label(text)
    return F.when(_any(label, NET_LABELS), 1.0).when(label.isin(*NET_MISREAD), 0.82).otherwise(0.0)


def date_strength(text: Column) -> Column:
    label = compact_label(text)
    return F.when(_any(label, DATE_LABELS), 1.0).when(label.isin(*DATE_SHORT), 0.86).otherwise(0.0)


def price_strength(text: Column) -> Column:
    label = compact_label(text)
    return F.when(F.startswith(label, F.lit("mrp")) | F.contains(label, F.lit("maximumretailprice")), 1.0).otherwise(0.0)


def _payload(a: Column, b: Column) -> Column:
    return F.struct(a.cast("string").alias("a"), b.cast("string").alias("b"))


def quantity_value(text: Column) -> Column:
    amount = F.regexp_extract(text, QUANTITY, 1)
    return F.when(text.rlike(QUANTITY) & (decimal(amount) > 0), _payload(amount, piece_unit(F.regexp_extract(text, QUANTITY, 2))))


def date_value(text: Column) -> Column:
    number = _payload(F.lpad(F.regexp_extract(text, NUMBER_DATE, 1), 2, "0"), full_year(F.regexp_extract(text, NUMBER_DATE, 2)))
    name = _payload(month_number(F.regexp_extract(text, NAME_DATE, 1)), full_year(F.regexp_extract(text, NAME_DATE, 2)))
    return F.when(text.rlike(NUMBER_DATE), number).when(text.rlike(NAME_DATE), name)


def price_value(text: Column) -> Column:
    amount = F.regexp_extract(text, PRICE, 2)
    return F.when(text.rlike(PRICE) & (decimal(amount) > 0), _payload(amount, currency(F.regexp_extract(text, PRICE, 1))))


def centre(r: Column) -> tuple[Column, Column]:
    return r["x"] + r["w"] / 2, r["y"] + r["h"] / 2


def distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def aligned(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    row = F.abs(ay - by) <= F.greatest(F.lit(0.035), 1.5 * F.greatest(a["h"], b["h"]))
    column = F.abs(ax - bx) <= F.greatest(F.lit(0.035), 1.5 * F.greatest(a["w"], b["w"]))
    return row | column


def pair_score(a: Column, b: Column, strength: Column, reach: float) -> Column:
    near = 1 - distance(a, b) / reach
    return 2 * strength + 0.35 * a["confidence"] + 0.45 * b["confidence"] + 1.6 * near + 0.35


def best_pair(regions: Column, strength: Callable[[Column], Column], value: Callable[[Column], Column], reach: float) -> Column:
    """struct(score, label, value, payload) of the best pair; null if there is none."""
    labels = F.filter(F.transform(regions, lambda r, i: F.struct(r.alias("r"), i.alias("i"), strength(r["text"]).alias("s"))), lambda x: x["s"] > 0)
    values = F.filter(F.transform(regions, lambda r, i: F.struct(r.alias("r"), i.alias("i"), value(r["text"]).alias("p"))), lambda x: x["p"].isNotNull())

    def pairs(a: Column) -> Column:
        fit = F.filter(values, lambda v: (a["r"]["id"] != v["r"]["id"]) & (distance(a["r"], v["r"]) <= reach) & aligned(a["r"], v["r"]))
        return F.transform(
            fit,
            lambda v: F.struct(
                pair_score(a["r"], v["r"], a["s"], reach).alias("score"), (-a["i"]).alias("first"), (-v["i"]).alias("then"),
                a["r"].alias("label"), v["r"].alias("value"), v["p"].alias("payload"),
            ),
        )

    return F.array_max(F.flatten(F.transform(labels, pairs)))


def _found(best: Column, value: Column, confidence: Column, **attrs: Column) -> Column:
    made = candidate(
        value, joined_evidence(best["label"]["text"], best["value"]["text"]), F.least(F.lit(0.98), confidence),
        extraction_strategy=F.lit("spatial_label_value"), **attrs,
    )
    ids = F.array(best["label"]["id"], best["value"]["id"])
    return F.when(best.isNotNull(), F.struct(made.alias("d"), ids.alias("region_ids")))


def spatial_fields(views: DataFrame) -> DataFrame:
    """Adds net_quantity, month_year and mrp (structs of d and region_ids, null if not found) to views with ``regions``.

    ``regions``: array of (id, text, confidence, x, y, w, h), shares of the page; blank ones are left out.
    """
    some = F.filter("regions", lambda r: r["text"].rlike(r"(?U)\S"))
    rows = settled(
        settled(views, _r=some),
        _net=best_pair(F.col("_r"), net_strength, quantity_value, 0.16),
        _date=best_pair(F.col("_r"), date_strength, date_value, 0.18),
        _price=best_pair(F.col("_r"), price_strength, price_value, 0.16),
    )
    net, date, price = F.col("_net"), F.col("_date"), F.col("_price")
    both = lambda b, base, k, v: base + k * b["label"]["confidence"] + v * b["value"]["confidence"]
    label = price["label"]["text"]
    code = F.coalesce(
        price["payload"]["b"],
        F.when(F.contains(label, F.lit("₹")) | F.endswith(compact_label(label), F.lit("rs")) | F.contains(compact_label(label), F.lit("inr")), "INR"),
    )
    taxed = F.exists("_r", lambda r: (distance(price["label"], r) <= 0.22) & _any(compact_label(r["text"]), TAX_LABELS))
    amount, unit = net["payload"]["a"], net["payload"]["b"]
    month, year = date["payload"]["a"], date["payload"]["b"]
    return settled(
        rows,
        net_quantity=_found(net, F.concat_ws(" ", amount, unit), both(net, F.lit(0.82), 0.08, 0.08), amount=amount, unit=unit),
        month_year=_found(date, F.concat_ws("/", month, year), both(date, F.lit(0.80), 0.08, 0.09), month=month, year=year),
        mrp=_found(
            price, F.concat_ws(" ", code, price["payload"]["a"]), both(price, F.when(code.isNotNull(), 0.84).otherwise(0.76), 0.06, 0.07),
            amount=price["payload"]["a"], currency=code, tax_inclusive_phrase=F.coalesce(taxed, F.lit(False)),
        ),
    ).drop("_r", "_net", "_date", "_price")
