"""Label views, contexts, page regions and price readings that Spark derives from the part, supplier and lineitem tables.

The tables have no label text, so each part is a package and its views are composed from its columns; remainders of
its key decide which declarations are wrong, missing or in conflict. One SQL text serves Spark and other engines
alike: tables stand in braces, prices are counted in integer paise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = """select p_partkey as k, p_name as name, p_size as size, s_name as maker,
  cast(round(p_retailprice * 100) as bigint) as paise,
  case when p_partkey % 7 = 0 then p_size when p_partkey % 7 = 1 then (case when p_partkey % 14 = 8 then 2000 else 1000 end)
       when p_partkey % 7 = 3 then p_size else p_size * 10 end as n,
  case when p_partkey % 7 = 2 then 'ml' when p_partkey % 7 = 3 then 'pcs' else 'g' end as unit
from {part} cross join (select count(*) as suppliers from {supplier}) c join {supplier} on s_suppkey = p_partkey % suppliers"""

_PRICED = f"""select *, cast(cast(floor(paise / 100) as bigint) as string) || '.' || lpad(cast(paise % 100 as string), 2, '0') as price,
  cast(cast(floor(paise / 100) as bigint) + 10 as string) || '.' || lpad(cast(paise % 100 as string), 2, '0') as other_price,
  cast(floor((2 * paise * (case when n >= 1000 then 1000 else 1 end) + n) / (2 * n)) as bigint) as per_unit,
  case when n >= 1000 then 'kg' when unit = 'pcs' then 'pc' else unit end as per
from ({_PARTS}) parts"""

#: Remainders of a package's key by 27 whose seal view points to the price: directly, or from far away (the pointer first, beside a
#: second pointer, and as near to one label as to another).
_SEAL = """case k % 27 when 0 then 'MRP (incl. of all taxes) and batch no: see under the seal.' when 9 then 'For MRP refer to bottom'
    when 18 then 'MRP inclusive of all taxes' || chr(10) || 'Batch 12' || chr(10) || 'Keep dry' || chr(10) || 'See on the lid'
    when 5 then 'See on the cap.' || chr(10) || repeat('Store dry ', 20) || chr(10) || 'MRP incl. of all taxes as printed'
    when 14 then 'MRP: see under the seal.' || chr(10) || repeat('Keep cool ', 20) || chr(10) || 'Batch and date refer to the bottom'
    else 'MRP ' || repeat('x ', 98) || 'see at the base' || ' ' || repeat('y ', 92) || 'M.R.P. incl. of all taxes' end"""

_TEXTS = f"""select k, view_no, case view_no when 1 then 'front' when 2 then 'back' when 3 then 'side' else 'seal' end as side, case view_no
when 1 then 'Product Name: ' || name || case when k % 23 = 5 then '' else
  chr(10) || (case when k % 4 = 2 then 'Net Wt. ' else 'Net Quantity: ' end) || cast(n as string) || ' ' || unit
  || case when k % 18 = 9 then '' else chr(10) || (case when k % 6 = 4 then 'Maximum Retail Price: ' else 'MRP: ' end)
    || (case when k % 5 = 0 then '' when k % 5 = 1 then '₹' else 'Rs. ' end) || price
    || (case when k % 11 = 0 then '' else ' (inclusive of all taxes)' end) end
  || chr(10) || (case when k % 10 = 3 then 'Packed on Mar 2025' else 'Mfg Date: ' || cast(k % 12 + 1 as string) || '/'
    || (case when k % 2 = 0 then '2025' else '25' end) end) end
when 2 then (case when k % 9 = 1 then 'Manufacturer: ' else 'Manufactured by: ' end) || maker
  || (case when k % 3 = 0 then '' else ', 12 Industrial Road, Pune 411001' end)
  || chr(10) || (case when k % 15 = 7 then 'Write to care' || cast(k as string) || '@example.com' else
    'Consumer Care: ' || (case when k % 8 = 6 then '' else 'care' || cast(k as string) || '@example.com ' end)
    || '98765' || lpad(cast(k % 100000 as string), 5, '0') || (case when k % 4 = 3 then '' else ', 5 Park Street, Pune' end) end)
  || chr(10) || 'Unit Sale Price: Rs. '
  || cast(cast(floor((per_unit + (case when k % 9 = 4 then 100 else 0 end)) / 100) as bigint) as string) || '.'
  || lpad(cast((per_unit + (case when k % 9 = 4 then 100 else 0 end)) % 100 as string), 2, '0')
  || ' per ' || (case when k % 10 = 7 then '100 g' else per end)
  || (case when k % 8 = 1 then chr(10) || 'Country of Origin: India' when k % 8 = 4 then chr(10) || 'Made in Viet Nam.' else '' end)
  || (case when k % 12 = 2 then chr(10) || 'Best before 6 months' when k % 12 = 5 then chr(10) || 'Use by: see cap' else '' end)
  || (case when k % 16 = 3 then chr(10) || 'Size: 10 x 20 cm' when k % 16 = 6 then chr(10) || 'Dimensions 5cm × 6cm × 7.5 cm' else '' end)
when 3 then 'MRP Rs. ' || (case when k % 8 = 0 then other_price when paise % 100 = 0 then
    cast(cast(floor(paise / 100) as bigint) as string) else price end) || ' incl. of all taxes'
  || chr(10) || 'Net Qty ' || cast(n as string) || '.0 ' || unit || chr(10) || 'Customer helpline 1800'
  || chr(10) || 'Consumer Helpline 99999' || lpad(cast(k % 100000 as string), 5, '0')
else {_SEAL} end as ocr_text
from ({_PRICED}) p cross join (select 1 as view_no union all select 2 union all select 3 union all select 4) sides
where view_no = 1 or k % 23 <> 5 and (view_no = 2 or view_no = 3 and k % 4 = 0 or view_no = 4 and k % 9 in (0, 5))"""

VIEWS = f"""select k as package_id, view_no, 'image-' || cast(view_no as string) as image_id, side || '.png' as file_name,
  ocr_text from ({_TEXTS}) views"""

RAW_VIEWS = f"""select package_id, view_no, image_id, file_name, case when package_id % 3 = 0
  then chr(13) || '  ' || replace(ocr_text, chr(10), chr(13) || chr(10) || chr(10) || chr(9)) || chr(9) || ' '
  when package_id % 3 = 1 then replace(ocr_text, ' ', chr(9) || ' ') || chr(10) || chr(10) || chr(10) || chr(10) || 'end' else ocr_text end as ocr_text
from ({VIEWS}) v"""

CONTEXTS = """select p_partkey as package_id, p_partkey % 4 = 1 as imported_product, p_partkey % 6 = 2 as may_become_unfit,
  p_partkey % 8 = 3 as dimensions_relevant, case p_partkey % 6 when 3 then 'combination' when 4 then 'group'
  when 5 then 'multi_piece' else 'single' end as package_form, p_partkey % 13 = 0 as alcoholic_beverage,
  case when p_partkey % 17 = 0 then 'tobacco' when p_partkey % 19 = 0 then 'pan_masala' else 'general' end as commodity_class
from {part}"""

#: A page of each package: labels at the left, values beside or below them, some out of reach, and decoys.
_BOXES = f"""select k, o, case o when 1 then (case when k % 3 = 0 then 'Net Quantity:' when k % 3 = 1 then 'Ne W' else 'NET WT.' end)
  when 2 then cast(n as string) || ' ' || unit when 3 then '250 g'
  when 4 then (case when k % 4 = 0 then 'MRP Rs' when k % 4 = 1 then 'M.R.P. ₹' else 'Maximum Retail Price' end)
  when 5 then (case when k % 3 = 0 then 'Rs. ' when k % 3 = 1 then '₹' else '' end) || price || (case when k % 2 = 0 then '/-' else '' end)
  when 6 then '89012345678905' when 7 then '(Incl. of all taxes)'
  when 8 then (case when k % 3 = 0 then 'Month of Packing' when k % 3 = 1 then 'MFD' else 'Pkd. 1' end)
  when 9 then (case when k % 4 = 0 then 'Sept-2025' when k % 4 = 1 then cast(k % 12 + 1 as string) || '/25' when k % 4 = 2 then
    lpad(cast(k % 12 + 1 as string), 2, '0') || '.2025' else '13/2025' end) when 10 then 'Energy 250 kcal' else ' ' end as text,
  case o when 1 then 0.95 when 2 then 0.90 when 3 then 0.99 when 4 then 0.97 when 5 then 0.88 when 6 then 0.99 when 7 then 0.91 when 8 then 0.93
    when 9 then 0.86 else 0.9 end as confidence,
  case o when 1 then 0.10 when 2 then 0.10 + 0.01 * (k % 20) when 3 then 0.10 when 5 then 0.50 + 0.012 * (k % 16) when 8 then 0.10
    when 9 then 0.10 + 0.015 * (k % 16) when 10 then 0.8 when 11 then 0.1 else 0.50 end as x,
  case o when 1 then 0.10 when 2 then 0.10 when 3 then 0.10 + 0.012 * (k % 15) when 4 then 0.40 when 5 then 0.40 + 0.01 * (k % 7) when 6 then 0.42
    when 7 then 0.42 + 0.02 * (k % 14) when 10 then 0.8 when 11 then 0.1 else 0.70 end as y,
  case o when 2 then 0.06 when 3 then 0.06 when 4 then 0.12 when 5 then 0.08 when 7 then 0.14 when 8 then 0.12 when 9 then 0.08 else 0.10 end as w, 0.02 as h
from ({_PRICED}) p cross join (select 1 as o union all select 2 union all select 3 union all select 4 union all select 5 union all select 6
  union all select 7 union all select 8 union all select 9 union all select 10 union all select 11) ords
where case o when 3 then k % 5 = 2 when 4 then k % 18 <> 9 when 7 then k % 11 <> 0 else true end"""

REGIONS = f"""select k as package_id, o as region_ord, 'r' || cast(o as string) as id, text, cast(confidence as double) as confidence,
  cast(x as double) as x, cast(y as double) as y, cast(w as double) as w, cast(h as double) as h from ({_BOXES}) boxes"""

#: Readings of a package's price: of each order line one, by its flags one of up to six families. An order's lines can share their
#: number, so the order takes in what else tells lines apart. Some packages' seals are unreadable: nothing but unit rates and blanks.
READINGS = f"""select l_partkey as package_id, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey,
    l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as obs_ord,
  l_returnflag || l_linestatus as family, 1 - l_discount as confidence, price,
  case when l_partkey % 27 = 18 and (l_orderkey + l_linenumber) % 9 not in (4, 6) then '' else case (l_orderkey + l_linenumber) % 9 when 0 then 'Rs.' || price when 1 then 'R5. ' || replace(price, '0', 'O') || '/-'
    when 2 then 'Re ' || price || ' (Rs.0.21 per g)' when 3 then price || ' (Rs. 0.21/ 9)' when 4 then 'Rs.0.21 per g'
    when 5 then (case when l_partkey % 4 = 1 then 'Rs ' || other_price else '₹' || price end) when 6 then ''
    when 7 then 'INR:' || cast(cast(floor(paise / 100) as bigint) as string) else 'best before 12 months' end end as text
from {{lineitem}} join ({_PRICED}) priced on priced.k = l_partkey"""

#: Readings of close-ups: of a view that points elsewhere, at the place it points to, else of the front's seal; dealt to three stages of
#: reading. Of a reading's two regions one or both show the price; places are shares of the close-up, whose own place in the image is sx, sy, sw, sh.
CLOSEUPS = f"""select package_id, case when k % 9 in (0, 5) then 4 else 1 end as view_no, locator, stage, obs_ord, family,
  case when text <> '' and k % 27 = 5 then text || chr(10) || 'Best before 9 months' else text end as text,
  case when text = '' then 0 else 2 end as n_regions, text as r1_text, confidence - (case when obs_ord % 4 = 2 then 0.125 else 0 end) as r1_confidence,
  case when obs_ord % 4 = 2 then price else 'Batch 12' end as r2_text, case when obs_ord % 4 = 2 then confidence else 0.99 end as r2_confidence,
  cast(case locator when 'seal' then 0.25 else 0 end as double) as sx, cast(case locator when 'seal' then 0.4 when 'bottom' then 0.62 else 0 end as double) as sy,
  cast(case locator when 'seal' then 0.5 else 1 end as double) as sw, cast(case locator when 'seal' then 0.2 when 'bottom' then 0.38 else 0.4 end as double) as sh
from (select r.*, package_id as k, case package_id % 27 when 9 then 'bottom' when 23 then 'bottom' when 18 then 'top' when 5 then 'top'
    when 14 then (case when obs_ord % 2 = 0 then 'bottom' else 'seal' end) else 'seal' end as locator,
    case (obs_ord - 1) % 3 when 0 then 'wide' when 1 then 'attention' else 'direct' end as stage from ({READINGS}) r) d"""

TABLES = ("part", "supplier", "lineitem")


def derive(spark: SparkSession, sf_dir: str, sql: str, packages: DataFrame | None = None) -> DataFrame:
    """Runs one of the texts above over the tables in ``sf_dir``.

    ``packages`` (package_id): those that readings are wanted for. Readings are numbered package by package, so order lines of other packages
    can go before they are sorted; the optimizer takes no join below the expressions that the texts put on top.
    """
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    if packages is not None:
        named["lineitem"] = named["lineitem"].join(packages.select(F.col("package_id").alias("l_partkey")), "l_partkey", "left_semi")
    return spark.sql(sql, **named)


def plain(sql: str) -> str:
    """The text with the tables' plain names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


CROPS = """select p_partkey as package_id, o as ord, 'c' || cast(o as string) as label, cast((p_partkey * 37 + o * 61) % 500 as int) as x,
  cast((p_partkey * 53 + o * 29 * (p_partkey % 3)) % 400 as int) as y, cast(300 + (p_partkey * o) % 200 as int) as w,
  cast(60 + (p_partkey + o * 7) % 50 as int) as h, cast((p_partkey * 31 + o * 17) % 100 as double) / 100 as score
from {part} cross join (select 1 as o union all select 2 union all select 3 union all select 4 union all select 5) five"""
