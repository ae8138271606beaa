"""Declarations of one source over another, and those of all views of a package as one fact for each kind.

A fact keeps what all views say: equal values confirm one another, different ones are a conflict that stays visible.
Rows are gathered by package and kind; a package has few views, so a gathered list is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import ATTRIBUTES
from ..functions.text import decimal, distinct_texts, plain_number, settled, strip


def merge(primary: DataFrame, supplemental: DataFrame, *by: str) -> DataFrame:
    """For each ``by`` and key one declaration: the supplemental one only if it is strictly more confident."""
    both = primary.withColumn("_src", F.lit(0)).unionByName(supplemental.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    best = Window.partitionBy(*by, "key").orderBy(F.desc("confidence"), "_src")
    return both.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_src")


def identity(key: Column, value: Column, attrs: Column) -> Column:
    """What two declarations of a kind must share not to be in conflict."""
    amount = plain_number(attrs["amount"])
    price = F.concat_ws("|", F.upper(F.coalesce(attrs["currency"], F.lit(""))), amount)
    quantity = F.concat_ws("|", amount, F.lower(F.coalesce(attrs["unit"], F.lit(""))))
    plain = F.concat(F.lit("="), F.trim(F.regexp_replace(F.lower(value), r"(?U)\s+", " ")))
    numeric = decimal(attrs["amount"]).isNotNull()
    return F.when((key == "mrp") & numeric, price).when((key == "net_quantity") & numeric, quantity).otherwise(plain)


def labelled(evidence: Column, attrs: Column) -> Column:
    file = attrs["source_file"]
    return F.when(file.isNotNull() & (file != ""), F.concat(F.lit("["), file, F.lit("] "), evidence)).otherwise(evidence)


def _with(attrs: Column, **changed: Column) -> Column:
    return F.struct(*(changed.get(a, attrs[a]).cast("string").alias(a) for a in ATTRIBUTES))


def fuse(declarations: DataFrame, package: str = "package_id", order: str = "view_no", text: str | None = None) -> DataFrame:
    """A fact for each package and key: value, evidence, confidence, attrs, region_ids, source_image_ids, n_views.

    Expects key, value, evidence, confidence, attrs and, if there are any, region_ids, image_id and src. Of equally confident
    views the first counts. Where ``src`` tells several declarations of a kind in one view apart, the first of the most confident ones is the view's.
    Rows with the key ``text`` are parts of a text, which their value then is.
    """
    none = F.array().cast("array<string>")
    regions = F.coalesce("region_ids", none) if "region_ids" in declarations.columns else none
    image = F.col("image_id") if "image_id" in declarations.columns else F.lit(None).cast("string")
    source = F.col("src") if "src" in declarations.columns else F.lit(0)
    item = F.struct(
        F.col(order).alias("at"), source.alias("src"), "value", "evidence", "confidence", "attrs", regions.alias("regions"), image.alias("image"),
        identity(F.col("key"), F.col("value"), F.col("attrs")).alias("same"), labelled(F.col("evidence"), F.col("attrs")).alias("said"),
    )
    rows = declarations.groupBy(package, "key").agg(F.collect_list(item).alias("_unsorted"))
    sorted_ = F.array_sort("_unsorted", lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(a["src"] - b["src"]))
    if "src" in declarations.columns:
        rows = settled(rows, _sorted=sorted_)
        better = lambda x, y: (x["at"] == y["at"]) & ((y["confidence"] > x["confidence"]) | ((y["confidence"] == x["confidence"]) & (y["src"] < x["src"])))
        several = F.exists("_sorted", lambda x: x["src"] > 0)
        own = F.filter("_sorted", lambda x: ~F.exists("_sorted", lambda y: better(x, y)))
        sorted_ = F.when(several, own).otherwise(F.col("_sorted"))
    rows = settled(rows, items=sorted_)
    top = F.array_max(F.transform("items", lambda x: x["confidence"]))
    rows = settled(rows, best=F.get(F.filter("items", lambda x: x["confidence"] == top), F.lit(0)))

    def all_of(get) -> Column:
        return distinct_texts(F.transform("items", get))

    values = F.array_join(all_of(lambda x: x["value"]), " | ")
    several = F.size("items") > 1
    conflict = F.size(F.array_distinct(F.transform("items", lambda x: x["same"]))) > 1
    attrs = F.col("best.attrs")
    usual = _with(
        attrs,
        multi_image_conflict=F.when(conflict, "true").otherwise(attrs["multi_image_conflict"]),
        candidate_values=F.when(conflict, values).otherwise(attrs["candidate_values"]),
        multi_image_confirmed=F.when(several & ~conflict, "true").otherwise(attrs["multi_image_confirmed"]),
    )
    emails, phones = all_of(lambda x: x["attrs"]["email"]), all_of(lambda x: x["attrs"]["phone"])
    care = _with(
        attrs,
        email=F.coalesce(F.get(emails, F.lit(0)), attrs["email"]),
        phone=F.coalesce(F.get(phones, F.lit(0)), attrs["phone"]),
        email_candidates=F.when(F.size(emails) > 1, F.array_join(emails, " | ")).otherwise(attrs["email_candidates"]),
        phone_candidates=F.when(F.size(phones) > 1, F.array_join(phones, " | ")).otherwise(attrs["phone_candidates"]),
        address_detected=F.exists("items", lambda x: F.coalesce(x["attrs"]["address_detected"] == "true", F.lit(False))),
        multi_image_fused=several,
    )
    is_care = F.col("key") == "consumer_care"
    value = F.when(is_care, values).otherwise(F.col("best.value"))
    if text is not None:
        value = F.when(F.col("key") == text, F.array_join(F.transform("items", lambda x: x["value"]), "\n\n")).otherwise(value)
    return rows.select(
        package,
        "key",
        value.alias("value"),
        F.array_join(all_of(lambda x: x["said"]), " || ").alias("evidence"),
        top.alias("confidence"),
        F.when(is_care, care).otherwise(usual).alias("attrs"),
        distinct_texts(F.flatten(F.transform("items", lambda x: x["regions"]))).alias("region_ids"),
        all_of(lambda x: x["image"]).alias("source_image_ids"),
        F.size("items").alias("n_views"),
    )


def combined_text(views: DataFrame, package: str = "package_id") -> DataFrame:
    """(package, raw_text): the non-blank views in order, each under a line with its file's name."""
    some = views.where(F.col("ocr_text").rlike(r"\S"))
    part = F.concat(F.lit("--- "), F.col("file_name"), F.lit(" ---\n"), strip(F.col("ocr_text")))
    parts = some.groupBy(package).agg(F.array_sort(F.collect_list(F.struct("view_no", part.alias("part")))).alias("parts"))
    return parts.select(package, F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("raw_text"))


def namespaced(image_id: Column, ids: Column) -> Column:
    """Region ids that are unique within a package."""
    return F.transform(ids, lambda x: F.concat(image_id, F.lit(":"), x))
