"""The rule profile: which declarations a package needs, what each is worth, and what the facts of a package earn.

One row of facts for a package (a struct for each kind) is judged in place by all ten rules; a package's checks are an
array that is exploded at the end, so that checks, score and summary need one shuffle by package, that of the pivot.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import LABELS
from ..functions.text import decimal, settled, word_chars

PROFILE = "IN-LMPC-physical-retail"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    key: str
    weight: int


#: The rules of the profile with their weights, 100 in all.
RULES = (
    Rule("LMPC-6-1-a", "manufacturer", 14),
    Rule("LMPC-6-1-aa", "country_origin", 8),
    Rule("LMPC-6-1-b", "commodity_name", 10),
    Rule("LMPC-6-1-c", "net_quantity", 16),
    Rule("LMPC-6-1-d", "month_year", 10),
    Rule("LMPC-6-1-da", "best_before", 6),
    Rule("LMPC-6-1-e", "mrp", 16),
    Rule("LMPC-6-1-f", "dimensions", 4),
    Rule("LMPC-6-2", "consumer_care", 12),
    Rule("LMPC-6-11", "unit_sale_price", 4),
)
#: Context of a package, with what holds where nothing is given.
CONTEXT = {
    "imported_product": False,
    "may_become_unfit": False,
    "dimensions_relevant": False,
    "alcoholic_beverage": False,
    "package_form": "single",
    "commodity_class": "general",
}


def profile(spark) -> DataFrame:
    """The rules as a table: rule_ord, rule_id, key, label, weight."""
    rows = [(n, r.rule_id, r.key, LABELS[r.key], r.weight) for n, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, key string, label string, weight int")


def applies(key: str) -> Column:
    """Whether a rule applies by the package's context alone."""
    return {
        "country_origin": F.col("imported_product"),
        "best_before": F.col("may_become_unfit"),
        "dimensions": F.col("dimensions_relevant"),
        "unit_sale_price": ~F.col("alcoholic_beverage") & (F.col("package_form") == "single"),
    }.get(key, F.lit(True))


def not_needed(key: str) -> Column:
    """Why a rule doesn't apply by the context."""
    price = F.when(F.col("alcoholic_beverage"), "na_alcohol").otherwise("na_package_form")
    codes = {"country_origin": "na_not_imported", "best_before": "na_not_perishable", "dimensions": "na_no_dimensions"}
    return price if key == "unit_sale_price" else F.lit(codes.get(key, "na"))


def fact(key: str, name: str | None = None) -> Column:
    return F.col(f"facts.{key}" + (f".{name}" if name else ""))


def attr(key: str, name: str) -> Column:
    return F.col(f"facts.{key}.attrs.{name}")


def conflicted(key: str) -> Column:
    return F.coalesce(attr(key, "multi_image_conflict") == "true", F.lit(False))


def normal_quantity() -> tuple[Column, Column]:
    """Amount and unit of the net quantity in g, ml or pieces; null in a conflict or if it can't be read."""
    amount, unit = decimal(attr("net_quantity", "amount")), attr("net_quantity", "unit")
    usable = ~conflicted("net_quantity") & amount.isNotNull() & (unit != "")
    scaled = (
        F.when(unit == "mg", amount / 1000).when(unit.isin("kg", "l"), amount * 1000).when(unit == "cl", amount * 10).otherwise(amount)
    )
    base = F.when(unit.isin("mg", "kg"), "g").when(unit.isin("cl", "l"), "ml").otherwise(unit)
    return F.when(usable, scaled.cast("decimal(20,6)")), F.when(usable, base)


def unit_basis() -> tuple[Column, Column]:
    """How many of the prescribed unit a package holds, and that unit: per g below 1 kg, per kg from there on, and so on."""
    amount, unit = normal_quantity()
    large = unit.isin("g", "ml") & (amount >= 1000)
    count = F.when(large, (amount / 1000).cast("decimal(20,6)")).when(unit.isin("g", "ml", "pc"), amount)
    of = F.when(large, F.when(unit == "g", "kg").otherwise("l")).when(unit.isin("g", "ml", "pc"), unit)
    return count, of


def small_package() -> Column:
    amount, unit = normal_quantity()
    small = (F.col("commodity_class") == "general") & unit.isin("g", "ml") & (amount <= 10)
    return F.coalesce(small, F.lit(False))


def price_is_unit_price() -> Column:
    """Whether the price is that of one prescribed unit, so that a unit price would repeat it."""
    count, _ = unit_basis()
    one = (count == 1) & decimal(attr("mrp", "amount")).isNotNull() & ~conflicted("mrp")
    return F.coalesce(one, F.lit(False))


def _outcome(status: str, code: str | Column, confidence: Column, percent: int) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(
        F.lit(status).alias("status"), code.alias("message_code"), confidence.alias("confidence"), F.lit(percent).alias("percent")
    )


def validation(key: str) -> Column:
    """The outcome where the declaration is there: status, message_code, confidence, percent of the weight earned."""
    conf = fact(key, "confidence")
    at_most = lambda cap: F.least(conf, F.lit(cap))
    good = _outcome("pass", "ok", conf, 100)
    out = F.when(conflicted(key), _outcome("warning", "conflict", at_most(0.70), 45))
    is_true = lambda name: F.coalesce(attr(key, name) == "true", F.lit(False))
    if key == "manufacturer":
        out = out.when(~is_true("address_detected"), _outcome("warning", "no_address", at_most(0.76), 62))
    elif key == "mrp":
        rupees = F.coalesce(attr(key, "currency") == "INR", F.lit(False))
        code = (
            F.when(~rupees & ~is_true("tax_inclusive_phrase"), "mrp_no_currency_no_tax")
            .when(~rupees, "mrp_no_currency")
            .otherwise("mrp_no_tax")
        )
        out = out.when(~rupees | ~is_true("tax_inclusive_phrase"), _outcome("warning", code, at_most(0.74), 55))
    elif key == "consumer_care":
        lacks = lambda name: F.coalesce(attr(key, name) == "", F.lit(True))
        missing = F.concat_ws(
            ",", F.when(lacks("phone"), "phone"), F.when(lacks("email"), "email"), F.when(~is_true("address_detected"), "address")
        )
        out = out.when(missing != "", _outcome("warning", F.concat(F.lit("care_incomplete:"), missing), at_most(0.76), 62))
    elif key == "unit_sale_price":
        count, unit = unit_basis()
        amount, per = decimal(attr(key, "amount")), decimal(attr(key, "reference_quantity"))
        price = decimal(attr("mrp", "amount"))
        open_ = count.isNull() | fact("mrp").isNull() | amount.isNull() | per.isNull()
        other = (per != 1) | ~F.coalesce(attr(key, "reference_unit") == unit, F.lit(False))
        right = F.round(F.try_divide(price, count), 2) == F.round(amount, 2)
        out = (
            out.when(conflicted("net_quantity") | conflicted("mrp"), _outcome("warning", "usp_conflict", at_most(0.68), 45))
            .when(open_, _outcome("warning", "usp_unverifiable", at_most(0.72), 55))
            .when(other, _outcome("fail", "usp_wrong_basis", conf, 0))
            .when(price.isNull() | (count <= 0), _outcome("warning", "usp_unchecked", at_most(0.75), 70))
            .when(~right, _outcome("fail", "usp_mismatch", conf, 0))
        )
    return out.otherwise(good)


def _check(n: int, rule: Rule) -> Column:
    key = rule.key
    needed = applies(key)
    none = _outcome("not_applicable", "na_small_pack", F.lit(1.0), 0)
    out = F.when(F.col("small_pack"), none)
    if key == "unit_sale_price":
        out = out.when(needed & price_is_unit_price(), _outcome("not_applicable", "na_usp_equals_mrp", F.lit(1.0), 0))
    out = out.when(~needed, _outcome("not_applicable", not_needed(key), F.lit(1.0), 0))
    out = out.when(fact(key).isNotNull(), validation(key))
    if key == "mrp":
        hint = F.least(fact("mrp_reference", "confidence"), F.lit(0.72))
        out = out.when(fact("mrp_reference").isNotNull(), _outcome("warning", "mrp_unresolved_ref", hint, 25))
    blank = ~F.coalesce(F.col("raw_text").rlike(r"(?U)\S"), F.lit(False))
    out = out.otherwise(_outcome("fail", "missing", F.when(blank, 0.0).otherwise(0.88), 0))
    evidence = fact(key, "evidence")
    if key == "mrp":  # a locator's wording stands in for a price that wasn't found
        evidence = F.when(fact(key).isNull() & ~F.col("small_pack"), fact("mrp_reference", "evidence")).otherwise(evidence)
    return F.struct(
        F.lit(n).alias("rule_ord"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(key).alias("key"),
        F.lit(rule.weight).alias("weight"),
        fact(key, "value").alias("value"),
        evidence.alias("evidence"),
        out.alias("out"),
    )


def facts_of(declarations: DataFrame, texts: DataFrame, contexts: DataFrame, package: str = "package_id") -> DataFrame:
    """A row for each package of ``contexts``: its context, raw_text, and facts with a struct for each kind.

    Of several facts of a kind (hints of several views) the least by value and evidence counts.
    """
    columns = ["value", "evidence", "confidence", "attrs"]
    kinds = [*LABELS, "mrp_reference"]
    pivot = declarations.groupBy(package).agg(
        *(F.min(F.when(F.col("key") == k, F.struct(*columns))).alias(k) for k in kinds)
    )
    return with_context(texts.join(pivot.select(package, F.struct(*kinds).alias("facts")), package, "full"), contexts, package)


def with_context(facts: DataFrame, contexts: DataFrame, package: str = "package_id") -> DataFrame:
    """Facts and raw_text of packages beside their contexts; a package of ``contexts`` without any has null facts and an empty text."""
    rows = contexts.join(facts, package, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in CONTEXT.items()}).withColumn(
        "raw_text", F.coalesce("raw_text", F.lit(""))
    )


def judged(facts: DataFrame, package: str = "package_id", keep: list[str] | tuple[str, ...] = (), kinds: Collection[str] = tuple(LABELS)) -> DataFrame:
    """(package, checks): the array of the ten checks of a package, after the columns to ``keep``.

    ``kinds``: those whose checks are wanted. All need the net quantity's fact, the unit price's check also the price's.
    """
    rows = settled(facts, small_pack=small_package(), short=word_chars(F.col("raw_text")) < 40)
    rows = settled(rows, checks=F.array(*(_check(n, r) for n, r in enumerate(RULES) if r.key in kinds)))
    short = F.col("short")

    def final(x: Column) -> Column:
        doubt = short & (x["out"]["status"] == "fail")
        pick = lambda a, b: F.when(doubt, a).otherwise(b)
        return F.struct(
            x["rule_ord"].alias("rule_ord"),
            x["rule_id"].alias("rule_id"),
            x["key"].alias("key"),
            x["weight"].alias("weight"),
            F.when(x["out"]["status"] == "not_applicable", "not_applicable").otherwise("required").alias("applicability"),
            pick(F.lit("warning"), x["out"]["status"]).alias("status"),
            x["value"].alias("value"),
            x["evidence"].alias("evidence"),
            pick(F.least(x["out"]["confidence"], F.lit(0.35)), x["out"]["confidence"]).alias("confidence"),
            pick(F.lit("low_text"), x["out"]["message_code"]).alias("message_code"),
            x["out"]["percent"].alias("percent"),
        )

    return settled(rows, checks=F.transform("checks", final)).select(package, *keep, "checks")


def checks(facts: DataFrame, package: str = "package_id") -> DataFrame:
    """Ten rows for each package."""
    return judged(facts, package).select(package, F.explode("checks").alias("c")).select(package, "c.*")


def summary(facts: DataFrame, package: str = "package_id") -> DataFrame:
    """score (null if no rule applies), status and the counts of each status, for each package."""
    return summed(judged(facts, package), package).drop("checks")


def summed(judgements: DataFrame, package: str = "package_id") -> DataFrame:
    """Adds a package's summary to its checks."""
    many = lambda status: F.size(F.filter("checks", lambda x: x["status"] == status)).cast("long")
    needed = F.filter("checks", lambda x: x["status"] != "not_applicable")
    total = F.aggregate(needed, F.lit(0), lambda s, x: s + x["weight"])
    points = F.aggregate(needed, F.lit(0), lambda s, x: s + x["weight"] * x["percent"])
    rows = judgements.select(
        package,
        "checks",
        total.alias("total"),
        points.alias("points"),
        many("pass").alias("passed"),
        many("warning").alias("warnings"),
        many("fail").alias("failed"),
        many("not_applicable").alias("not_applicable"),
    )
    score = F.bround(F.col("points") / F.col("total"), 0).cast("int")
    status = F.when(F.col("total") == 0, "not_applicable").when(F.col("failed") > 0, "fail").when(F.col("warnings") > 0, "warning")
    return rows.select(
        package, "checks", F.when(F.col("total") > 0, score).alias("score"), status.otherwise("pass").alias("status"),
        "passed", "warnings", "failed", "not_applicable",
    )


def tone(summaries: DataFrame) -> DataFrame:
    """How a report shows a score: good, warn, bad or neutral."""
    good = (F.col("score") >= 85) & (F.col("failed") == 0)
    shown = F.when(F.col("score").isNull(), "neutral").when(good, "good").when(F.col("score") >= 55, "warn").otherwise("bad")
    return summaries.withColumn("tone", shown)
