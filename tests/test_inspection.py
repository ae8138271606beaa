"""Label texts from end to end: extraction, rules, fusion, and the order of input making no difference."""

import pytest
from pyspark.sql import functions as F

from packlens.functions import extract, text
from packlens.operators import fusion, rules

GOLDEN = """Product Name: Roasted Oats
Manufactured by: Green Mills Pvt Ltd, 12 Industrial Road, Pune 411001
Net Quantity: 500 g
MRP: Rs. 250.00 (inclusive of all taxes)
Mfg Date: 08/2026
Consumer Care: 5 Park Street, Pune, care@green.example 9876543210
Unit Sale Price: Rs. 0.50 per g"""


def judged(spark, *views, **context):
    rows = [(1, n, f"image-{n}", f"{n}.png", v) for n, v in enumerate(views, 1)]
    df = spark.createDataFrame(rows, "package_id long, view_no int, image_id string, file_name string, ocr_text string")
    declared = extract.declarations(df).withColumn("attrs", F.col("attrs").withField("source_file", F.col("file_name")))
    facts = rules.facts_of(fusion.fuse(declared), fusion.combined_text(df), context_of(spark, **context))
    checks = {r["key"]: r for r in rules.checks(facts).collect()}
    return checks, rules.summary(facts).first()


def context_of(spark, **given):
    row = {**rules.CONTEXT, **given}
    return spark.createDataFrame([(1, *row.values())], "package_id long, imported_product boolean, may_become_unfit boolean, dimensions_relevant boolean, alcoholic_beverage boolean, package_form string, commodity_class string")


def test_golden_label(spark):
    checks, total = judged(spark, GOLDEN)
    assert (total["score"], total["status"], total["failed"]) == (100, "pass", 0)
    assert {k for k, c in checks.items() if c["status"] == "not_applicable"} == {"country_origin", "best_before", "dimensions"}


@pytest.mark.parametrize(
    ("old", "new", "key", "status", "code"),
    [
        ("Rs. 250.00", "250.00", "mrp", "warning", "mrp_no_currency"),
        (" (inclusive of all taxes)", "", "mrp", "warning", "mrp_no_tax"),
        (", 12 Industrial Road, Pune 411001", "", "manufacturer", "warning", "no_address"),
        ("per g", "per 100 g", "unit_sale_price", "fail", "usp_wrong_basis"),
        ("0.50 per", "0.60 per", "unit_sale_price", "fail", "usp_mismatch"),
        ("care@green.example ", "", "consumer_care", "warning", "care_incomplete:email"),
        ("Net Quantity: 500 g\n", "", "net_quantity", "fail", "missing"),
        ("Net Quantity: 500 g\n", "", "unit_sale_price", "warning", "usp_unverifiable"),
        ("MRP: Rs. 250.00 (inclusive of all taxes)\n", "", "mrp", "fail", "missing"),
    ],
)
def test_one_change(spark, old, new, key, status, code):
    checks, _ = judged(spark, GOLDEN.replace(old, new))
    assert (checks[key]["status"], checks[key]["message_code"]) == (status, code)


def test_contexts(spark):
    checks, _ = judged(spark, GOLDEN, imported_product=True, may_become_unfit=True, dimensions_relevant=True)
    assert {k for k, c in checks.items() if c["message_code"] == "missing"} == {"country_origin", "best_before", "dimensions"}
    assert judged(spark, GOLDEN, alcoholic_beverage=True, package_form="group")[0]["unit_sale_price"]["message_code"] == "na_alcohol"
    assert judged(spark, GOLDEN, package_form="group")[0]["unit_sale_price"]["message_code"] == "na_package_form"
    small = GOLDEN.replace("500 g", "10 g")
    checks, total = judged(spark, small)
    assert total["score"] is None and total["not_applicable"] == 10 and total["status"] == "not_applicable"
    assert judged(spark, small, commodity_class="pan_masala")[1]["score"] is not None
    kilo = GOLDEN.replace("500 g", "1 kg")
    assert judged(spark, kilo)[0]["unit_sale_price"]["message_code"] == "na_usp_equals_mrp"


def test_little_text(spark):
    checks, total = judged(spark, "Product Name: Oats")
    assert {c["message_code"] for c in checks.values() if c["status"] == "warning"} == {"low_text"}
    assert total["failed"] == 0 and max(c["confidence"] for c in checks.values() if c["message_code"] == "low_text") == 0.35
    _, nothing = judged(spark, " ")
    assert nothing["failed"] == 0 and nothing["warnings"] == 7


def test_views_confirm_complete_and_conflict(spark):
    first, second = "MRP Rs. 60 incl. of all taxes\nConsumer Care care@a.example", "MRP Rs. 60.00 inclusive of all taxes\nConsumer Care 9876543210, A Road"
    rows = [(1, n, f"image-{n}", f"{n}.png", v) for n, v in enumerate((first, second), 1)]
    df = spark.createDataFrame(rows, "package_id long, view_no int, image_id string, file_name string, ocr_text string")
    fused = {r["key"]: r for r in fusion.fuse(extract.declarations(df)).collect()}
    assert fused["mrp"]["value"] == "INR 60" and fused["mrp"]["attrs"]["multi_image_confirmed"] == "true"
    care = fused["consumer_care"]["attrs"]
    assert (care["email"], care["phone"], care["address_detected"], care["multi_image_fused"]) == ("care@a.example", "9876543210", "true", "true")
    checks, _ = judged(spark, GOLDEN, "MRP Rs. 260 incl. of all taxes")
    assert checks["mrp"]["message_code"] == "conflict" and checks["unit_sale_price"]["message_code"] == "usp_conflict"


def test_order_of_input(spark, sf):
    from packlens.plans.queries import contexts, views

    def all_checks(df):
        declared = extract.declarations(df)
        facts = rules.facts_of(fusion.fuse(declared), fusion.combined_text(df), contexts(spark, sf))
        return sorted(map(tuple, rules.checks(facts).drop("percent").collect()), key=repr)

    df = views(spark, sf)
    assert all_checks(df) == all_checks(df.orderBy(F.rand(3)).repartition(7))


@pytest.mark.parametrize(
    ("given", "key", "value"),
    [
        ("USE BY:\nSee under the seal.", "best_before", "See under the seal."),
        ("MRP:\n250", "mrp", None),
        ("Mfd 12/08/2026", "month_year", "12/2008"),
        ("Packed on 5 Sept, 2025", "month_year", "09/2025"),
        ("Net Wt: 5 pieces", "net_quantity", "5 pc"),
        ("USP ₹2.50 / 100 ml", "unit_sale_price", "INR 2.50 / 100 ml"),
        ("write to support.team@x.example", "consumer_care", "support.team@x.example"),
        ("Size 5 cm x 6\ncm x 7 mm", "dimensions", "5 cm x 6 cm x 7 mm"),
        ("made in Viet Nam.", "country_origin", "Viet Nam"),
        ("🙂 line\n🙂 Product name: Tea 🙂", "commodity_name", "Tea 🙂"),
    ],
)
def test_wordings(spark, given, key, value):
    df = spark.createDataFrame([(given,)], "ocr_text string")
    got = {r["key"]: r["value"] for r in extract.declarations(df).collect()}
    assert got.get(key) == value


def test_text_functions(spark):
    c = F.col("t")
    rows = ["O5.00", "60", "1O0", "0.50", "x1", "12.340", "7."]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r[0] for r in df.select(text.canonical_amount(c)).collect()] == ["5", "60", "100", "0.5", "x1", "12.34", "7"]
    df = spark.createDataFrame([("a\r\n\n\n b \t c\n ",)], "t string")
    assert df.select(text.normal_text(c)).first()[0] == "a\n\n b c"
    places = spark.createDataFrame([(t,) for t in ("Seam", "crimp", "BASE", "lid", "seal", None)], "t string")
    assert [r[0] for r in places.select(text.locator(c)).collect()] == ["seal", "seal", "bottom", "top", "seal", None]


def test_lazy_stages_derive_the_close_ups_once(spark, sf, monkeypatch):
    """Readings of packages with work are derived once for all turns, those of other packages not at all."""
    from packlens.plans import fixtures, queries

    wanted = queries.closeups(spark, sf, queries._work(spark, sf)).count()
    assert 0 < wanted < queries.closeups(spark, sf).count()
    made, derive = spark.sparkContext.accumulator(0), fixtures.derive

    @F.udf("string")
    def counted(said):
        made.add(1)
        return said

    def counting(spark, sf_dir, sql, *given):
        rows = derive(spark, sf_dir, sql, *given)
        return rows.withColumn("text", counted.asNondeterministic()("text")) if sql == fixtures.CLOSEUPS else rows

    monkeypatch.setattr(fixtures, "derive", counting)
    queries.lazy_stages(spark, sf).collect()
    assert made.value == wanted


def test_lazy_readings_may_bring_regions(spark):
    from packlens.operators import inspection

    work = spark.createDataFrame([(1, 1, [("seal", "see the seal", False, True)])], f"package_id long, view_no int, work array<{inspection.HINT}>")
    kind = "package_id long, view_no int, locator string, stage string, obs_ord int, family string, text string, regions array<struct<text:string,confidence:double>>"
    read = spark.createDataFrame([(1, 1, "seal", "wide", 1, "a", "Rs. 12", [("Rs. 12", 0.97), ("Batch", 0.1)])], kind)
    won, made, _ = inspection.lazily(work, lambda asked: read.join(asked.drop("explicit"), [*inspection.PLACE, "stage"]))
    assert [(r["amount"], r["mean_confidence"]) for r in won.collect()] == [("12", 0.97)]
    assert [r["confidence"] for r in made.collect()] == [0.97]


def test_facts_of_some_kinds(spark):
    """The kinds that are asked for come out as among all of them, prices from close-ups too; each view is searched for work once, close-ups are made for views with work."""
    from packlens.operators import inspection

    texts = [(1, 1, GOLDEN), (2, 1, GOLDEN.replace("MRP: Rs. 250.00 (inclusive of all taxes)\n", "")), (2, 2, "MRP incl. of all taxes see the seal"), (3, 1, "MRP see the lid"), (4, 1, "Net Qty 5 g")]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(said):
        seen.add(1)
        return said

    kind = "package_id long, view_no int, image_id string, file_name string, ocr_text string"
    views = spark.createDataFrame([(p, n, f"image-{n}", f"{n}.png", said) for p, n, said in texts], kind)
    contexts = spark.createDataFrame([(p, *rules.CONTEXT.values()) for p in range(1, 6)], context_of(spark).schema)
    read = [(2, 2, "seal", "wide", n, "ab"[n], "Rs. 12", 0.9) for n in (0, 1)]
    readings = spark.createDataFrame(read, "package_id long, view_no int, locator string, stage string, obs_ord int, family string, text string, confidence double")
    wanted = []

    def closeups(work):
        wanted.extend(tuple(r) for r in work.select("package_id", "view_no").collect())
        return readings

    def checks(kinds, views, closeups):
        facts = inspection.package_facts(views, contexts, closeups, kinds)
        rows = rules.judged(facts, kinds=kinds).select("package_id", F.explode("checks").alias("c")).select("package_id", "c.*")
        return sorted((tuple(r) for r in rows.where("key in ('net_quantity', 'mrp')").collect()), key=repr)

    some = checks(("net_quantity", "mrp"), views.withColumn("ocr_text", counted.asNondeterministic()("ocr_text")), closeups)
    assert seen.value == len(texts) and sorted(wanted) == [(2, 2), (3, 1)]
    assert len(some) == 10 and some == checks(tuple(extract.LABELS), views, readings)
    assert [r for r in some if r[0] == 2 and "INR 12" in r] and {"mrp_unresolved_ref", "low_text", "ok"} <= {v for r in some for v in r}
