"""Views inspected from end to end: work, stages that read only what is open, outcomes in order, text that grows, regions of several views."""

import pytest
from pyspark.sql import functions as F

from packlens.operators import fusion, inspection, rules
from packlens.plans import queries

from .test_inspection import GOLDEN, context_of

VIEW = "package_id long, view_no int, image_id string, file_name string, ocr_text string"
READ = "package_id long, view_no int, locator string, stage string, obs_ord int, family string, text string, confidence double"
TWO = "MRP see under the seal.\n" + "Keep cool " * 25 + "\nBatch refer to the bottom"


def views(spark, *texts):
    return spark.createDataFrame([(1, n, f"image-{n}", f"{n}.png", t) for n, t in enumerate(texts, 1)], VIEW)


def readings(spark, *rows):
    return spark.createDataFrame([(1, v, where, stage, n, f"f{n}", text, 0.9) for n, (v, where, stage, text) in enumerate(rows)], READ)


def outcomes(spark, text, *rows):
    work = inspection.with_work(views(spark, text)).where(F.size("work") > 0)
    won = inspection.settled_places(inspection.read_closeups(work, readings(spark, *rows)))
    done = inspection.folded(work.join(won, list(inspection.VIEW), "left")).select(F.explode("done").alias("x"))
    return [(r["locator"], r["outcome"], r["value"], r["tax"]) for r in done.select("x.hint.locator", "x.outcome", "x.d.value", F.col("x.d.attrs.tax_inclusive_phrase").alias("tax")).collect()]


SEAL, BOTTOM = [(1, "seal", "wide", "Rs. 12"), (1, "seal", "wide", "Rs 12")], [(1, "bottom", "wide", "Rs. 15"), (1, "bottom", "wide", "Rs 15")]


@pytest.mark.parametrize(
    ("text", "rows", "expected"),
    [
        (TWO, [], [("seal", "unresolved", "See seal", "false"), ("bottom", "unresolved", "See bottom", "false")]),
        (TWO, SEAL, [("seal", "recovered", "INR 12", "false"), ("bottom", "kept", None, None)]),
        (TWO, BOTTOM, [("seal", "unresolved", "See seal", "false"), ("bottom", "recovered", "INR 15", "false")]),
        (TWO, SEAL + BOTTOM, [("seal", "recovered", "INR 12", "false"), ("bottom", "kept", None, None)]),
        (TWO.replace("Batch", "Inclusive of all taxes. Batch"), SEAL, [("seal", "recovered", "INR 12", "false"), ("bottom", "kept", None, None)]),
        ("MRP incl. of all taxes see the seal\nMRP Rs. 9", SEAL, [("seal", "enriched", "INR 9", "true")]),
        ("MRP Rs. 9 incl. of all taxes see the seal", SEAL, [("seal", "kept", None, None)]),
        ("MRP printed elsewhere", SEAL, [("seal", "recovered", "INR 12", "false")]),
        ("MRP printed elsewhere", [], [("seal", "nothing", None, None)]),
        ("MRP Rs. 9", SEAL, []),
    ],
)
def test_places_in_order(spark, text, rows, expected):
    assert outcomes(spark, text, *rows) == expected


def test_a_clear_seal_is_work_without_words(spark):
    crops = F.array(F.struct(F.lit("seal").alias("label"), F.lit(0.8).alias("score")))
    assert inspection.with_work(views(spark, "Net Quantity: 5 g").withColumn("crops", crops)).first()["work"][0]["explicit"] is False
    assert inspection.with_work(views(spark, "Net Quantity: 5 g")).first()["work"] == []


def test_stages_count_one_after_another(spark):
    """Readings of later stages have no say where an earlier one agreed; a look without a hint begins with single lines."""
    rows = [(1, "seal", "direct", "Rs 7"), (1, "seal", "direct", "Rs. 7"), (1, "seal", "direct", "Rs 7.00"), *SEAL]
    assert outcomes(spark, "MRP see the seal", *rows)[0][2] == "INR 12"
    assert outcomes(spark, "MRP printed elsewhere", *rows)[0][2] == "INR 7"
    assert outcomes(spark, "MRP see the seal", *rows[:3])[0][2] == "INR 7"


def test_settled_places_never_reach_the_engine(spark, tmp_path):
    work = inspection.with_work(views(spark, "MRP see the seal", "MRP see the lid")).where(F.size("work") > 0)
    table = readings(spark, *SEAL, (2, "top", "wide", "?"), (2, "top", "attention", "Rs. 3"), (2, "top", "attention", "Rs 3"), (1, "seal", "attention", "Rs. 99"))
    seen = spark.sparkContext.accumulator(0)

    def engine(batches):
        for batch in batches:
            for r in batch.itertuples():
                if r.stage != "wide" and r.locator == "seal":
                    raise AssertionError("a settled place was read again")
                seen.add(1)
            yield batch

    def read(asked):
        made = asked.drop("explicit").join(table, [*inspection.PLACE, "stage"]).select(table.columns)
        return made.mapInPandas(engine, READ)

    won, made, ledger = inspection.lazily(work, read)
    assert {(r["view_no"], r["amount"]) for r in won.collect()} == {(1, "12"), (2, "3")}
    assert sorted((r["view_no"], r["turn"], r["read"], r["settled"]) for r in ledger.collect()) == [(1, 1, 2, True), (2, 1, 1, False), (2, 2, 2, True)]
    assert made.count() == seen.value == 5  # every reading was made once


def test_added_text_is_extracted_too(spark):
    rows = [(2, "seal", "wide", "Rs. 12\nBest before 9 months"), (2, "seal", "wide", "Rs 12")]
    grown = inspection.recovered_views(views(spark, "Net Quantity: 5 g", "MRP incl. of all taxes see the seal"), readings(spark, *rows))
    assert {r["view_no"]: len(r["more"]) for r in grown.collect()} == {1: 0, 2: 1}
    found = {r["key"]: r for r in inspection.by_view(inspection.declared(grown)).where("view_no = 2").collect()}
    assert found["best_before"]["value"] == "9 months"
    assert found["mrp"]["value"] == "INR 12" and found["mrp"]["attrs"]["tax_inclusive_phrase"] == "true"
    assert found[inspection.TEXT]["value"].endswith("[Image-variant OCR ensemble: MRP via seal]\nRs. 12\nBest before 9 months\n---\nRs 12")


def test_equal_confidence_keeps_the_text_s_own(spark):
    kind = "package_id long, view_no int, key string, src int, value string, confidence double"
    rows = [(1, 1, "mrp", 0, "own", 0.9), (1, 1, "mrp", 1, "later", 0.9), (1, 2, "mrp", 0, "own", 0.8), (1, 2, "mrp", 1, "surer", 0.9), (1, 2, "mrp", 2, "last", 0.9)]
    kept = inspection.by_view(spark.createDataFrame(rows, kind)).orderBy("view_no").collect()
    assert [r["value"] for r in kept] == ["own", "surer"]


def test_the_package_takes_over_what_its_view_recovered(spark):
    """The same package without and with close-ups: the price's rule alone changes."""
    label = GOLDEN.replace("MRP: Rs. 250.00 (inclusive of all taxes)\n", "")
    both = views(spark, label, "MRP inclusive of all taxes: see under the seal.")
    rows = [(2, "seal", "wide", "Rs. 250"), (2, "seal", "wide", "Rs 250.00")]
    check = lambda facts: {r["key"]: (r["status"], r["message_code"]) for r in rules.checks(facts).collect()}
    closed = check(inspection.package_facts(both, context_of(spark), readings(spark)))
    opened = check(inspection.package_facts(both, context_of(spark), readings(spark, *rows)))
    assert closed["mrp"] == ("warning", "mrp_unresolved_ref") and opened["mrp"] == ("pass", "ok")
    assert {k for k in opened if opened[k] != closed[k]} == {"mrp", "unit_sale_price"}


def test_manual_and_image_path_differ_only_in_prefix_and_fusion_flag(spark):
    one = views(spark, GOLDEN)
    image = inspection.package_facts(one, context_of(spark)).first()["facts"].asDict(True)
    manual = inspection.manual_facts(one.select("package_id", "ocr_text"), context_of(spark)).first()["facts"].asDict(True)
    for key, fact in manual.items():
        if fact is None:
            assert image[key] is None
            continue
        other = image[key]
        assert other["evidence"] == f"[1.png] {fact['evidence']}" and other["value"] == fact["value"] and other["confidence"] == fact["confidence"]
        changed = {a for a in fact["attrs"] if fact["attrs"][a] != other["attrs"][a]}
        assert changed == ({"source_file", "multi_image_fused"} if key == "consumer_care" else {"source_file"})


def test_regions_of_several_views_are_told_apart(spark):
    rows = queries._with_lines(views(spark, "MRP: Rs. 5", "MRP: Rs. 5\nNet Quantity: 3 g"))
    facts = inspection.package_facts(rows, context_of(spark)).first()["facts"]
    assert facts["mrp"]["region_ids"] == ["image-1:r1", "image-2:r1"] and facts["net_quantity"]["region_ids"] == ["image-2:r2"]


def test_order_and_partitions_make_no_difference(spark, sf):
    made = lambda v, c: sorted(map(str, rules.summary(inspection.package_facts(v, queries.contexts(spark, sf), c)).collect()))
    some, read = queries.views(spark, sf).where("package_id < 60"), queries.closeups(spark, sf).where("package_id < 60")
    assert made(some, read) == made(some.orderBy(F.rand(3)).repartition(3), read.orderBy(F.rand(4)).repartition(2))


def test_empty_tables_and_nulls(spark):
    none = views(spark).limit(0)
    assert inspection.recovered_views(none, readings(spark)).isEmpty()
    rows = spark.createDataFrame([(1, 1, None, None, None), (1, 2, "b", "b.png", "")], VIEW)
    facts = inspection.package_facts(rows, context_of(spark), readings(spark)).first()
    assert facts["raw_text"] == "" and all(f is None for f in (facts["facts"] or []))
    assert fusion.combined_text(rows).isEmpty()
