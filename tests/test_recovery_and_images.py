"""Close-ups: hints, prices in noisy readings, votes, crops, renderings, payloads and files."""

import json
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packlens.functions.text import places
from packlens.operators import recovery, spatial, vision
from packlens.plans import queries
from packlens.sources import ingest, report


@pytest.mark.parametrize(
    ("reading", "price"),
    [
        ("Rs.60 (Rs.0.21 per g)", "INR 60"),
        ("R5 6O.OO/-", "INR 60"),
        ("Re. 60.00 incl", "INR 60"),
        ("60 (Rs. 0.21/ 9)", "INR 60"),
        ("Rs.0.21 per g then ₹ 60", "INR 60"),
        ("Rs.0.21 per g", None),
        ("Rs 5 / 100 ml", None),
        ("INR:99.50", "INR 99.5"),
        ("", None),
        (None, None),
    ],
)
def test_prices(spark, reading, price):
    df = spark.createDataFrame([(reading,)], "t string").select(recovery.price_in(F.col("t")).alias("p"))
    got = df.select(F.concat_ws(" ", "p.currency", "p.amount")).first()[0]
    assert (got or None) == price


def test_hints(spark):
    kind = "package_id long, view_no int, ocr_text string"
    rows = [
        (1, 1, "For MRP, batch and date see under the seal"),
        (2, 1, "MRP incl. of all taxes: refer to cap.\n" + "x " * 200 + "see on the bottom"),
        (3, 1, "see under the seal"), (4, 1, None), (5, 1, ""),
        (6, 1, "😀 see the lid 😀" + "y" * 300 + " M.R.P. 60 incl. of all taxes " + "z" * 300 + "MRP 5"),
    ]
    got = recovery.hints(spark.createDataFrame(rows, kind)).orderBy("package_id", "hint_ord").collect()
    assert [(r["package_id"], r["locator"], r["tax_inclusive_phrase"]) for r in got] == [
        (1, "seal", False), (2, "top", True), (2, "bottom", True), (6, "top", True),
    ]
    assert got[0]["evidence"] == "For MRP, batch and date see under the seal" and got[2]["evidence"].endswith("... see on the bottom")
    assert " M.R.P. 60 incl. of all taxes z" in got[3]["evidence"] and got[3]["evidence"].endswith("... see the lid")
    assert recovery.hints(spark.createDataFrame([], kind)).collect() == []


def test_places_are_those_of_the_pattern(spark):
    texts = ["", "ab", "xabyabz 😀ab", "abab", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", places(F.col("t"), "ab").alias("p"))
    for r in df.collect():
        want = None if r["t"] is None else [(m.start(), m[0]) for m in re.finditer("ab", r["t"])]
        assert (None if r["p"] is None else [(x["at"], x["said"]) for x in r["p"]]) == want


def test_hints_once_for_each_place(spark):
    df = spark.createDataFrame([(1, 1, "MRP see seal. MRP see the seam. MRP see lid"), (1, 2, None)], "package_id long, view_no int, ocr_text string")
    assert sorted(r["locator"] for r in recovery.hints(df).collect()) == ["seal", "top"]


def test_consensus(spark):
    rows = [
        (1, 1, "a", "Rs 60", 0.7), (1, 2, "b", "Rs.60.00", 0.7), (1, 3, "a", "Rs 50", 0.99), (1, 4, "a", "Rs 50", 0.99),  # families before votes
        (2, 1, "a", "Rs 60", 0.85), (2, 2, "a", "Rs 60", 0.85),  # two votes, too unsure
        (3, 1, "a", "Rs 60", 0.97), (4, 1, "a", "Rs 60", 0.95),  # a single vote must be sure
        (5, 1, "a", "Rs 60", 0.9), (5, 2, "b", "Rs 70", 0.9), (5, 3, "b", "Rs 60", 0.9), (5, 4, "a", "Rs 70", 0.9),  # even
        (6, 1, "a", "", 0.9), (6, 2, "a", None, None),
    ]
    df = spark.createDataFrame(rows, "package_id long, obs_ord int, family string, text string, confidence double")
    won = {r["package_id"]: r["amount"] for r in recovery.consensus(recovery.votes(df)).collect()}
    assert won == {1: "60", 3: "60"}
    dealt = df.withColumn("stage", F.when(F.col("obs_ord") <= 2, 0).otherwise(1))
    staged = recovery.by_stage(dealt, (0, 1)).collect()
    assert {(r["package_id"], r["stage"]) for r in staged} == {(1, 0), (3, 0)}
    # the other stage first: two sure readings settle 1 there, and nobody else has readings in it that do
    other = recovery.by_stage(dealt, (1, 0)).collect()
    assert {(r["package_id"], r["stage"], r["amount"]) for r in other} == {(1, 1, "50"), (3, 0, "60")}
    tried = recovery.attempts(df, recovery.consensus(recovery.votes(df))).where("package_id = 1").orderBy("obs_ord").collect()
    assert [(r["amount"], r["agrees"]) for r in tried] == [("60", True), ("60", True), ("50", False), ("50", False)]
    assert recovery.votes(df.limit(0)).collect() == []


def region(i, t, x, y, w=0.1, h=0.02, c=0.9):
    return (i, t, c, x, y, w, h)


def test_pairs_by_place(spark):
    kind = "package_id long, regions array<struct<id string, text string, confidence double, x double, y double, w double, h double>>"
    regions = [
        region("r1", "MRP Rs", 0.5, 0.4), region("r2", "250.00", 0.56, 0.4), region("r3", "89012345678905", 0.5, 0.41), region("r4", "99", 0.9, 0.9),
        region("r5", "(Incl. of all taxes)", 0.5, 0.45), region("r6", "Ne W", 0.1, 0.1), region("r7", "0 g", 0.11, 0.1), region("r8", "60 g.", 0.2, 0.1),
        region("r9", "MFD", 0.1, 0.7), region("r10", "SEPT 25", 0.2, 0.7), region("r11", " ", 0.2, 0.7),
    ]
    for rows in (regions, regions[::-1]):
        got = spatial.spatial_fields(spark.createDataFrame([(1, rows), (2, []), (3, None)], kind)).orderBy("package_id").collect()
        assert got[0]["mrp"]["d"]["value"] == "INR 250.00" and got[0]["mrp"]["d"]["attrs"]["tax_inclusive_phrase"] == "true"
        assert got[0]["net_quantity"]["d"]["value"] == "60 g" and got[0]["net_quantity"]["region_ids"] == ["r6", "r8"]
        assert got[0]["month_year"]["d"]["value"] == "09/2025"
        assert got[1]["mrp"] is None and got[2]["mrp"] is None


def test_suppression_and_choice(spark):
    kind = "crops array<struct<ord int, label string, x int, y int, w int, h int, score double>>"
    crops = [(1, "a", 0, 0, 100, 10, 0.9), (2, "b", 0, 1, 100, 10, 0.8), (3, "c", 0, 50, 100, 10, 0.5), (4, "d", 0, 80, 100, 10, 0.5), (5, "e", 300, 80, 100, 10, 0.1)]
    df = spark.createDataFrame([(crops,), ([],)], kind)
    got = df.select(F.transform(recovery.suppress(F.col("crops")), lambda c: c["label"]).alias("k")).collect()
    assert [r["k"] for r in got] == [["a", "c", "d"], []]
    one = df.select(F.size(recovery.select_crops(F.col("crops"))).alias("n")).collect()
    assert [r["n"] for r in one] == [2, 0]


def test_recovery_from_end_to_end(spark):
    readings = [(1, 1, "a", "Rs 60", 0.7), (1, 2, "b", "Rs.60.00", 0.7), (1, 3, "a", "", 0.1), (4, 1, "a", "Rs 9", 0.1)]
    readings = spark.createDataFrame(readings, "package_id long, obs_ord int, family string, text string, confidence double")
    price = lambda code, amount, tax: (0.8, {"currency": code, "amount": amount, "tax_inclusive_phrase": tax})
    kind = (
        "package_id long, locator string, evidence string, tax_inclusive_phrase boolean,"
        " price struct<confidence double, attrs struct<currency string, amount string, tax_inclusive_phrase string>>"
    )
    rows = [
        (1, "seal", "MRP see seal", True, None),  # a consensus
        (2, "seal", "MRP see seal", True, price("INR", "5", "false")),  # complete, only the hint has the tax phrase
        (3, "seal", "MRP see seal", False, price("INR", "5", "false")),  # complete
        (4, "top", "MRP see lid", False, price(None, "5", "true")),  # readings without a consensus
        (5, None, None, None, None),  # a look without a hint
    ]
    won = recovery.consensus(recovery.votes(readings))
    got = {r["package_id"]: r for r in recovery.recovered(spark.createDataFrame(rows, kind), won, readings).collect()}
    assert {k: (r["outcome"], r["value"]) for k, r in got.items()} == {
        1: ("recovered", "INR 60"), 2: ("enriched", "INR 5"), 3: ("kept", "INR 5"), 4: ("unresolved", "top"), 5: ("nothing", None),
    }
    assert (got[2]["confidence"], got[3]["confidence"], got[4]["confidence"]) == (0.9, 0.8, 0.82)
    assert got[1]["added_text"] == "--- close-up ---\nRs 60\n---\nRs.60.00" and got[4]["added_text"] is None


def png(gray):
    """A grey PNG."""
    height, width = gray.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), gray], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows, 1)) + part(b"IEND", b"")


def test_turning():
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert vision.upright(gray, 6).tolist() == np.rot90(gray, -1).tolist() and vision.upright(gray, 1) is not None
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x0112, 3, 1, 6)
    app1 = b"Exif\0\0" + tiff
    assert vision.exif_orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1) == 6
    assert vision.exif_orientation(b"\xff\xd8") == 1 and vision.exif_orientation(b"") == 1


def test_images_from_files(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "a.png").write_bytes(png(np.full((226, 400), 200, np.uint8)))
    (tmp_path / "p1" / "b.png").write_bytes(b"no image")
    rows = {r["path"].rpartition("/")[2]: r for r in vision.read_rasters(spark, str(tmp_path)).collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"]) == (400, 226) and rows["b.png"]["width"] is None
    files = ingest.checked(ingest.image_files(spark, str(tmp_path))).orderBy("view_no").collect()
    assert [(f["package_id"], f["image_id"], f["reject_reason"]) for f in files] == [("p1", "image-1", None), ("p1", "image-2", None)]


def test_recognition_plug_in(spark):
    def engine():
        def read(image):
            if image == b"bad":
                raise ValueError("unreadable")
            return [(" Rs 60 ", 1.7, [[-5.0, 2.0], [50.0, 400.0]]), (" ", 0.5, [])]

        return read

    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "image_id long, png binary")
    got = vision.recognise(df, engine, "image_id").orderBy("image_id").collect()
    assert got[0]["rec_texts"] == [" Rs 60 ", " "] and got[1]["reject_reason"] == "ValueError: unreadable"
    payload = vision.recognise(df, engine, "image_id").selectExpr("1 as package_id", "*", "100 as width", "200 as height")
    (r,) = ingest.payload_regions(payload).collect()
    assert (r["region_id"], r["text"], r["confidence"]) == ("r1", "Rs 60", 1.0)
    assert [(p["x"], p["y"]) for p in r["polygon"]] == [(0.0, 0.01), (0.5, 1.0)]


def test_lines_without_a_detector(spark):
    def engine():
        def read(image):
            if image == b"bad":
                raise ValueError("unreadable")
            return "Rs 60", 0.9

        return read

    rows = [(1, bytearray(b"ok"), 8), (2, bytearray(b"ok"), 7), (3, bytearray(b"bad"), 20), (4, None, 20), (5, bytearray(b"ok"), None)]
    df = spark.createDataFrame(rows, "image_id long, png binary, height int")
    got = vision.recognise_lines(df, engine, "image_id").orderBy("image_id").collect()
    assert [(r["text"], r["reject_reason"]) for r in got] == [("Rs 60", None), ("", None), ("", "ValueError: unreadable"), ("", None), ("", None)]


def test_windows(spark):
    df = spark.createDataFrame([(w,) for w in (100, 419, 420, 900, 1600, 4000)], "w int")
    for r in df.select("w", vision.windows(F.col("w")).alias("t")).collect():
        if r["w"] < 420:
            assert r["t"] == []
            continue
        assert len(r["t"]) <= 5 and r["t"][0]["start"] == 0 and r["t"][-1]["start"] + r["t"][-1]["w"] == r["w"]


def test_limits_and_evidence(spark, tmp_path):
    rows = [(1, n, 100, "image/png") for n in range(1, 8)] + [(2, 1, 500, "image/png"), (2, 2, 10, "text/plain"), (2, 3, 90, "image/png"), (2, 4, 90, "image/png")]
    df = spark.createDataFrame(rows, "package_id long, view_no int, length long, mime string")
    got = ingest.checked(df, ingest.Limits(6, 400, 600)).where("package_id = 2").orderBy("view_no").collect()
    assert [r["reject_reason"] for r in got] == ["file_too_large", "not_an_image", None, "total_too_large"]
    request = {"context": {"imported_product": True}, "images": [{"image_id": "a", "file_name": "a.png", "ocr_text": "x", "declarations": [{"key": "mrp", "value": "INR 5", "confidence": 0.9}]}]}
    df = spark.createDataFrame([(1, json.dumps(request)), (2, "{}"), (3, "no json"), (4, None)], "package_id long, json string")
    parsed = ingest.evidence(df)
    assert [r["reject_reason"] for r in parsed.orderBy("package_id").collect()] == [None, "no_evidence", "no_evidence", "no_evidence"]
    (d,) = ingest.evidence_declarations(parsed).collect()
    assert (d["key"], d["value"], d["view_no"], d["image_id"]) == ("mrp", "INR 5", 1, "a")
    (tmp_path / "t.txt").write_text("  MRP Rs 5\n")
    assert [r["ocr_text"] for r in ingest.manual_texts(spark, str(tmp_path / "t.txt")).collect()] == ["MRP Rs 5"]


def test_reports(spark, sf, tmp_path):
    from packlens.plans.queries import report_json

    reports = report_json(spark, sf)
    one = json.loads(reports.where("package_id = 5").first()["report"])
    assert len(one["checks"]) == 10 and set(one["summary"]) >= {"status", "passed"}
    report.write_reports(reports, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == reports.count()


def test_every_consensus_resolves_its_reference(spark, sf, monkeypatch):
    """Odd packages too: only those whose readings settle no price stay unresolved."""
    read = queries.readings
    monkeypatch.setattr(queries, "readings", lambda *at: read(*at).where("package_id % 27 <> 0"))
    hinted = {x["package_id"] for x in queries.direct_hints(spark, sf).collect()}
    won = {x["package_id"] for x in queries.consensus_price(spark, sf).collect()}
    got = {x["package_id"] for x in queries.unresolved_reference(spark, sf).collect()}
    assert got == hinted - won and got and any(k % 2 for k in hinted & won)
