"""The registered queries over the label corpus, each (spark, sf_dir) -> DataFrame with scalar columns."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text
from ..functions.text import settled
from ..operators import fusion, inspection, recovery, rules, spatial, vision
from ..sources import ingest, report
from ..tables import stash
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]

#: Attributes that each kind of declaration shows.
SHOWN = {
    "manufacturer": "role address_detected",
    "country_origin": "country",
    "commodity_name": "",
    "net_quantity": "amount unit",
    "month_year": "month year",
    "best_before": "declaration",
    "mrp": "amount currency tax_inclusive_phrase",
    "dimensions": "dimensions",
    "consumer_care": "email phone address_detected",
    "unit_sale_price": "currency amount reference_quantity reference_unit",
}


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' views, dealt by package: they come from a table of one file, and extraction, the costly part, should keep all cores busy.

    The number is stated, since views are small and would otherwise be put together again by their bytes.
    """
    return fixtures.derive(spark, sf_dir, fixtures.VIEWS).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "package_id")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.derive(spark, sf_dir, fixtures.CONTEXTS)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each package with its page's regions in order."""
    rows = fixtures.derive(spark, sf_dir, fixtures.REGIONS)
    region = F.struct("region_ord", "id", "text", "confidence", "x", "y", "w", "h")
    return rows.groupBy("package_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(fixtures.derive(spark, sf_dir, fixtures.READINGS), text=F.col("text"))


def all_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of every view; each carries its file's name as the source of its evidence."""
    rows = extract.declarations(views(spark, sf_dir))
    return rows.withColumn("attrs", F.col("attrs").withField("source_file", F.col("file_name")))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(all_declarations(spark, sf_dir))


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that point to a price elsewhere, with their direct hint."""
    seal = settled(views(spark, sf_dir), hint=recovery.direct_hint(F.col("ocr_text")))
    return seal.where("hint is not null").select("package_id", "view_no", "hint.*")


def closeups(spark: SparkSession, sf_dir: str, work: DataFrame | None = None) -> DataFrame:
    """Readings of close-ups with their regions and the close-up's place in the image.

    ``work``: views; close-ups of other packages are left out.
    """
    rows = settled(fixtures.derive(spark, sf_dir, fixtures.CLOSEUPS, work), text=F.col("text"))
    at = lambda n, y, h: F.struct(
        F.lit(n).alias("id"), F.col(f"{n}_text").alias("text"), F.col(f"{n}_confidence").alias("confidence"),
        F.lit(0.1).alias("x"), F.lit(y).alias("y"), F.lit(0.4).alias("w"), F.lit(h).alias("h"),
    )
    regions = F.when(F.col("n_regions") > 0, F.array(at("r1", 0.2, 0.3), at("r2", 0.6, 0.2)))
    source = F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sw").alias("w"), F.col("sh").alias("h"))
    none = F.array().cast("array<struct<id:string,text:string,confidence:double,x:double,y:double,w:double,h:double>>")
    return rows.select("package_id", "view_no", "locator", "stage", "obs_ord", "family", "text", F.coalesce(regions, none).alias("regions"), source.alias("source"))


def facts(spark: SparkSession, sf_dir: str, kinds: Collection[str] = tuple(extract.LABELS)) -> DataFrame:
    """A row of facts for each package, inspected from end to end: prices that close-ups settle where a view points, and what the added text says."""
    return inspection.package_facts(views(spark, sf_dir), contexts(spark, sf_dir), lambda work: closeups(spark, sf_dir, work), kinds)


def _conf(c: str | Column) -> Column:
    return F.round(c, 6).alias("confidence")


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspection.with_work(views(spark, sf_dir)).where(F.size("work") > 0)


def place_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readings with regions come to at each place that a view points to: the first stage at which they agree."""
    won = inspection.first_consensus(inspection.read_closeups(_work(spark, sf_dir), closeups(spark, sf_dir)))
    return won.select("package_id", "view_no", "locator", "turn", "currency", "amount", "families", "votes", F.round("mean_confidence", 6).alias("mean_confidence"), "evidence", "direct")


def lazy_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage read and settled, when later stages read only the places that earlier ones left open."""
    work = stash(_work(spark, sf_dir).select(*inspection.VIEW, "work"), "work")
    places = work.select(*inspection.VIEW, F.explode("work.locator").alias("locator"))
    # what a turn reads from: derived once, for all turns
    rows = stash(closeups(spark, sf_dir, work).drop("source").join(places, list(inspection.PLACE), "left_semi"), "closeups")
    read = lambda asked: rows.join(asked.drop("explicit"), [*inspection.PLACE, "stage"])
    return inspection.lazily(work, read)[2]


def hint_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each place that a view points to, in order: what it came to, given what was known before it."""
    work = _work(spark, sf_dir)
    won = inspection.settled_places(inspection.read_closeups(work, closeups(spark, sf_dir)))
    rows = inspection.folded(work.join(won, list(inspection.VIEW), "left")).select("package_id", "view_no", F.posexplode("done").alias("n", "x"))
    return rows.select(
        "package_id", "view_no", (F.col("n") + 1).cast("long").alias("hint_ord"), "x.hint.locator", "x.hint.explicit", "x.outcome", "x.d.value", "x.d.evidence",
        _conf("x.d.confidence"), F.col("x.d.attrs.tax_inclusive_phrase").alias("tax_inclusive_phrase"),
    )


def second_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of the views whose text grew, from the text that close-ups added to as well."""
    grown = inspection.recovered_views(views(spark, sf_dir), closeups(spark, sf_dir)).where(F.contains("ocr_text", F.lit(inspection.HEADER.partition("{")[0])))
    rows = inspection.by_view(inspection.declared(grown)).where(F.col("key") != inspection.TEXT)
    return rows.select("package_id", "view_no", "key", "value", "evidence", _conf("confidence"))


def recovered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions behind recovered prices, numbered through a view, as places in its image."""
    work = _work(spark, sf_dir)
    made = inspection.recovered_regions(inspection.read_closeups(work, closeups(spark, sf_dir)), work)
    corner = lambda n, axis: F.round(F.col("polygon")[n][axis], 6)
    return made.select("package_id", "view_no", "id", "text", _conf("confidence"), corner(0, "x").alias("x0"), corner(0, "y").alias("y0"), corner(2, "x").alias("x1"), corner(2, "y").alias("y1"))


def _with_lines(rows: DataFrame) -> DataFrame:
    """Views with a region for each line of their text."""
    lines = F.transform(F.split("ocr_text", "\n"), lambda x, n: F.struct(F.concat(F.lit("r"), (n + 1).cast("string")).alias("id"), x.alias("text")))
    return rows.withColumn("regions", lines)


def hint_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a view that its hints quote."""
    rows = _with_lines(_work(spark, sf_dir)).select("package_id", "view_no", "regions", F.explode("work").alias("h")).where("h.explicit")
    ids = recovery.reference_regions(F.col("h.evidence"), F.col("regions"))
    return rows.select("package_id", "view_no", "h.locator", F.array_join(ids, ",").alias("region_ids"))


def view_finding_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region of any view of a package the last rule that says something about it; ids are told apart by image."""
    rows = inspection.package_facts(_with_lines(views(spark, sf_dir)), contexts(spark, sf_dir))
    keyed = F.map_from_arrays(F.array(*(F.lit(r.key) for r in rules.RULES)), F.array(*(F.col(f"facts.{r.key}.region_ids") for r in rules.RULES)))
    linked = rules.judged(rows.withColumn("_ids", keyed), keep=["_ids"]).select("package_id", "_ids", F.explode("checks").alias("c"))
    return report.finding_regions(linked.select("package_id", "c.rule_ord", "c.rule_id", "c.status", F.col("_ids")[F.col("c.key")].alias("region_ids")))


def manual_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages inspected by the text of their front alone: no file's name, nothing fused."""
    texts = views(spark, sf_dir).where("view_no = 1").select("package_id", "ocr_text")
    rows = rules.checks(inspection.manual_facts(texts, contexts(spark, sf_dir)))
    return rows.select("package_id", "rule_id", "status", "value", "evidence", _conf("confidence"), "message_code")


def _extractor(key: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, found = extract.searched(views(spark, sf_dir))
        rows = settled(rows, d=extract.EXTRACTORS[key](found)).where("d is not null")
        shown = [F.col(f"d.attrs.{a}").alias(a) for a in SHOWN[key].split()]
        return rows.select("package_id", "view_no", "d.value", "d.evidence", _conf("d.confidence"), *shown)

    return query


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.derive(spark, sf_dir, fixtures.RAW_VIEWS)
    return raw.select("package_id", "view_no", text.normal_text(F.col("ocr_text")).alias("normal"))


def address_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).select("package_id", "view_no", text.is_address(F.col("ocr_text")).alias("address"))


def emails_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ascii_only = extract.EMAIL.replace("(?iU)", "(?i)")
    some = docs.where(F.contains("text", F.lit("@")))
    return settled(some.select("doc_id", "text"), email=text.found(F.col("text"), ascii_only, 0)).where("email is not null").select("doc_id", "email")


def combined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.combined_text(views(spark, sf_dir))


def size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a package for each 7 doc_ids: too many, too large, too large together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(
        F.floor(F.col("doc_id") / 7).alias("package_id"), F.col("doc_id").alias("view_no"), F.col("n_chars").alias("length"),
        F.when(F.col("doc_id") % 31 == 5, "text/plain").otherwise("image/png").alias("mime"),
    )
    limits = ingest.Limits(files=6, file_bytes=9_000, total_bytes=20_000)
    return ingest.checked(files, limits).select("package_id", "view_no", "reject_reason")


def fuse_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fused(spark, sf_dir).where("key <> 'consumer_care'")
    return rows.select(
        "package_id", "key", "value", "evidence", _conf("confidence"), F.col("n_views").cast("long").alias("n_views"),
        F.array_join("source_image_ids", ",").alias("images"),
        F.col("attrs.multi_image_confirmed").alias("confirmed"),
    )


def fuse_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fused(spark, sf_dir).where("attrs.multi_image_conflict = 'true'")
    return rows.select("package_id", "key", "value", F.col("attrs.candidate_values").alias("candidate_values"))


def fuse_consumer_care(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fused(spark, sf_dir).where("key = 'consumer_care'")
    names = "email phone email_candidates phone_candidates address_detected multi_image_fused".split()
    return rows.select("package_id", "value", "evidence", _conf("confidence"), *(F.col(f"attrs.{n}").alias(n) for n in names))


def _won(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.consensus(recovery.votes(readings(spark, sf_dir)))


def merge_supplemental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front view's price against that of the readings."""
    front = extract.declarations(views(spark, sf_dir).where("view_no = 1")).where("key = 'mrp'")
    columns = ["package_id", "key", "value", "evidence", "confidence", "attrs"]
    merged = fusion.merge(front.select(columns), recovery.winner_facts(_won(spark, sf_dir)).select(columns), "package_id")
    return merged.select("package_id", "value", _conf("confidence"), F.col("attrs.ensemble_votes").alias("ensemble_votes"))


def rule_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By context alone: one row for each package and rule."""
    each = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), rules.applies(r.key).alias("applies")) for r in rules.RULES))
    return contexts(spark, sf_dir).select("package_id", F.explode(each).alias("r")).select("package_id", "r.*")


def unit_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    count, unit = rules.unit_basis()
    amount, base = rules.normal_quantity()
    as_int = lambda c: F.round(c * 1000).cast("long")
    return facts(spark, sf_dir).select(
        "package_id", as_int(amount).alias("thousandths"), base.alias("base_unit"), as_int(count).alias("basis_thousandths"),
        unit.alias("basis_unit"), rules.small_package().alias("small_package"), rules.price_is_unit_price().alias("price_is_unit_price"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["package_id", "rule_id", "applicability", "status", "value", "evidence", _conf("confidence"), "message_code"]
    return rules.checks(facts(spark, sf_dir)).select(columns)


def usp_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.checks(facts(spark, sf_dir)).where("key = 'unit_sale_price'")
    return rows.select("package_id", "status", "message_code", "value")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.summary(facts(spark, sf_dir))


def score_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.tone(summary(spark, sf_dir)).select("package_id", "tone")


def rule_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each rule of the profile came out over all packages."""
    rows = rules.checks(facts(spark, sf_dir)).groupBy("rule_id", "status").agg(F.count("*").alias("packages"))
    return rows.join(F.broadcast(rules.profile(spark)), "rule_id").select("rule_ord", "rule_id", "key", "weight", "status", "packages")


def _spatial(key: str, *names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spatial.spatial_fields(regions(spark, sf_dir)).where(F.col(key).isNotNull())
        return rows.select(
            "package_id", f"{key}.d.value", f"{key}.d.evidence", _conf(f"{key}.d.confidence"),
            F.array_join(f"{key}.region_ids", ",").alias("region_ids"), *(F.col(f"{key}.d.attrs.{n}").alias(n) for n in names),
        )

    return query


def evidence_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's regions that the fused facts of a package quote."""
    rows = fused(spark, sf_dir).where("key in ('net_quantity', 'mrp')").join(regions(spark, sf_dir), "package_id")
    linked = extract.linked_regions(F.col("evidence"), F.col("regions"))
    return rows.select("package_id", "key", F.array_join(linked, ",").alias("region_ids"))


def finding_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each quoted region of a package's page the last rule that says something about it."""
    kinds = ("net_quantity", "mrp")  # those that a page's regions are linked with; no other kind has a say in their checks
    checked = rules.judged(facts(spark, sf_dir, kinds), keep=["facts"], kinds=kinds).join(regions(spark, sf_dir), "package_id")
    rows = checked.select("package_id", "facts", "regions", F.explode("checks").alias("c"))
    quoted = F.when(F.col("c.key") == "mrp", F.col("facts.mrp.evidence")).otherwise(F.col("facts.net_quantity.evidence"))
    rows = settled(rows.select("package_id", "regions", "c", quoted.alias("said")).where("said is not null"), region_ids=extract.linked_regions(F.col("said"), F.col("regions")))
    return report.finding_regions(rows.select("package_id", "c.rule_ord", "c.rule_id", "c.status", "region_ids"))


def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(readings(spark, sf_dir), p=recovery.price_in(F.col("text"))).select("package_id", F.col("obs_ord").cast("long").alias("obs_ord"), "p.*")


def vote_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recovery.votes(readings(spark, sf_dir))
    return rows.select("package_id", "currency", "amount", "families", "votes", F.round("mean_confidence", 6).alias("mean_confidence"), F.col("rank_no").cast("long").alias("rank_no"))


def consensus_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.winner_facts(_won(spark, sf_dir)).select("package_id", "value", _conf("confidence"), "votes", "families")


def _staged(spark: SparkSession, sf_dir: str, stages: tuple[str, ...]) -> DataFrame:
    """Readings dealt to three stages; ``stage`` is the place of the stage that settled the price."""
    names = F.array(*(F.lit(s) for s in recovery.EXPLICIT))
    rows = readings(spark, sf_dir).withColumn("stage", F.get(names, ((F.col("obs_ord") - 1) % 3).cast("int")))
    won = recovery.by_stage(rows, stages)
    at = F.array_position(F.array(*(F.lit(s) for s in stages)), F.col("stage")) - 1
    return won.select("package_id", at.alias("stage"), "currency", "amount", "families", "votes")


def staged_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage with a consensus counts, in the order that follows an explicit hint."""
    return _staged(spark, sf_dir, recovery.EXPLICIT)


def staged_price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the order that follows a look at the image without a hint."""
    return _staged(spark, sf_dir, recovery.FALLBACK)


def reading_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading, what it says, and whether it agrees with the price that won."""
    rows = recovery.attempts(readings(spark, sf_dir), _won(spark, sf_dir))
    return rows.select("package_id", F.col("obs_ord").cast("long").alias("obs_ord"), "family", "currency", "amount", "agrees")


def recovery_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery from end to end: packages with a hint, or without one but with words of a price and no complete price."""
    read = all_declarations(spark, sf_dir)
    price = fusion.fuse(read.where("key = 'mrp'")).select("package_id", F.struct("confidence", "attrs").alias("price"))
    hints = recovery.hints(views(spark, sf_dir)).groupBy("package_id").agg(F.min(F.struct("view_no", "hint_ord", "locator", "evidence", "tax_inclusive_phrase")).alias("hint"))
    texts = fusion.combined_text(views(spark, sf_dir))
    rows = texts.join(hints, "package_id", "left").join(price, "package_id", "left")
    no_crops = F.array().cast("array<struct<label:string,score:double>>")
    looked = recovery.visual_fallback(F.col("hint").isNotNull().cast("int"), F.col("price"), F.col("raw_text"), no_crops)
    wanted = rows.where(F.col("hint").isNotNull() | looked).select("package_id", "hint.locator", "hint.evidence", "hint.tax_inclusive_phrase", "price")
    done = recovery.recovered(wanted, _won(spark, sf_dir), readings(spark, sf_dir))
    return done.select("package_id", "outcome", "value", _conf("confidence"), "added_text")


def spatial_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of a package's front, whose regions are known: a value found by place goes before one found in the text."""
    page = spatial.spatial_fields(regions(spark, sf_dir)).drop("regions")
    kinds = ("net_quantity", "month_year", "mrp")
    placed = page.select("package_id", *(F.col(k).getField("d").alias(f"_{k}") for k in kinds))
    front = views(spark, sf_dir).where("view_no = 1").join(placed, "package_id")
    rows = extract.declarations(front, lambda key: F.col(f"_{key}") if key in kinds else None)
    return rows.select("package_id", "key", "value", "evidence", _conf("confidence"), F.col("attrs.extraction_strategy").alias("extraction_strategy"))


def evidence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations sent as JSON, taken in again and fused: the same facts as without the detour."""
    sent = all_declarations(spark, sf_dir).withColumn("attributes", F.from_json(F.to_json("attrs"), "map<string,string>"))
    item = F.struct("key", "value", "evidence", "confidence", "attributes")
    images = sent.groupBy("package_id", "view_no", "image_id", "file_name").agg(F.collect_list(item).alias("declarations"))
    image = F.struct("view_no", "image_id", "file_name", "declarations")
    ordered = F.array_sort(F.collect_list(image), lambda a, b: a["view_no"] - b["view_no"])
    requests = images.groupBy("package_id").agg(ordered.alias("images"))
    taken = ingest.evidence_declarations(ingest.evidence(requests.select("package_id", F.to_json(F.struct("images")).alias("json"))))
    attrs = extract.attributes(**{a: F.col("attributes")[a] for a in extract.ATTRIBUTES})
    rows = fusion.fuse(taken.withColumn("attrs", attrs)).where("key <> 'consumer_care'")
    return rows.select("package_id", "key", "value", "evidence", _conf("confidence"), F.col("n_views").cast("long").alias("n_views"))


def best_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.best_readings(readings(spark, sf_dir))


def reference_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.hints(views(spark, sf_dir)).select("package_id", "view_no", "locator", "evidence", "tax_inclusive_phrase")


def direct_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(spark, sf_dir)


def unresolved_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recovery.unresolved(_sealed(spark, sf_dir), _won(spark, sf_dir))
    return rows.select("package_id", "value", "evidence", _conf("confidence"))


def recovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which packages need close-ups, and which complete prices take over a hint's tax phrase."""
    front = extract.declarations(views(spark, sf_dir).where("view_no = 1")).where("key = 'mrp'")
    price = front.select("package_id", F.struct("confidence", "attrs").alias("price"))
    hint = _sealed(spark, sf_dir).select("package_id", "tax_inclusive_phrase")
    rows = hint.join(price, "package_id", "left")
    return rows.select(
        "package_id", recovery.needs_recovery(F.col("price")).alias("needs_recovery"),
        F.round(recovery.enriched(F.col("price"), F.col("tax_inclusive_phrase")), 6).alias("enriched_confidence"),
    )


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.derive(spark, sf_dir, fixtures.CROPS)
    return rows.groupBy("package_id").agg(F.collect_list(F.struct("ord", "label", "x", "y", "w", "h", "score")).alias("crops"))


def crop_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recovery.suppress(F.col("crops"))
    return _crops(spark, sf_dir).select("package_id", F.array_join(F.transform(kept, lambda c: c["label"]), ",").alias("kept"))


def crop_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a package's crops, by score, the first or the first two."""
    ordered = F.array_sort("crops", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["ord"] - b["ord"]))
    rows = _crops(spark, sf_dir).withColumn("ordered", ordered)
    chosen = recovery.select_crops(F.col("ordered"))
    return rows.select("package_id", F.array_join(F.transform(chosen, lambda c: c["label"]), ",").alias("chosen"))


def attention_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over a line as wide as a package's price in paise, hundredths dropped, lets it be."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    wide = part.select(F.col("p_partkey").alias("package_id"), (100 + F.col("p_partkey") * 13 % 3000).cast("int").alias("line_width"))
    return wide.select("package_id", "line_width", F.posexplode(vision.windows(F.col("line_width"))).alias("n", "t")).select(
        "package_id", "line_width", F.col("n").cast("long").alias("n"), F.col("t.start").cast("long").alias("start"), F.col("t.w").cast("long").alias("w")
    )


def remap_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a package's value boxes in a close-up, as places in the image."""
    rows = fixtures.derive(spark, sf_dir, fixtures.REGIONS).where("region_ord in (2, 5, 9)")
    corner = F.array(F.struct("x", "y"), F.struct((F.col("x") + F.col("w")).alias("x"), (F.col("y") + F.col("h")).alias("y")))
    source = F.struct(F.lit(0.25).alias("x"), F.lit(0.5).alias("y"), F.lit(0.9).alias("w"), F.lit(0.7).alias("h"))
    rows = rows.select("package_id", "id", ingest.remapped(corner, source).alias("p"))
    rounded = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("package_id", "id", rounded(F.col("p")[0]["x"], "x0"), rounded(F.col("p")[0]["y"], "y0"), rounded(F.col("p")[1]["x"], "x1"), rounded(F.col("p")[1]["y"], "y1"))


def payload_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's regions as a recognition payload: blank texts, missing and wild scores, points outside the image."""
    rows = fixtures.derive(spark, sf_dir, fixtures.REGIONS)
    score = F.when(F.col("region_ord") == 3, None).when(F.col("region_ord") == 5, F.col("confidence") + 1).otherwise(F.col("confidence"))
    item = F.struct(
        "region_ord", "text", score.alias("score"),
        F.array(F.array(F.col("x") * 1000 - 300, F.col("y") * 600), F.array((F.col("x") + F.col("w")) * 1000, (F.col("y") + F.col("h")) * 900)).alias("poly"),
    )
    payload = rows.groupBy("package_id").agg(F.array_sort(F.collect_list(item)).alias("i"))
    payload = payload.select(
        "package_id", F.lit("image-1").alias("image_id"), F.lit(1000).alias("width"), F.lit(600).alias("height"),
        F.transform("i", lambda x: x["text"]).alias("rec_texts"), F.transform("i", lambda x: x["score"]).alias("rec_scores"),
        F.transform("i", lambda x: x["poly"]).alias("rec_polys"),
    )
    made = ingest.payload_regions(payload).withColumn("box", ingest.hull(F.col("polygon")))
    return made.select(
        "package_id", "region_id", "text", F.round("confidence", 6).alias("confidence"),
        *(F.round(f"box.{n}", 6).alias(n) for n in "xywh"),
    )


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.documents(rules.summed(rules.judged(facts(spark, sf_dir))))


QUERIES: dict[str, Query] = {
    **{f"x_{key}": _extractor(key) for key in extract.EXTRACTORS},
    "spatial_net_quantity": _spatial("net_quantity", "amount", "unit"),
    "spatial_month_year": _spatial("month_year", "month", "year"),
    "spatial_mrp": _spatial("mrp", "amount", "currency", "tax_inclusive_phrase"),
    **{
        f.__name__: f
        for f in (
            norm_text, address_flag, emails_in_documents, combined_text, size_limits, fuse_declarations, fuse_conflicts,
            fuse_consumer_care, merge_supplemental, rule_applicability, unit_basis, checks, usp_arithmetic, summary, score_tone,
            rule_profile, evidence_regions, finding_regions, parse_price, vote_price, consensus_price, staged_price,
            best_readings, reference_hints, direct_hints, unresolved_reference, recovery_plan, crop_nms, crop_select,
            attention_tiles, remap_polygon, payload_regions, report_json, staged_price_fallback, reading_attempts, recovery_outcome,
            spatial_first, evidence_facts, place_consensus, lazy_stages, hint_outcomes, second_extraction, recovered_regions, hint_regions,
            view_finding_regions, manual_inspection,
        )
    },
}
