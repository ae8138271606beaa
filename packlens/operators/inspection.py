"""Inspection from end to end, view by view: which places a view points to, what close-ups of them settle, and a second extraction over the text that grew.

A view's work is a short ordered list of places (explicit hints, else a look at the seal) in its own row. Close-ups are joined to the few views
that have work; their readings are voted on place by place, stage by stage; a fold over a view's work then carries along whether a price is known:
the first place that settles it makes later ones ``kept`` or ``enriched``, each open one leaves a pseudo-fact. What is recovered goes into its own view
before views are fused. Texts move only for views with work; a package's declarations and texts meet in one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.extract import attributes, candidate
from ..functions.text import compact, places, settled, strip
from ..sources.ingest import remapped
from ..tables import stash
from . import fusion, recovery, rules

VIEW, PLACE = ("package_id", "view_no"), ("package_id", "view_no", "locator")
HINT = "struct<locator:string,evidence:string,tax_inclusive_phrase:boolean,explicit:boolean>"
#: The evidence of a look at the seal that no text asked for.
UNASKED = "no price and no locator read; the seal was searched"
#: Fixed value: the line above recovered texts in a view's text.
HEADER = "[Image-variant OCR ensemble: MRP via {}]"


def with_work(views: DataFrame) -> DataFrame:
    """Adds ``price`` (the text's price declaration, null if none) and ``work``: the places to look at, in order.

    Explicit hints, one for each locator. A view without hints and without a complete price has the seal as work if its text
    has words of a price, or its ``crops`` (if there is such a column) a clear seal.
    """
    t = F.col("ocr_text")
    points, words = t.rlike(f"(?i){recovery.POINTER}"), t.rlike(rf"(?i){recovery.LABEL}|{recovery.TAX}")
    none = places(F.lit(""), "x")
    when = lambda pattern: F.when(F.col("_points"), places(t, pattern)).otherwise(F.slice(none, 1, 0))
    # a price's label is one of the words, so other texts are searched no further
    rows, found = extract.searched(settled(views, _points=points, _words=words).withColumn("_said", F.when(F.col("_words"), t)), extract.PRICE_PATTERNS, "_said")
    rows = settled(
        rows, price=extract.mrp(found), _direct=when(recovery.DIRECT), _pointers=when(f"(?i){recovery.POINTER}"), _labels=when(f"(?i){recovery.LABEL}"),
    )
    rows = settled(rows, _all=recovery.hint_array(t, F.col("_direct"), F.col("_pointers"), F.col("_labels")))
    earlier = lambda n: F.transform(F.slice("_all", F.lit(1), n), lambda h: h["locator"])
    once = F.filter("_all", lambda h, n: ~F.array_contains(earlier(n), h["locator"]))
    explicit = F.transform(once, lambda h: h.withField("explicit", F.lit(True)).cast(HINT))
    look = F.struct(
        F.lit("seal").alias("locator"), F.lit(UNASKED).alias("evidence"), t.rlike(f"(?i){recovery.TAX}").alias("tax_inclusive_phrase"), F.lit(False).alias("explicit")
    ).cast(HINT)
    clear = F.exists("crops", lambda c: (c["label"] == "seal") & (c["score"] >= 0.70)) if "crops" in views.columns else F.lit(False)
    asked = (F.size("_all") == 0) & recovery.needs_recovery(F.col("price")) & (F.col("_words") | F.coalesce(clear, F.lit(False)))
    return settled(rows, work=F.when(asked, F.array(look)).otherwise(explicit)).select(*views.columns, "price", "work")


def place_of(stage: Column, explicit: Column) -> Column:
    """When a stage's turn comes (1, 2, 3; null for other stages), by the order that an explicit hint or a look without one asks for."""
    turn = lambda order: F.nullif(F.array_position(F.array(*(F.lit(s) for s in order)), stage), F.lit(0)).cast("int")
    return F.when(explicit, turn(recovery.EXPLICIT)).otherwise(turn(recovery.FALLBACK))


def read_closeups(work: DataFrame, closeups: DataFrame) -> DataFrame:
    """The readings that have a place in some view's work, with its ``turn``, the price read (``p``) and the reading's confidence.

    ``closeups``: package_id, view_no, locator, stage, obs_ord, family, text, and ``confidence`` or ``regions`` (id, text, confidence, …), whose
    best match with the price then counts.
    """
    asked = work.select(*VIEW, F.explode("work").alias("h")).select(*VIEW, "h.locator", "h.explicit")
    rows = closeups.join(asked, list(PLACE)).withColumn("turn", place_of(F.col("stage"), F.col("explicit"))).where("turn is not null")
    return priced(rows)


def priced(rows: DataFrame) -> DataFrame:
    """Readings, stripped, with the price read (``p``) and their ``confidence``, if they have ``regions`` instead. A text is searched once."""
    rows = settled(rows, text=strip(F.col("text")))
    rows = settled(rows, _masked=F.regexp_replace("text", recovery.RATE, " "))
    rows = settled(rows, p=recovery.price_in(F.col("text"), F.col("_masked"))).drop("_masked")
    return settled(rows, confidence=recovery.reading_confidence(F.col("regions"), F.col("p"))) if "regions" in rows.columns else rows


def first_consensus(read: DataFrame, *by: str, only: int | None = None) -> DataFrame:
    """For each place the winner of the first turn at which all readings so far agree enough: by, turn, currency, amount, families, votes, mean_confidence, evidence, direct.

    ``only``: asks for this turn alone, of readings that go no further.
    """
    by = by or PLACE
    upto = F.explode(F.sequence(F.col("turn"), F.lit(3))) if only is None else F.lit(only)
    seen = read.where("p is not null").withColumn("at", upto)
    order = F.struct("turn", "obs_ord")
    voted = seen.groupBy(*by, "at", F.col("p.currency").alias("currency"), F.col("p.amount").alias("amount")).agg(
        F.size(F.collect_set("family")).cast("long").alias("families"), F.count("*").alias("votes"), F.avg("confidence").alias("mean_confidence"), F.min("obs_ord").alias("first_ord"),
        F.min_by("p.evidence", order).alias("evidence"), F.bool_or(F.col("stage") == "direct").alias("direct"),
    )
    ranked = voted.withColumn("rank_no", F.row_number().over(Window.partitionBy(*by, "at").orderBy(F.desc("families"), F.desc("votes"), F.desc(F.round("mean_confidence", 9)), "first_ord")))
    won = recovery.consensus(ranked, *by, "at")
    first = won.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).where("_n = 1")
    return first.drop("_n", "rank_no", "first_ord").withColumnRenamed("at", "turn")


def lazily(work: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stage after stage, reading only what is still open: (winners, readings made, ledger).

    ``read`` gets the open places of a turn (package_id, view_no, locator, explicit, stage) and makes their readings (with ``confidence`` or ``regions``), say
    with a recognition engine; it is called with places that earlier turns settled left out, before anything is read. Readings are written, so no engine runs twice. The
    ledger has a row for each place and turn that was asked: turn, read (readings made) and settled. Three turns at most.
    """
    open_ = stash(work.select(*VIEW, F.explode("work").alias("h")).select(*VIEW, "h.locator", "h.explicit"), "open")
    made, winners, ledger = [], [], []
    for turn in (1, 2, 3):
        asked = open_.withColumn("stage", F.when(F.col("explicit"), recovery.EXPLICIT[turn - 1]).otherwise(recovery.FALLBACK[turn - 1]))
        made.append(stash(priced(read(asked)).withColumn("turn", F.lit(turn)), "readings"))
        so_far = reduce(DataFrame.unionByName, made).join(open_.select(*PLACE), list(PLACE), "left_semi")
        winners.append(stash(first_consensus(so_far, only=turn), "won"))
        counts = made[-1].groupBy(*PLACE).agg(F.count("*").alias("read"))
        known = open_.join(counts, list(PLACE), "left").join(winners[-1].select(*PLACE, F.lit(True).alias("settled")), list(PLACE), "left")
        ledger.append(known.select(*PLACE, F.lit(turn).alias("turn"), F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("settled", F.lit(False)).alias("settled")))
        open_ = stash(open_.join(winners[-1].select(*PLACE), list(PLACE), "left_anti"), "open")
        if open_.isEmpty():
            break
    return tuple(reduce(DataFrame.unionByName, x) for x in (winners, made, ledger))


def agreeing(read: DataFrame, won: DataFrame, *by: str) -> DataFrame:
    """The readings that a winner counted, with ``nth``, their place among them, and the winner (``w``)."""
    by = by or PLACE
    winner = F.struct("turn", "currency", "amount", "families", "votes", "mean_confidence", "evidence", "direct")
    rows = read.join(won.select(*by, winner.alias("w")), list(by))
    rows = rows.where((F.col("turn") <= F.col("w.turn")) & (F.col("p.currency") == F.col("w.currency")) & (F.col("p.amount") == F.col("w.amount")))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "obs_ord")))


def settled_places(read: DataFrame) -> DataFrame:
    """(package_id, view_no, won): for each view an array of what its places came to, with the first four texts that agree."""
    rows = agreeing(read, first_consensus(read)).where("nth <= 4")
    places_ = rows.groupBy(*PLACE).agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("said"))
    won = F.struct("locator", "w.currency", "w.amount", "w.families", "w.votes", "w.mean_confidence", "w.evidence", "w.direct", F.transform("said", lambda x: x["text"]).alias("texts"))
    return places_.groupBy(*VIEW).agg(F.collect_list(won).alias("won"))


def recovered_price(hint: Column, won: Column) -> Column:
    """The declaration of a price that close-ups settled at the place of a hint."""
    value = F.concat_ws(" ", won["currency"], won["amount"])
    # rounded, so that the order in which a mean is summed doesn't show
    confidence = F.round(F.least(F.lit(0.96), F.greatest(F.lit(0.68), 0.58 + 0.05 * won["families"] + 0.20 * won["mean_confidence"])), 9)
    return candidate(
        value, compact(F.concat(hint["evidence"], F.lit(" -> "), won["evidence"]), 260), confidence, currency=won["currency"], amount=won["amount"],
        tax_inclusive_phrase=hint["tax_inclusive_phrase"], source=F.when(hint["explicit"], "referenced_region_ensemble").otherwise("required_mrp_visual_fallback"),
        locator=hint["locator"], recovery_strategy=F.when(won["direct"], "direct-text-recognition-ensemble").otherwise("image-variant-ensemble"),
        reference_evidence=hint["evidence"], ensemble_votes=won["votes"], ensemble_families=won["families"],
    )


def open_reference(hint: Column) -> Column:
    """The pseudo-declaration of an explicit hint that nothing settled."""
    return candidate(
        F.concat(F.lit("See "), hint["locator"]), hint["evidence"], 0.82, locator=hint["locator"], tax_inclusive_phrase=hint["tax_inclusive_phrase"],
        source=F.lit("unresolved_reference"),
    )


def enriched_price(price: Column, hint: Column) -> Column:
    """A complete price that takes over a hint's tax phrase."""
    attrs = price["attrs"]
    changed = {"tax_inclusive_phrase": F.lit("true"), "source": F.lit("direct_plus_reference"), "locator": hint["locator"], "reference_evidence": hint["evidence"]}
    return F.struct(
        price["value"].alias("value"), compact(F.concat(price["evidence"], F.lit(" -> "), hint["evidence"]), 260).alias("evidence"),
        F.least(F.lit(0.96), F.greatest(price["confidence"], F.lit(0.90))).alias("confidence"),
        attributes(**{a: changed.get(a, attrs[a]) for a in extract.ATTRIBUTES}).alias("attrs"),
    )


def folded(work: DataFrame) -> DataFrame:
    """Adds ``done``: for each place of a view's work, in order, struct(hint, outcome, key, d, texts).

    The fold carries the price that is known. While it isn't complete, a place with a consensus is ``recovered`` and makes it known, and
    another is ``unresolved`` (``nothing`` if no text asked for it); once it is known, a place is ``enriched`` if its hint alone has the tax phrase, else
    ``kept``. ``work``: price, work and won (may be null).
    """
    # what each place could come to is worked out once, before the fold picks
    at = lambda h: F.get(F.filter("won", lambda w: w["locator"] == h["locator"]), F.lit(0))
    tried = F.transform("work", lambda h: F.struct(h.alias("h"), at(h).alias("w")))
    rows = settled(work, _tried=tried)
    made = F.transform("_tried", lambda x: F.struct(x["h"].alias("h"), x["w"].isNotNull().alias("won"), F.when(x["w"].isNotNull(), recovered_price(x["h"], x["w"])).otherwise(open_reference(x["h"])).alias("d"), x["w"]["texts"].alias("texts")))
    rows = settled(rows, _made=made)
    direct = F.when(~recovery.needs_recovery(F.col("price")), F.lit(0)).cast("int")
    # the place in the list that settles the price: 0 for the text's own, null if none does
    first = F.aggregate(
        "_made", F.struct(direct.alias("known"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("before")),
        lambda s, x: F.struct(
            F.coalesce(s["known"], F.when(x["won"], s["n"] + 1)).alias("known"), (s["n"] + 1).alias("n"), F.concat(s["before"], F.array(s["known"])).alias("before")
        ),
        lambda s: s["before"],
    )
    rows = settled(rows, _before=first)

    def outcome(x: Column, n: Column) -> Column:
        before = F.get("_before", n)
        known = F.when(before > 0, F.get("_made", before - 1)["d"]).otherwise(F.col("price"))
        lacks = ~F.coalesce(known["attrs"]["tax_inclusive_phrase"] == "true", F.lit(False))
        rich = x["h"]["tax_inclusive_phrase"] & lacks
        name = (
            F.when(before.isNotNull() & rich, "enriched").when(before.isNotNull(), "kept").when(x["won"], "recovered")
            .when(x["h"]["explicit"], "unresolved").otherwise("nothing")
        )
        d = F.when(before.isNotNull() & rich, enriched_price(known, x["h"])).when(before.isNull() & (x["won"] | x["h"]["explicit"]), x["d"])
        return F.struct(x["h"].alias("hint"), name.alias("outcome"), d.alias("d"), F.when(before.isNull() & x["won"], x["texts"]).alias("texts"))

    return settled(rows, done=F.transform("_made", outcome)).drop("_tried", "_made", "_before")


def grown(rows: DataFrame) -> DataFrame:
    """Adds to a view's text what its recovered places read, and ``more``: the declarations of its work, in order, as struct(key, d)."""
    new = F.filter("done", lambda x: F.size(x["texts"]) > 0)
    part = lambda x: F.concat(F.lit(HEADER.partition("{")[0]), x["hint"]["locator"], F.lit("]\n"), F.array_join(x["texts"], "\n---\n"))
    text = F.when(F.size(new) > 0, strip(F.concat(F.col("ocr_text"), F.lit("\n"), F.array_join(F.transform(new, part), "\n")))).otherwise(F.col("ocr_text"))
    key = lambda x: F.when(x["outcome"] == "unresolved", "mrp_reference").otherwise("mrp")
    more = F.transform(F.filter("done", lambda x: x["d"].isNotNull()), lambda x: F.struct(key(x).alias("key"), x["d"].alias("d")))
    return settled(rows, _text=text, more=more).withColumn("ocr_text", F.col("_text")).drop("_text")


def recovered_views(views: DataFrame, closeups: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The views with the text that close-ups added, and ``more``. Views are searched for work once and written; those without work don't move.

    ``closeups``: a table, or what makes one for the views with work.
    """
    worked = stash(with_work(views), "work")
    some = worked.where(F.size("work") > 0)
    if not isinstance(closeups, DataFrame):
        closeups = closeups(some)
    won = settled_places(stash(read_closeups(some.select(*VIEW, "work"), closeups).select(*PLACE, "stage", "turn", "obs_ord", "family", "text", "p", "confidence"), "read"))
    done = grown(folded(some.join(won, list(VIEW), "left"))).select(*views.columns, "more")
    rest = worked.where(F.size("work") == 0).select(*views.columns, F.array().cast(done.schema["more"].dataType).alias("more"))
    return rest.unionByName(done)


#: The key under which a view's text travels with its declarations.
TEXT = "_text"


def declared(views: DataFrame, spatial: Callable[[str], Column | None] = lambda key: None, kinds: Collection[str] = tuple(extract.LABELS)) -> DataFrame:
    """A row for each declaration of each view and for its text: the view's keys, key, src (0: the text's own), value, evidence, confidence, attrs, region_ids.

    Extraction runs over the text that grew. ``views``: package_id, view_no, image_id, file_name, ocr_text, and if there are any more (declarations
    that recovery adds) and regions (id, text, …, of the view): ids come out as ``image_id:id``, so that those of several views don't clash.
    Texts are searched for the ``kinds`` alone.
    """
    rows, t = extract.searched(views, tuple(p for k in kinds for p in extract.PATTERNS_OF[k]))
    each = []
    for key in kinds:
        made, placed = extract.EXTRACTORS[key](t), spatial(key)
        each.append(F.struct(F.lit(key).alias("key"), F.lit(0).alias("src"), (made if placed is None else F.coalesce(placed, made)).alias("d")))
    none = F.lit(None).cast("string")
    part = F.concat(F.lit("--- "), F.col("file_name"), F.lit(" ---\n"), strip(F.col("ocr_text")))
    said = F.when(F.col("ocr_text").rlike(r"(?U)\S"), candidate(part, none, 0.0))
    each.append(F.struct(F.lit(TEXT).alias("key"), F.lit(0).alias("src"), said.alias("d")))
    all_ = F.array(*each)
    if "more" in views.columns:
        all_ = F.concat(all_, F.transform("more", lambda x, n: F.struct(x["key"].alias("key"), (n + 1).alias("src"), x["d"].alias("d"))))
    kept = [*VIEW, "image_id", "file_name", *(["regions"] if "regions" in views.columns else [])]
    rows = rows.select(*kept, F.explode(all_).alias("x")).where(F.col("x.d").isNotNull() & F.col("x.key").isin(*kinds, "mrp_reference", TEXT))
    rows = rows.select(*kept, "x.key", "x.src", "x.d.*")
    rows = rows.withColumn("attrs", F.col("attrs").withField("source_file", F.col("file_name")))
    if "regions" not in views.columns:
        return rows
    hinted = F.when(F.col("src") > 0, recovery.reference_regions(F.col("attrs.reference_evidence"), F.col("regions")))
    ids = F.coalesce(hinted, extract.linked_regions(F.col("evidence"), F.col("regions")))
    return rows.withColumn("region_ids", fusion.namespaced(F.col("image_id"), ids)).drop("regions")


def by_view(rows: DataFrame) -> DataFrame:
    """Of several declarations of a kind in one view the first of the most confident ones."""
    best = Window.partitionBy(*VIEW, "key").orderBy(F.desc("confidence"), "src")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def package_facts(
    views: DataFrame, contexts: DataFrame, closeups: DataFrame | Callable[[DataFrame], DataFrame] | None = None, kinds: Collection[str] = tuple(extract.LABELS)
) -> DataFrame:
    """A row for each package of ``contexts``: its context, raw_text, and facts with a struct for each of the ``kinds`` (with region_ids if views have regions).

    Declarations and texts of a package meet once: merged view by view, fused over views and laid side by side without another shuffle.
    """
    rows = declared(recovered_views(views, closeups) if closeups is not None else views, kinds=kinds)
    # the number is stated: fusing and judging are costly for their bytes, by which partitions would be put together
    fused = fusion.fuse(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "package_id"), text=TEXT)
    fields = ["value", "evidence", "confidence", "attrs", *(["region_ids"] if "region_ids" in rows.columns else [])]
    kinds = [*kinds, "mrp_reference"]
    one = [F.min(F.when(F.col("key") == k, F.struct(*fields))).alias(k) for k in kinds]
    wide = fused.groupBy("package_id").agg(F.max(F.when(F.col("key") == TEXT, F.col("value"))).alias("raw_text"), *one)
    return rules.with_context(wide.select("package_id", "raw_text", F.struct(*kinds).alias("facts")), contexts)


def manual_facts(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """The same for packages that are one text each (package_id, ocr_text): no view, no file, nothing to fuse, nothing to look at."""
    rows, t = extract.searched(texts.select("package_id", strip(F.col("ocr_text")).alias("raw_text")), text="raw_text")
    none = F.lit(None).cast(rows.select(extract.mrp(t).alias("d")).schema["d"].dataType)
    facts = F.struct(*(e(t).alias(k) for k, e in extract.EXTRACTORS.items()), none.alias("mrp_reference"))
    return rules.with_context(settled(rows, facts=facts).select("package_id", "raw_text", "facts"), contexts)


def recovered_regions(read: DataFrame, work: DataFrame) -> DataFrame:
    """The regions behind the winners: package_id, view_no, id (t1, t2, … through a view), text, confidence, polygon in the image.

    Of each agreeing reading the regions that show the price, or all of them if none does. ``read``: as ``read_closeups`` gives it, with regions (x, y, w, h
    as shares of the close-up) and source (the close-up's place in the image); ``work``: views with their work.
    """
    won = first_consensus(read)
    order = work.select(*VIEW, F.posexplode("work").alias("hint_ord", "h")).select(*VIEW, "hint_ord", "h.locator")
    known = work.select(*VIEW, (~recovery.needs_recovery(F.col("price"))).alias("_complete"))
    # only the first place that settles a view's price is read into the view
    first = won.join(order, list(PLACE)).join(known, list(VIEW)).where("not _complete")
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*VIEW).orderBy("hint_ord"))).where("_n = 1").drop("_n", "hint_ord", "_complete")
    rows = agreeing(read, first)
    shown = recovery.matching_regions(F.col("regions"), F.col("p.currency"), F.col("p.amount"))
    rows = settled(rows, _shown=F.when(F.size(shown) > 0, shown).otherwise(F.col("regions")))
    corner = lambda r, dx, dy: F.struct((r["x"] + dx * r["w"]).alias("x"), (r["y"] + dy * r["h"]).alias("y"))
    each = rows.select(*VIEW, "locator", "nth", "source", F.posexplode("_shown").alias("at", "r"))
    polygon = F.array(*(corner(F.col("r"), dx, dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))))
    number = F.row_number().over(Window.partitionBy(*VIEW).orderBy("nth", "at"))
    return each.select(
        *VIEW, F.concat(F.lit("t"), number.cast("string")).alias("id"), F.col("r.text").alias("text"), F.col("r.confidence").alias("confidence"),
        remapped(polygon, F.col("source")).alias("polygon"),
    )
