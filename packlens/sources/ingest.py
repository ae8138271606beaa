"""Sources: manual texts, image files, evidence as JSON, payloads of a recognition engine; and what is turned away.

Nothing fails a job: a row that can't be used keeps its keys and says why (``reject_reason``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

EVIDENCE = (
    "context struct<imported_product boolean, may_become_unfit boolean, dimensions_relevant boolean, alcoholic_beverage boolean,"
    " package_form string, commodity_class string>, images array<struct<image_id string, file_name string, ocr_text string,"
    " declarations array<struct<key string, label string, value string, evidence string, confidence double,"
    " attributes map<string, string>, region_ids array<string>, source_image_ids array<string>>>>>"
)


@dataclass(frozen=True)
class Limits:
    files: int = 6
    file_bytes: int = 10 * 1024 * 1024
    total_bytes: int = 40 * 1024 * 1024


def manual_texts(spark: SparkSession, path: str) -> DataFrame:
    """One view for each text file: package_id (its path), view_no, file_name, ocr_text."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("package_id"), strip(F.col("value")).alias("ocr_text"))
    return files.select("package_id", F.lit(1).alias("view_no"), F.lit("manual").alias("file_name"), "ocr_text")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder for each package, numbered by name: package_id, view_no, image_id, file_name, mime, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    kind = F.lower(F.substring_index("path", ".", -1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind.isin("png", "webp", "bmp"), F.concat(F.lit("image/"), kind)).otherwise("other")
    rows = files.select(
        F.element_at(parts, -2).alias("package_id"), F.element_at(parts, -1).alias("file_name"), mime.alias("mime"), "length", "content"
    )
    number = F.row_number().over(Window.partitionBy("package_id").orderBy("file_name"))
    return rows.withColumn("view_no", number).withColumn("image_id", F.concat(F.lit("image-"), F.col("view_no").cast("string")))


def valid_image_id(c: Column) -> Column:
    """Given ids have at most 40 letters, digits, dashes and underscores."""
    return c.rlike("^[A-Za-z0-9_-]{1,40}$")


def checked(files: DataFrame, limits: Limits = Limits(), package: str = "package_id") -> DataFrame:
    """Adds reject_reason: a package with too many files goes whole; then a file's kind, its size, and the running total.

    ``files``: package, view_no, mime, length. The window is over one package's files.
    """
    whole = Window.partitionBy(package)
    order = whole.orderBy("view_no").rowsBetween(Window.unboundedPreceding, 0)
    reason = (
        F.when(F.count("*").over(whole) > limits.files, "too_many_files")
        .when(~F.startswith("mime", F.lit("image/")), "not_an_image")
        .when(F.col("length") > limits.file_bytes, "file_too_large")
        .when(F.sum("length").over(order) > limits.total_bytes, "total_too_large")
    )
    return files.withColumn("reject_reason", reason)


def input_kind(has_text: Column, has_files: Column) -> Column:
    """Either a text or files must be given: the reason why not, else null."""
    return F.when(has_text & has_files, "text_and_files").when(~has_text & ~has_files, "no_input")


def evidence(rows: DataFrame, column: str = "json") -> DataFrame:
    """Requests with evidence made elsewhere: adds context and images; the reason where the text is no such request."""
    parsed = rows.withColumn("_e", F.from_json(column, EVIDENCE))
    n = F.size("_e.images")
    reason = F.when(F.col("_e.images").isNull(), "no_evidence").when((n < 1) | (n > Limits().files), "image_count")
    return parsed.withColumns({"context": F.col("_e.context"), "images": F.col("_e.images"), "reject_reason": reason}).drop("_e")


def evidence_declarations(requests: DataFrame, package: str = "package_id") -> DataFrame:
    """A row for each declaration of each image of the accepted requests."""
    images = requests.where("reject_reason is null").select(package, F.posexplode("images").alias("n", "image"))
    rows = images.select(package, (F.col("n") + 1).alias("view_no"), "image.image_id", "image.file_name", F.explode("image.declarations").alias("d"))
    return rows.select(package, "view_no", "image_id", "file_name", "d.*")


def payload_regions(payloads: DataFrame) -> DataFrame:
    """Regions of a recognition payload: package_id, image_id, region_id, region_ord, text, confidence, polygon.

    Blank texts go after numbering; scores are kept within 0 and 1, a missing one is 0; points become shares of the
    image, kept inside it. ``payloads``: rec_texts, rec_scores, rec_polys, width, height.
    """
    each = F.arrays_zip("rec_texts", "rec_scores", "rec_polys")
    rows = payloads.select("package_id", "image_id", "width", "height", F.posexplode(each).alias("n", "r"))
    inside = lambda v, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / size))
    polygon = F.transform(
        "r.rec_polys", lambda p: F.struct(inside(p[0], F.col("width")).alias("x"), inside(p[1], F.col("height")).alias("y"))
    )
    return rows.where(F.col("r.rec_texts").rlike(r"(?U)\S")).select(
        "package_id",
        "image_id",
        F.concat(F.lit("r"), (F.col("n") + 1).cast("string")).alias("region_id"),
        (F.col("n") + 1).alias("region_ord"),
        strip(F.col("r.rec_texts")).alias("text"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.rec_scores", F.lit(0.0)))).alias("confidence"),
        F.coalesce(polygon, F.array().cast("array<struct<x:double,y:double>>")).alias("polygon"),
    )


def hull(polygon: Column) -> Column:
    """The box around a polygon: x, y, w, h; zeros if there are no points."""
    side = lambda f, name: F.coalesce(f(F.transform(polygon, lambda p: p[name])), F.lit(0.0))
    x, y = side(F.array_min, "x"), side(F.array_min, "y")
    return F.struct(x.alias("x"), y.alias("y"), (side(F.array_max, "x") - x).alias("w"), (side(F.array_max, "y") - y).alias("h"))


def remapped(polygon: Column, source: Column) -> Column:
    """Points of a close-up (shares of it) as shares of the image it was cut from (x, y, w, h in shares), kept inside."""
    inside = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return F.transform(
        polygon,
        lambda p: F.struct(
            inside(source["x"] + p["x"] * source["w"]).alias("x"), inside(source["y"] + p["y"] * source["h"]).alias("y")
        ),
    )
