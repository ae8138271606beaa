"""Extension, not part of the batch inspection: views that arrive as a stream.

Extraction works row by row, so it runs on a streaming table as it is. Facts of a package need all of its views: a
batch of declarations is added to a table, and packages that got new ones are judged anew from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions import extract
from ..operators import fusion


def read_views(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet files with views."""
    kind = "package_id bigint, view_no int, image_id string, file_name string, ocr_text string"
    return spark.readStream.schema(kind).parquet(path)


def keep_declarations(views: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes the declarations of arriving views to a Parquet table; ends when all there is has been read. No state is kept."""
    rows = extract.declarations(views)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)


def facts(spark: SparkSession, table: str) -> DataFrame:
    """The facts of all packages so far; a view that came more than once counts once."""
    return fusion.fuse(spark.read.parquet(table).dropDuplicates(["package_id", "view_no", "key"]))
