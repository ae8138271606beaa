"""Sharding by sampled splitters: shards of near equal bytes along a key order.

The key is (60 bits of the text's digest, doc_id), so that equal texts are neighbours; a heavy group is subdivided like any other range. A size-weighted sample of keys
(each row's rank is -ln(u) / size with u from a hash, the smallest ranks are drawn) gives quantile boundaries; records
are range-partitioned by them; ranges measured as overfull are subdivided by a further sample from within. Exact sums
of the ranges then place each record: its shard is the part of all bytes before it.

Only the sampled keys, the boundaries and the ranges' sums reach the driver; a range has about ``RANGE_BYTES`` of records, of which
narrow rows without text are sorted in one task.

Defined results: a null text counts as an empty one (8 bytes), rows that repeat are placed one after the other, null
doc_ids come first within equal texts, an empty table gives an empty table. Further columns pass through (names starting with
``_s_`` are reserved; those of the results are replaced).
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, whole_text

#: Bytes of records that a range has on average, and the fewest ranges.
RANGE_BYTES, RANGES = 4 << 30, 192
#: Bytes of a record beside its text.
OVERHEAD = 8


def record_size() -> Column:
    return (F.octet_length(whole_text()) + OVERHEAD).cast("long")


def _sample(rows: DataFrame, k: int) -> list[tuple]:
    """k keys, drawn by size without a seed that changes: the same rows give the same sample."""
    u = (F.abs(F.xxhash64("_s_key", "_s_id", F.lit("draw")) % 9007199254740992) + 1) / 9007199254740993.0
    drawn = rows.select("_s_key", "_s_id", (-F.log(u) / F.col("size")).alias("r")).orderBy("r").limit(k)
    return sorted((r[0], r[1]) for r in drawn.collect())


def _range_of(splitters: list[tuple]) -> Column:
    """The number of splitters at or below a row's key."""
    keys, ties = np.array([k for k, _ in splitters], np.int64), np.array([t for _, t in splitters], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        out = low.copy()
        for k in np.unique(low[high > low]):  # a splitter of the same key: the tie decides
            at = np.flatnonzero((low == k) & (high > low))
            out[at] = k + np.searchsorted(ties[k : high[at[0]]], tie.to_numpy()[at], "right")
        return pd.Series(out.astype(np.int32))

    return place("_s_key", "_s_id") if splitters else F.lit(0)


def _quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def assign(
    docs: DataFrame, shards: int, ranges: int | None = None, per_range: int = 24, rounds: int = 3, columns: list[str] | None = None
) -> DataFrame:
    """Adds size, text_crc32, shard and slot (place in the shard, from 0) to each row.

    ``ranges``: how many ranges the records are dealt to, by default one for each ``RANGE_BYTES``, ``RANGES`` at least.
    ``per_range``: sampled keys for each. ``rounds``: times that overfull ranges are subdivided. ``columns``: those of
    ``docs`` to keep, all by default; a text that isn't kept doesn't move.
    """
    spark = docs.sparkSession
    text = whole_text()
    rows = docs.withColumns(
        {
            "size": record_size(),
            "text_crc32": F.crc32(F.encode(text, "utf-8")),
            "_s_key": F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 15), 16, 10).cast("long"),
            "_s_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
        }
    )
    keep = [c for c in (docs.columns if columns is None else columns) if c not in ("size", "text_crc32", "shard", "slot")]
    rows = rows.select(*keep, "size", "text_crc32", "_s_key", "_s_id")
    narrow = stash(rows.select("_s_key", "_s_id", "size"), "sizes")
    if ranges is None:
        ranges = max(RANGES, -(-(narrow.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES))
    splitters = _quantiles(_sample(narrow, ranges * per_range), ranges)
    for _ in range(rounds):
        sums = narrow.groupBy(_range_of(splitters).alias("r")).agg(
            F.sum("size").alias("b"), F.min(F.struct("_s_key", "_s_id")).alias("lo"), F.max(F.struct("_s_key", "_s_id")).alias("hi")
        ).collect()
        total = sum(r["b"] for r in sums)
        # a range of one key can't be cut; rows that share it are equal and placed one after the other
        overfull = [r["r"] for r in sums if r["b"] * ranges > 2 * total and r["lo"] != r["hi"]]
        if not overfull:
            break
        inside = narrow.where(_range_of(splitters).isin(overfull))
        more = _sample(inside, len(overfull) * per_range)
        added = set()
        for r in overfull:
            lo = splitters[r - 1] if r else None
            hi = splitters[r] if r < len(splitters) else None
            own = [k for k in more if (lo is None or k > lo) and (hi is None or k < hi)]
            share = next(x["b"] for x in sums if x["r"] == r) * ranges / total
            added |= set(_quantiles(own, min(len(own), int(share) + 1))) if own else set()
        if not added:
            break
        splitters = sorted({*splitters, *added})
    sums = {r["r"]: (r["b"], r["n"]) for r in narrow.groupBy(_range_of(splitters).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    bases, b, n = [], 0, 0
    for r in range(len(splitters) + 1):
        bases.append((r, b, n))
        b, n = b + sums.get(r, (0, 0))[0], n + sums.get(r, (0, 0))[1]
    base = F.broadcast(spark.createDataFrame(bases, "_s_range int, _s_bytes long, _s_rows long"))
    order = Window.partitionBy("_s_range").orderBy("_s_key", "_s_id")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        rows.withColumn("_s_range", _range_of(splitters))
        .withColumns({"_s_before": before, "_s_n": F.row_number().over(order) - 1})
        .join(base, "_s_range")
        .withColumns(
            {
                "_s_row": F.col("_s_rows") + F.col("_s_n"),
                "shard": F.expr(f"least((_s_bytes + _s_before) * {shards} div {max(b, 1)}, {shards - 1})").cast("int"),
            }
        )
        .drop("_s_range", "_s_before", "_s_n", "_s_bytes", "_s_rows", "_s_key", "_s_id")
    )
    return placed


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: the row's place in its shard. The first row of each shard (one number a shard) is sent to all."""
    placed = stash(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("_s_row").alias("_s_first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", (F.col("_s_row") - F.col("_s_first")).cast("long")).drop("_s_row", "_s_first")


def shard(docs: DataFrame, shards: int = 24, ranges: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot."""
    return with_slots(assign(docs, shards, ranges, columns=columns))


def write(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Writes a folder for each shard; its files hold slots in order, so that reading them by name gives the shard's order."""
    done = shard(docs, shards)
    done.repartitionByRange(max(shards, 1), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
