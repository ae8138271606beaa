"""Packing along a space-filling curve: documents with like words share sequences, and nothing is padded but the last.

A document's ids are counted in ``DIMENSIONS`` hashed bins (square roots of the counts, length 1), projected to three
fixed directions, brought to 10 bits each by the normal distribution and turned into a Hilbert key. Keys are
range-sorted by sampled splitters, into ranges of about ``RANGE_BYTES`` of ids; the documents in that order are one stream of ids,
cut every ``length`` ids.
Neighbours on the curve therefore share sequences, and only the last sequence has padding.

Defined results: a null text is an empty one and has just the end id; documents of one key are ordered by doc_id (null first)
and a digest of their ids, so rows that repeat follow one another; an empty table gives no pieces. Only doc_id passes through.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, stash, whole_text
from .sharding import _quantiles, _range_of, _sample
from .tokens import encoder, id_width

DIMENSIONS, AXES, BITS = 1024, 3, 10
#: Bytes of ids that a range, and so a task, has on average; sampled keys on average for each range, where they are many in all.
RANGE_BYTES, LEAST_SAMPLE, SAMPLE = 64 << 20, 4, 1_000_000


def directions() -> np.ndarray:
    """The projection: fixed pseudo-random directions."""
    return np.random.default_rng(20_24).standard_normal((DIMENSIONS, AXES))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of integer points (rows) on the Hilbert curve of their cube, by Gray-code unwinding of each bit plane."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(documents: list[np.ndarray], axes: np.ndarray) -> np.ndarray:
    """The Hilbert key of each id array."""
    if not documents:
        return np.zeros(0, np.int64)
    vectors = np.empty((len(documents), DIMENSIONS))
    for row, ids in zip(vectors, documents, strict=True):
        row[:] = np.bincount((ids.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(22), minlength=DIMENSIONS)
    np.sqrt(vectors, out=vectors)
    placed = (vectors @ axes) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    share = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in placed.ravel()]).reshape(placed.shape)
    return hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenized(docs: DataFrame, tokenizer: str, end: int, width: str) -> DataFrame:
    """doc_id, ids (binary), size (ids with the end id), _s_key (Hilbert key), _s_id, crc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, axes = encoder(tokenizer), directions()
        for batch in in_parts(batches, 256):
            made = code.batches(batch.column("text").to_pylist())
            arrays = [np.append(np.frombuffer(x, "<u4"), np.uint32(end)) for x in made]
            packed = [a.astype(width).tobytes() for a in arrays]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(packed, pa.binary()),
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array(curve_keys(arrays, axes), pa.int64()),
                    pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                ],
                ["doc_id", "ids", "size", "_s_key", "crc"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary, size bigint, _s_key bigint, crc bigint").withColumn(
        "_s_id", F.coalesce("doc_id", F.lit(-(2**63)))
    )


def pack(
    docs: DataFrame, tokenizer: str, end: int, length: int = 1024, ranges: int | None = None, per_range: int = 24, width: str | None = None
) -> DataFrame:
    """The pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``ranges``: by default as many as the session's shuffle partitions, or more so that none has more than ``RANGE_BYTES``
    on average. ``width``: of stored ids, by default from the tokenizer's vocabulary.
    """
    width = width or id_width(tokenizer, end)
    rows = stash(tokenized(docs, tokenizer, end, width), "ids")
    if ranges is None:
        size = (rows.agg(F.sum("size")).first()[0] or 0) * int(width[-1])
        ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    per_range = max(LEAST_SAMPLE, min(per_range, SAMPLE // ranges))
    splitters = _quantiles(_sample(rows, ranges * per_range), ranges)
    ranged = rows.withColumn("_s_range", _range_of(splitters))
    sums = {r["_s_range"]: r["b"] for r in ranged.groupBy("_s_range").agg(F.sum("size").alias("b")).collect()}
    bases, total = [], 0
    for r in range(len(splitters) + 1):
        bases.append(total)
        total += sums.get(r, 0)
    # a range is whole in one partition, in order
    placed = ranged.repartitionById(len(splitters) + 1, "_s_range").sortWithinPartitions("_s_range", "_s_key", "_s_id", "crc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        at, last = 0, None
        for whole in batches:
            out: list[tuple] = []
            for doc, packed, part in zip(*(whole.column(c).to_pylist() for c in ("doc_id", "ids", "_s_range")), strict=True):
                if part != last:
                    at, last = bases[part], part
                ids = np.frombuffer(packed, width)
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, length)
                    stop = min(len(ids), start + length - offset)
                    out.append((doc, start, stop - start, ids[start:stop].astype("<u4").tobytes(), len(ids), sequence, offset))
                    start = stop
                at += len(ids)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return placed.select("doc_id", "ids", "_s_range").mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, length: int = 1024, pad: int = 0) -> DataFrame:
    """sequence_id and its ids, padded to ``length``: the pieces of a sequence are at most ``length`` rows."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.concat_ws("", F.transform(parts, F.hex)).alias("h"))
    filler = F.repeat(F.lit(pad.to_bytes(4, "little").hex()), (length - F.col("n")).cast("int"))
    return joined.select("sequence_id", F.col("n").alias("n_ids"), F.unhex(F.concat("h", filler)).alias("ids"))
