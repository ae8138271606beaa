"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of ``length`` bytes that starts at two places is found, and each byte that one covers goes. Only some suffixes are
indexed: those at anchors, the least of the hashes of ``gram`` bytes within any ``length`` bytes. Equal strings
have their anchors at the same offsets, so two places with an equal string have an equal entry in the arrays.

An entry has the hash of the suffix's first ``gram`` bytes (its order in the array) and the hash of its context, the bytes that any string with
this anchor can reach. A new batch of documents becomes an array sorted by the first, dealt by both, so that an entry with very many contexts
is in no single task; it is merge-scanned against every level of the family for entries in common, and levels of equal size are
merged, so that each entry is rewritten a logarithmic number of times. There are as many batches as the bytes ask for, and at least ``BATCHES``;
which batch a document is in changes no result.

What the scans find is then settled exactly. A context that occurs twice repeats whole. Other contexts of one entry are compared by their
strings of ``length`` bytes: the first and the last one that another context has at the same offset bound what is
removed around the anchor (all of them contain it). Lists of more than ``LIST`` contexts are dealt to groups of about that many by
the hash of the context, so no task holds a list, also if all of it shares one string; strings of several groups meet in counts.
The work grows with the bytes, not with the pairs.

Spans are kept by the text's hash and size, not by row: rows with equal texts are each other's repeats.

Defined results: a null text counts as an empty one; texts shorter than ``length`` stay whole; rows that repeat lose
everything if they are long enough; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .common import drop, in_parts, stash, whole_text

#: Contexts of one entry that one task compares at most; contexts of short lists that are compared at once, about.
LIST, TOGETHER = 16_384, 2048
#: Bytes of text in a batch, about, and the least number of batches.
BATCH_BYTES, BATCHES = 4 << 40, 4
#: Bytes hashed at once; longer texts are taken in overlapping parts.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Repeats:
    length: int = 200
    gram: int = 64

    @property
    def reach(self) -> int:
        """How far before its anchor a string may start."""
        return self.length - self.gram


class _Powers:
    """Powers of the base and of its inverse, modulo 2^64, for running sums over a part."""

    def __init__(self) -> None:
        n = 1 << 12
        self.up, self.down = self._table(_BASE, n), self._table(pow(_BASE, -1, 1 << 64), n)
        self.bytes = np.random.default_rng(64).integers(0, 1 << 64, 256, np.uint64)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = self._table(_BASE, size), self._table(pow(_BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums (rows of a matrix each on their own) from which any substring's hash follows."""
    up, _ = _POWERS.to(data.shape[-1])
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum(_POWERS.bytes[data] * up, axis=-1, out=out[..., 1:])
    return out


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """The hash of each substring of ``size`` bytes."""
    n = sums.shape[-1] - size
    _, down = _POWERS.to(n)
    h = (sums[..., size:] - sums[..., :n]) * down
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xFF51AFD7ED558CCD)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = pick(out[:-rest], out[rest:])
    return out


def _anchors(data: np.ndarray, r: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, entry hashes and running sums of one part of at least ``length`` bytes."""
    sums = _sums(data)
    grams = _hashes(sums, r.gram)
    rank = (grams >> np.uint64(32)).astype(np.uint32)
    width = r.reach + 1
    least = _sliding(rank, width, np.minimum)
    # a place is chosen if it is the least of some window: then the greatest of its windows' least ones is its own
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == rank)
    return at, grams[at], sums


def entries(raw: bytes, r: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, entry hashes and context hashes of a text's anchors."""
    n = len(raw)
    if n < r.length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data, found = np.frombuffer(raw, np.uint8), []
    around = 2 * r.length
    for first in range(0, n, PART):
        lo, hi = max(0, first - around), min(n, first + PART + around)
        if hi - lo < r.length:
            continue
        at, h, sums = _anchors(data[lo:hi], r)
        own = (at + lo >= first) & (at + lo < first + PART)
        at, h = at[own], h[own]  # every string with one of these is inside the part
        a, b = np.maximum(at - r.reach, 0), np.minimum(at + r.length, hi - lo)
        _, down = _POWERS.to(hi - lo + 1)
        c = (sums[b] - sums[a]) * down[a]
        # the context's shape tells a text's beginning or end from bytes that go on
        c = (c ^ (c >> np.uint64(31))) * np.uint64(0xC4CEB9FE1A85EC53) + ((at - a) * 4096 + (b - at)).astype(np.uint64)
        found.append((at + lo, h, c))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


ENTRY = "batch int, h bigint, c bigint, th bigint, n bigint, pos bigint"


def index_entries(docs: DataFrame, r: Repeats, batches: int) -> DataFrame:
    """An entry for each anchor of each row; a batch takes whole partitions of the input, so that a task writes to one batch."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(source):
            texts, hashes, slices = part.column("text").to_pylist(), part.column("th").to_numpy(), part.column("slice").to_numpy()
            raws = [t.encode("utf-8", "surrogatepass") for t in texts]
            made = [entries(raw, r) for raw in raws]
            counts = [len(m[0]) for m in made]
            if not sum(counts):
                continue
            th = np.repeat(hashes, counts)
            at, h, c = (np.concatenate(x) for x in zip(*made, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(slices % batches, counts).astype(np.int32)),
                    pa.array(h.view(np.int64)),
                    pa.array(c.view(np.int64)),
                    pa.array(th),
                    pa.array(np.repeat(np.array([len(x) for x in raws], np.int64), counts)),
                    pa.array(at.astype(np.int64)),
                ],
                ["batch", "h", "c", "th", "n", "pos"],
            )

    text = whole_text()
    return docs.select(F.xxhash64(text).alias("th"), text.alias("text"), F.spark_partition_id().alias("slice")).mapInArrow(run, ENTRY)


def batches_for(docs: DataFrame) -> int:
    """How many batches the bytes of the texts ask for."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(BATCHES, -(-size // BATCH_BYTES))


def as_array(batch: DataFrame) -> DataFrame:
    """The suffix array of a batch: (h, c, k); k counts the entries with this context."""
    return batch.groupBy("h", "c").agg(F.count("*").alias("k"))


def _in_order(array: DataFrame) -> DataFrame:
    """An array as a table, each part in order. It has just been gathered by (h, c) and is dealt no other way: the contexts of a common entry lie apart."""
    return stash(array.sortWithinPartitions("h", "c"), "array")


@dataclass
class Family:
    """Level i is empty or the array of 2^i batches. ``found`` has the entry hashes that occurred twice."""

    levels: list[DataFrame | None] = field(default_factory=list)
    found: list[DataFrame] = field(default_factory=list)

    def add(self, array: DataFrame) -> None:
        """Scans a new batch's array against itself and all levels, then merges levels of equal size."""
        array = _in_order(array)
        # one scan of the batch and all levels: rows of an entry meet in partial sums, not in one task
        both = array.select("h", "k", F.lit(False).alias("old"))
        for level in self.levels:
            if level is not None:
                both = both.unionByName(level.select("h", F.lit(0).cast("long").alias("k"), F.lit(True).alias("old")))
        here = both.groupBy("h").agg(F.sum("k").alias("k"), F.bool_or("old").alias("old"))
        self.found.append(stash(here.where("k > 1 or (k = 1 and old)").select("h"), "found"))
        at = 0
        while at < len(self.levels) and (level := self.levels[at]) is not None:
            merged = level.unionByName(array).groupBy("h", "c").agg(F.sum("k").alias("k"))
            old = array
            array = _in_order(merged)
            drop(array.sparkSession, old, level)
            self.levels[at] = None
            at += 1
        self.levels += [None] * (at + 1 - len(self.levels))
        self.levels[at] = array

    def repeated(self) -> DataFrame:
        """(h, c, k) of the entries whose h was found twice."""
        found = self.found[0]
        for x in self.found[1:]:
            found = found.unionByName(x)
        arrays, *others = [x for x in self.levels if x is not None]
        for x in others:
            arrays = arrays.unionByName(x)
        out = arrays.join(stash(found.distinct(), "found"), "h", "left_semi")
        return out.groupBy("h", "c").agg(F.sum("k").alias("k")) if others else out

    def drop(self) -> None:
        """Deletes the family's tables."""
        for x in [*self.levels, *self.found]:
            if x is not None:
                drop(x.sparkSession, x)


def _strings(contexts: list[bytes], r: Repeats) -> np.ndarray:
    """The hash of each string of ``length`` bytes of each context (0 beyond its end)."""
    width = r.reach + r.length
    out = np.zeros((len(contexts), r.reach + 1), np.uint64)
    for at in range(0, len(contexts), TOGETHER):
        part = contexts[at : at + TOGETHER]
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        out[at : at + TOGETHER] = _hashes(_sums(data), r.length)[:, : r.reach + 1]
    sizes = np.array([len(x) for x in contexts])
    out[np.arange(r.reach + 1) > (sizes - r.length)[:, None]] = 0
    return out


def _settle(key: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each row whose key another row has too (first above last: none)."""
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[back] > 1
    first, last = np.full(rows, 1 << 30), np.full(rows, -1)
    np.minimum.at(first, row[twice], place[twice])
    np.maximum.at(last, row[twice], place[twice])
    return first, last


SETTLED = "h bigint, c bigint, first int, last int"


def _from_lists(contexts: DataFrame, r: Repeats) -> DataFrame:
    """Settles lists that are whole in a partition and in order of h."""

    def flush(h: np.ndarray, c: np.ndarray, left: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        strings = _strings(raw, r)
        row, place = np.nonzero(strings)
        offset = (left[row] - place).astype(np.uint64)  # of the anchor in the string
        mixed = (strings[row, place] ^ (h[row].view(np.uint64) * np.uint64(_BASE))) + offset * np.uint64(0xC4CEB9FE1A85EC53)
        first, last = _settle(mixed, row, place, len(raw))
        some = last >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(h[some]), pa.array(c[some]), pa.array(first[some].astype(np.int32)), pa.array(last[some].astype(np.int32))],
            ["h", "c", "first", "last"],
        )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[int, int], tuple[int, bytes]] = {}
        current = None
        for batch in source:
            for h, c, left, raw in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "left", "raw")), strict=True):
                if h != current and len(rows) >= min(LIST, TOGETHER):
                    yield flush(*_columns(rows))
                    rows = {}
                current = h
                rows[h, c] = (left, raw)
        if rows:
            yield flush(*_columns(rows))

    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, SETTLED)


def _columns(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    keys = np.array(list(rows), np.int64).reshape(-1, 2)
    return keys[:, 0].copy(), keys[:, 1].copy(), np.array([x for x, _ in rows.values()]), [x for _, x in rows.values()]


def _from_long_lists(contexts: DataFrame, r: Repeats) -> DataFrame:
    """Settles lists of any size: their contexts are dealt to groups of about ``LIST``, whatever strings they share.

    A string that two contexts of a group have is settled there. A group then tells each of its strings once, so that the strings
    of different groups meet in counts, and only the strings that could widen what a context has are looked up in them.
    """

    def flush(h: int, rows: dict[int, tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        strings = _strings([x for _, x in rows.values()], r)
        row, place = np.nonzero(strings)
        offset = (np.array([x for x, _ in rows.values()])[row] - place).astype(np.uint64)
        key = (strings[row, place] ^ np.uint64(h * _BASE % (1 << 64))) + offset * np.uint64(0xC4CEB9FE1A85EC53)
        first, last = _settle(key, row, place, len(rows))
        c = np.array(list(rows), np.int64)
        some = np.flatnonzero(last >= 0)
        yield told(h, c[some], None, first[some], last[some])
        told_key, at, count = np.unique(key, return_index=True, return_counts=True)
        open_ = (count == 1) & ((place[at] < first[row[at]]) | (place[at] > last[row[at]]))
        for mine in (True, False):
            keys, at_ = told_key[open_ == mine], at[open_ == mine]
            for k in range(0, len(keys), 1 << 16):
                part = at_[k : k + (1 << 16)]
                yield told(h, c[row[part]] if mine else None, keys[k : k + (1 << 16)], place[part], place[part])

    def told(h: int, c: np.ndarray | None, key: np.ndarray | None, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        n = len(first)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, h, np.int64)),
                pa.nulls(n, pa.int64()) if c is None else pa.array(c),
                pa.nulls(n, pa.int64()) if key is None else pa.array(key.view(np.int64)),
                pa.array(first.astype(np.int32)),
                pa.array(last.astype(np.int32)),
            ],
            ["h", "c", "key", "first", "last"],
        )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, {}
        for batch in source:
            for h, share, c, left, raw in zip(*(batch.column(k).to_pylist() for k in ("h", "share", "c", "left", "raw")), strict=True):
                if (h, share) != current:
                    if rows:
                        yield from flush(current[0], rows)
                    current, rows = (h, share), {}
                rows[c] = (left, raw)
        if rows:
            yield from flush(current[0], rows)

    dealt = contexts.withColumn("share", F.pmod(F.xxhash64("c"), "parts")).drop("parts")
    dealt = dealt.repartition("h", "share").sortWithinPartitions("h", "share")
    strings = stash(dealt.mapInArrow(run, "h bigint, c bigint, key bigint, first int, last int"), "strings")
    common = strings.where("key is not null").groupBy("key").agg(F.count("*").alias("groups")).where("groups > 1").select("key")
    wider = strings.where("key is not null and c is not null").join(common, "key").select("h", "c", "first", "last")
    settled = strings.where("key is null").select("h", "c", "first", "last").unionByName(wider)
    settled = stash(settled.groupBy("h", "c").agg(F.min("first").alias("first"), F.max("last").alias("last")), "long")
    drop(contexts.sparkSession, strings)
    return settled


def _per_text(rows: DataFrame, *columns: str, merge: bool = False) -> DataFrame:
    """One row for each (th, n) with the array ``at`` of its structs, merged into runs if they are intervals.

    Broadcast only if its rows and elements are counted within the bound.
    """
    grouped = rows.groupBy("th", "n").agg(F.array_sort(F.collect_set(F.struct(*columns))).alias("at"))
    if merge:
        grouped = grouped.mapInArrow(_merged, grouped.schema)
    grouped = stash(grouped, "texts")
    total = grouped.agg(F.count("*"), F.sum(F.size("at"))).first()
    return F.broadcast(grouped) if total[0] <= common.BROADCAST_ROWS and (total[1] or 0) <= 4 * common.BROADCAST_ROWS else grouped


def _merged(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        runs = [[{"lo": a, "hi": b} for a, b in _runs(at)] for at in batch.column("at").to_pylist()]
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("th"), batch.column("n"), pa.array(runs, kind)], ["th", "n", "at"])


def _with_texts(docs: DataFrame, per_text: DataFrame, how: str) -> DataFrame:
    """``docs`` (columns prefixed ``_d``) joined to the arrays of their texts."""
    text = whole_text()
    side = per_text.withColumnsRenamed({"th": "_th", "n": "_n", "at": "_at"})
    return docs.join(side, (F.xxhash64(text) == F.col("_th")) & (F.octet_length(text) == F.col("_n")), how)


def _contexts(docs: DataFrame, wanted: DataFrame, r: Repeats) -> DataFrame:
    """(h, c, parts, left, raw) of the wanted contexts, read from the texts."""
    per_text = _per_text(wanted, "pos", "h", "c", "parts")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in in_parts(source):
            out = []
            for th, text, at in zip(*(batch.column(k).to_pylist() for k in ("_th", "text", "_at")), strict=True):
                if th in done:  # a copy
                    continue
                if len(done) > 100_000:
                    done.clear()
                done.add(th)
                raw = text.encode("utf-8", "surrogatepass")
                for x in at:
                    lo = max(0, x["pos"] - r.reach)
                    out.append((x["h"], x["c"], x["parts"], x["pos"] - lo, raw[lo : x["pos"] + r.length]))
            for k in range(0, len(out), 8192):
                columns = zip(*out[k : k + 8192], strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["h", "c", "parts", "left", "raw"])

    rows = _with_texts(docs, per_text, "inner").select("_th", whole_text().alias("text"), "_at")
    return rows.mapInArrow(run, "h bigint, c bigint, parts bigint, left bigint, raw binary")


def by_batch(entries: DataFrame) -> DataFrame:
    """Entries as a table in which each batch has its own files, so that it is read alone."""
    spark, path = entries.sparkSession, common.scratch(entries.sparkSession, "entries")
    entries.write.partitionBy("batch").parquet(path)
    return spark.read.schema(entries.schema).parquet(path)


def spans(docs: DataFrame, r: Repeats = Repeats(), batches: int | None = None) -> DataFrame:
    """(th, n, at): for each text, by hash and size, the byte intervals (lo, hi) to remove. ``batches``: else as many as the bytes ask for."""
    batches = batches or batches_for(docs)
    index = by_batch(index_entries(docs, r, batches))
    family = Family()
    for batch in range(batches):
        family.add(as_array(index.where(F.col("batch") == batch)))
    folded = stash(family.repeated(), "folded")
    family.drop()
    lists = folded.groupBy("h").agg(F.count("*").alias("contexts"), F.min("k").alias("least"))
    hits = index.join(folded, ["h", "c"])
    left, right = F.least(F.col("pos"), F.lit(r.reach)), F.least(F.col("n") - F.col("pos"), F.lit(r.length))
    hits = stash(hits.where(left + right >= r.length).select("h", "c", "th", "n", "pos", "k"), "hits")
    lists = stash(lists, "lists")

    drop(docs.sparkSession, index, folded)
    # lists in which every context repeats whole are settled
    several = lists.where("contexts > 1 and least = 1").select("h", F.ceil(F.col("contexts") / LIST).cast("long").alias("parts"))
    wanted = hits.groupBy("h", "c").agg(F.min(F.struct("th", "n", "pos")).alias("x")).join(several, "h")
    contexts = stash(_contexts(docs, wanted.select("h", "c", "parts", "x.*"), r), "contexts")
    short = _from_lists(contexts.where("parts = 1").drop("parts"), r)
    long = _from_long_lists(contexts.where("parts > 1"), r)
    settled = stash(short.unionByName(long).distinct(), "settled")
    drop(docs.sparkSession, contexts)

    whole = hits.where("k > 1").select("th", "n", (F.col("pos") - left).alias("lo"), (F.col("pos") + right).alias("hi"))
    parts = (
        hits.where("k = 1")
        .join(settled, ["h", "c"])
        .select("th", "n", (F.col("pos") - left + F.col("first")).alias("lo"), (F.col("pos") - left + F.col("last") + r.length).alias("hi"))
    )
    return _per_text(whole.unionByName(parts).distinct(), "lo", "hi", merge=True)


def _runs(at: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping or touching intervals as maximal runs."""
    out: list[tuple[int, int]] = []
    for x in at or ():
        if out and x["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["hi"]))
        else:
            out.append((x["lo"], x["hi"]))
    return out


#: What ``remove`` adds; a column of such a name is replaced.
RESULT = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_text": "string"}


def remove(docs: DataFrame, r: Repeats = Repeats(), batches: int | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans (long), kept_sha256 and kept_text (a character that lost a byte goes whole)."""
    text = whole_text()
    rows = _with_texts(docs, spans(docs, r, batches), "left").withColumn("_text", text).drop("_th", "_n", *RESULT)
    schema = StructType([f for f in rows.schema.fields if f.name not in ("_text", "_at")])
    for name, kind in RESULT.items():
        schema = schema.add(name, kind)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(source):
            made = []
            for text, at in zip(batch.column("_text").to_pylist(), batch.column("_at").to_pylist(), strict=True):
                raw, runs = text.encode("utf-8", "surrogatepass"), _runs(at)
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else raw
                made.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if runs else text))
            columns = list(zip(*made, strict=True)) if made else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            passed = batch.drop_columns(["_text", "_at"])
            yield pa.RecordBatch.from_arrays(
                [*passed.columns, *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))],
                [*passed.schema.names, *RESULT],
            )

    return rows.mapInArrow(run, schema)


def clean(docs: DataFrame, r: Repeats = Repeats(), batches: int | None = None) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the text; n_chars follows; a text that loses nothing stays as it is."""
    done = remove(docs, r, batches).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
