"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted shingles.

Words are lower-cased runs of letters and digits (ASCII punctuation separates). Items are put into classes by size; the
class gives the window's size, half to four fifths of the item (geometric classes, so that few sizes serve all items).
Every window of an item is indexed; a document's windows are taken at a stride so small that any passage of the item's size contains one of
them, aligned with a window of the item. A window's SimHash is the majority of its words' 64-bit hashes, from running
sums. Fingerprints are looked up by four blocks of 16 bits and their one-bit neighbours, which finds every fingerprint within
``RADIUS`` = 7 differing bits (one of four blocks then differs in at most one). A candidate aligns item and document; the
weighted Jaccard similarity of 5-word shingles (weight: mean rarity of the words among all items, counted once in Spark) at that place and
up to two words beside it (``SHIFTS``: an inserted or dropped word moves what follows it) decides, at 0.8.

A verbatim item is always found. A near copy is found if one of its windows stays within the radius, which is not guaranteed; a test
holds the operator against all documents, items and places and asks for nine tenths of the pairs at 0.8 or more.

The benchmark is read in blocks of at most about ``ITEMS`` items and ``ITEM_WORDS`` words, sent to the executors one block at a time,
against all documents. How it is cut makes no difference. No document is shuffled. A word's rarity comes from the items that hold a word of its counter, one of
``COUNTERS`` (a fixed number), so what all tasks share is bounded however large the benchmark is.

Defined results: rows have the columns of ``FOUND`` alone, ``clean`` keeps the columns of its table; null ids match like others; a null or empty text or item matches nothing; items with fewer than five words are one shingle; an
item found several times in a row's text gives its best place (first on ties); rows that repeat give rows that repeat; empty tables
give empty tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stash
from .words import WORD_HASHES

RADIUS, BLOCKS, SHINGLE, SIMILARITY = 7, 4, 5, 0.8
#: Items, and words of items, sent to the executors at once.
ITEMS, ITEM_WORDS = 20_000, 500_000
#: Counters of words, of a fixed number: words that share one have the frequency of both.
COUNTERS = 1 << 22
#: Words handled at once; longer texts are taken in overlapping parts.
WORDS = 100_000
#: Word offsets tried around the alignment that a window gives.
SHIFTS = (0, -1, 1, -2, 2)
FOUND = "doc_id bigint, item_id bigint, word_start bigint, n_words bigint, hamming int, similarity double"

_SEPARATORS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SEPARATORS).split() if text else []


def _runs(words: list[bytes], k: int) -> Iterator[tuple[bytes, ...]]:
    return zip(*(words[i:] for i in range(k)), strict=False)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))


def simhashes(hashes: np.ndarray, starts: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """The SimHash of the windows that begin at ``starts``."""
    sums = running(hashes, size) if sums is None else sums
    more = sums[starts + size] - sums[starts] > size // 2
    return np.packbits(more, axis=1).view(np.uint64).ravel()


def running(hashes: np.ndarray, largest: int) -> np.ndarray:
    """Running sums of the hashes' bits, modulo a power of two above ``largest``: their differences over a window are exact."""
    kind = np.uint8 if largest < 256 else np.uint16 if largest < 65536 else np.uint32
    out = np.zeros((len(hashes) + 1, 64), kind)
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    np.cumsum(bits, axis=0, dtype=kind, out=out[1:])
    return out


def window_size(m: int) -> int:
    """The class of an item of m words."""
    size = 4
    if 5 * size > 4 * m:
        return m
    while 5 * (size * 3 // 2) <= 4 * m:
        size = size * 3 // 2
    return size


@dataclass
class _Class:
    stride: int
    prints: np.ndarray  # fingerprints of all windows of the class's items
    item: np.ndarray
    offset: np.ndarray
    heads: list[np.ndarray]  # for each block: where the list of each 16-bit key begins
    lists: list[np.ndarray]


class Rarity(dict):
    """The logarithmic rarity of each word among all items; what a worker has looked up is remembered, within a bound."""

    def __init__(self, counters: np.ndarray, counts: np.ndarray, n: int) -> None:
        super().__init__()
        order = np.argsort(counters)
        self.counters, self.counts, self.n = counters[order], counts[order], n

    def __reduce__(self) -> tuple:
        return Rarity, (self.counters, self.counts, self.n)

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 100_000:
            self.clear()
        counter = WORD_HASHES[word] % COUNTERS
        at = int(np.searchsorted(self.counters, counter))
        seen = int(self.counts[at]) if at < len(self.counters) and self.counters[at] == counter else 1
        self[word] = value = float(np.log1p(self.n / seen))
        return value

    @classmethod
    def of(cls, texts: list[str | None]) -> Rarity:
        seen, n = Counter(), 0
        for text in texts:
            if words := words_of(text):
                seen.update({WORD_HASHES[w] % COUNTERS for w in set(words)})
                n += 1
        return cls(np.array(list(seen), np.int64), np.array(list(seen.values()), np.int64), n)


def rarity_of(benchmark: DataFrame) -> Rarity:
    """From all items, counted in Spark; at most ``COUNTERS`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = Rarity.of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([-1, *part.counters.tolist()], pa.int64()), pa.array([part.n, *part.counts.tolist()], pa.int64())], ["counter", "n"])

    counted = benchmark.select("text").mapInArrow(run, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counters, counts = counted.column("counter").to_numpy(), counted.column("n").to_numpy()
    return Rarity(counters[counters >= 0], counts[counters >= 0], int(counts[counters < 0].sum()))


class Index:
    """The fingerprints and shingles of a block of items; ``rarity`` is that of all items (of these alone, if it isn't given)."""

    def __init__(self, items: list[tuple[int | None, str | None]], rarity: Rarity | None = None) -> None:
        self.ids = [i for i, t in items if words_of(t)]
        words = [words_of(t) for _, t in items if words_of(t)]
        self.rarity = Rarity.of([t for _, t in items]) if rarity is None else rarity
        self.sizes = [len(ws) for ws in words]
        self.shingles = [self._shingles(ws) for ws in words]
        self.classes: dict[int, _Class] = {}
        groups: dict[int, list[int]] = {}
        for k, m in enumerate(self.sizes):
            groups.setdefault(window_size(m), []).append(k)
        for size, members in sorted(groups.items()):
            prints = [simhashes(hashes_of(words[k]), np.arange(self.sizes[k] - size + 1), size) for k in members]
            counts = [len(p) for p in prints]
            flat = np.concatenate(prints)
            heads, lists = [], []
            for b in range(BLOCKS):
                key = ((flat >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                near = np.concatenate([key, *(key ^ (1 << i) for i in range(16))])
                rows = np.tile(np.arange(len(flat)), 17)
                order = np.argsort(near, kind="stable")
                heads.append(np.searchsorted(near[order], np.arange(65537)))
                lists.append(rows[order].astype(np.int32))
            self.classes[size] = _Class(
                min(self.sizes[k] - size + 1 for k in members),
                flat,
                np.repeat(members, counts),
                np.concatenate([np.arange(c) for c in counts]),
                heads,
                lists,
            )

    def _shingles(self, words: list[bytes]) -> dict[tuple[bytes, ...], tuple[int, float]]:
        """Count and weight of each shingle."""
        k = min(SHINGLE, len(words))
        found = Counter(_runs(words, k))
        return {s: (c, sum(self.rarity[w] for w in s) / k) for s, c in found.items()}

    def similarity(self, item: int, words: list[bytes]) -> float:
        own = self.shingles[item]
        if not words or own.keys().isdisjoint(_runs(words, min(SHINGLE, len(words)))):
            return 0.0
        other = self._shingles(words)
        both = sum(min(c, own[s][0]) * w for s, (c, w) in other.items() if s in own)
        total = sum(c * w for c, w in own.values()) + sum(c * w for c, w in other.values())
        return both / (total - both)

    def _near(self, size: int, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, row of the class, differing bits) within the radius."""
        c = self.classes[size]
        for b in range(BLOCKS):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            head, count = c.heads[b][key], c.heads[b][key + 1] - c.heads[b][key]
            window = np.flatnonzero(count)
            if not len(window):
                continue
            count, head = count[window], head[window]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = c.lists[b][np.repeat(head, count) + step]
            window = np.repeat(window, count)
            bits = np.bitwise_count(prints[window] ^ c.prints[row])
            close = bits <= RADIUS
            yield window[close], row[close], bits[close]

    def _scan_part(self, docs: list[tuple[int, int, list[bytes]]], found: dict) -> None:
        """docs: (number, first word's place in its text, words)."""
        lengths = np.array([len(w) for _, _, w in docs])
        begins = np.cumsum(lengths) - lengths
        hashes = hashes_of([w for _, _, ws in docs for w in ws])
        sums = running(hashes, max(self.classes))
        for size, c in self.classes.items():
            per = np.where(lengths >= size, (lengths - size) // c.stride + 1, 0)
            which = np.repeat(np.arange(len(docs)), per)
            if not len(which):
                continue
            place = (np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)) * c.stride
            prints = simhashes(hashes, begins[which] + place, size, sums)
            for window, row, bits in self._near(size, prints):
                for w, r, b in zip(window.tolist(), row.tolist(), bits.tolist(), strict=True):
                    number, first, _ = docs[which[w]]
                    start = int(place[w]) + first - int(c.offset[r])
                    at = (number, int(c.item[r]), start)
                    found[at] = min(b, found.get(at, 99))

    def scan(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, int, float]]]:
        """For each text: (row of the item, word_start, n_words, hamming, similarity) of the items found in it. Some texts at a time."""
        for at in range(0, len(texts), 256):
            yield from self._scan(texts[at : at + 256])

    def _scan(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, float]]]:
        words = [words_of(t) for t in texts]
        overlap = max(self.sizes, default=1)
        found: dict[tuple[int, int, int], int] = {}
        part: list[tuple[int, int, list[bytes]]] = []
        waiting = 0
        for number, ws in enumerate(words):
            for first in range(0, max(1, len(ws) - overlap), WORDS):
                piece = ws[first : first + WORDS + overlap]
                part.append((number, first, piece))
                waiting += len(piece)
                if waiting >= WORDS:
                    self._scan_part(part, found)
                    part, waiting = [], 0
        if waiting:
            self._scan_part(part, found)
        best: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in texts]
        for (number, item, at), bits in sorted(found.items()):
            ws, m = words[number], self.sizes[item]
            for shift in SHIFTS:
                start = max(0, at + shift)
                similar = self.similarity(item, ws[start : max(0, at + shift + m)])
                if similar >= SIMILARITY and similar > best[number].get(item, (0.0,))[0]:
                    best[number][item] = (similar, start, min(len(ws), at + shift + m) - start, bits)
                if similar >= 1 or (shift == 0 and similar == 0):
                    break
        return [[(i, s, n, b, sim) for i, (sim, s, n, b) in sorted(x.items())] for x in best]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks; an item without words is in none."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, words = rows.agg(F.count("*"), F.sum(F.size(F.split("text", r"\s+")))).first()
    blocks = max(-(-n // ITEMS), -(-(words or 0) // ITEM_WORDS))
    rarity = rarity_of(rows)
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = Index(sorted(((r[0], r[1]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), rarity)
        if index.ids:
            yield index


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, word_start, n_words, hamming, similarity."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts, shared = [spark.createDataFrame([], FOUND)], None
    for index in indexes(benchmark):
        if shared is not None:  # a block's index is given up before the next one is sent
            parts[-1] = stash(parts[-1], "hits")
            shared.destroy()
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                hits = own.scan(batch.column("text").to_pylist())
                flat = [
                    (doc, own.ids[i], s, n, b, sim)
                    for doc, found in zip(batch.column("doc_id").to_pylist(), hits, strict=True)
                    for i, s, n, b, sim in found
                ]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "word_start", "n_words", "hamming", "similarity"), x, strict=True)) for x in flat],
                    pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("word_start", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32()), ("similarity", pa.float64())]),
                )

        parts.append(rows.mapInArrow(run, FOUND))
    return reduce(DataFrame.unionByName, parts)


def _holds(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def holds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series([bool(x) for x in shared.value.scan(text.tolist())], dtype=bool)
        release()

    return holds


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    for index in indexes(benchmark):
        docs = docs.where(~_holds(docs.sparkSession.sparkContext.broadcast(index))(F.coalesce("text", F.lit(""))))
    return docs
