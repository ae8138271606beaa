"""Exact Jaccard join of word n-gram sets, with skipping by set relations, and the groups its links form.

A text's set has its distinct n-word shingles, hashed to 64 bits. Equal sets are one class with one answer. Shingles are
ordered rare to common (a count sketch of all texts, of fixed size, gives the order; any order is exact), so two sets that link share one
of their first |x| - ceil(t |x|) + 1 shingles: only those are indexed, and only of sets that a different set can link with.

Skipping, after the work on set relations in similarity joins:

* an index list is cut into blocks by size band and position. A posting is late if fewer shingles follow it than a set of the same
  size needs; two late ones never link, and a late one only meets smaller sets, so blocks are skipped whole before any pair is made;
* each band of a list has a leader, the set in which the shingle stands first: the one with the fewest shingles of its own. The
  band's sets are first compared with it alone. A set that links with its leader takes over its answer (the group); lists whose sets
  all have one answer by then are skipped whole;
* in the other lists only sets outside the list's largest group are looked up, only against sets of other groups, and what is known of
  both and their leader answers for them where it can: they share at most what x shares with the leader and what y has besides it;
* a pair that met at the indexed shingle before in both sets isn't made again, and is looked at in full only if the sets' bitmaps leave a
  link possible: each shingle flips a bit, so sets differ in at least as many shingles as their bitmaps in bits;
* where sets outside still stand against large groups, they are first compared with growing numbers of representatives, so that
  most join before all members are looked at.

So groups of near copies cost work in proportion to their size, no pair within a found group is looked at, and no link that
joins two groups is lost: for each linked pair with different groups, the block of its first shared shingle yields it.

Groups come from contraction of forests within partitions and then alternating large-star and small-star steps; links stay in tables.

Defined results: null or empty texts and texts without words have an empty set and link with nothing; a text of fewer than n words
is one shingle; null doc_ids take part but never name a group unless nothing else does (the group's name is null then);
rows that repeat are in one group; empty tables give empty tables; further columns pass through ``keep_one``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, in_parts, small, stash, whole_text
from .words import WORD_HASHES

#: Counters of the sketch, in chunks; its size is fixed, whatever the input.
SKETCH_BITS, CHUNK_BITS = 20, 16


@dataclass(frozen=True)
class Join:
    """n-word shingles; sets link when ``per * intersection >= share * union``."""

    n: int = 5
    share: int = 80
    per: int = 100


_ODD, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : len(words) - k + 1 + i]) * _ODD
        out ^= out >> np.uint64(29)
    out *= _FINAL
    return np.unique(out ^ (out >> np.uint64(32)))


def bitmap(values: np.ndarray) -> bytes:
    """A bitmap with two to four bits for each shingle, in which a shingle flips the bit of its hash."""
    width = 1 << max(6, (2 * len(values) - 1).bit_length())
    flips = np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """The bits in which two bitmaps differ; the wider one is folded to the other's width."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_id(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def scan(docs: DataFrame, join: Join) -> DataFrame:
    """One reading of the texts: rows (doc_id, th, id, n, bits) and the parts of the sketch (chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
        for batch in in_parts(batches):
            sets = [shingles(t, join.n) for t in batch.column("text").to_pylist()]
            np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                schema=schema,
            )
        size = 1 << CHUNK_BITS
        for chunk in range(1 << (SKETCH_BITS - CHUNK_BITS)):
            part = counts[chunk * size : (chunk + 1) * size]
            if part.any():
                packed = zlib.compress(part.astype(np.min_scalar_type(int(part.max()))).tobytes(), 1)
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "counts": packed}], schema)

    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, th bigint, id bigint, n bigint, bits binary, chunk int, counts binary")


def _added(parts: DataFrame) -> DataFrame:
    """Adds up the counters that meet in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, sums = 1 << CHUNK_BITS, {}
        for batch in batches:
            for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                part = np.frombuffer(raw, f"<u{len(raw) // size}").astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, part in sums.items():
            packed = zlib.compress(part.astype(np.min_scalar_type(int(part.max()))).tobytes(), 1)
            yield pa.RecordBatch.from_pylist([{"chunk": chunk, "counts": packed}], pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    return parts.mapInArrow(run, "chunk int, counts binary")


def rarity(parts: DataFrame) -> np.ndarray:
    """For each counter 0 if its count is ordinary, else the binary logarithm of how far it is above the mean."""
    chunks = 1 << (SKETCH_BITS - CHUNK_BITS)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(8)))
    once = _added(salted.repartition(4 * chunks, "chunk", "salt").select("chunk", "counts"))
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in _added(once.repartition(chunks, "chunk")).collect():
        raw, size = zlib.decompress(r["counts"]), 1 << CHUNK_BITS
        counts[r["chunk"] * size : (r["chunk"] + 1) * size] += np.frombuffer(raw, f"<u{len(raw) // size}").astype(np.int64)
    mean = max(1.0, counts.mean())
    # counts within a few deviations of the mean differ by chance
    above = (counts - mean) / (4 * np.sqrt(mean) + 4)
    return np.where(above >= 1, np.log2(np.maximum(above, 1)) + 1, 0).astype(np.uint8)


def _prefix(values: np.ndarray, classes: np.ndarray, join: Join) -> np.ndarray:
    order = np.lexsort((values, classes[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
    n = len(values)
    return values[order[: n - -(-join.share * n // join.per) + 1]]


def postings(docs: DataFrame, join: Join, classes: np.ndarray) -> DataFrame:
    """(token, id, size, pos) of the prefixes.

    Sets too small to link with any but themselves have none: the nearest other set has one shingle more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, last = shared.value, set()
        for part in in_parts(batches):
            sets = [shingles(t, join.n) for t in part.column("text").to_pylist()]
            found = {set_id(s): s for s in sets if join.per * len(s) >= join.share * (len(s) + 1)}
            ids = [i for i in found if i not in last]  # copies nearby need no second posting
            last = set(found)
            if not ids:
                continue
            parts = [_prefix(found[i], rank, join) for i in ids]
            sizes = [len(p) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(parts).view(np.int64)),
                    pa.array(np.repeat(np.array(ids, np.int64), sizes)),
                    pa.array(np.repeat(np.array([len(found[i]) for i in ids], np.int32), sizes)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])),
                ],
                ["token", "id", "size", "pos"],
            )

    return docs.select(whole_text().alias("text")).mapInArrow(run, "token bigint, id bigint, size int, pos int")


def sets_of(docs: DataFrame, join: Join, texts: DataFrame) -> DataFrame:
    """(id, set): the shingle hashes, packed, of one text of each wanted set; ``texts`` has their hashes (th)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part in in_parts(batches):
            sets = (shingles(t, join.n) for t in part.column("text").to_pylist())
            found = {i: s.tobytes() for s in sets if (i := set_id(s)) not in done}
            done = set(found) | (done if len(done) < 100_000 else set())  # copies nearby
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["id", "set"])

    text = whole_text()
    wanted = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).join(small(texts), "th", "left_semi")
    return stash(wanted.select("text").mapInArrow(run, "id bigint, set binary").dropDuplicates(["id"]), "packed")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, join: Join) -> DataFrame:
    """(a, b, both, linked): how many shingles each pair shares. Only sets that stand in a pair are read from the texts, each once."""
    pairs = stash(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = rows.where("n > 0").groupBy("id").agg(F.min("th").alias("th")).join(ids, "id", "left_semi").select("th")
    sets = sets_of(docs, join, stash(texts, "texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked = [], []
            last, first = None, np.zeros(0, np.uint64)
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                raw = x.as_buffer()
                if last is None or raw != last:  # pairs of one leader follow one another
                    last, first = raw, np.frombuffer(raw, np.uint64)
                second = np.frombuffer(y.as_buffer(), np.uint64)
                place = np.searchsorted(first, second)
                both.append(int((first[np.minimum(place, len(first) - 1)] == second).sum()))
                linked.append(join.per * both[-1] >= join.share * (len(first) + len(second) - both[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int32()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"]
            )

    right = pairs.join(sets.withColumnsRenamed({"id": "b", "set": "set_b"}), "b")
    both = right.join(sets.withColumnsRenamed({"id": "a", "set": "set_a"}), "a")
    out = stash(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, both int, linked boolean"), "links")
    drop(docs.sparkSession, sets, pairs)
    return out


def _forest(links: DataFrame) -> DataFrame:
    """Links with the same groups as those of each partition, every node linked to the smallest it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = [x for x in root if top(x) != x]
        for at in range(0, len(nodes), 65_536):
            part = nodes[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(x) for x in part], pa.int64())], ["a", "b"])

    return links.mapInArrow(run, "a bigint, b bigint")


def groups(links: DataFrame) -> DataFrame:
    """(id, group) of every linked node but the group's smallest, whose id names it."""
    star = stash(_forest(links), "forest").distinct()
    while True:
        # large star: each larger neighbour goes to the smallest one
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node and its smaller neighbours go to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        links = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = stash(links.distinct(), "star")
        # done when every node has one link, to a node that has none of its own
        many = new.groupBy("a").agg(F.count("*").alias("c")).where("c > 1")
        chained = new.join(new.select(F.col("a").alias("b")), "b", "left_semi")
        if new.isEmpty() or (many.isEmpty() and chained.isEmpty()):
            return new.select(F.col("a").alias("id"), F.col("b").alias("group"))
        star = new


def _needed(x: str, y: str, join: Join) -> str:
    """Shingles that sets of these sizes must share to link."""
    return f"ceil({join.share} * cast({x} + {y} as bigint) / {join.per + join.share})"


def _fit(join: Join, y_size: str = "y.size", y_pos: str = "y.pos") -> str:
    """Postings x and y: sizes can link, and enough shingles follow both positions."""
    sizes = f"least(x.size, {y_size}) * {join.per} >= greatest(x.size, {y_size}) * {join.share}"
    return f"{sizes} and least(x.size - x.pos, {y_size} - {y_pos}) >= {_needed('x.size', y_size, join)}"


def blocked(posted: DataFrame, join: Join) -> DataFrame:
    """The postings of lists that aren't one posting, with band, late, prev, and the leader of their band (lead, lead_size, lead_pos).

    A band is 1 / t times the band before: sets that link are in the same band or neighbours. ``late``: fewer shingles
    follow than the overlap that two sets of this size need. ``prev``: the set's shingle before among those of the index.
    """
    lists = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    band = F.floor(F.log(F.col("size").cast("double")) / float(np.log(join.per / join.share))).cast("int")
    late = F.expr(f"size - pos < {_needed('size', 'size', join)}")
    index = stash(posted.join(lists, "token").distinct(), "listed")
    drop(posted.sparkSession, posted)
    listed = index
    # a set's prefix is one window
    prev = F.lag("token").over(Window.partitionBy("id").orderBy("pos"))
    index = stash(listed.withColumns({"band": band, "late": late, "prev": prev}), "index")
    drop(posted.sparkSession, listed)
    leaders = index.groupBy("token", "band").agg(F.min(F.struct("pos", "size", "id")).alias("y"))
    leaders = leaders.select("token", "band", F.col("y.id").alias("lead"), F.col("y.size").alias("lead_size"), F.col("y.pos").alias("lead_pos"))
    out = stash(index.join(leaders, ["token", "band"]), "blocked")
    drop(posted.sparkSession, index)
    return out


def bounds(pairs: DataFrame, signatures: DataFrame, join: Join) -> DataFrame:
    """(a, b, most, likely): the most shingles that each pair can share, by their bitmaps, and whether that is enough.

    ``signatures``: (id, n, bits), a row for each document.
    """
    pairs = stash(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # copies meet in partial aggregates before anything is dealt by set
    own = signatures.groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits")).join(ids, "id", "left_semi")
    own = stash(own, "signatures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.fromiter(map(differing, batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()), np.int64, len(batch))
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            most = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
            likely = join.per * most >= join.share * (na + nb - most)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(most.astype(np.int32)), pa.array(likely)], ["a", "b", "most", "likely"]
            )

    first = pairs.join(own.withColumnsRenamed({"id": "a", "n": "n_a", "bits": "bits_a"}), "a")
    both = first.join(own.withColumnsRenamed({"id": "b", "n": "n_b", "bits": "bits_b"}), "b")
    out = stash(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint, most int, likely boolean"), "bounds")
    drop(pairs.sparkSession, pairs, own)
    return out


#: Sets outside the main groups, times these groups, that are looked up at once for each posting of the open lists; beyond it
#: representatives are asked first.
AT_ONCE = 8
#: Representatives of a list's main group are so many times more in each round.
MORE = 16


def _open(index: DataFrame, group: DataFrame, met: DataFrame) -> DataFrame:
    """The postings of lists whose sets have different groups, with group, main (the list's largest group) and what is known of set and leader.

    ``up``: shingles shared with the leader at most; ``own``: shingles besides the leader's, where they were counted.
    """
    known = stash(index.join(group, "id", "left").withColumn("group", F.coalesce("group", "id")), "known")
    parts = known.groupBy("token", "group").agg(F.count("*").alias("c"))
    main = F.max(F.struct("c", "group"))
    mixed = parts.groupBy("token").agg(main["group"].alias("main"), F.count("*").alias("k")).where("k > 1").select("token", "main")
    rows = known.join(mixed, "token").join(met, ["id", "lead"], "left")
    itself = F.col("id") == F.col("lead")
    rows = rows.withColumn("up", F.when(itself, F.col("size")).otherwise(F.col("up")))
    out = stash(rows.withColumn("own", F.when(itself, 0).otherwise(F.col("size") - F.col("both"))), "open")
    drop(index.sparkSession, known)
    return out


def _outside(lists: DataFrame) -> DataFrame:
    """The postings of sets outside their list's main group, once for each block (near, near_late) that they can meet."""
    block = lambda step, late: F.struct((F.col("band") + step).alias("near"), F.lit(late).alias("near_late"))
    early = F.array(block(-1, False), block(0, False), block(1, False), block(0, True), block(1, True))
    meets = F.when(F.col("late"), F.array(block(-1, False), block(0, False))).otherwise(early)
    return lists.where("group <> main").withColumn("_m", F.explode(meets)).select(*lists.columns, "_m.near", "_m.near_late")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def classes_and_groups(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, id, n) of all documents, and (id, group) of the sets that link (but those that name a group)."""
    spark = docs.sparkSession
    found = stash(scan(docs, join), "sets")
    rows = found.where("chunk is null").select("doc_id", "th", "id", "n")
    signatures = found.where("chunk is null and n > 0").select("id", "n", "bits")
    classes = rarity(found.where("chunk is not null").select("chunk", "counts"))
    posted = stash(postings(docs, join, classes), "postings")
    index = blocked(posted, join)

    # each set against the leaders of its bands
    first = index.alias("x").where(f"id <> lead and {_fit(join, 'lead_size', 'lead_pos')}").select(F.col("id").alias("b"), F.col("lead").alias("a"))
    bound = bounds(first.distinct(), signatures, join)
    checked = verified(bound.where("likely").select("a", "b"), docs, rows, join)
    links = checked.where("linked").select("a", "b")
    group = groups(links)
    met = bound.join(checked.select("a", "b", "both"), ["a", "b"], "left")
    met = stash(met.select(F.col("b").alias("id"), F.col("a").alias("lead"), F.coalesce("both", "most").alias("up"), "both"), "met")
    drop(spark, bound)

    representatives = MORE
    while True:
        lists = _open(index, group, met)
        sizes = lists.groupBy("token").agg(F.count_if(F.expr("group = main")).alias("inside"), F.count_if(F.expr("group <> main")).alias("outside"))
        whole = sizes.agg(F.sum(F.expr("outside * (inside + outside)")), F.sum(F.expr("inside + outside")), F.max("inside")).first()
        if whole[0] is None or whole[0] <= AT_ONCE * whole[1] or whole[2] <= representatives:
            break
        # those that join a group by one of its representatives need no look at its other members
        near = [F.col("band").alias("near"), F.col("late").alias("near_late"), F.pmod(F.xxhash64("id"), F.lit(representatives))]
        chosen = lists.where("group = main").groupBy("token", *near).agg(F.min(F.struct("pos", "size", "id")).alias("y")).select("token", "near", "near_late", "y.*")
        pairs = _pairs(_outside(lists).alias("x").join(chosen.alias("y"), ["token", "near", "near_late"]).where(_fit(join)))
        more = verified(bounds(pairs, signatures, join).where("likely").select("a", "b"), docs, rows, join).where("linked").select("a", "b")
        links = links.unionByName(more)
        group = groups(links)
        representatives *= MORE
        drop(spark, lists)

    # a pair of different groups has at least one set outside the list's largest group: x
    y = lists.withColumnsRenamed({"band": "near", "late": "near_late"})
    new = "x.group <> y.group and (y.group = y.main or x.id < y.id) and coalesce(x.prev <> y.prev, true)"
    derived = f"x.lead = y.lead and least(x.up + y.own, y.up + x.own) < {_needed('x.size', 'y.size', join)}"
    joined = _outside(lists).alias("x").join(y.alias("y"), ["token", "near", "near_late"]).where(f"{new} and {_fit(join)} and not coalesce({derived}, false)")
    more = verified(bounds(_pairs(joined), signatures, join).where("likely").select("a", "b"), docs, rows, join).where("linked").select("a", "b")
    return rows, groups(links.unionByName(more)) if not more.isEmpty() else group


def join_documents(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, th (hash of the text), id (class), n_shingles and component_id of each row of ``docs``."""
    rows, group = classes_and_groups(docs, join)
    # copies first, then groups: no step gathers the rows of a group
    named = rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("least")).join(group, "id", "left")
    named = named.withColumn("group", F.coalesce("group", "id"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    names = named.join(least, "group").select("id", "component_id")
    return (
        rows.join(names, "id", "left")
        .withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumnRenamed("n", "n_shingles")
    )


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One document of each group, that with the smallest doc_id; rows with the same doc_id and text count as one document and stay together."""
    joined = join_documents(docs, join)
    gone = joined.where("component_id is not null and not doc_id <=> component_id").select(
        F.col("doc_id").alias("_n_doc"), F.col("th").alias("_n_th")
    )
    gone = small(stash(gone.distinct(), "gone"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("_n_doc")) & (F.xxhash64(whole_text()) == F.col("_n_th"))
    return docs.join(gone, match, "left_anti")
