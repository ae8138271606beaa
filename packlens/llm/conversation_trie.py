"""Prefix trie of conversations: range-partitioned shards finish their nodes, the skeleton of splitter paths is reduced.

A conversation is a path: the 128-bit digests of its turns (role and text), in order, as bytes. Paths with a common beginning are neighbours
in their order, so a range of (path, conv_id) holds the whole subtree of every node but those on the paths at its two borders. The
borders (splitters) come from a size-weighted sample; the trie of their paths, the skeleton, is sent to all tasks. Each task reads its range
in order with the stack of one path in memory and finishes every node off the skeleton; of skeleton nodes it gives partial aggregates, which
are added up by node, and then summed along the skeleton. conv_id is part of the order, so even a single conversation that a third of
all others repeat is cut into ranges.

The digest of the conversations that end at a node needs their ids in order: inside a range they arrive in it; a skeleton node's ids are
carried as joined strings of at most ``PIECE`` ids, ordered by range, and hashed as a stream (a sum over one string is one
stream's work by its nature; no list is held).

Texts never move: what is shuffled of a turn is its digest and its length. A conversation's digests (16 bytes a turn) are in one row.

Defined results: turns go by number, null first; turns with one number by their digests, repeated rows each count as turns; null roles and texts
are empty; rows without conv_id belong to no conversation; an empty table gives an empty table (no root); further columns don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Bytes of a turn's digest.
WIDTH = 16
#: Ranges at most; turns that a range has on average; conversations drawn for each range.
RANGES, RANGE_TURNS, DRAWN = 4096, 50_000, 40
#: Bytes that the borders' paths may have together; with ``WIDTH`` bytes a turn this bounds the skeleton too.
BORDER_BYTES = 16_000_000
#: Ids joined into one string at most.
PIECE = 20_000
#: A finished node has ``ends_sha256`` and ``above``, its parent's place on the skeleton (or none); a part of a skeleton node has ``bone``, its place there.
ROWS = (
    "shard int, seq bigint, bone bigint, depth bigint, conv_id bigint, parent_conv_id bigint, above bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, ends_sha256 string, chars bigint, ends string"
)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): a row for each conversation with its turns in order as struct(digest, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(said, 256)), 1, WIDTH)
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    paths = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return paths.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("path"))


def shared_beginnings(paths: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin as their block's first one does: the first h turns of conversation c - c % ``block``, then the own ones after h;
    h is the CRC of the decimal c modulo ``most``."""
    paths = stash(paths, "paths")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = paths.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, most - 1).alias("_head"))
    rows = paths.withColumns({"_h": h, "_base": F.col("conv_id") - F.col("conv_id") % block}).join(first, "_base", "left")
    none = F.slice("path", 1, 0)
    head = F.coalesce(F.when(F.col("_h") > 0, F.slice("_head", F.lit(1), F.greatest(F.lit(1), F.col("_h")))), none)
    tail = F.when(F.size("path") > F.col("_h"), F.slice("path", F.col("_h") + 1, F.size("path"))).otherwise(none)
    return rows.select("conv_id", F.concat(head, tail).alias("path"))


def packed(paths: DataFrame) -> DataFrame:
    """(conv_id, key, chars): the path as bytes, and the lengths of its turns' texts."""
    key = F.unhex(F.array_join(F.transform("path", lambda t: F.hex(t["digest"])), ""))
    return paths.select("conv_id", key.alias("key"), F.transform("path", lambda t: t["chars"]).alias("chars"))


def splitters(keys: DataFrame) -> list[tuple[bytes, int]]:
    """Borders of the ranges, as (key, conv_id): quantiles of a sample weighted by turns.

    A border's path ends with the turn in which it differs from the sample's path before it; only among equal paths it is whole and conv_id decides.
    """
    n, size = keys.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    turns_ = (size or 0) // WIDTH + (n or 0)
    wanted = int(min(RANGES, -(-turns_ // RANGE_TURNS)))
    if wanted <= 1:
        return []
    weight = F.octet_length("key") / WIDTH + 1
    # each conversation is drawn by its share of the turns; what weighs more than a draw keeps its weight
    share = F.least(F.lit(1.0), weight * DRAWN * wanted / turns_)
    chance = F.pmod(F.xxhash64("conv_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    drawn = keys.where(chance < share).select("key", "conv_id", (weight / share).alias("w"))
    ordered = drawn.repartitionByRange(max(1, wanted // 16), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    ordered = stash(ordered.withColumn("part", F.spark_partition_id()), "drawn")
    sums = {r["part"]: r["w"] for r in ordered.groupBy("part").agg(F.sum("w").alias("w")).collect()}
    before, total = {}, 0.0
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    step = total / wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = None, b"", 0.0
        for batch in batches:
            out = []
            for key, conv, w, own in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "w", "part")), strict=True):
                if own != part:
                    part, last, at = own, b"", before[own]
                if int(at / step) != int((at + w) / step):
                    same = 0
                    while same < len(key) and key[same : same + WIDTH] == last[same : same + WIDTH]:
                        same += WIDTH
                    out.append((int((at + w) / step), *((key, conv) if key == last else (key[: same + WIDTH], -(1 << 63)))))
                last, at = key, at + w
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["n", "key", "conv_id"])

    by_part = ordered.repartition("part").sortWithinPartitions("part", "key", "conv_id")
    found = stash(by_part.mapInArrow(run, "n bigint, key binary, conv_id bigint"), "borders")
    every = -(-(found.agg(F.sum(F.octet_length("key"))).first()[0] or 0) // BORDER_BYTES)
    return sorted({(bytes(r["key"]), r["conv_id"]) for r in found.where(F.col("n") % max(1, every) == 0).collect()})


def skeleton(borders: list[tuple[bytes, int]]) -> tuple[dict[tuple[int, bytes], int], list[int]]:
    """The trie of the borders' paths: the place of (parent's place, turn's digest), and the parent of each place. Place 0 is the root."""
    places: dict[tuple[int, bytes], int] = {}
    parents = [-1]
    for key, _ in borders:
        at = 0
        for start in range(0, len(key), WIDTH):
            step = (at, key[start : start + WIDTH])
            if step not in places:
                places[step] = len(parents)
                parents.append(at)
            at = places[step]
    return places, parents


class _Open:
    """A node on the path that is being read."""

    __slots__ = ("bone", "chars", "children", "ends", "first", "leaves", "members", "saved", "sha")

    def __init__(self, first: int, chars: int, bone: int | None) -> None:
        self.first, self.chars, self.bone = first, chars, bone
        self.members = self.children = self.leaves = self.saved = 0
        self.sha = None
        self.ends: list[int] = []


class _Reader:
    """Reads the conversations of a range in order; the rows of closed nodes gather in ``rows``, children before parents."""

    def __init__(self, shard: int, places: dict[tuple[int, bytes], int]) -> None:
        self.shard, self.places = shard, places
        self.path = b""
        self.stack: list[_Open] = []
        self.rows: list[tuple] = []
        self.seq = 0

    def _row(self, bone=None, depth=None, first=None, members=None, children=None, leaves=None, saved=None, sha=None, chars=None, ends=None) -> None:
        self.rows.append((self.shard, self.seq, bone, depth, first, None, None, members, children, leaves, saved, sha, chars, ends))
        self.seq += 1

    def _piece(self, node: _Open) -> None:
        self._row(bone=node.bone, ends=",".join(map(str, node.ends)))
        node.ends = []

    def close(self, depth: int) -> None:
        """Closes the nodes of the path at ``depth`` and below."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            at = len(self.stack)
            if node.bone is not None:
                if node.ends:
                    self._piece(node)
                self._row(node.bone, at, node.first, node.members, node.children, node.leaves, node.saved, None, node.chars)
            else:
                node.leaves += node.children == 0
                node.saved += (node.members - 1) * node.chars
                self._row(None, at, node.first, node.members, node.children, node.leaves, node.saved, (node.sha or hashlib.sha256()).hexdigest())
            if self.stack:
                above = self.stack[-1]
                above.first, above.members = min(above.first, node.first), above.members + node.members
                if node.bone is None:  # what a skeleton node adds to its parent is counted once, when all ranges are together
                    above.children += 1
                    above.leaves += node.leaves
                    above.saved += node.saved

    def read(self, key: bytes, conv: int, chars: np.ndarray) -> None:
        depth = len(key) // WIDTH
        if self.stack:
            most = min(depth, len(self.stack) - 1) * WIDTH
            same = most
            if self.path[:most] != key[:most]:
                same = 0
                while self.path[same : same + WIDTH] == key[same : same + WIDTH]:
                    same += WIDTH
            self.close(same // WIDTH + 1)
        self.path = key
        for at in range(len(self.stack), depth + 1):
            above = self.stack[-1].bone if at else None
            bone = 0 if not at else None if above is None else self.places.get((above, key[(at - 1) * WIDTH : at * WIDTH]))
            self.stack.append(_Open(conv, int(chars[at - 1]) if at else 0, bone))
        top = self.stack[-1]
        top.first, top.members = min(top.first, conv), top.members + 1
        if top.bone is not None:
            top.ends.append(conv)
            if len(top.ends) >= PIECE:
                self._piece(top)
        elif top.sha is None:
            top.sha = hashlib.sha256(str(conv).encode())
        else:
            top.sha.update(f",{conv}".encode())


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ROWS.split(","))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def shard_nodes(keys: DataFrame, borders: list[tuple[bytes, int]]) -> DataFrame:
    """Finished nodes, parts of skeleton nodes, and pieces of the ids that end at these (``ends``), of all ranges."""
    shared = keys.sparkSession.sparkContext.broadcast((borders, skeleton(borders)[0]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = shared.value[0]
        for batch in batches:
            shards = [bisect_right(lines, (k, c)) for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int32())], [*batch.schema.names, "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            chars = batch.column("chars")
            flat, offsets = chars.values.to_numpy(), chars.offsets.to_numpy()
            for n, (key, conv, shard) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "shard")), strict=True)):
                if reader is None or reader.shard != shard:
                    if reader:
                        reader.close(0)
                        yield _batch(reader.rows)
                    reader = _Reader(shard, shared.value[1])
                reader.read(key, conv, flat[offsets[n] : offsets[n + 1]])
                if len(reader.rows) >= 8192:
                    yield _batch(reader.rows)
                    reader.rows = []
        if reader:
            reader.close(0)
            yield _batch(reader.rows)

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come last first, parents before children: the node last read one level above is the parent."""
        path: dict[int, tuple[int | None, int | None]] = {}
        for batch in batches:
            conv, above = [None] * len(batch), [None] * len(batch)
            for n, (depth, bone, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("depth", "bone", "conv_id")), strict=True)):
                if depth is None:
                    continue
                path[depth] = (None, bone) if bone is not None else (first, None)
                if depth and bone is None:
                    conv[n], above[n] = path[depth - 1]
            columns = [pa.array(conv, pa.int64()) if f.name == "parent_conv_id" else pa.array(above, pa.int64()) if f.name == "above" else batch.column(f.name) for f in _SCHEMA]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    placed = keys.mapInArrow(deal, "conv_id bigint, key binary, chars array<bigint>, shard int")
    ranges = placed.repartitionById(len(borders) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "conv_id")
    return ranges.mapInArrow(read, ROWS).sortWithinPartitions("shard", F.desc("seq")).mapInArrow(parents, ROWS)


def ends_of(pieces: DataFrame) -> DataFrame:
    """(bone, ends_sha256): the digest of the ids that end at a skeleton node, its pieces read in order as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        made = lambda done: pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.int64()), pa.array([s for _, s in done], pa.string())], ["bone", "ends_sha256"])
        for batch in batches:
            done = []
            for bone, ends in zip(batch.column("bone").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if bone == last:
                    sha.update(f",{ends}".encode())
                    continue
                if last is not None:
                    done.append((last, sha.hexdigest()))
                last, sha = bone, hashlib.sha256(ends.encode())
            yield made(done)
        if last is not None:
            yield made([(last, sha.hexdigest())])

    ordered = pieces.select("bone", "shard", "seq", "ends").repartition("bone").sortWithinPartitions("bone", "shard", "seq")
    return ordered.mapInArrow(run, "bone bigint, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def skeleton_nodes(rows: DataFrame, borders: list[tuple[bytes, int]]) -> DataFrame:
    """The skeleton's nodes (bone and the result's columns): parts of all ranges are added up by node, then along the skeleton, whose size is bounded."""
    by_node = rows.where("bone is not null and ends is null").groupBy("bone", "depth").agg(
        F.min("conv_id").alias("first"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"),
    )
    parents = skeleton(borders)[1]
    found = {r["bone"]: r for r in by_node.collect()}
    children, leaves, saved = (np.zeros(len(parents), np.int64) for _ in range(3))
    for bone in range(len(parents) - 1, -1, -1):  # children stand behind their parents
        if r := found.get(bone):
            children[bone] += r["children"]
            leaves[bone] += r["leaves"] + (children[bone] == 0)
            saved[bone] += r["saved"] + (r["n"] - 1) * r["chars"]
            if bone:
                children[parents[bone]] += 1
                leaves[parents[bone]] += leaves[bone]
                saved[parents[bone]] += saved[bone]
    made = [
        (bone, r["first"], r["depth"], found[parents[bone]]["first"] if bone else None, r["n"], int(children[bone]), int(leaves[bone]), int(saved[bone]))
        for bone, r in found.items()
    ]
    kind = "bone bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    nodes = rows.sparkSession.createDataFrame(made, kind)
    ends = ends_of(rows.where("ends is not null"))
    return nodes.join(ends, "bone", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path of struct(digest, chars)), one row each."""
    keys = stash(packed(paths), "keys")
    borders = splitters(keys)
    rows = stash(shard_nodes(keys, borders), "nodes")
    bones = stash(skeleton_nodes(rows, borders), "skeleton")
    above = F.broadcast(bones.select(F.col("bone").alias("above"), F.col("conv_id").alias("_parent")))  # at most the skeleton's nodes
    own = rows.where("bone is null").join(above, "above", "left").withColumn("parent_conv_id", F.coalesce("_parent", "parent_conv_id"))
    return own.select(RESULT).unionByName(bones.select(RESULT))
