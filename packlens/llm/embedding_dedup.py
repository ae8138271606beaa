"""Embedding near-duplicates: an inverted multi-index over vector halves, searched by multi-sequence traversal, verified in double precision.

Independent codebooks of the two halves form a product grid; each vector lies in the cell of its nearest centroids. How far a vector is
at least from a cell is known from the bisectors between centroids, for each half alone; the traversal visits cells in ascending order of
the sum of both squared distances. It ends where the target recall is reached: the bound is measured on neighbours made at the
least cosine in random directions and on the true neighbours of sampled queries among all vectors, and never needs to be
above the distance at which nothing links (up to there, recall is 1).

A pair is looked at once, in the cell with the higher rank of the two: vectors visit only cells that rank above their own. In a
cell visitors are multiplied with the vectors at home there, in blocks; what leaves a task is a number of links for each vector and a forest
of links, never pairs. Equal vectors are one class with a multiplicity before anything is dealt, so that copies cost nothing; crowded
cells are dealt in chunks of home vectors times parts of visitors. Within a large group of different near copies all pairs
are still multiplied, as exact numbers of links ask for it: the work, not the memory or the rows, grows with the square of such a group.

The codebooks are fitted on a bounded sample (``SAMPLE`` vectors, ``SAMPLE_BYTES``); all vectors are indexed and all are queries.

Defined results: a null, empty or zero vector, or one with null or non-finite components, links with nothing; vectors link only with
those of their own length (lengths but the commonest are compared whole); rows that repeat are vectors each and link with one another; a
null vec_id never names a group unless nothing else does (the group's name is null then, and its vectors without id are kept);
an empty table gives an empty table; further columns don't matter and pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash
from .ngram_join import groups

#: Vectors, and bytes of vectors, that codebooks are fitted on; centroids at most for a half; sampled queries.
SAMPLE, SAMPLE_BYTES, CENTROIDS, QUERIES = 65_536, 32_000_000, 1024, 256
#: Vectors at home in a chunk of a crowded cell, and vectors that one part of a cell's visitors has at most, on average.
CHUNK, PART = 4096, 65_536
#: Bins of the histogram of traversal costs.
BINS = 512
_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


@dataclass(frozen=True)
class Near:
    """Vectors link at a cosine of ``share`` or more; ``recall`` is the traversal's target; ``per_cell`` vectors to a cell on average."""

    share: float = 0.95
    recall: float = 0.97
    per_cell: int = 512


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, also where squares would overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def matrix(packed: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length from their bytes."""
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1).astype(np.float64)


def _kind(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def keyed(vectors: DataFrame, with_vector: bool) -> DataFrame:
    """(vec_id, key, vec): a 128-bit digest and the bytes of each vector that can link; nulls for the others."""
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # one kind of zero; null is NaN
            begins = np.cumsum(lengths) - lengths
            keys: list[bytes | None] = [None] * len(batch)
            packed: list[bytes | None] = [None] * len(batch)
            for n in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == n)
                found = flat[begins[rows][:, None] + np.arange(n)]
                top = np.abs(found).max(axis=1)
                for row, vector in zip(rows[np.isfinite(top) & (top > 0)].tolist(), found[np.isfinite(top) & (top > 0)], strict=True):
                    raw = vector.tobytes()
                    keys[row], packed[row] = xxhash.xxh3_128_digest(raw), raw if with_vector else None
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["vec_id", "key", "vec"])

    element = "float" if kind == "<f4" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id bigint, key binary, vec binary")


def classes_of(vectors: DataFrame) -> DataFrame:
    """(id, key, m, least, vec): the different vectors, how many rows have each, and the smallest vec_id. Copies meet in partial aggregates."""
    rows = keyed(vectors, True).where("key is not null")
    once = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    return stash(once.withColumn("id", F.monotonically_increasing_id()), "classes")


def codebook(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample: the first ``k`` points, moved to the means of those nearest to them."""
    centroids = points[:k].copy()
    for _ in range(rounds if k > 1 else 1):
        nearest = np.concatenate(
            [((centroids**2).sum(1) - 2 * points[at : at + 4096] @ centroids.T).argmin(1) for at in range(0, len(points), 4096)]
        )
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


class Grid:
    """The product grid of two codebooks, and how far its traversal goes."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.half, self.k, self.bound = sample.shape[1] // 2, k, 0.0
        self.books = [codebook(part, k) for part in self.parts(sample)]
        self.apart = [np.sqrt(np.maximum(((c[:, None, :] - c[None]) ** 2).sum(2), 1e-30)) if k <= 256 else self._apart(c) for c in self.books]

    @staticmethod
    def _apart(c: np.ndarray) -> np.ndarray:
        squares = (c**2).sum(1)
        return np.sqrt(np.maximum(squares[:, None] + squares - 2 * c @ c.T, 1e-30))

    def parts(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def costs(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cells, and for each half the squared least distances to the regions of its centroids."""
        home, out = np.zeros(len(vectors), np.int64), []
        for part, centroids, apart in zip(self.parts(vectors), self.books, self.apart, strict=True):
            far = (part**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * part @ centroids.T
            nearest = far.argmin(1)
            least = far[np.arange(len(part)), nearest][:, None]
            bisector = np.maximum(far - least, 0) / (2 * apart[nearest])
            out.append(bisector**2)
            home = home * self.k + nearest
        return home, out

    def cost(self, costs: list[np.ndarray], cells: np.ndarray) -> np.ndarray:
        """The traversal's cost at which each row reaches its cell of ``cells``."""
        rows = np.arange(len(cells))
        return costs[0][rows, cells // self.k] + costs[1][rows, cells % self.k]

    def rank(self, cells: np.ndarray) -> np.ndarray:
        mixed = cells.astype(np.uint64) * np.uint64(_ODD)
        return mixed ^ (mixed >> np.uint64(31))

    def visits(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether at home): the home cells, and the cells of higher rank that the traversal reaches."""
        home, (first, second) = self.costs(vectors)
        row, i = np.nonzero(first <= self.bound)
        left = self.bound - first[row, i]
        pair, j = np.nonzero(second[row] <= left[:, None])
        row, cell = row[pair], i[pair] * self.k + j
        above = self.rank(cell) > self.rank(home[row])
        at = np.arange(len(vectors))
        return np.concatenate([at, row[above]]), np.concatenate([home, cell[above]]), np.repeat([True, False], [len(at), int(above.sum())])

    def reached(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The bound from which the pairs of rows of ``x`` and ``y`` meet."""
        (a, from_x), (b, from_y) = self.costs(x), self.costs(y)
        lower = self.rank(a) < self.rank(b)
        return np.where(a == b, 0.0, np.where(lower, self.cost(from_x, b), self.cost(from_y, a)))


def _made_neighbours(x: np.ndarray, share: float) -> np.ndarray:
    """For each row one with the cosine ``share``, in a random direction."""
    if x.shape[1] == 1:
        return x
    aside = np.random.default_rng(7).normal(size=x.shape)
    aside -= (aside * x).sum(1, keepdims=True) * x
    return share * x + np.sqrt(max(0.0, 1 - share**2)) * aside / np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-30)


def fitted(classes: DataFrame, near: Near, length: int, n: int, kind: str) -> Grid:
    """The grid for the ``n`` classes whose vectors have ``length`` bytes, with the bound of its traversal."""
    spark = classes.sparkSession
    k = int(min(CENTROIDS, max(1, round(np.sqrt(n / near.per_cell)))))
    size = min(SAMPLE, max(4096, 32 * k), max(k, SAMPLE_BYTES // length))
    own = classes.where(F.length("vec") == length)
    head = own.orderBy(F.xxhash64("key"), "key").limit(size).select("id", "vec").toArrow()
    sample = units(matrix(head.column("vec").combine_chunks(), kind))
    grid = Grid(sample, min(k, len(sample)))
    most = 2 - 2 * near.share
    if grid.k == 1:
        return grid
    made = np.quantile(grid.reached(sample[:2048], _made_neighbours(sample[:2048], near.share)), near.recall)
    shared = spark.sparkContext.broadcast((grid, sample[:QUERIES], np.array(head.column("id")[:QUERIES])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, queries, ids = shared.value
        counts = np.zeros((len(queries), BINS), np.int64)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                x = units(matrix(batch.column("vec"), kind))
                row, query = np.nonzero((x @ queries.T >= near.share) & (batch.column("id").to_numpy()[:, None] != ids))
                if len(row):
                    cost = grid.reached(x[row], queries[query])
                    np.add.at(counts, (query, np.minimum(BINS - 1, np.ceil(cost / most * (BINS - 1))).astype(np.int64)), 1)
        query, bin_ = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(bin_), pa.array(counts[query, bin_])], ["query", "bin", "n"])

    measured = own.select("id", "vec").mapInArrow(run, "query bigint, bin bigint, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n"))
    found = np.zeros((QUERIES, BINS))
    for r in measured.collect():
        found[r["query"], r["bin"]] = r["n"]
    true = 0.0
    some = found[found.sum(1) > 0]
    for shares in (some.sum(0), (some / np.maximum(some.sum(1, keepdims=True), 1)).sum(0)):
        if shares.sum():
            true = max(true, np.searchsorted(np.cumsum(shares), near.recall * shares.sum() - 1e-9) / (BINS - 1) * most)
    grid.bound = float(min(most, max(made, true)))
    return grid


def placed(classes: DataFrame, shared, length: int, kind: str, with_vector: bool) -> DataFrame:
    """(cell, id, home, m, vec): each class in its home cell and as a visitor; vectors of other lengths in a cell for their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: Grid = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                sizes = pc.binary_length(batch.column("vec")).to_numpy()
                row, cell, home = np.flatnonzero(sizes != length), -sizes[sizes != length].astype(np.int64), np.ones((sizes != length).sum(), bool)
                own = np.flatnonzero(sizes == length)
                if len(own):
                    r, c, h = grid.visits(units(matrix(batch.column("vec").take(pa.array(own)), kind)))
                    row, cell, home = np.concatenate([row, own[r]]), np.concatenate([cell, c]), np.concatenate([home, h])
                pick = pa.array(row)
                taken = [batch.column(c).take(pick) for c in ("id", "m")]
                vec = batch.column("vec").take(pick) if with_vector else pa.nulls(len(row), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell), taken[0], pa.array(home), taken[1], vec], ["cell", "id", "home", "m", "vec"])

    return classes.select("id", "m", "vec").mapInArrow(run, "cell bigint, id bigint, home boolean, m bigint, vec binary")


def dealt(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds chunk and part: a cell's home vectors are index rows of their chunk in every part, and its other rows ask every chunk in their part.

    Home vectors ask the chunks after their own. In the most cells there is one chunk and one part.
    """
    crowded = counts.where(f"home > {CHUNK} or asking > {PART}").select(
        "cell", F.ceil(F.col("home") / CHUNK).cast("int").alias("_chunks"), F.greatest(F.lit(1), F.ceil(F.col("asking") / PART)).cast("int").alias("_parts")
    )
    all_ = rows.join(small(stash(crowded, "crowded")), "cell", "left")
    all_ = all_.withColumns({"_chunks": F.coalesce("_chunks", F.lit(1)), "_parts": F.coalesce("_parts", F.lit(1))})
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    place = lambda chunk, part, asks: F.struct(chunk.alias("chunk"), part.alias("part"), F.lit(asks).alias("asks"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    index = F.transform(upto("_parts"), lambda p: place(own("_chunks", 1), p, False))
    asked = F.transform(F.filter(upto("_chunks"), lambda c: ~F.col("home") | (c > own("_chunks", 1))), lambda c: place(c, own("_parts", 2), True))
    spread = F.explode(F.when(F.col("home"), F.concat(index, asked)).otherwise(asked))
    return all_.withColumn("_at", spread).select("cell", "_at.*", "id", "m", "vec")


class _Tile:
    """A chunk of a cell: its vectors, their links so far, and the groups that links make of them."""

    def __init__(self, share: float, kind: str, first_part: bool) -> None:
        self.share, self.kind, self.inner = share, kind, first_part
        self.waiting: list[pa.RecordBatch] = []
        self.raw: np.ndarray | None = None
        self.edges: list[tuple[int, int]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.waiting.append(batch)

    def _links(self, x: np.ndarray, raw: np.ndarray) -> np.ndarray:
        near = x @ self.x.T
        out = near >= self.share
        for i, j in zip(*np.nonzero(np.abs(near - self.share) < 1e-9), strict=True):  # the product's order of sums must not decide
            a, b = raw[i] / np.abs(raw[i]).max(), self.raw[j] / np.abs(self.raw[j]).max()
            out[i, j] = np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))) >= self.share
        return out

    def _joined(self, ids: np.ndarray, links: np.ndarray) -> None:
        """Adds a forest of the links of rows to this chunk's vectors."""
        for row in np.flatnonzero(links.any(axis=1)).tolist():
            columns = np.flatnonzero(links[row])
            labels, first = np.unique(self.label[columns], return_index=True)
            self.edges += [(int(ids[row]), int(self.ids[columns[f]])) for f in first.tolist()]
            if len(labels) > 1:
                self.label[np.isin(self.label, labels[1:])] = labels[0]

    def seal(self) -> None:
        if self.raw is not None or not self.waiting:
            return
        table = pa.Table.from_batches(self.waiting).combine_chunks()
        self.waiting = []
        self.raw = matrix(table.column("vec").combine_chunks(), self.kind)
        self.ids, self.m = table.column("id").to_numpy(), table.column("m").to_numpy()
        self.x, self.links, self.label = units(self.raw), np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        if self.inner:
            for at in range(0, len(self.ids), 1024):
                links = np.triu(self._links(self.x[at : at + 1024], self.raw[at : at + 1024]), at + 1)
                self.links[at : at + 1024] += links @ self.m
                self.links += self.m[at : at + 1024] @ links
                self._joined(self.ids[at : at + 1024], links)

    def ask(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.seal()
        if self.raw is None:
            return
        raw, ids = matrix(batch.column("vec"), self.kind), batch.column("id").to_numpy()
        links = self._links(units(raw), raw)
        self.links += batch.column("m").to_numpy() @ links
        self._joined(ids, links)
        yield from _made(ids, links @ self.m, self.edges)
        self.edges = []

    def done(self) -> Iterator[pa.RecordBatch]:
        self.seal()
        if self.raw is not None:
            yield from _made(self.ids, self.links, self.edges)


def _made(ids: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    some = links > 0
    if some.any() or edges:
        a = np.concatenate([ids[some], np.array([e[0] for e in edges], np.int64)])
        n = np.concatenate([links[some], np.zeros(len(edges), np.int64)])
        other = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array([e[1] for e in edges], pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), other], ["a", "links", "b"])


def compared(rows: DataFrame, near: Near, kind: str) -> DataFrame:
    """(a, links, b): numbers of links of vectors (b is null), and links of a forest (links is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for whole in batches:
            keys = np.stack([whole.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "chunk", "part", "asks")])
            cuts = np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(whole)], strict=True):
                if start == end:
                    continue
                place, asks = tuple(keys[:3, start].tolist()), bool(keys[3, start])
                if place != key:
                    if tile:
                        yield from tile.done()
                    key, tile = place, _Tile(near.share, kind, place[2] == 0)
                for at in range(start, end, 1024):
                    part = whole.slice(at, min(1024, end - at))
                    if asks:
                        yield from tile.ask(part)
                    else:
                        tile.add(part)
        if tile:
            yield from tile.done()

    ordered = rows.repartition("cell", "chunk", "part").sortWithinPartitions("cell", "chunk", "part", "asks")
    return ordered.mapInArrow(run, "a bigint, links bigint, b bigint")


def near_duplicates(vectors: DataFrame, near: Near = Near()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding)."""
    kind, spark = _kind(vectors), vectors.sparkSession
    classes = classes_of(vectors)
    common = classes.groupBy(F.length("vec").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if common:
        grid = spark.sparkContext.broadcast(fitted(classes, near, common["length"], common["n"], kind))
        count = lambda c: F.count_if(c).alias
        counts = placed(classes, grid, common["length"], kind, False).groupBy("cell").agg(count(F.col("home"))("home"), count(~F.col("home"))("asking"))
        asking = F.when(F.col("home") > CHUNK, F.col("home")).otherwise(0) + F.col("asking")
        counts = counts.withColumn("asking", asking)
        found = stash(compared(dealt(placed(classes, grid, common["length"], kind, True), counts), near, kind), "links")
    else:
        found = spark.createDataFrame([], "a bigint, links bigint, b bigint")
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    forest = found.where("b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    named = classes.select("id", "key", "m", "least").join(groups(forest), "id", "left").withColumn("group", F.coalesce("group", "id"))
    names = named.groupBy("group").agg(F.min("least").alias("component_id"))
    known = named.join(names, "group").join(links, "id", "left")
    known = known.select("key", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("_in"))
    out = keyed(vectors, False).select("vec_id", "key").join(small(stash(known, "named")), "key", "left")
    own = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def keep_one(vectors: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of ``vectors`` whose vec_id is kept, with all their columns; rows that share a vec_id stay or go together."""
    kept = near_duplicates(vectors, near).where("kept").select(F.col("vec_id").alias("_e_id")).distinct()
    return vectors.join(small(stash(kept, "kept")), F.col("vec_id").cast("long").eqNullSafe(F.col("_e_id")), "left_semi")
