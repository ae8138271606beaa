"""Links and groups of vectors against all pairs, in one cell, on a grid, and with every branch that shuffles or deals."""

import math

import numpy as np
import pytest

from packlens.llm import common
from packlens.llm import embedding_dedup as ed

VEC = "vec_id bigint, embedding array<float>, label int, kept string, n_links int"


def all_pairs(rows, share=0.95):
    """(vec_id, n_links, component_id, kept) by looking at every pair."""
    good = []
    for n, (_, e, *_rest) in enumerate(rows):
        ok = e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(e)
        good.append(np.array(e, np.float32).astype(float) if ok else None)
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = good[i], good[j]
            if a is not None and b is not None and len(a) == len(b):
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= share:
                    links[i] += 1
                    links[j] += 1
                    root[max(top(i), top(j))] = min(top(i), top(j))
    out = []
    for n, r in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if top(m) == top(n) and rows[m][0] is not None]
        group = min(ids) if ids else None
        out.append((r[0], links[n], group, r[0] == group))
    return sorted(out, key=str)


def odd_vectors():
    r = np.random.default_rng(2)
    rows = [(n, r.normal(size=8).tolist()) for n in range(60)]
    for n in range(60, 140):  # near copies around three vectors, of which one attracts most
        base = np.array(rows[(n * n) % 3][1]) if n % 4 else np.array(rows[0][1])
        rows.append((n, (base + r.normal(size=8) * 0.18).tolist()))
    rows += [(n, [1.0, 2.0, 3.0, 4.0, 0.0, 0.0, 0.0, 0.0]) for n in range(140, 170)]  # copies
    rows += [(170, [2.0, 4.0, 6.0, 8.0, 0.0, -0.0, 0.0, 0.0]), (5, rows[5][1]), (None, rows[6][1]), (None, [9.0] + [0.0] * 6 + [-9.0])]
    rows += [(171, None), (172, []), (173, [0.0] * 8), (174, [1.0, None] * 4), (175, [math.nan] + [1.0] * 7), (176, [math.inf] + [1.0] * 7)]
    rows += [(177, [1.0, 2.0]), (178, [1.0, 2.1]), (179, [3.0]), (180, [4.0]), (181, [-4.0]), (182, [3e38] * 8), (183, [1e-38] * 8)]
    return [(n, v, 1, "old", 3) for n, v in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(odd_vectors(), VEC).repartition(5)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_one_cell_gives_all_links(vectors):
    assert found(ed.near_duplicates(vectors)) == all_pairs(odd_vectors())


@pytest.mark.parametrize("chunk", [4096, 7])
def test_a_grid_whose_traversal_goes_to_the_end_gives_all_links(vectors, monkeypatch, chunk):
    """At recall 1 the bound is that at which nothing links; chunks and parts of cells, and joins that shuffle, change nothing."""
    monkeypatch.setattr(ed, "CHUNK", chunk)
    monkeypatch.setattr(ed, "PART", 11 if chunk < 100 else ed.PART)
    if chunk < 100:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    fitted = ed.fitted

    def to_the_end(classes, near, *rest):
        grid = fitted(classes, near, *rest)
        assert grid.k > 1
        grid.bound = 2 - 2 * near.share
        return grid

    monkeypatch.setattr(ed, "fitted", to_the_end)
    assert found(ed.near_duplicates(vectors, ed.Near(per_cell=8))) == all_pairs(odd_vectors())


def test_recall_against_all_pairs_on_a_grid(spark):
    """Groups whose members differ in few directions, which random neighbours don't foresee."""
    r = np.random.default_rng(4)
    base, few = r.normal(size=(150, 16)), r.normal(size=(2, 16))
    rows = [(n, (base[n % 150] + r.normal(size=2) * 0.45 @ few).tolist(), 0, "", 0) for n in range(1200)]
    true, got = all_pairs(rows), found(ed.near_duplicates(spark.createDataFrame(rows, VEC), ed.Near(per_cell=8)))
    true_links, links = {t[0]: t[1] for t in true}, {t[0]: t[1] for t in got}
    assert all(links[n] <= true_links[n] for n in links) and sum(true_links.values()) > 1000
    assert sum(links.values()) >= 0.95 * sum(true_links.values())


def test_traversal_bound_is_below_every_distance(spark):
    """The cost of a cell is never above the squared distance to a vector in it."""
    r = np.random.default_rng(5)
    x, y = ed.units(r.normal(size=(500, 12))), ed.units(r.normal(size=(500, 12)))
    grid = ed.Grid(ed.units(r.normal(size=(400, 12))), 9)
    assert (grid.reached(x, y) <= ((x - y) ** 2).sum(1) + 1e-9).all()


def test_keep_one_and_empty(spark, vectors):
    kept = ed.keep_one(vectors)
    assert kept.columns == vectors.columns
    ids = sorted(str(r["vec_id"]) for r in kept.collect())
    want = {t[0] for t in all_pairs(odd_vectors()) if t[3]}
    assert ids == sorted(str(r[0]) for r in odd_vectors() if r[0] in want)
    none = ed.near_duplicates(vectors.limit(0))
    assert none.isEmpty() and none.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_doubles_at_the_threshold(spark):
    c = 0.95
    rows = [(1, [1.0, 0.0]), (2, [c, math.sqrt(1 - c * c)]), (3, [0.949, math.sqrt(1 - 0.949**2)]), (4, [1e200, 0.0])]
    got = {r["vec_id"]: r["n_links"] for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()}
    assert got[4] == got[1] and got[3] == 1 and got[1] >= 1
