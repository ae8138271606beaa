"""The set join against all pairs."""

import random
import re

import numpy as np
import pytest

from packlens.llm import ngram_join
from packlens.llm.ngram_join import Join


def brute(rows, join):
    """(doc_id, n_shingles, component_id) of each row, from all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(words[i : i + join.n]) for i in range(max(1, len(words) - join.n + 1))) if words else frozenset())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and join.per * len(a & b) >= join.share * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def run(df, join):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(df, join).collect()), key=repr)


def copies(seed, n_bases=12, n=260):
    """Groups of near copies, some a few edits from one another, some chains of edits, with passages that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    shared = [word() for _ in range(25)]
    bases = [[word() for _ in range(r.randint(3, 90))] + (shared if k % 2 else []) for k in range(n_bases)]
    rows = []
    for i in range(n):
        base = bases[0 if r.random() < 0.4 else r.randrange(n_bases)]
        words = base[:]
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = word()
        if r.random() < 0.1:
            base[r.randrange(len(base))] = word()
        rows.append((r.randrange(10_000), " ".join(words) if r.random() < 0.8 else " ".join(words).upper()))
    return rows


def lost_base(seed, n=240):
    """Copies of a text that is itself lost, each with its own number of edits, and texts that hold half of it or a passage of it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(n):
        words = base[:]
        for _ in range(r.randint(1, 5)):
            words[r.randrange(len(words))] = word()
        if i % 3 == 1:
            words = words[: r.choice((60, 90, 105))] + [word() for _ in range(r.randint(10, 60))]
        if i % 3 == 2 and i % 2:
            words = [word() for _ in range(r.randint(5, 40))] + words[40:60]
        rows.append((i + 7, " ".join(words)))
    return rows


@pytest.mark.parametrize(
    ("make", "join", "rounds"), [(copies, Join(4, 85), None), (copies, Join(5, 80), None), (lost_base, Join(4, 85), (0, 2)), (lost_base, Join(5, 80), None)]
)
def test_all_pairs(spark, monkeypatch, join, make, rounds):
    if rounds:  # sets outside ask representatives of the large groups first
        monkeypatch.setattr(ngram_join, "AT_ONCE", rounds[0])
        monkeypatch.setattr(ngram_join, "MORE", rounds[1])
    rows = make(join.n)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    assert run(df, join) == brute(rows, join)


def test_odd_rows(spark, odd, empty):
    join = Join(4, 85)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(odd, join) == brute(rows, join)
    assert run(empty, join) == []
    kept = ngram_join.keep_one(odd, join)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x))
    want = [d for d, _, c in brute(rows, join) if c is None or d == c]
    assert ids == sorted(want, key=lambda x: (x is None, x))
    assert ngram_join.keep_one(empty, join).collect() == []


def test_derived_answers_keep_every_link(spark):
    """Sets just inside and just outside the bound, of sizes round a band's edge, around one set."""
    join, words = Join(1, 80), [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        size, shift = 40 + i % 25, i % 12
        rows.append((i, " ".join(words[shift : shift + size] + [f"own{i}x{k}" for k in range(i % 7)])))
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), join) == brute(rows, join)


def test_bitmaps_never_overstate_a_difference():
    r = random.Random(3)
    for _ in range(300):
        x = {r.getrandbits(64) for _ in range(r.choice((1, 5, 40, 700)))}
        y = {v for v in x if r.random() < 0.9} | {r.getrandbits(64) for _ in range(r.choice((0, 1, 30, 900)))}
        x, y = (np.array(sorted(v), np.uint64) for v in (x, y))
        assert ngram_join.differing(ngram_join.bitmap(x), ngram_join.bitmap(y)) <= len(np.setxor1d(x, y))


def test_small_sets(spark):
    """The smallest sets that another set can link with, and smaller ones."""
    join = Join(1, 80)
    rows = [(10 * n + k, " ".join(f"s{n}w{i}" for i in range(n - k))) for n in range(2, 9) for k in (0, 1)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string"), join) == brute(rows, join)


def test_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(500, 70), (300, 301)]
    r = random.Random(4)
    links = [(a, b) if r.random() < 0.5 else (b, a) for a, b in links]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    got = {(r["id"], r["group"]) for r in ngram_join.groups(df).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101 + i, 100) for i in range(40)} | {(500, 70), (301, 300)}
