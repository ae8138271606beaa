"""Decontamination against a direct search for every item in every document."""

import math
import random
import re
from collections import Counter

from packlens.llm import decontaminate as d

ITEM = "item_id bigint, text string"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_planted_items(spark, odd, empty):
    r = random.Random(1)
    items = [(i, sentence(r, n)) for i, n in enumerate((1, 3, 5, 8, 12, 17, 25, 40, 60, 130, 300))]
    items += [(20, None), (21, ""), (22, "..."), (None, sentence(r, 30)), (23, items[6][1])]
    rows, want = [], set()
    for k in range(60):
        i, text = items[k % 11]
        before, after = sentence(r, r.randint(0, 150)), sentence(r, r.randint(0, 150))
        kind = k % 3
        words = text.split()
        if kind == 1:
            text = text.upper().replace(" ", ",\n ")
        if kind == 2 and len(words) >= 40:  # one edit in the middle of a long one, at the end of a shorter one
            words[len(words) // 2 if len(words) > 50 else -1] = "zzz"
            text = " ".join(words)
        rows.append((k, f"{before} {text} {after}", "en", "s", 0))
        want |= {(k, i)} | ({(k, 23)} if i == 6 else set())
    docs = spark.createDataFrame(rows, odd.schema).unionByName(odd.withColumn("doc_id", odd.doc_id + 1000))
    bench = spark.createDataFrame(items, ITEM)
    got = d.find(docs, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} >= want
    # every further hit is a real one: the short items occur by chance
    texts = {x[0]: x[1] for x in docs.collect()}
    norm = lambda t: b" " + b" ".join(d.words_of(t)) + b" "
    for x in got:
        if (x["doc_id"], x["item_id"]) not in want:
            assert norm(dict(items)[x["item_id"]]) in norm(texts[x["doc_id"]])
    kept = {x["doc_id"] for x in d.clean(docs, bench).collect()}
    assert kept == {x["doc_id"] for x in docs.collect()} - {x["doc_id"] for x in got}
    assert d.find(empty, bench).collect() == []
    assert d.find(docs, bench.limit(0)).collect() == []
    assert d.clean(docs, bench.where("item_id = 20")).count() == docs.count()


def weighted_jaccard(a, b, rarity, rare):
    def bag(words):
        k = min(5, len(words))
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()

    x, y = bag(a), bag(b)
    weigh = lambda s: sum(rarity.get(w, rare) for w in s) / len(s)
    both = sum(min(c, y[s]) * weigh(s) for s, c in x.items())
    total = sum(c * weigh(s) for bags in (x, y) for s, c in bags.items())
    return both / (total - both)


def edited(r, words):
    """A near copy: words replaced, put in, taken out, or a part cut off at either end."""
    words, n = words[:], max(1, int(len(words) * r.uniform(0, 0.05)))
    kind = r.randrange(6)
    for _ in range(n):
        if kind in (1, 5):
            words[r.randrange(len(words))] = sentence(r, 1)
        if kind in (2, 5):
            words.insert(r.randrange(len(words)), sentence(r, 1))
        if kind == 3 and len(words) > 1:
            del words[r.randrange(len(words))]
    cut = int(len(words) * r.uniform(0, 0.12))
    return words[cut:] if kind == 4 and n % 2 else words[: len(words) - cut] if kind == 4 else words


def test_recall_against_all_items_and_places(spark, odd):
    """Every document, item and place; of the pairs at 0.8 or more at least nine tenths are found, and no others."""
    r = random.Random(7)
    items = [(i, sentence(r, n)) for i, n in enumerate((5, 9, 14, 20, 27, 36, 53, 80, 120))]
    rows = []
    for k in range(120):
        own = edited(r, items[k % len(items)][1].split())
        rows.append((k, " ".join([sentence(r, r.randint(1, 40)), *own, sentence(r, r.randint(1, 40))]), "en", "s", 0))
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    seen = Counter(w for _, t in items for w in set(words(t)))
    rarity, rare = {w: math.log(1 + len(items) / c) for w, c in seen.items()}, math.log(1 + len(items))
    want = set()
    for doc, text, *_ in rows:
        ws = words(text)
        for i, t in items:
            own = words(t)
            some = set(own)
            if any(weighted_jaccard(own, ws[at : at + len(own)], rarity, rare) >= 0.8 for at in range(len(ws)) if len(some & set(ws[at : at + len(own)])) > len(some) // 2):
                want.add((doc, i))
    got = {(x["doc_id"], x["item_id"]) for x in d.find(spark.createDataFrame(rows, odd.schema), spark.createDataFrame(items, ITEM)).collect()}
    assert got <= want and len(want) > 50
    assert len(got) >= 0.9 * len(want), (len(got), len(want))


def test_blocks_of_items_and_long_texts(spark, odd, monkeypatch):
    r = random.Random(2)
    items = [(i, sentence(r, 20)) for i in range(50)]
    text = sentence(r, 900) + " " + items[7][1] + " " + sentence(r, 900)
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], odd.schema)
    monkeypatch.setattr(d, "ITEMS", 9)
    got = d.find(docs, spark.createDataFrame(items, ITEM)).collect()
    assert [(x["item_id"], x["word_start"], x["n_words"], x["similarity"]) for x in got] == [(7, 900, 20, 1.0)]
    monkeypatch.setattr(d, "ITEMS", 10_000)
    monkeypatch.setattr(d, "ITEM_WORDS", 90)  # as many blocks as the words ask for
    assert len(list(d.indexes(spark.createDataFrame(items, ITEM)))) > 8
    monkeypatch.setattr(d, "WORDS", 100)
    index = d.Index(items)
    assert [x[:3] for x in list(index.scan([None, text]))[1]] == [(7, 900, 20)]


def test_every_fingerprint_within_the_radius_is_found():
    r = random.Random(3)
    index = d.Index([(i, sentence(r, 24)) for i in range(200)])
    (size, c), = index.classes.items()
    prints = c.prints.copy()
    for k in range(len(prints)):
        for b in r.sample(range(64), r.randint(0, d.RADIUS)):
            prints[k] ^= type(prints[k])(1 << b)
    found = {(w, x) for ws, xs, _ in index._near(size, prints) for w, x in zip(ws.tolist(), xs.tolist(), strict=True)}
    assert found >= {(k, k) for k in range(len(prints))}


def test_how_the_benchmark_is_cut_makes_no_difference(spark, odd, monkeypatch):
    """Near copies about the threshold: the same rows, with the same similarities, from one block and from one block an item."""
    r = random.Random(11)
    lead = sentence(r, 12)
    items = [(i, f"{lead} {sentence(r, 30)}") for i in range(12)] + [(50 + i, sentence(r, 35)) for i in range(12)]
    rows = []
    for k in range(240):
        words = items[k % len(items)][1].split()
        for _ in range(r.randint(0, 2)):
            words[r.randrange(len(words))] = r.choice(items[r.randrange(24)][1].split())
        rows.append((k, " ".join([sentence(r, 5), *words, sentence(r, 5)]), "en", "s", 0))
    docs, bench = spark.createDataFrame(rows, odd.schema), spark.createDataFrame(items, ITEM).repartition(3)
    hits = lambda: sorted((x["doc_id"], x["item_id"], x["word_start"], round(x["similarity"], 12)) for x in d.find(docs, bench).collect())
    whole = hits()
    assert 100 < len(whole) < 240
    monkeypatch.setattr(d, "ITEMS", 3)
    assert hits() == whole
    assert {x["doc_id"] for x in d.clean(docs, bench).collect()} == {k for k, *_ in rows} - {h[0] for h in whole}
