"""Removal of repeated strings against a table of every string."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packlens.llm import suffix_dedup
from packlens.llm.suffix_dedup import Repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def run(df, r, batches=3):
    done = suffix_dedup.remove(df, r, batches).collect()
    return sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in done), key=repr)


def passages(seed, n=150):
    """Texts with passages that others share whole, in part, shifted, or with themselves."""
    r = random.Random(seed)
    letters = lambda k: "".join(r.choice("ab é") for _ in range(k))
    pool = [letters(r.randint(15, 90)) for _ in range(8)]
    texts = []
    for _ in range(n):
        t = letters(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            t += p[a : a + r.randint(5, 80)] + letters(r.randint(0, 12))
        texts.append(t)
    return texts + [texts[0]] * 5 + ["ab" * 40, "a" * 90, "ab" * 41 + "é", "", None, pool[0] + pool[1] + pool[0]]


@pytest.mark.parametrize("r", [Repeats(20, 8), Repeats(33, 7), Repeats(12, 11)])
def test_every_string(spark, r):
    texts = passages(r.length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    want = sorted(((i, *x) for i, x in enumerate(brute(texts, r.length))), key=repr)
    assert run(df, r) == want


def test_long_lists_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LIST", 4)
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    r, texts = Repeats(20, 8), passages(7)
    got = [x for t in texts for x in [suffix_dedup.entries((t or "").encode(), r)]]
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 20)
    for t, parts in zip(texts, got, strict=True):
        for a, b in zip(parts, suffix_dedup.entries((t or "").encode(), r), strict=True):
            assert a.tolist() == b.tolist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert run(df, r, 1) == sorted(((i, *x) for i, x in enumerate(brute(texts, 20))), key=repr)


def test_one_string_in_many_contexts(spark, monkeypatch):
    """No group that is dealt to a task holds all contexts of a string, and strings of different groups still meet."""
    monkeypatch.setattr(suffix_dedup, "LIST", 16)
    r, rand, dealt = Repeats(20, 8), random.Random(3), []
    letters = lambda k: "".join(rand.choice("abcdefgh") for _ in range(k))
    passage, pair = letters(26), letters(9)
    texts = [letters(30) + passage + letters(30) for _ in range(300)]
    texts += [letters(30) + pair + passage + letters(30), letters(30) + pair + passage + letters(30)]  # a wider string that only two have
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    whole = type(df).repartition

    def repartition(self, *by):
        if len(by) == 2:
            dealt.append(self.groupBy(*by).count().agg({"count": "max"}).first()[0])
        return whole(self, *by)

    monkeypatch.setattr(type(df), "repartition", repartition)
    assert run(df, r, 1) == sorted(((i, *x) for i, x in enumerate(brute(texts, 20))), key=repr)
    assert dealt and max(dealt) <= 2 * 16


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(((d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows], 200), strict=True)), key=repr)
    clash = odd.selectExpr("*", "1 as n_bytes", "2 as th", "3 as n", "4 as at")
    assert run(clash, Repeats()) == want
    assert run(empty, Repeats()) == []
    cleaned = suffix_dedup.clean(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()


def test_family_merges_geometrically(spark, odd):
    family = suffix_dedup.Family()
    sizes = []
    for k in range(5):
        family.add(suffix_dedup.as_array(suffix_dedup.index_entries(odd.where(f"pmod(doc_id, 5) = {k}"), Repeats(), 1)))
        sizes.append([x is not None for x in family.levels])
    assert sizes == [[True], [False, True], [True, True], [False, False, True], [True, False, True]]
    assert family.levels[2].where("h is not null").count() > 0


def test_batches_by_bytes_change_no_result(spark, monkeypatch):
    r, texts = Repeats(20, 8), passages(11)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(9)
    want = sorted(((i, *x) for i, x in enumerate(brute(texts, 20))), key=repr)
    assert suffix_dedup.batches_for(df) == suffix_dedup.BATCHES
    size = sum(len((t or "").encode()) for t in texts)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", size // 6)
    assert suffix_dedup.batches_for(df) in (6, 7)
    assert run(df, r, None) == want


def test_a_batch_is_read_alone_and_no_part_of_an_array_holds_an_entry(spark):
    """One beginning in very many contexts: its entries lie in many parts of every array."""
    r, rand = Repeats(20, 8), random.Random(5)
    letters = lambda k: "".join(rand.choice("abcdefgh") for _ in range(k))
    gram = letters(26)
    df = spark.createDataFrame([(i, letters(30) + gram + letters(30)) for i in range(400)], "doc_id bigint, text string").repartition(8)
    index = suffix_dedup.by_batch(suffix_dedup.index_entries(df, r, 4))
    read = index.where("batch = 1").selectExpr("input_file_name() as f").distinct().collect()
    assert read and all("batch=1/" in x["f"] for x in read)
    family = suffix_dedup.Family()
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for b in range(2):
            family.add(suffix_dedup.as_array(index.where(f"batch = {b}")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    array = family.levels[1].selectExpr("h", "input_file_name() as f")
    parts = array.groupBy("h").agg(F.count("*").alias("rows"), F.countDistinct("f").alias("files")).orderBy("rows", ascending=False).first()
    assert parts["rows"] > 50 and parts["files"] > 1
