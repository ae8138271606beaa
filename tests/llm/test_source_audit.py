"""Divergences against plain loops with Python's integers; spills, joins that shuffle, and counts beyond 64 bits."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packlens.llm import common
from packlens.llm import source_audit as sa

from .conftest import DOC, odd_documents

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def diverge(p, q):
    return (p - q) ** 2 // (p + q)


def plain(rows, min_docs=10, top=10):
    often, counts, groups, out = defaultdict(Counter), defaultdict(Counter), set(), []
    for _, text, lang, source, *_rest in rows:
        lang, source = lang or "", source or ""
        terms = Counter(t.translate(LOW) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        groups.add((lang, source))
        often[lang].update(terms.keys())
        counts[lang, source].update(terms)
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in often[lang].items() if n >= min_docs]
        own = sorted(s for g, s in groups if g == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in own}
        p = {s: [1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept] for s in own}
        q = [1 + 10**9 * (sum(counts[lang, s][t] for s in own) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept]
        for s in own:
            pairs = [(o, sum(map(diverge, p[s], p[o]))) for o in own if o != s]
            terms = [(t, diverge(a, b)) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(ranked)]
    return sorted(out)


def documents():
    r = random.Random(9)
    rows = odd_documents()
    for n in range(300):
        words = [r.choice("Der die DAS und ǅ é É ß 漢字 🙂 it's a-b x1y z_z \x00k\x7fm".split(" ")) for _ in range(r.randint(0, 60))]
        rows.append((100 + n, " ".join(words), r.choice(["de", "fr", None]), r.choice(["s1", "s2", "é", None, ""]), 0))
    return rows + rows[-3:] + [(900, "lonely", "xx", "only", 6), (901, None, "yy", "a", 0), (902, "one", "yy", "b", 3), (903, "word " * 50_000, "de", "s9", 0)]


@pytest.mark.parametrize(("entries", "part", "rows"), [(400_000, 4_000_000, 1_000_000), (20, 1000, 0)])
def test_audit_is_that_of_plain_loops(spark, monkeypatch, entries, part, rows):
    monkeypatch.setattr(sa, "ENTRIES", entries)
    monkeypatch.setattr(sa, "PART", part)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    docs = spark.createDataFrame(documents(), DOC).withColumns({"term": F.lit("clash"), "value": F.lit(1), "stripe": F.lit(2)}).repartition(5)
    assert sorted(map(tuple, sa.audit(docs).collect())) == plain(documents())


def test_other_settings_and_an_empty_table(spark, empty):
    docs = spark.createDataFrame(documents(), DOC)
    assert sorted(map(tuple, sa.audit(docs, sa.Audit(min_docs=3, top=2)).collect())) == plain(documents(), 3, 2)
    out = sa.audit(empty)
    assert out.isEmpty() and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_of_large_counts_are_exact(spark):
    counts = [0, 1, sa.PLAIN - 1, sa.PLAIN, sa.PLAIN + 1, 7 * 10**15, 10**17 + 3]
    rows = [(c, n, k) for c in counts for n in (c, c + 12_345, 2 * 10**17 + 1) for k in (1, 10**7)]
    df = spark.createDataFrame(rows, "c bigint, n bigint, k bigint")
    for r in df.select("*", sa.share(F.col("c"), F.col("n"), F.col("k")).alias("p")).collect():
        assert r["p"] == 1 + 10**9 * (r["c"] + 2) // (r["n"] + 2 * r["k"])
