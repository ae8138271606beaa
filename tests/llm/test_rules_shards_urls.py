"""Quality rules, sharding and URL filters against plain loops."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packlens.llm import quality, sharding, url_filter
from packlens.llm.queries import URL_RULES
from packlens.llm.quality import Limits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text, window=8):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    again = set()
    for i in range(len(words) - window + 1):
        if grams[tuple(words[i : i + window])] > 1:
            again |= set(range(i, i + window))
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), n < 20 or 100 * len(again) > 30 * n)


def test_statistics(spark, odd):
    rows = [(i, t) for i, t in enumerate(["a b c d e f g h i " * 3, "x " * 40, "# a\n# a\n\n \n#%&|<> $*", "one two\vthree\ffour\u00a0five six", "🙂 é\u3000x " * 30])]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], odd.schema)
    df = quality.with_statistics(odd.unionByName(more)).collect()
    for r in df:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == statistics(r["text"]), r["text"][:80]


def test_frequent_lines(spark, odd, empty):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    notice = "All  RIGHTS reserved here"
    rows = [(i, f"{body(i)}\n{notice if i % 2 else notice.lower()}", "en", "a", 0) for i in range(30)]
    rows += [(100 + i, f"short text {i} of a host with few words of its own today indeed yes\n" + "the same very long line of words again and again for all of them " * 2, "en", "b", 0) for i in range(30)]
    rows += [(200, body(999) + "\ncopied line", "en", "c", 0)] * 30  # one document, thirty times: no frequent line
    rows += [(400 + i, body(998) + "\ncopied line", "en", "d", 0) for i in range(30)]  # thirty documents with one text: each counts
    rows += [(300, body(300) + "\n" + notice, "en", None, 0), (301, None, None, None, None)]
    docs = spark.createDataFrame(rows, odd.schema).repartition(5)
    limits = Limits(min_docs=20, percent=8)
    got = {r["doc_id"]: r for r in quality.judge(docs, limits).collect()}
    assert {i for i, r in got.items() if r["n_lines_removed"]} == set(range(30)) | set(range(100, 130)) | set(range(400, 430))
    assert {i for i, r in got.items() if r["kept"]} == set(range(30)) | {200, 300}
    kept = {r["doc_id"]: r for r in quality.clean(docs, limits).collect()}
    assert set(kept) == {i for i, r in got.items() if r["kept"]}
    assert kept[3]["text"] == body(3) and kept[3]["n_chars"] == len(body(3)) and kept[200]["text"] == rows[60][1]
    assert quality.clean(docs, limits).columns == docs.columns
    clash = docs.withColumns({"n_words": F.lit("x"), "kept": F.lit(3), "pos": F.lit(1), "col": F.lit(2)})
    assert {r["doc_id"] for r in quality.judge(clash, limits).collect() if r["kept"]} == set(kept)
    assert quality.judge(empty).collect() == [] and quality.clean(odd).count() <= odd.count()


@pytest.mark.parametrize("shards", [1, 4, 24])
def test_shards(spark, odd, empty, shards):
    docs = odd.unionByName(odd.where("doc_id = 3").withColumn("doc_id", F.explode(F.sequence(F.lit(1000), F.lit(1200)))))
    clash = docs.withColumns({"size": F.lit("x"), "shard": F.lit(1)})
    got = sharding.shard(clash, shards, ranges=9).collect()
    assert len(got) == docs.count()
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(shards):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= largest
    again = sharding.shard(docs.repartition(3), shards, ranges=5).select("doc_id", "shard", "slot", "text_crc32")
    pick = lambda rows: Counter((r["doc_id"], r["shard"], r["slot"], r["text_crc32"]) for r in rows)
    assert pick(again.collect()) == pick(got)
    assert sharding.shard(empty, shards).collect() == []


def test_written_shards(spark, odd, tmp_path):
    sharding.write(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and back.select("shard").distinct().count() <= 4


def judged(url, rules):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), found[1]) if found else ""
    path = found[2] if found else ""
    rules = [(h, p or "", a) for h, p, a in rules]
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_urls(spark):
    rules = [*URL_RULES, ("net", "/es/", "block"), ("a.net", None, "block"), (None, "/", "block"), ("b.net", "/p", "allow"), ("b.net", "/p", "block"), ("net", "/es/x", "allow")]
    hosts = ["www.example.com", "EXAMPLE.com", "notexample.com", "x.www.example.com", "a.net", "b.net", "net", "user@a.net", "a.net:80", "", "com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/en/a?x#y", "/es/xy", "/p/q", "?q=/en/", "#f", "//en/")]
    urls += [None, "", "no scheme", "://", "a://b://c/d", "http://example.com/é/", "http://com/\nx"]
    df = spark.createDataFrame([(i % 50, u) for i, u in enumerate(urls + urls[:3])], "page_id long, url string").withColumns({"h": F.lit(1), "rule": F.lit(2)})
    ready = spark.createDataFrame(rules, "host string, path string, action string")
    got = Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, ready).collect())
    assert got == Counter((r["page_id"], r["url"], *judged(r["url"], rules)) for r in df.collect())
    none = url_filter.filter_urls(df, ready.limit(0)).collect()
    assert len(none) == df.count() and {r["verdict"] for r in none} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), ready).collect() == []


def test_quality_rules_beside_columns_of_their_names(spark):
    """``judge`` replaces them, ``clean`` hands them on; the verdicts are the same."""
    rows = [(i, "shared line here\n" + " ".join(f"w{i}x{k}" for k in range(40)), "s") for i in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = plain.withColumns({c: F.lit(f"old {c}") for c in quality.RESULTS})
    pick = lambda df: sorted((r["doc_id"], *(r[c] for c in quality.RESULTS)) for r in df.collect())
    assert pick(quality.judge(clash)) == pick(quality.judge(plain))
    cleaned = quality.clean(clash)
    assert cleaned.columns == clash.columns and all(r[c] == f"old {c}" for r in cleaned.collect() for c in quality.RESULTS)
    assert sorted((r["doc_id"], r["text"]) for r in cleaned.collect()) == sorted((r["doc_id"], r["text"]) for r in quality.clean(plain).collect())
