"""Token counts, files and packing against the library itself."""

import json
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packlens.llm import packing, token_count, token_output, tokens
from packlens.llm.common import scratch, shared_dir
from packlens.llm.tokens import PieceEncoder, encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA19 '\n\tstreveld.!ßé|<>")), max_size=60)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_ids_are_the_librarys(path, text):
    code = encoder(path)
    assert code.encode(text) == np.asarray(code.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr("packlens.llm.tokens.MAX_PIECES", 3)
    code = PieceEncoder(BYTE)
    for text in ("one two three four five", "one six seven", "\n\n  one  \n two"):
        assert np.frombuffer(code.encode(text), "<u4").tolist() == ids_of(BYTE, text)


def test_counts(spark, odd):
    cache = scratch(spark, "cache")
    got = token_count.count_tokens(odd, WORD, cache).collect()
    assert len(got) == odd.count()
    for r in got:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(ids_of(WORD, text)))
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    stored = spark.read.parquet(cache)
    assert stored.count() == odd.fillna("", ["text"]).select("text").distinct().count()
    # what is stored isn't encoded again, by another run or for other rows
    again = token_count.count_tokens(odd.unionByName(odd.limit(3)), WORD, cache)
    assert spark.read.parquet(cache).count() == stored.count()
    assert again.count() == odd.count() + 3
    other = token_count.count_tokens(odd, BYTE, cache)
    assert spark.read.parquet(cache).count() == 2 * stored.count()
    assert {r["n_tokens"] for r in other.where("doc_id = 47").collect()} == {len(ids_of(BYTE, "one"))}


def test_counts_of_nothing(spark, empty):
    assert token_count.count_tokens(empty, WORD, scratch(spark, "cache")).collect() == []


def test_many_tasks_add_few_files(spark, odd):
    many = {"spark.sql.shuffle.partitions": 40, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in many}
    cache, shared = scratch(spark, "cache"), Path(shared_dir(spark).removeprefix("file://"))
    written = lambda: set(shared.rglob("part-*.parquet"))
    old = written()
    try:
        for key, value in many.items():
            spark.conf.set(key, value)
        half = F.col("doc_id") % 2 == 0
        token_count.count_tokens(odd.where(half), WORD, cache)
        got = token_count.count_tokens(odd, WORD, cache)
        # nothing but the cache is written, and a few files in each of two turns
        assert all(str(f).startswith(cache.removeprefix("file://")) for f in written() - old)
        assert 0 < len(written() - old) <= 2 * token_count.FILES
        assert Counter((r["doc_id"], r["text"], r["n_tokens"]) for r in got.collect()) == Counter(
            (r["doc_id"], r["text"], len(ids_of(WORD, r["text"]))) for r in odd.collect()
        )
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_only_remembered_contents_are_looked_up(spark, odd):
    cache, some = scratch(spark, "cache"), F.coalesce(F.col("doc_id") < 20, F.lit(False))
    token_count.remember(odd.where(some), WORD, cache)
    held = {r["text"] or "" for r in odd.where(some).collect()}
    got = token_count.look_up(odd, WORD, cache).collect()
    assert len(got) == odd.count()
    assert {(r["n_tokens"] is not None) == ((r["text"] or "") in held) for r in got} == {True}


def test_files_round_trip(spark, odd):
    path = scratch(spark, "ids")
    token_output.write(odd, WORD, path, end=1, files=3)
    got = token_output.read(spark, path).collect()
    want = [(r["doc_id"], r["text"], [*ids_of(WORD, r["text"]), 1]) for r in odd.collect()]
    assert Counter((r["doc_id"], crc(np.frombuffer(r["ids"], "<u4")), r["n_tokens"]) for r in got) == Counter((d, crc(i), len(i)) for d, _, i in want)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_file_of_another_dictionary(spark, odd, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_output.write(odd, WORD, path, end=1, files=2)
    fs, root = token_output._open(path)
    with pytest.raises(ValueError, match="another dictionary"):
        token_output.IdFile(fs, f"{root}/part-000000.ids", b"other")


@pytest.mark.parametrize(("path", "change"), [
    (BYTE, lambda s: s["pre_tokenizer"].update(add_prefix_space=True)),
    (WORD, lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[\p{L}]+|\S")),
    (WORD, lambda s: s["normalizer"]["normalizers"].pop()),
    (BYTE, lambda s: s["model"].update(ignore_merges=True)),
])
def test_files_of_another_layout_go_through_the_library(tmp_path, path, change):
    spec = json.loads(open(path, encoding="utf-8").read())
    change(spec)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["it's a Plain text, 12 words", " leading", "x-y  z"]
    code = tokens.PieceEncoder(str(other))
    assert code.kind is None
    assert [np.frombuffer(x, "<u4").tolist() for x in code.encode_many(texts)] == [Tokenizer.from_file(str(other)).encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.PieceEncoder(path).kind is not None


def test_files_of_nothing(spark, empty):
    path = scratch(spark, "ids")
    token_output.write(empty, WORD, path, end=1)
    assert token_output.read(spark, path).collect() == []


def test_packing(spark, odd):
    got = packing.pack(odd, BYTE, end=0, length=64, ranges=7).collect()
    want = [(r["doc_id"], [*ids_of(BYTE, r["text"]), 0]) for r in odd.collect()]
    by_place = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    stream, at = [], 0
    for r in by_place:
        assert r["sequence_id"] * 64 + r["offset"] == at  # gapless, nothing padded before the end
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["offset"] + r["length"] <= 64
        at += r["length"]
        if r["start"] == 0:
            stream.append([r["doc_id"], []])
        assert stream[-1][0] == r["doc_id"] and len(stream[-1][1]) == r["start"]
        stream[-1][1].extend(ids)
    assert Counter((d, tuple(i)) for d, i in stream) == Counter((d, tuple(i)) for d, i in want)
    rows = packing.sequences(packing.pack(odd, BYTE, end=0, length=64, ranges=7), 64).collect()
    assert all(len(r["ids"]) == 256 for r in rows)
    assert len(rows) == -(-at // 64)


def test_packing_nothing(spark, empty):
    assert packing.pack(empty, BYTE, end=0).collect() == []


def test_hilbert_neighbours_touch():
    side = np.arange(8)
    cube = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    order = cube[np.argsort(packing.hilbert(cube, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
