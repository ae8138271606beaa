"""The trie against a plain one, with one range and with many, on small tables with every odd case."""

import hashlib
import random
import zlib

import pytest

from packlens.llm import conversation_trie as ct

TURN = "conv_id bigint, turn bigint, role string, text string, path string, depth int"


def rebuilt(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(ts, key=lambda v: v[:2])] for c, ts in convs.items()}
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(convs.get(c - c % 100, [])[:h]) + tuple(ts[h:])
    return out


def plain_trie(paths):
    nodes, kids, leaves, saved, out = {}, {}, {}, {}, []
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    for n in sorted(nodes, key=len, reverse=True):
        own = kids.get(n, [])
        leaves[n] = sum(leaves[x] for x in own) or 1
        saved[n] = sum(saved[x] for x in own) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[n] if len(paths[c]) == len(n))))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(nodes[n]), len(n), parent, len(nodes[n]), len(own), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    r = random.Random(3)
    rows = []
    for c in [*range(100, 160), *range(300, 330), *range(205, 260)]:  # 200 itself is absent
        for t in range(r.randint(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "x🙂y", "yes\nno"]) if t else "hello", "p", 7))
    for c in range(1000, 1040):  # the same conversation over and over
        rows += [(c, t, "user", f"turn {t}", "p", 7) for t in range(7)]
    rows += [(400, t, "user", "deep", "p", 7) for t in range(60)] + [(401, t, "user", "deep", "p", 7) for t in range(61)]
    rows += [(500, None, "user", "first", "p", 7), (500, 0, "user", "second", "p", 7), (500, 0, "user", "second", "p", 7), (None, 0, "user", "none", "p", 7)]
    return rows


@pytest.mark.parametrize(("range_turns", "piece"), [(50_000, 20_000), (100, 20_000), (40, 2)])
def test_trie_is_that_of_a_plain_one(spark, monkeypatch, range_turns, piece):
    monkeypatch.setattr(ct, "RANGE_TURNS", range_turns)
    monkeypatch.setattr(ct, "PIECE", piece)
    rows = conversations()
    table = spark.createDataFrame(rows, TURN).repartition(4)
    paths = ct.shared_beginnings(ct.turns(table))
    if range_turns < 1000:
        assert len(ct.splitters(ct.packed(paths))) > 2
    found = sorted(map(tuple, ct.trie(paths).collect()), key=str)
    assert found == plain_trie(rebuilt(rows))


def test_a_conversation_can_be_without_turns_and_a_table_empty(spark):
    none = next(c for c in range(601, 700) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(none, 0, "user", "gone", "p", 7)]
    table = spark.createDataFrame(rows, TURN)
    found = [tuple(r) for r in ct.trie(ct.shared_beginnings(ct.turns(table))).collect()]
    assert found == plain_trie(rebuilt(rows)) == [(none, 0, None, 1, 0, 1, 0, hashlib.sha256(str(none).encode()).hexdigest())]
    assert ct.trie(ct.shared_beginnings(ct.turns(table.limit(0)))).isEmpty()


def test_borders_take_no_more_bytes_than_allowed(spark, monkeypatch):
    monkeypatch.setattr(ct, "RANGE_TURNS", 40)
    keys = ct.packed(ct.shared_beginnings(ct.turns(spark.createDataFrame(conversations(), TURN))))
    many = ct.splitters(keys)
    monkeypatch.setattr(ct, "BORDER_BYTES", sum(len(k) for k, _ in many) // 2)
    few = ct.splitters(keys)
    assert set(few) < set(many) and sum(len(k) for k, _ in few) < sum(len(k) for k, _ in many)
