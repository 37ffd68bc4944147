"""Tries of conversations against plain dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from skyweave.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, block=None):
    """Rows in turn's order within a conversation, no ties."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    built = dict(own)
    if block:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        built = {c: own.get(c - c % block, [])[: heads[c]] + own[c][heads[c] :] for c in own}
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        words = len([w for w in node[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if node else 0
        sums[node] = (1 if not kids[node] else sum(sums[k][0] for k in kids[node]), (len(members[node]) - 1) * words + sum(sums[k][1] for k in kids[node]))
    out = set()
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), *sums[node], digest))
    return out


def found(spark, rows, **how):
    made = prefixes.trie(spark.createDataFrame(rows, SCHEMA), **how).select(*COLUMNS).collect()
    assert len(made) == len(set(made))
    return set(map(tuple, made))


def sample(seed, n=300):
    draw = random.Random(seed)
    texts = ["", "one", "two words", "three\tof them", None]
    rows = []
    for c in draw.sample(range(2 * n), n):
        for t in range(draw.randint(1, 9)):
            rows.append((c, None if t == 0 and draw.random() < 0.3 else t, draw.choice(["user", None, "assistant"]) if t > 2 else "user", draw.choice(texts[:2] if t < 3 else texts)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [None, 20])
@pytest.mark.parametrize("band", [1, 3, 4096])
def test_same_as_brute_force(spark, block, band):
    rows = sample(band)
    assert found(spark, rows, block=block, band=band) == brute(rows, block)


def test_shards_agree(spark, monkeypatch):
    rows = sample(5)
    monkeypatch.setattr(prefixes, "SHARD", 40)
    monkeypatch.setattr(prefixes, "NEAR", 1)
    monkeypatch.setattr(prefixes, "RUN", 2)
    assert found(spark, rows, block=20, band=4) == brute(rows, 20)


def test_one_long_conversation_and_its_copy(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (7, 90) for t in range(2000)] + [(8, t, "user", "turn 0") for t in range(3)]
    assert found(spark, rows, band=256) == brute(rows)


def test_conversations_without_a_turn_left(spark):
    # crc32("3") % 4 is 3 and there is no conversation 0: all of it goes, and it ends at the root.
    assert zlib.crc32(b"3") % 4 == 3
    rows = [(3, 1, "user", "a"), (3, 2, "user", "b")]
    assert found(spark, rows, block=20) == brute(rows, 20) == {(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())}


def test_odd_rows(spark):
    assert found(spark, []) == set()
    rows = [(None, 1, "user", "lost"), (1, 1, "user", "x y"), (2, 1, "user", "x y"), (2, 2, "us", "erx")]
    assert found(spark, rows) == brute(rows)
    twice = [(1, 1, "user", "b"), (1, 1, "user", "a"), (2, 1, "user", "a"), (2, 1, "user", "b"), (1, 1, "user", "a"), (2, 1, "user", "a")]
    made = found(spark, twice)  # rows of one turn come in some fixed order, the same in either conversation
    assert {r[3] for r in made} == {2} and {r[1] for r in made} == {0, 1, 2, 3}
    named = spark.createDataFrame([(1, 1, "user", "x", 5, "y")], SCHEMA + ", n1 long, words string")
    assert prefixes.trie(named, block=20).count() == 1 + (zlib.crc32(b"1") % 4 == 0)
    long = [(1, 1, "user", "w " * 500_000), (2, 1, "user", "w " * 500_000)]
    assert found(spark, long) == brute(long)


def test_slots_are_minimal_and_perfect():
    draw = np.random.default_rng(1)
    keys = np.unique(draw.integers(0, 1 << 62, (5000, 2)).astype(np.uint64), axis=0)
    slots = prefixes.Slots(keys[:, 0], keys[:, 1])
    assert sorted(slots(keys[:, 0], keys[:, 1])) == list(range(len(keys)))
    assert (slots(keys[:, 1], keys[:, 0]) == -1).all()
    assert len(prefixes.Slots(keys[:0, 0], keys[:0, 1])(keys[:9, 0], keys[:9, 1])) == 9
