import random

import numpy as np

from skyweave.llm import chunks


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_gear_is_the_rolling_sum():
    data = np.frombuffer(b"some bytes that roll through the gear, more than thirty-two of them", np.uint8)
    h = 0
    for b, got in zip(data, chunks.gear(data)):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFFFFFF
        assert h == got


def test_passages(spark):
    rng = random.Random(1)
    shared = words(rng, 120)
    texts = [(1, words(rng, 200)), (2, words(rng, 30) + shared + words(rng, 50)), (3, "z" + shared), (4, None), (5, ""), (6, words(rng, 300))]
    texts += [(7, texts[5][1]), (7, texts[5][1]), (None, shared), (8, "short line\n" + words(rng, 40)), (9, "short line\n" + words(rng, 40)), (10, "q" * 50_000)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, size int")
    rows = chunks.deduplicate(docs).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    for i in (1, 4, 5, 8, 9):
        assert by[i]["n_repeated"] == by[i]["n_removed"] == 0, i
    assert by[2]["n_repeated"] > len(shared) / 2 and by[3]["n_repeated"] > len(shared) / 2
    assert by[6]["n_removed"] == 0 and by[7]["n_removed"] > 0.5 * by[7]["n_bytes"]
    text = dict(texts)[7].encode()
    assert len(chunks.removed(text, by[7]["spans"])) == by[7]["n_bytes"] - by[7]["n_removed"]
    assert chunks.deduplicate(docs.limit(0)).count() == 0


def plain(rows, run=160, anchor=24, gap=24, bits=5, least=12, most=256):
    """The operator by its definition, a byte at a time."""
    found = []  # (row, start, end, digest)
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        h, ends = 0, []
        for i, x in enumerate(b):
            h = ((h << 1) + int(chunks.GEAR[x])) & 0xFFFFFFFF
            if h >> (32 - bits) == 0 and i + 1 >= chunks.REACH:
                ends.append(i + 1)
        ends = sorted({*ends, *([len(b)] if b else [])})
        a = 0
        for e in ends:
            while e - a > most:
                found.append((k, a, a + most, b[a : a + most]))
                a += most
            found.append((k, a, e, b[a:e]))
            a = e
    found = [f for f in found if f[2] - f[1] >= least]
    distinct = {(rows[k], a, e): c for k, a, e, c in found}
    often = {}
    for k, a, e, c in found:
        often[c] = often.get(c, 0) + 1
    out = []
    order = lambda r: (rows[r][0] is not None, rows[r][0] or 0)
    for k, row in enumerate(rows):
        mine = sorted((a, e, c) for j, a, e, c in found if j == k and often[c] > 1)
        runs = []
        for a, e, c in mine:
            if runs and a - runs[-1][-1][1] < gap:
                runs[-1].append((a, e, c))
            else:
                runs.append([(a, e, c)])
        good = [x for r in runs if r[-1][1] - r[0][0] >= run and max(e - a for a, e, _ in r) >= anchor for x in r]
        out.append((row[0], len((row[1] or "").encode()), sum(e - a for a, e, _ in good), good))
    return out, found, distinct, order


def test_against_plain_definition(spark):
    """Which bytes repeat, row by row; and of each chunk all go but the first
    of the table, so that what stays holds it once."""
    rng = random.Random(7)
    shared = [words(rng, n) for n in (60, 90, 25, 8)]
    rows = [(i, " ".join(rng.choice([words(rng, 40), rng.choice(shared)]) for _ in range(rng.randint(1, 4)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "é" * 900), (53, "é" * 700), (None, shared[0] + " x"), rows[3], rows[3]]
    got = sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_repeated"]) for r in chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    expected, *_ = plain(rows)
    assert got == sorted(map(str, (e[:3] for e in expected)))
    # Rows of one id and text share their first occurrence; leave one of them for the rest.
    once = list(dict.fromkeys(rows))
    found = {(r["doc_id"]): r for r in chunks.deduplicate(spark.createDataFrame(once, "doc_id long, text string")).collect()}
    expected, *_ = plain(once)
    where: dict = {}
    for i, _, _, good in expected:
        for a, e, c in good:
            gone = any(int(x.split(":")[0]) <= a and e <= int(x.split(":")[1]) for x in filter(None, found[i]["spans"].split(",")))
            where.setdefault(c, []).append(gone)
    assert where and all(v.count(False) <= 1 for v in where.values())
    assert sum(v.count(False) == 1 for v in where.values()) > 0.8 * len(where)


def test_all_repeated_chunks(spark):
    """Equal chunks are counted wherever they are, each but the first of the
    table once more."""
    rng = random.Random(17)
    lines = [words(rng, n) for n in (3, 5, 12)]
    rows = [(i, "\n".join(rng.choice([words(rng, 20), rng.choice(lines)]) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(70, None), (71, "b" * 3000)]
    got = {r["doc_id"]: (r["n_equal"], r["n_again"]) for r in chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    _, found, _, _ = plain(rows)
    often, first = {}, {}
    for k, a, e, c in found:
        often[c] = often.get(c, 0) + 1
    th = dict(zip((r[0] for r in rows), range(len(rows))))
    equal, again = dict.fromkeys(th, 0), dict.fromkeys(th, 0)
    for k, a, e, c in sorted(found):
        if often[c] > 1:
            equal[rows[k][0]] += e - a
            again[rows[k][0]] += (e - a) * (c in first)
            first.setdefault(c, k)
    assert got == {i: (equal[i], again[i]) for i in th} and sum(again.values()) > 500
