import random

from pyspark.sql import functions as F

from skyweave.llm import columns


def brute(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    letter = lambda n: "".join(rng.choice("ab cdé") for _ in range(n))
    shared, other = letter(500), letter(300)
    texts = [None, "", "short", shared, shared, letter(900), "x" + shared + letter(50), letter(40) + shared[:399], letter(40) + shared[90:] + "y"]
    texts += [other * 4, "ab" * 600, letter(3000) + shared[20:460] + letter(100) + shared[:420], letter(60) + shared[50:470] + letter(30)]
    texts += [letter(20) + shared[k : k + 430] + letter(40) for k in range(0, 60, 7)] + [letter(20_000)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, shared, 1), (5, texts[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int")
    expected = brute([r[1] for r in rows], 400)
    as_set = lambda x: sorted(map(str, x))
    passages = brute([r[1] for r in rows], 300)
    # Every anchor with two kinds of pieces or more counts as crowded, too.
    for group, short in ((1024, None), (1024, 300), (1, 300)):
        found = columns.deduplicate(docs, group=group, short=short).select("doc_id", "n_bytes", "n_removed", "n_spans", "n_repeated", F.col("kept")).collect()
        wanted = ((rows[i][0], *e[:3], (passages[i] if short else e)[1], e[3]) for i, e in enumerate(expected))
        assert as_set((r[0], *map(int, r[1:5]), bytes(r[5])) for r in found) == as_set(wanted)
    assert columns.deduplicate(docs.limit(0)).count() == 0


def test_rounds_sort_and_share_prefixes():
    import numpy as np

    words = [b"banana", b"bananas", b"anana", b"ban"]
    frame = np.zeros((4, 7), np.uint8)
    for k, w in enumerate(words):
        frame[k, : len(w)] = np.frombuffer(w, np.uint8)
    last = np.array([len(w) - 1 for w in words])
    x, order, common = list(columns.construct(frame, np.zeros(4, int), last, np.zeros(4, int)))[-1]
    assert x == 0 and [words[k] for k in order] == sorted(words) and common.tolist() == [0, 0, 3, 6]
