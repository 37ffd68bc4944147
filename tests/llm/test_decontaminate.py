import random

from skyweave.llm import decontaminate as D

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old tower"


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[:], i
        for j, t in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t))
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        p = "".join(rng.choice("ab c") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 90)))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert D.nearest(masks, len(p), t)[0] == distance(p, t)


def test_finds_what_brute_force_finds(spark):
    rng = random.Random(5)
    items = [(1, ITEM), (2, ITEM.upper() + "!"), (3, None), (4, ""), (5, "short one")]
    docs = [(0, None), (1, ""), (2, ITEM), (2, ITEM), (3, "x" * 200_000 + " " + ITEM), (4, "nothing here"), (None, "a Short, one.")]
    for k in range(60):
        text = list(f"before {ITEM} after")
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(text))
            text[at] = rng.choice(["", "z", text[at] + "q"])
        docs.append((10 + k, "".join(text)))
    table = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, matches int")
    found = D.match(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(docs)
    by_text = {r["text"]: {m["item_id"]: m["distance"] for m in r["matches"]} for r in found}
    for _, text in docs:
        expected = {}
        for i, item in items:
            n = D.normal(item or "")
            e = D.budget(len(n), 0.1, 12)
            near = distance(n, D.normal((text or "")[-3000:])) if n else 99
            if near <= e:
                expected[i] = near
        assert by_text[text] == expected, text
    assert D.clean(table, spark.createDataFrame(items, "item_id long, text string")).where("doc_id in (0, 1, 4)").count() == 3


def test_every_edit_of_the_rate_counts(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items, docs = [], []
    for k, m in enumerate([7, 10, 15, 19, 23, 24, 36, 40, 57, 100, 394]):
        item = "".join(rng.choice(letters) for _ in range(m))
        items.append((k, item))
        for n in (int(m * 0.1), int(m * 0.1) + 1):
            text = list(item)
            for at in range(n):
                text[min(m - 1, m * (2 * at + 1) // (2 * n))] = "0"  # a digit in the middle of each of n stretches
            docs.append((100 * k + n, "12345 " + "".join(text) + " 67890"))
    found = D.match(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(docs)
    for r in found:
        k, n = divmod(r["doc_id"], 100)
        item = items[k][1]
        near = distance(item, D.normal(r["text"]))
        assert {m["item_id"]: m["distance"] for m in r["matches"]} == ({k: near} if near <= int(len(item) * 0.1) else {}), (item, n)
        assert near == n


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "art"), (2, "Go on!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a party started"), (2, "modern ART, they said"), (3, "cargo only"), (4, "we go on"), (5, "art")], "doc_id long, text string")
    assert {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in D.match(docs, items).collect()} == {1: [], 2: [1], 3: [], 4: [2], 5: [1]}


def test_blocks_of_items_and_empty_tables(spark):
    items = spark.createDataFrame([(i, f"{i} {ITEM} {i}") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"7 {ITEM} 7")], "doc_id long, text string")
    many = D.match(docs, items, block=300).first()["matches"]
    assert sorted(m["item_id"] for m in many) == list(range(20)) and {m["item_id"]: m["distance"] for m in many}[7] == 0
    assert D.match(docs, items.limit(0)).first()["matches"] == []
    assert D.match(docs.limit(0), items).count() == 0
