import random

import numpy as np
from voxelloom.llm import decontaminate


def brute(text, item):
    """Whether any stretch of 13 tokens or more, or the whole shorter item, has four of five equal."""
    a, b = text.lower().split(), item.lower().split()
    least = min(13, len(b))
    for d in range(-len(b) + 1, len(a)):
        same = [a[i] == b[i - d] for i in range(max(d, 0), min(len(a), len(b) + d))]
        for i in range(len(same)):
            equal = 0
            for j in range(i, len(same)):
                equal += same[j]
                if least and j - i + 1 >= least and 5 * equal >= 4 * (j - i + 1):
                    return True
    return False


def test_whole_query_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 9, 12, 13, 20, 40])))) for i in range(25)]
    items.append((25, items[7][1]))
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if i % 2:
            part = items[rng.randrange(26)][1].split()
            for k in range(len(part)):
                if rng.random() < 0.15:
                    part[k] = rng.choice(vocabulary)
            words[5:5] = part
        docs.append((i, " ".join(words)))
    docs += [(60, None), (61, "")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                     spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = {(d, i) for d, t in docs for i, x in items if brute(t or "", x)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 30
    texts, benchmark = dict(docs), dict(items)
    for r in got:
        a, b = texts[r["doc_id"]].split()[r["first_token"]:][:r["n_tokens"]], benchmark[r["item_id"]].split()
        assert r["n_tokens"] == len(a) >= min(13, len(b)) and 5 * r["n_equal"] >= 4 * len(a)
        assert any(sum(x == y for x, y in zip(a, b[k:])) == r["n_equal"] for k in range(len(b)))


def test_diagonals_equal_all_pairs(monkeypatch):
    monkeypatch.setattr(decontaminate, "MEETINGS", 50)
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = (rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint64) for _ in range(2))
        known, at = decontaminate.seeds_of(b)
        h, p = decontaminate.seeds_of(a)
        want = {int(q - k) for x, q in zip(h, p) for y, k in zip(known, at) if x == y}
        assert set(decontaminate.diagonals(h, p, b, len(a)).tolist()) == want


def test_one_word_repeated(spark):
    docs = spark.createDataFrame([(1, "na " * 20000), (2, "na " * 12), (3, "other words " * 9000)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "na " * 800), (2, "na " * 700 + "batman")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["first_token"], r["n_tokens"], r["n_equal"])
           for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1): (0, 800, 800), (1, 2): (0, 700, 700)}


def test_filters_keep_columns_that_are_named_like_keys(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, words, 5, 6, 7), (2, "clean", 5, 6, 7)], "doc_id bigint, text string, _key1 int, _Key1a int, k1 int")
    left = decontaminate.decontaminated(docs, spark.createDataFrame([(1, words)], "item_id bigint, text string"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean", 5, 6, 7)]
