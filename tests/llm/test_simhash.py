import random

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

rng = random.Random(5)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows):
    """(id, print) -> {row: smallest reachable id}, by comparing all pairs."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {}
    for (i, _), l in zip(rows, label):
        low[l] = min(low.get(l, i), i) if i is not None else low.get(l)
    return [low[l] for l in label]


def test_segments_within_two_bits_share_a_codeword():
    words = np.array([rng.getrandbits(21) for _ in range(60)])
    for x in words:
        others = [x ^ (1 << a | 1 << b) for a in range(21) for b in range(21)]
        keys, ok = simhash.segment_keys(np.array([x, *others]))
        own = set(keys[0][ok[0]])
        assert len(own) in (1, 6)
        assert all(own & set(k[o]) for k, o in zip(keys[1:], ok[1:]))


def test_prints_within_four_bits_share_a_key():
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        at, keys = simhash.fingerprint_keys(np.array([x, y], dtype=np.uint64))
        assert set(keys[at == 0]) & set(keys[at == 1])


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c d", "A b C d e f g é Ü  x", "w " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def corpus():
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(300)] = rng.choice(words)
            docs.append(" ".join(text))
    docs += [None, "", "  ", "one", "one", "ONE"]
    rng.shuffle(docs)
    return [(1000 - i, t, 0, "x") for i, t in enumerate(docs)] + [(None, "one", 1, "y"), (1000, docs[0], 2, "z")]


@pytest.mark.parametrize("hot", [4096, 4])
def test_groups_match_all_pairs(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, print long, component_id string")
    found = sorted((tuple(r) for r in simhash.near_duplicates(docs, hot_key=hot).collect()), key=str)
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    expected = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=str)
    assert found == expected


def test_empty_table_and_keep_one(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", "p"), (2, "a b c d e", "q"), (3, "other words here now ok", "r")], "doc_id long, text string, s string")
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == [(1, "a b c d e", "p"), (3, "other words here now ok", "r")]
