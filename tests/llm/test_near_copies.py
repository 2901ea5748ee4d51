import random

import numpy as np
import pytest

from lodestone.llm import simhash


def _shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _share(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _pair(rng, least, most):
    """A text and an edited copy whose share of shingles lies in a range."""
    words = [f"w{i}" for i in range(5000)]
    while True:
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        copy = list(base)
        for _ in range(rng.randint(1, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        if least <= _share(" ".join(base), " ".join(copy)) < most:
            return " ".join(base), " ".join(copy)


@pytest.mark.parametrize("texts", [None, 1_000_000, 1_000_000_000])
def test_lone_pairs_are_found_at_every_size(spark, texts):
    rng = random.Random(12)
    pairs = [_pair(rng, *r) for r in [(0.8, 0.82)] * 150 + [(0.82, 1.0)] * 100 + [(0.7, 0.8)] * 60]
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string").repartition(3)
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs, texts).collect()}
    found = [group[2 * i + 1] == 2 * i for i in range(len(pairs))]
    assert sum(found[:150]) >= 140 and sum(found[150:250]) >= 97 and not any(found[250:])
    assert len(set(group.values())) == 2 * len(pairs) - sum(found)


def test_blocks_grow_with_the_texts():
    assert [simhash.key_plan(n)[0] for n in (0, 1000, 1_000_000, 1_000_000_000)] == [7, 16, 26, 36]
    rng = np.random.default_rng(1)
    prints = rng.integers(-(1 << 63), 1 << 63, (40, simhash.LANES))
    keys = simhash.block_keys(prints, 24, 200)
    assert keys.shape == (40, 200) and len(np.unique(keys)) == keys.size
    per = simhash.WIDE // 24
    close = prints.copy()
    for row in close:  # fewer bits differ than there are blocks
        for bit in rng.choice(simhash.WIDE, per - 1, replace=False):
            row[bit // 64] ^= np.int64(np.uint64(1 << int(bit % 64)).view(np.int64))
    same = simhash.block_keys(close, 24, 200) == keys
    assert all(same[:, at : at + per].any(axis=1).all() for at in range(0, 200 - per, per))


@pytest.mark.parametrize("first_part", [1, 8, 10_000])
def test_crowds_equal_brute_force(spark, monkeypatch, first_part):
    monkeypatch.setattr(simhash, "FIRST_PART", first_part)
    rng = random.Random(13)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = [" ".join(w if rng.random() > 0.012 else f"x{rng.randrange(9)}" for w in base) for _ in range(60)] + [None, "", "one two", "One two"]
    root = {i: i for i in range(len(texts))}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(texts):
        for j in range(i):
            if _share(a, texts[j]) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs, 1).collect()} == {i: find(i) for i in range(len(texts))}
