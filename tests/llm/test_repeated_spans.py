import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm.repeated_spans import anchored_runs, remove_repeats, repeated_windows


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in bodies for s in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(30), prose(12)
    rows = [(i, prose(rng.randint(0, 60))) for i in range(40)]
    rows += [(100 + i, prose(rng.randint(1, 9)) + passage + prose(rng.randint(1, 9))) for i in range(40)]
    rows += [(200, line + "\n" + line), (201, "ab" * 150), (202, "a" * 300), (203, "xyz" + "a" * 120)]
    rows += [(300, rows[3][1]), (301, rows[50][1]), (302, None), (303, ""), (None, prose(30)), (300, rows[3][1])]
    return rows


@pytest.mark.parametrize("length, crowd, block", [(40, 2000, 1 << 20), (40, 5, 500), (25, 3, 1), (200, 2000, 1 << 20)])
def test_equals_brute_force(spark, length, crowd, block):
    rows = corpus(length)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, digest string, tid long").repartition(3)
    found = remove_repeats(docs, length, crowd, block).drop("spans").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, length)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).collect() == []


def test_blocks_equal_brute_force():
    rng = np.random.default_rng(3)
    for alphabet in (2, 3, 256):
        pieces = [bytes(rng.integers(0, alphabet, n, dtype=np.uint8)) for n in rng.integers(1, 60, 40)]
        pieces += [p + b"\x00\xff" + p for p in pieces[:6]] + [b"\x01" * 30, b"\x01" * 9]
        for length in (1, 4, 9):
            seen = Counter(p[s : s + length] for p in pieces for s in range(len(p) - length + 1))
            expected = [[seen[p[s : s + length]] > 1 for s in range(len(p) - length + 1)] for p in pieces]
            assert [x.tolist() for x in repeated_windows(pieces, length)] == expected


def test_runs_hold_every_window_once_under_a_key_of_its_content():
    data = np.frombuffer(("ab" * 40 + "hello world, " * 9 + "".join(map(str, range(90)))).encode(), dtype=np.uint8)
    keys = {}
    for k in (7, 20):
        first, windows, key, _ = anchored_runs(data, k, 20)
        owned = np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows, strict=True)])
        assert owned.tolist() == list(range(len(data) - 19))
        for s, one in zip(owned.tolist(), np.repeat(key, windows).tolist(), strict=True):
            assert keys.setdefault((k, data[s : s + 20].tobytes()), one) == one
