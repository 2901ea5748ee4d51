import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from oracle import compare, database

from lodestone.llm import importance

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute_force(rows, target):
    s, t = (Counter(bucket(f) for text in texts for f in features_of(text)) for texts in ([x for _, x in rows], target))
    total_s, total_t = s.total() + 10_000.0, t.total() + 10_000.0
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * total_s) / ((s[b] + 1) * total_t)))
    out = []
    for i, text in rows:
        found = features_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append((i, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return out, able[: 5 * len(able) // 100]


def odd_texts(n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abZ9é中") for _ in range(rng.choice([1, 2, 3, 9, 63, 64, 65, 66, 200])))
    return ["".join(word() + rng.choice([" ", "-", "\x00", ". ", "_"]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 700, 40])
def test_runs_and_draw_equal_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    if slice_bytes < 1 << 20:  # workers import the module anew, so the pieces are checked here
        import numpy as np
        import pyarrow as pa

        texts = [None, "", *odd_texts(40), "x" * 5000, "One two  THREE"]
        for row, text in enumerate(texts):
            got = Counter()
            for data, starts, carried, rows in importance._slices(pa.array(texts)):
                found = importance.runs(data, starts, carried, 10_000)
                got.update(found.bucket[np.asarray(rows)[found.segment] == row].tolist())
            assert got == Counter(bucket(f) for f in features_of(text)), text
        return
    rows = [(i, t) for i, t in enumerate(odd_texts(120))] + [(None, "to be or not " * 30), (5, "a b c " * 90), (7, None), (8, ""), (9, "same " * 40), (10, "same " * 40), (11, "w" * 200_000 + " tail")]
    target = ["a b c d", "to be or not to be", None]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, rank string").repartition(3)
    found = importance.importance_resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    scored, drawn = brute_force(rows, target)
    assert Counter(tuple(r)[:5] for r in found) == Counter(scored)
    assert [tuple(r)[:5] for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1))


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, 7 if i % 2 else 9, i != 4) for i in range(100)], "doc_id long, score long, able boolean")
    found = importance.draw_highest(rows, rows["able"], 60).filter("rank IS NOT NULL").orderBy("rank").collect()
    evens = [i for i in range(0, 100, 2) if i != 4]
    assert [r["doc_id"] for r in found] == (evens + list(range(1, 100, 2)))[: 99 * 60 // 100]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_resample(none, none).collect() == []
    alone = importance.importance_resample(spark.createDataFrame([(1, "a")], "doc_id long, text string"), none).first()
    assert alone["n_features"] == 1 and alone["rank"] is None


def test_query_equals_its_sql(spark):
    compare(importance.op13_importance(spark, SF), database(SF), importance.OP13_SQL)
