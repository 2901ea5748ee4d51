import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import blocks as B


def hits_of(top):
    return [tuple(r.values()) for batch in top.hits() for r in pa.Table.from_batches([batch]).to_pylist()]


def test_the_best_of_many_tiles_equal_a_plain_sort(monkeypatch):
    rng = np.random.default_rng(3)
    for cells, held in ((1 << 20, 1 << 17), (7, 5)):
        monkeypatch.setattr(B, "TILE_CELLS", cells)
        monkeypatch.setattr(B, "ROWS_HELD", held)
        queries, ids, scores = np.array([5, 9, 2]), rng.permutation(400), rng.integers(-2, 6, (400, 3)).astype(float)
        top = B.Best(queries, 4, 0.0)
        for start in range(0, 400, 37):
            top.add(ids[start : start + 37], scores[start : start + 37, [2, 0]], np.array([2, 0]))
            top.add(ids[start : start + 37], scores[start : start + 37, [1]], np.array([1]))
        want = [(int(q), int(i), -s) for n, q in enumerate(queries) for s, i in sorted((-scores[r, n], ids[r]) for r in range(400) if scores[r, n] > 0)[:4]]
        assert sorted(hits_of(top)) == sorted(want)
        assert hits_of(B.Best(queries, 4)) == []


def test_ties_do_not_fill_the_memory():
    top, scores = B.Best(np.arange(512), 10), np.zeros((4096, 512))
    tracemalloc.start()
    for n in range(4):
        top.add(np.arange(n * 4096, (n + 1) * 4096), scores)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20  # all ties of a chunk, sorted as a frame, took 290 MB
    assert len(hits_of(top)) == 5120


def test_long_texts_make_short_chunks(spark):
    texts = spark.range(64, numPartitions=1).select("id", F.repeat(F.lit("x"), 1 << 18).alias("text"))
    found = [len(r["id"]) for r in B.index_chunks(texts).select("id").collect()]
    assert sum(found) == 64 and max(found) <= 32
