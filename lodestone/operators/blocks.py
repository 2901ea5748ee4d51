"""Searches for stored queries over a stored index, in blocks of both.

Queries are packed into rows of up to a few thousand each, index rows into
chunks as they are read, and each chunk meets each block: tasks see one pair at
a time, so neither the driver nor a task ever holds all queries, and there are as
many jobs for one query as for a million. A task keeps the k best of each query
and passes these on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import staged

CHUNK_ROWS = 1024
CHUNK_BYTES = 4 << 20
TILE_CELLS = 1 << 20  # scores at once
ROWS_HELD = 1 << 17  # hits of a block, with ties, between two cuts
BLOCKS_HELD = 8  # of queries, prepared, and their best so far, in a task
HITS = "query_id long, id long, score double"


class Best:
    """The k best hits above `above` of each query of a block, of scores that
    come in tiles. Ties of the kth stay until there are too many rows."""

    def __init__(self, queries: np.ndarray, k: int, above: float = -math.inf):
        self.queries, self.k, self.above = queries, k, above
        self.least = np.full(len(queries), -math.inf)  # of the kth hit so far
        self.parts, self.rows, self.room = [], 0, max(ROWS_HELD, 2 * k * len(queries))

    def add(self, ids: np.ndarray, scores: np.ndarray, places: np.ndarray | None = None) -> None:
        """Scores by id and query, of all queries or of those at `places`."""
        least = self.least if places is None else self.least[places]
        step = max(1, TILE_CELLS // max(1, len(least)))
        for start in range(0, len(ids), step):
            part = scores[start : start + step]
            at, q = np.nonzero((part >= least) & (part > self.above))
            self.parts.append((q if places is None else places[q], ids[start + at], part[at, q]))
            self.rows += len(q)
            if self.rows > self.room:
                self._cut()

    def _cut(self) -> None:
        q, ids, scores = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.least[q[last]] = scores[last]
        kept = place < self.k
        self.parts = [(q[kept], ids[kept], scores[kept])]
        self.rows = int(np.count_nonzero(kept))

    def hits(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._cut()
            for q, ids, scores in self.parts:
                yield pa.RecordBatch.from_arrays([pa.array(self.queries[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "id", "score"])


def query_blocks(queries: DataFrame, count: int, at_once: int) -> DataFrame:
    """(block, asked): the rows of about `at_once` of `count` queries, all rows of
    a query together, as a written table."""
    blocks = math.ceil(count / at_once) or 1
    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct(*queries.columns)).alias("asked"))
    return staged(packed, "query-blocks")


def index_chunks(index: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of `index` packed as they are read, without a shuffle: by `rows`, and
    by about CHUNK_BYTES where rows are long."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(rows, batch.num_rows * CHUNK_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], part.schema.names)

    return index.mapInArrow(pack, ", ".join(f"{name} array<{kind}>" for name, kind in index.dtypes))


def search(index: DataFrame, blocks: DataFrame, k: int, prepare: Callable, score: Callable, above: float = -math.inf, rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, id, score): the k best hits above `above` of each query among
    the rows that a task sees, to be ranked over all tasks.

    `prepare(*columns of asked)` makes of a block's Arrow columns what
    `score(prepared, *columns of the index)` takes, with its query ids first;
    that gives (ids, scores by id and query) once or several times a chunk, and
    the places of the queries where it isn't all of them.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            block_of = batch.column("block").to_pylist()
            for row, block in enumerate(block_of):
                if block not in held:
                    if len(held) >= BLOCKS_HELD:
                        for _, top in held.values():
                            yield from top.hits()
                        held = {}
                    prepared = prepare(*batch.column("asked")[row].values.flatten())
                    held[block] = prepared, Best(prepared[0], k, above)
                prepared, top = held[block]
                for found in score(prepared, *[batch.column(c)[row].values for c in names]):
                    top.add(*found)
        for _, top in held.values():
            yield from top.hits()

    names = index.columns
    return index_chunks(index, rows).crossJoin(blocks).mapInArrow(best, HITS)  # chunks and blocks, not rows


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
