"""Removal of byte strings that occur more than once, on a Burrows-Wheeler transform.

Every window of `length` bytes belongs to the anchor it holds: the hashed gram
that is least among its grams. Equal windows have equal anchors, so windows
meet by anchor, as pieces of text whose windows all have the same one; only
anchors that occur twice go on, and equal pieces go on once. Pieces of an anchor
are laid side by side with others up to a bounded block. On the block's
Burrows-Wheeler transform, intervals grow backward, breadth first, and set the
common prefixes of neighbouring suffixes by increasing value; the expansion
stops at `length`, and neighbours left without a value share a window. An
anchor with too many different pieces for a block is cut again by longer
anchors, at last by whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import staged, table

LENGTH = 200
CROWD = 2000
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 1 << 22
TEXTS_AT_ONCE = 64

_BASE = 0x9E3779B97F4A7C15
_SPOT = np.uint64((1 << 24) - 1)
_VALUES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up = np.cumprod(np.append(np.uint64(1), np.full(size - 1, _BASE, dtype=np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(np.uint64(1), np.full(size - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k bytes of a uint8 array."""
    up, down = _powers.get(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[data] * down, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[: len(data) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchored_runs(data: np.ndarray, k: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with the same anchor: first window, number
    of windows, the anchor's hash, and whether it stands at two places or more.
    Runs are at most as long as a window has grams."""
    grams = length - k + 1
    parts = []
    for at in range(0, max(0, len(data) - length + 1), SLICE_BYTES):
        h = gram_hashes(data[at : at + SLICE_BYTES + length - 1], k)
        least = (h & ~_SPOT) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < grams:
            least = np.minimum(least[: len(least) - (grams - span)], least[grams - span :])
        spots = (least & _SPOT).astype(np.int64)
        cut = np.flatnonzero(np.append(True, spots[1:] != spots[:-1]))
        keys = h[spots[cut]]
        new = np.append(True, keys[1:] != keys[:-1])
        starts = cut[new]
        counts = np.diff(np.append(starts, len(spots)))
        several = np.diff(np.append(np.flatnonzero(new), len(cut))) > 1
        keys = keys[new]
        pieces = -(-counts // grams)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, ends = np.repeat(starts, pieces) + nth * grams, np.repeat(starts + counts, pieces)
            counts, keys, several = np.minimum(grams, ends - starts), np.repeat(keys, pieces), np.repeat(several, pieces)
        parts.append((starts + at, counts, keys.view(np.int64), several))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def bounded_suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols (or more)."""
    n = len(symbols)
    padded = np.append(symbols, np.zeros(7, dtype=symbols.dtype)).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = key * 257 + padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key, reach = key[order], 7
    head = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while reach < depth:
        open_at = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of suffixes that still tie
        if not len(open_at):
            break
        who = order[open_at]
        after = np.where(who + reach < n, rank[np.minimum(who + reach, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[open_at], key = who[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        head[open_at] = fresh
        rank[order[open_at]] = np.maximum.accumulate(np.where(fresh, open_at, 0))
        reach *= 2
    return order


def open_boundaries(symbols: np.ndarray, suffixes: np.ndarray, length: int) -> np.ndarray:
    """For each place of the suffix array, whether it shares `length` symbols or
    more with the place before. Symbol 0 ends a piece; what holds for suffixes
    that meet one sooner has no meaning."""
    n = len(symbols)
    bwt = symbols[suffixes - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    later, earlier = np.full(n, n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    later[by_symbol[:-1][same]] = by_symbol[1:][same]
    earlier[by_symbol[1:][same]] = by_symbol[:-1][same]
    open_ = np.ones(n + 1, dtype=bool)
    bounds = np.cumsum(np.append(0, np.bincount(symbols, minlength=257)))
    left, right = bounds[1:-1], bounds[2:]
    left, right = left[right > left], right[right > left]
    open_[bounds] = False
    for _ in range(1, length):
        if not len(left):
            break
        sizes = right - left
        at = np.repeat(left - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        usable = bwt[at] != 0
        lasts = at[usable & (later[at] >= np.repeat(right, sizes))]
        firsts = at[usable & (earlier[at] < np.repeat(left, sizes))]
        right, left = np.sort(step[lasts]) + 1, np.sort(step[firsts])
        fresh = open_[right]
        left, right = left[fresh], right[fresh]
        open_[right] = False
    return open_[:n]


def repeated_windows(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, which of its windows occur again in these pieces."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    symbols = np.frombuffer(b"\x00".join(pieces) + b"\x00", dtype=np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[ends - 1] = 0
    whole = np.repeat(ends - 1, sizes + 1) - np.arange(len(symbols)) >= length
    suffixes = bounded_suffix_array(symbols, length)
    shared = open_boundaries(symbols, suffixes, length)
    ok = whole[suffixes]
    shared[1:] &= ok[1:] & ok[:-1]
    shared[0] = False
    again = np.zeros(len(symbols), dtype=bool)
    again[suffixes[shared]] = True
    again[suffixes[np.flatnonzero(shared) - 1]] = True
    return [again[e - s - 1 : e - 1 - (length - 1)] if s >= length else np.zeros(0, dtype=bool) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _anchors(texts: DataFrame, k: int, length: int) -> DataFrame:
    """(tid, key, first, windows, places) of each run of each text."""
    schema = pa.schema([("tid", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("windows", pa.int32()), ("places", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part, found, ids = batch.slice(at, TEXTS_AT_ONCE), [], []
                for tid, body in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found.append(anchored_runs(np.frombuffer(body.as_buffer(), dtype=np.uint8), k, length))
                    ids.append(np.full(len(found[-1][0]), tid, dtype=np.int64))
                first, windows, keys, several = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _batch(schema, [np.concatenate(ids), keys, first, windows.astype(np.int32), several.astype(np.int32) + 1])

    return texts.select("tid", "body").mapInArrow(cut, "tid long, key long, first long, windows int, places int")


PIECES = pa.schema([("tid", pa.int64()), ("first", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()), ("windows", pa.int32()), ("content", pa.binary())])
PIECES_DDL = "tid long, first long, key long, digest binary, windows int, content binary"


def _pieces(texts: DataFrame, runs: DataFrame, length: int, with_content: bool = True) -> DataFrame:
    """The text under each run, with its digest. Runs of a text are one list,
    no longer than the text."""
    lists = runs.groupBy("tid").agg(F.collect_list(F.struct("first", "windows", "key")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                columns: list[list] = [[], [], [], [], [], []]
                for tid, body, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for run in found:
                        content = body[run["first"] : run["first"] + run["windows"] + length - 1]
                        values = (tid, run["first"], run["key"], hashlib.blake2b(content, digest_size=16).digest(), run["windows"], content if with_content else b"")
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                yield _batch(PIECES, columns)

    return texts.join(lists, "tid").select("tid", "body", "runs").mapInArrow(cut, PIECES_DDL)


def _expanded(pieces: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(digest, begin, end): runs of repeated windows of each piece, found with
    all pieces of its key. Whole keys fill a block."""
    schema = pa.schema([("digest", pa.binary()), ("begin", pa.int32()), ("end", pa.int32())])

    def judged(names: list[bytes], bodies: list[bytes]) -> pa.RecordBatch:
        rows = [(name, a, b) for name, flags in zip(names, repeated_windows(bodies, length), strict=True) for a, b in _ranges(flags)]
        return _batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, bodies, held, last = [], [], 0, None
        for batch in batches:
            for key, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and held >= block_bytes:
                    yield judged(names, bodies)
                    names, bodies, held = [], [], 0
                names.append(digest)
                bodies.append(content)
                held, last = held + len(content), key
        if names:
            yield judged(names, bodies)

    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.select("key", "digest", "content").repartition(tasks, "key").sortWithinPartitions("key")
    return rows.mapInArrow(expand, "digest binary, begin int, end int")


def _repeats(texts: DataFrame, grams: list[int], length: int, crowd: int, block_bytes: int) -> DataFrame:
    """(tid, begin, end): windows of `texts` (tid, body), by number, that occur
    at another place of `texts` too. `grams` are the anchor lengths, rising to
    `length`."""
    k, longer = grams[0], grams[1:]
    runs = staged(_anchors(texts, k, length), "span-anchors")
    often = runs.groupBy("key").agg(F.sum("places").alias("n")).filter("n > 1").select("key")
    pieces = staged(_pieces(texts, runs.join(often, "key", "left_semi"), length, bool(longer)), "span-pieces")
    distinct = staged(pieces.groupBy("key", "digest").agg(F.any_value("content").alias("content"), F.first("windows").alias("windows"), F.count("*").alias("copies")), "span-distinct")
    alike = distinct.filter("copies > 1").select("digest", F.lit(0).alias("begin"), F.col("windows").alias("end"))
    if not longer:  # a run is a window here, and its digest stands for it
        return pieces.join(alike, "digest").select("tid", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))
    several = runs.groupBy("key").agg(F.max("places").alias("places"))
    sizes = distinct.groupBy("key").agg(F.count("*").alias("n")).join(several, "key").filter("n > 1 OR places > 1").select("key", "n")
    grouped = staged(distinct.join(sizes, "key"), "span-groups")
    found = alike.unionByName(_expanded(grouped.filter(F.col("n") <= crowd), length, block_bytes))
    crowded = grouped.filter(F.col("n") > crowd)
    if not crowded.isEmpty():
        again = staged(crowded.select(F.monotonically_increasing_id().alias("tid"), "digest", F.col("content").alias("body")), "span-crowded")
        deeper = _repeats(again, longer, length, crowd, block_bytes)
        found = found.unionByName(again.select("tid", "digest").join(deeper, "tid").select("digest", F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end")))
    found = staged(found, "span-found")
    return pieces.select("tid", "first", "digest").join(found, "digest").select("tid", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("end")).alias("end"))


def covered(ranges: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes under ranges of windows."""
    out: list[list[int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end + length - 1)
        else:
            out.append([begin, end + length - 1])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and spans, the removed (start, end) bytes.

    A byte goes when a string of `length` bytes over it also starts anywhere
    else in the table, the same document included. Every copy goes, also where
    the copies are whole documents: those are one text in the search and lose
    all their bytes if they are long enough.

    Defined cases: a null text is empty; texts shorter than `length` lose
    nothing; rows that repeat an id are documents of their own, so repeated
    rows are copies of each other; null ids keep their rows; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("body"))
    rows = rows.select("doc_id", "body", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"))
    unique = rows.filter(F.col("n_bytes") >= length).groupBy("digest").agg(F.any_value("body").alias("body"), F.count("*").alias("copies"))
    texts = staged(unique.select(F.monotonically_increasing_id().alias("tid"), "digest", "copies", "body"), "span-texts")
    grams = [max(1, length * 8 // 25), max(1, length * 4 // 5), length]
    windows = _repeats(texts.select("tid", "body"), grams, length, crowd, block_bytes)
    lists = windows.groupBy("tid").agg(F.collect_list(F.struct("begin", "end")).alias("windows"))
    schema = pa.schema([("digest", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                out = []
                for digest, body, found in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS_AT_ONCE).columns), strict=True):
                    spans = covered([(w["begin"], w["end"]) for w in found], length)
                    kept, done = hashlib.sha256(), 0
                    for a, b in spans:
                        kept.update(body[done:a])
                        done = b
                    kept.update(body[done:])
                    out.append((digest, sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
                yield _batch(schema, [list(c) for c in zip(*out, strict=True)])

    ddl = "digest string, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    partly = texts.filter("copies = 1").join(lists, "tid").select("digest", "body", "windows").mapInArrow(cut, ddl)
    wholly = texts.filter("copies > 1").select("digest", F.octet_length("body").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("body").cast("long").alias("end"))).alias("spans"))
    changed = staged(partly.unionByName(wholly), "span-changed")
    return rows.select("doc_id", "digest", "n_bytes").join(changed, "digest", "left").select(
        "doc_id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"),
    )


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
