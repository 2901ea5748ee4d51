"""Target-distribution importance resampling over hashed word runs.

Each run of one to three words falls into a bucket; a bucket's gain is the
scaled log ratio of its share in the target texts to its share in the corpus.
A document's weight is the sum of its gains, read from one array. Seeded Gumbel
noise turns the weights into a draw without replacement: the highest scores
win. Scores are integers, so the draw needs no sort of all documents: a
histogram of exact scores, summed from the top, gives the cutoff and each
score's first rank, and only documents at or above the cutoff are numbered.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.numbering import running_sums
from lodestone.session import staged, table

BUCKETS = 10_000
RUN_LENGTH = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
SLICE_BYTES = 1 << 20  # of text whose bytes are looked at together
TABLED = 64  # words of so many bytes have their checksums by table

_NUL = bytes(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def _zeros(n: int) -> int:
    return zlib.crc32(bytes(n))


def _shifted(value: int, n: int) -> int:
    """What the linear part of a checksum becomes when n bytes follow."""
    blank = bytes(n)
    return zlib.crc32(blank, value) ^ zlib.crc32(blank, 0)


# CRC-32 without its fixed start and end is linear: crc(m) = linear(m) ^ crc(zeros
# as long as m). So the part of each byte depends on its value and on how many
# bytes follow, and the checksum of joined words follows from those of the words.
_BYTE = np.array([[zlib.crc32(bytes([b]) + _NUL * j) ^ _zeros(j + 1) for b in range(256)] for j in range(TABLED)], dtype=np.uint32)
_SHIFT = np.array([[[_shifted(b << 8 * i, n) for b in range(256)] for i in range(4)] for n in range(TABLED + 2)], dtype=np.uint32)
_ZEROS = np.array([_zeros(n) for n in range(RUN_LENGTH * (TABLED + 1) + 1)], dtype=np.uint32)


def _shift_all(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = np.minimum(lengths, TABLED + 1)
    out = _SHIFT[at, 0, values & 255] ^ _SHIFT[at, 1, values >> 8 & 255] ^ _SHIFT[at, 2, values >> 16 & 255] ^ _SHIFT[at, 3, values >> 24]
    for i in np.flatnonzero(lengths > TABLED + 1):
        out[i] = _shifted(int(values[i]), int(lengths[i]))
    return out


def _finished(linear: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = linear ^ _ZEROS[np.minimum(lengths, len(_ZEROS) - 1)]
    for i in np.flatnonzero(lengths >= len(_ZEROS)):
        out[i] = int(linear[i]) ^ _zeros(int(lengths[i]))
    return out


class Runs(NamedTuple):
    """Features in order of the segment that they end in."""

    segment: np.ndarray
    bucket: np.ndarray
    words: np.ndarray  # of each segment, without those carried over


def runs(data: np.ndarray, starts: np.ndarray, carried: np.ndarray, buckets: int) -> Runs:
    """Buckets of all word runs of segments of `data` that begin at `starts`.
    The first `carried` words of a segment belong to the one before: runs that
    end in them have been counted."""
    data = _LOWER[data]
    inside = _IN_WORD[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts] = True
    begins = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | first[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | first[1:])) + 1
    if not len(begins):
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, np.zeros(len(starts), dtype=np.int64))
    length = ends - begins
    at = np.flatnonzero(inside)
    behind = np.repeat(ends - 1, length) - at
    linear = np.bitwise_xor.reduceat(_BYTE[np.minimum(behind, TABLED - 1), data[at]], np.r_[0, np.cumsum(length)[:-1]])
    for i in np.flatnonzero(length > TABLED):
        linear[i] = zlib.crc32(data[begins[i] : ends[i]].tobytes()) ^ _zeros(int(length[i]))
    segment = np.searchsorted(starts, begins, side="right") - 1
    place = np.arange(len(begins)) - np.searchsorted(begins, starts)[segment]
    own = place >= carried[segment]
    behind_blank = _shift_all(np.full(len(begins), zlib.crc32(b" ") ^ _zeros(1), dtype=np.uint32), length) ^ linear
    found = [(segment[own], _finished(linear, length)[own] % buckets)]
    total, run = length, linear
    for n in range(1, RUN_LENGTH):
        run = np.r_[np.zeros(1, np.uint32), _shift_all(run[:-1], length[1:] + 1)] ^ behind_blank
        total = np.r_[0, total[:-1]] + 1 + length
        whole = own & (place >= n)
        found.append((segment[whole], _finished(run, total)[whole] % buckets))
    order = np.argsort(np.concatenate([s for s, _ in found]), kind="stable")
    return Runs(np.concatenate([s for s, _ in found])[order], np.concatenate([b for _, b in found])[order].astype(np.int64), np.bincount(segment[own], minlength=len(starts)))


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, segment starts, carried words, rows) of about SLICE_BYTES each.
    A longer text is cut between words; a piece begins with the last words of
    the one before, so that runs across the cut are seen."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, body = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + SLICE_BYTES, side="right")) - 1)
        if ends[last] - ends[row] <= 2 * SLICE_BYTES:
            yield data[ends[row] : ends[last]], ends[row:last] - ends[row], np.zeros(last - row, dtype=np.int64), np.arange(row, last)
        else:
            yield from ((piece, np.zeros(1, dtype=np.int64), np.array([carried]), np.array([row])) for piece, carried in _pieces(data[ends[row] : ends[last]]))
        row = last


def _pieces(text: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    at, carry = 0, []
    while at < len(text):
        end = at + SLICE_BYTES
        while end < len(text):
            gap = np.flatnonzero(~_IN_WORD[_LOWER[text[end : end + SLICE_BYTES]]])
            if len(gap):
                end += int(gap[0])
                break
            end += SLICE_BYTES
        piece = text[at:end]
        head = b"".join(w + b" " for w in carry)
        yield np.r_[np.frombuffer(head, dtype=np.uint8), piece], len(carry)
        carry = (carry + _last_words(piece))[-(RUN_LENGTH - 1) :]
        at = end


def _last_words(piece: np.ndarray) -> list[bytes]:
    inside = np.r_[False, _IN_WORD[_LOWER[piece]], False]
    edges = np.flatnonzero(inside[1:] != inside[:-1])[-2 * (RUN_LENGTH - 1) :]
    return [piece[a:b].tobytes() for a, b in edges.reshape(-1, 2)]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the runs of all texts; a task adds up its own first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data, starts, carried, _ in _slices(batch.column(0)):
                total += np.bincount(runs(data, starts, carried, buckets).bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed shares, rounded down, by bucket."""
    k = float(len(corpus))
    all_corpus, all_target = float(corpus.sum()) + k, float(target.sum()) + k
    return np.array([math.floor(1000 * math.log(((t + 1) * all_corpus) / ((s + 1) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            words, features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for data, starts, carried, rows in _slices(batch.column(1)):
                found = runs(data, starts, carried, len(gain))
                sums = np.r_[0, np.cumsum(gain[found.bucket])]
                edges = np.searchsorted(found.segment, np.arange(len(rows) + 1))
                words[rows] += found.words
                features[rows] += np.diff(edges)
                weight[rows] += np.diff(sums[edges])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(weighed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def seeded_noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a standard Gumbel value, rounded down, the same on every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def draw_highest(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """`scored` (doc_id, score, ...) with rank 1, 2, 3 ... of the eligible rows
    with the highest scores, `percent` of a hundred of them, rounded down; ties
    go to the smaller doc_id, null ids first; all others have none.

    The exact scores' counts, summed from the top, say at which rank each score
    begins. A score's rows are numbered by doc_id in one task: the noise spreads
    rows of equal weight, so no score has more than 1 in 2,700 of the rows.
    """
    columns = scored.columns
    scored = staged(scored.withColumn("__eligible", F.coalesce(eligible, F.lit(False))), "importance-scored")
    histogram = scored.filter("__eligible").groupBy("score").agg(F.count("*").alias("n"))
    places = staged(running_sums(histogram, [F.col("score").desc()], "n"), "importance-places")
    wanted = (places.agg(F.sum("n")).first()[0] or 0) * percent // 100
    surviving = places.filter(F.col("before") < wanted)
    cutoff = surviving.agg(F.min("score")).first()[0]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    within = F.expr("row_number() OVER (PARTITION BY score ORDER BY doc_id)")
    above = F.col("__eligible") & (F.col("score") >= cutoff)
    placed = scored.filter(above).join(surviving.select("score", "before"), "score").withColumn("rank", F.col("before") + within)
    drawn = placed.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).cast("long").alias("rank"))
    return drawn.unionByName(scored.filter(~above).select(*columns, F.lit(None).cast("long").alias("rank")))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank.

    Words are runs of ASCII digits, ASCII letters (lower-cased) and characters
    beyond ASCII; features are runs of one to three words, repeats counted.
    Both passes over the texts keep one array of `buckets` numbers a task; that
    array alone passes through the driver.

    Defined cases: null and empty texts have no features and weight 0; fewer
    words than `least_words` are never drawn; an empty target makes every gain
    come from smoothing alone; rows that repeat an id are rows of their own and
    share its noise; a null id has the noise of an empty one; ties go to the
    smaller id; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    counts = []
    for texts, column in ((docs, text_col), (target, target_col)):
        by_bucket = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(texts, column, buckets).collect():  # one row a bucket
            by_bucket[r["bucket"]] = r["n"]
        counts.append(by_bucket)
    weighed = weigh(docs, bucket_gains(*counts), id_col, text_col)
    scored = weighed.withColumn("score", F.col("weight") + seeded_noise(F.col("doc_id"), seed))
    return draw_highest(scored, F.col("n_words") >= least_words, percent)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def sql_crc32(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a text's UTF-8 bytes."""
    steps = ", ".join(str(_zlib_step(b)) for b in range(256))
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {octets}), lambda c, b: xor(c >> 8, CAST([{steps}] AS BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295)"


def _zlib_step(b: int) -> int:
    for _ in range(8):
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return b


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id AS id, false AS goal, coalesce({_SQL_WORDS}, []) AS w FROM documents UNION ALL SELECT item_id, true, coalesce({_SQL_WORDS}, []) FROM benchmark),
f AS MATERIALIZED (SELECT id, goal, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS feature FROM w),
c AS MATERIALIZED (SELECT feature, {sql_crc32("feature")} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM f)),
n AS (SELECT bucket, count(*) FILTER (NOT goal) AS s, count(*) FILTER (goal) AS t FROM f JOIN c USING (feature) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM n) + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM n) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
d AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN c USING (feature) JOIN g USING (bucket) WHERE NOT goal GROUP BY id),
x AS (SELECT w.id AS doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substring(sha256('42:' || w.id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d ON d.id = w.id WHERE NOT goal),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE words >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)
"""
