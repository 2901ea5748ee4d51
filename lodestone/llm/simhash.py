"""SimHash near-deduplication by pigeonhole blocks.

A 64-bit fingerprint is cut into blocks; two fingerprints that differ in few
bits agree on some blocks, so they meet in a join on those blocks and their
Hamming distance is then verified. Fingerprints are joined once each, however
many documents have them, and a block value that too many fingerprints share is
linked through midpoints instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.session import staged, table, unstage

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
BLOCKS = 4
CROWD = 32
CHUNK = 1 << 16

# Near copies of the pipeline: five words, and LEAST_SHARE of the shingles of two texts.
NEAR_WORDS = 5
LEAST_SHARE = 0.8
LANES = 16
WIDE = 64 * LANES
DIFFERING = math.acos(2 * LEAST_SHARE / (1 + LEAST_SHARE)) / math.pi  # part of the bits in which such a pair differs: 0.151
WIDE_BITS = round(WIDE * DIFFERING + 2.4 * math.sqrt(WIDE * DIFFERING * (1 - DIFFERING)))  # 183 of 1,024: one such pair in 120 differs in more
RARE_BITS = 6
MEET = 0.975
FIRST_PART = 8
KEY_ROWS = 512


def hashed_shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), dtype=np.uint64)


def majority_bits(hashed: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), CHUNK):
        bits = np.unpackbits(hashed[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashed), bitorder="little").view(np.int64)[0])


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint, as a signed 64-bit integer; 0 without any word."""
    return majority_bits(hashed_shingles(text, words))


_MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, LANES), dtype=np.uint64)


def wide_print(hashed: np.ndarray) -> np.ndarray:
    """A fingerprint of WIDE bits: LANES of 64, from hashes mixed anew for each."""
    ones = np.zeros(WIDE, dtype=np.int64)
    for at in range(0, len(hashed), CHUNK // LANES):
        mixed = (hashed[at : at + CHUNK // LANES, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashed), bitorder="little").view(np.int64)


def simhash_column(text: Column, words: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="int64")

    return fingerprints(text)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of every choice of blocks that fingerprints within `max_bits` may
    agree on, as signed 64-bit integers."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_links(prints: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (`fp`) that connect exactly
    the fingerprints within `max_bits` of each other.

    Block values with `crowd` fingerprints or fewer are joined with themselves.
    In larger ones every fingerprint is listed under each value half way to a
    neighbour, `max_bits` // 2 flips away outside the shared blocks; two that
    share such a midpoint are close by the triangle inequality, and all of a
    midpoint link to its smallest. An odd `max_bits` has no exact midpoint, so
    crowded values then go through pairs too.
    """
    masks = block_masks(blocks, max_bits)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "block"))
    sizes = keyed.groupBy("part", "block").agg(F.count("*").alias("n")).filter("n > 1")
    met = staged(keyed.join(sizes, ["part", "block"]), "simhash-blocks")
    few = met if max_bits % 2 else met.filter(F.col("n") <= crowd)
    left, right = few.select("part", "block", F.col("fp").alias("a")), few.select("part", "block", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    links = left.join(right, ["part", "block"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")
    if max_bits % 2:
        return links
    flips = [0]
    for n in range(1, max_bits // 2 + 1):
        flips += [sum(1 << i for i in chosen) for chosen in combinations(range(64), n)]
    flips = [m - (1 << 64) if m >> 63 else m for m in flips]
    midpoints = (
        met.filter(F.col("n") > crowd)
        .select("fp", "part", F.element_at(F.lit(masks), F.col("part") + 1).alias("mask"), F.explode(F.lit(flips)).alias("flip"))
        .filter(F.col("mask").bitwiseAND(F.col("flip")) == 0)
        .select("fp", "part", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    )
    first = midpoints.groupBy("part", "middle").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    stars = midpoints.join(first, ["part", "middle"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return links.unionByName(stars.distinct())


def _named(prints: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id) of fingerprints (`fp`, `first`) under links of them."""
    member = components(links).withColumnRenamed("node", "fp")
    linked = staged(prints.join(member, "fp"), "simhash-linked")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def simhash_groups(docs: DataFrame, max_bits: int = MAX_BITS, words: int = SHINGLE_WORDS, blocks: int = BLOCKS, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id,
    the smallest doc_id that can be reached over links of `max_bits` or fewer.

    Defined cases: null, empty and blank texts have fingerprint zero, linked
    like any other; texts of fewer words than a shingle are one shingle; rows
    that repeat an id keep their rows; a null id never names a component
    unless all of its ids are null, which gives null; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    marked = staged(docs.select(F.col(id_col).alias("doc_id"), simhash_column(F.col(text_col), words).alias("fp")), "simhash")
    prints = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-prints")
    by_print = _named(prints, close_links(prints.select("fp"), max_bits, blocks, crowd))
    return marked.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def key_plan(texts: int) -> tuple[int, int]:
    """(bits of a block, blocks a fingerprint is listed under) for so many texts.

    A block has RARE_BITS more bits than the texts have doublings, so about one
    text in 64 meets a stranger on a block, however many texts there are; there
    are as many blocks as let a pair that differs in DIFFERING of its bits
    share one with chance MEET.
    """
    bits = math.ceil(math.log2(max(texts, 2))) + RARE_BITS
    return bits, math.ceil(math.log(1 - MEET) / math.log1p(-((1 - DIFFERING) ** bits)))


def block_keys(prints: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """Keys (row, block) of wide prints (row, lane): the fingerprint is cut into
    blocks of `bits`, then, permuted anew each time, cut again until there are
    `blocks`. Under each permutation a pair that differs in fewer bits than
    there are blocks shares one for certain."""
    per = WIDE // bits
    rng, keys = np.random.default_rng(11), []
    spread = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    for first in range(0, blocks, per):
        order = rng.permutation(WIDE)[: bits * per]
        padded = np.zeros((len(prints), per, 64), dtype=np.uint8)
        padded[:, :, :bits] = spread[:, order].reshape(len(prints), per, bits)
        values = np.packbits(padded, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
        number = np.arange(first, first + per, dtype=np.uint64)
        keys.append((values * np.uint64(0x9E3779B97F4A7C15) ^ (number << np.uint64(47)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
    return np.concatenate(keys, axis=1)[:, :blocks]


def near_links(nodes: DataFrame, texts: int | None = None) -> DataFrame:
    """Links (a, b) that connect all of `nodes` (node, wide, shingles) which
    share a block and LEAST_SHARE of their shingles; not every pair is listed.

    In one block of FIRST_PART, all nodes are compared with one of them, the
    same in many blocks, which links most copies. In each block, what is then
    outside its largest component is compared with a member of that component,
    another one in each block, and what still is outside with the whole block.
    Candidates must be within WIDE_BITS; the verdict is taken on the shingles.
    """
    bits, blocks = key_plan(nodes.count() if texts is None else texts)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEY_ROWS):
                part = batch.slice(at, KEY_ROWS)
                wide = part.column(1).flatten().to_numpy().reshape(part.num_rows, LANES)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), blocks)), pa.array(block_keys(wide, bits, blocks).ravel())], ["node", "key"])

    prints = nodes.select("node", "wide", F.size("shingles").alias("size"))
    keyed = nodes.select("node", "wide").mapInArrow(keys, "node long, key long").repartition("key")  # one exchange for both sides of the join below
    leader = F.min_by("node", F.xxhash64("node")).alias("leader")
    met = staged(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n"), leader).filter("n > 1"), "key"), "near-met")
    first = met.filter(F.pmod(F.xxhash64("key"), F.lit(FIRST_PART)) == 0)
    links = verified(first.select(F.col("node").alias("a"), F.col("leader").alias("b")), prints, nodes)
    split = _split_keys(met.select("key", "node", "n"), links)
    guide = split.filter("root = largest").groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("b"))
    more = verified(split.filter("root <> largest").select("key", F.col("node").alias("a")).join(guide, "key").select("a", "b"), prints, nodes)
    unstage(met)
    old, links = links, staged(links.unionByName(more), "near-links")
    rest = _split_keys(split.filter("n > 2").select("key", "node", "n"), links)  # the one pair of two has been compared
    placed = staged(rest.join(prints, "node"), "near-placed")
    unstage(old, more, split, rest)
    side = lambda c: [F.col("node").alias(c), F.col("root").alias(f"root_{c}"), F.col("wide").alias(f"wide_{c}"), F.col("size").alias(f"size_{c}")]
    outside, whole = placed.filter("root <> largest").select("key", *side("a")), placed.select("key", *side("b"))
    more = outside.join(whole, "key").filter((F.col("root_a") != F.col("root_b")) & _close("a", "b"))
    return links.unionByName(verified(more.select("a", "b"), None, nodes))


def _close(a: str, b: str) -> Column:
    """Sizes and wide prints that two texts of LEAST_SHARE can have."""
    sizes = F.least(f"size_{a}", f"size_{b}") >= LEAST_SHARE * F.greatest(f"size_{a}", f"size_{b}")
    return sizes & (sum((F.bit_count(F.col(f"wide_{a}")[i].bitwiseXOR(F.col(f"wide_{b}")[i])) for i in range(LANES)), F.lit(0)) <= WIDE_BITS)


def _split_keys(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (key, node, n), with root and largest, of the keys whose nodes
    aren't all in one component under `links`; largest is the root of most."""
    member = components(links).select("node", "root")
    placed = staged(keyed.join(member, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-placed")
    sums = placed.groupBy("key", "root").agg(F.count("*").alias("held")).groupBy("key").agg(F.max_by("root", F.struct("held", "root")).alias("largest"), F.count("*").alias("parts"))
    split = staged(placed.join(sums.filter("parts > 1").drop("parts"), "key"), "near-split")
    unstage(placed)
    return split


def verified(pairs: DataFrame, prints: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b), those within WIDE_BITS of each other (unless `prints` is
    None, where they are known to be) that share LEAST_SHARE of their shingles."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    if prints is not None:
        of = lambda c: prints.select(F.col("node").alias(c), F.col("wide").alias(f"wide_{c}"), F.col("size").alias(f"size_{c}"))
        pairs = pairs.join(of("a"), "a").join(of("b"), "b").filter(_close("a", "b")).select("a", "b")
    pairs = staged(pairs, "near-pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = staged(nodes.select("node", "shingles").join(asked, "node", "left_semi"), "near-sets")
    left, right = held.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), held.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    shared = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("shared"), (F.size("of_a") + F.size("of_b")).alias("both"))
    links = staged(shared.filter(F.col("shared") / (F.col("both") - F.col("shared")) >= LEAST_SHARE).select("a", "b"), "near-links")
    unstage(pairs, held)
    return links


def near_groups(docs: DataFrame, texts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and component_id, the smallest doc_id that
    can be reached over texts which share LEAST_SHARE of their shingles of
    NEAR_WORDS words.

    Texts meet on blocks of SimHash fingerprints of WIDE bits, are compared by
    Hamming distance and then, as fingerprints are estimates, by 32-bit hashes
    of the shingles themselves. A lone pair of exactly LEAST_SHARE meets with
    about chance MEET at every size of the table, a closer one more surely;
    `texts` stands for another size, as for tests.

    Defined cases: null, empty and blank texts have no shingles and are equal;
    texts of fewer words than a shingle are one shingle; rows that repeat an id
    keep their rows; a null id never names a component unless all of its ids
    are null, which gives null; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEY_ROWS):
                part = batch.slice(at, KEY_ROWS)
                rows = [np.unique(hashed_shingles(t, NEAR_WORDS)) for t in part.column(1).to_pylist()]
                digests = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in rows], dtype=np.uint64).view(np.int64)
                wide = np.stack([wide_print(h) for h in rows])
                short = [np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32) for h in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests), _lists(list(wide), np.int64), _lists(short, np.int32)],
                    ["doc_id", "digest", "wide", "shingles"],
                )

    same = ["digest", "wide"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = staged(rows.mapInArrow(prints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest long, wide array<long>, shingles array<int>"), "near")
    nodes = staged(marked.groupBy(*same).agg(F.min("doc_id").alias("first"), F.first("shingles").alias("shingles")).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    members = staged(marked.select("doc_id", *same).join(nodes.select("node", *same), same).select("doc_id", "node"), "near-members")
    unstage(marked)
    named = staged(_named(nodes.select(F.col("node").alias("fp"), "first"), near_links(nodes, texts)), "near-named")
    unstage(nodes)
    return members.join(named.withColumnRenamed("fp", "node"), "node").select("doc_id", "component_id")


def _lists(rows: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0] + [len(r) for r in rows])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows).astype(kind)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
