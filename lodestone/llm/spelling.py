"""Spelling variants: words one edit apart, and the common form of each.

Pairs come from a trie self-join with active-node sets. With one edit allowed,
the active nodes of a trie node are the node itself and a set of nodes one edit
away; a child's set follows from its parent's: the parent, the child's siblings
and its children, and of each node one edit away the child by the same
character. Where a word ends, words that end in its active nodes are its pairs.

The vocabulary is partitioned by prefix. Two words of m and m or m + 1
characters and one edit between them share their first half of characters
(`halves`) or, behind the edit, their last ones. So each word goes to the tries
of its prefix, and its reversal to those of its suffix, for both lengths that a
partner may have: four rows a word, whatever the vocabulary. A prefix with more
than `crowd` words is split by the next character: its children are tries of
their own, and pairs that part just there have equal tails, by which they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.importance import sql_crc32
from lodestone.session import staged, table, unstage

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
TYPO_EVERY = 97
CROWD = 50_000
BATCH = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TRIE = ["back", "m", "prefix", "tail"]  # what names a trie; a tail only where words meet by it
PAIRS = "word string, near string, near_n long"


def halves(m: int) -> int:
    """How many first characters pairs share whose shorter word has m
    characters, unless they share the last m less so many."""
    return (m - 1) // 2


def trie_rows(words: DataFrame) -> DataFrame:
    """The tries of each of `words` (word, n): back, whether the word is
    reversed, m, its prefix, its rest, and whether it is `short`, of m
    characters, or of m + 1."""
    size = F.length("word")
    shorts = F.array(*[F.struct((size - i).alias("m"), F.lit(i == 0).alias("short")) for i in (0, 1)])
    each = words.filter(size > 0).select("word", "n", F.explode(shorts).alias("as")).select("word", "n", "as.m", "as.short").filter("m > 0")
    half = F.floor((F.col("m") - 1) / 2).cast("int")
    ways = F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("read"), half.alias("k")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("read"), (F.col("m") - half).cast("int").alias("k")))
    each = each.select("n", "m", "short", F.explode(ways).alias("way")).select("n", "m", "short", "way.*")
    return each.select("back", "m", F.substring("read", F.lit(1), F.col("k")).alias("prefix"), F.lit(None).cast("string").alias("tail"), F.substring("read", F.col("k") + 1, F.length("read")).alias("rest"), "short", "n")


def split_crowds(rows: DataFrame, crowd: int) -> DataFrame:
    """`rows` with the tries of more than `crowd` words split where they branch,
    again and again: words below one child stay together, and those that part at
    the crowded node meet by the tail behind it. What all words of a trie begin
    with, as its first and last word tell, is passed at once. Every round is a
    written table."""
    done, rows = [], staged(rows, "spelling-tries")
    while True:
        sizes = rows.filter("tail IS NULL").groupBy("back", "m", "prefix").agg(F.count("*").alias("size"), F.min("rest").alias("first"), F.max("rest").alias("last_one"))
        crowded = staged(sizes.filter(F.col("size") > crowd).select("back", "m", "prefix", _shared("first", "last_one").alias("shared")), "spelling-crowds")
        done.append(rows)
        if crowded.isEmpty():
            break
        calm = rows.join(crowded, ["back", "m", "prefix"], "left_anti")
        passed = F.length("shared")
        own = rows.filter("tail IS NULL").join(crowded, ["back", "m", "prefix"]).withColumn("prefix", F.concat("prefix", "shared")).withColumn("rest", F.substring("rest", passed + 1, F.length("rest"))).select(*rows.columns)
        below = own.filter("rest <> ''")
        behind = F.substring("rest", F.lit(2), F.length("rest"))
        parted = below.withColumn("tail", behind).unionByName(own.filter("short").withColumn("tail", F.col("rest")).withColumn("rest", F.lit(None).cast("string")))
        children = below.withColumn("prefix", F.concat("prefix", F.substring("rest", 1, 1))).withColumn("rest", behind)
        done[-1] = staged(calm.unionByName(parted), "spelling-tries")
        further = staged(children, "spelling-tries")
        unstage(rows, crowded)
        rows = further
    return reduce(DataFrame.unionByName, done)


def _shared(a: str, b: str) -> Column:
    """What two strings begin with."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    differ = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    least = F.least(F.length(a), F.length(b))
    return F.when(least == 0, "").otherwise(F.substring(a, F.lit(1), F.coalesce(F.array_min(differ) - 1, least)))


def _trie_pairs(rests: list[str], short: list[bool]) -> Iterator[tuple[int, int]]:
    """Places of rests one edit apart, each pair once."""
    children: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, rest in enumerate(rests):
        node = 0
        for c in rest:
            below = children[node].get(c)
            if below is None:
                below = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = below
        ends[node] = i
    waiting = [(0, set(children[0].values()))]
    while waiting:
        node, near = waiting.pop()
        own = ends[node]
        if own >= 0:
            for other in near:
                i = ends[other]
                if i > own and (short[own] or short[i]):
                    yield own, i
        for c, child in children[node].items():
            active = {children[other][c] for other in near if c in children[other]}
            active.update(children[node].values(), children[child].values())
            active.add(node)
            active.discard(child)
            waiting.append((child, active))


def _parted_pairs(rests: list[str | None], short: list[bool], tail: str) -> Iterator[tuple[int, int]]:
    """Pairs that part at a crowded node and whose tails behind it are equal: a
    rest and another of one length, or a longer one and the tail itself, which
    stands without a rest. There are as many rests as characters."""
    base = next((i for i, r in enumerate(rests) if r is None), None)
    own = [i for i, r in enumerate(rests) if r is not None]
    for i in own:
        if short[i]:
            yield from ((i, j) for j in own if j > i and short[j])
        elif base is not None and rests[i][:1] != tail[:1]:
            yield base, i


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(word, near, near_n) of `words` (word, n): all pairs with one inserted,
    deleted or replaced code point between them, in both directions. Words are
    distinct and not empty. A task holds one trie of `crowd` words at most, or
    of one word and what differs from it in one character."""
    rows = split_crowds(trie_rows(words), crowd).repartition(*TRIE).sortWithinPartitions(*TRIE, "rest", "short")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []
        streamed = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in (*TRIE, "rest", "short", "n")), strict=True))
        for (back, m, prefix, tail), group in groupby(streamed, key=lambda r: r[:4]):
            held = list(group)
            if len(held) < 2:
                continue
            rests, short, n = zip(*(r[4:] for r in held), strict=True)
            if not any(short):
                continue
            read = [prefix + (tail if r is None else r) for r in rests]
            full = [w[::-1] for w in read] if back else read
            half = halves(m)
            for a, b in _trie_pairs(rests, short) if tail is None else _parted_pairs(rests, short, tail):
                if back and full[a][:half] == full[b][:half]:
                    continue  # found from the front
                out += [(full[a], full[b], n[b]), (full[b], full[a], n[a])]
            if len(out) >= BATCH:
                yield _pair_batch(out)
                out = []
        yield _pair_batch(out)

    return rows.mapInArrow(joined, PAIRS)


def _pair_batch(pairs: list[tuple[str, str, int]]) -> pa.RecordBatch:
    word, near, n = zip(*pairs, strict=True) if pairs else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the last form that can be reached.
    Each round doubles how far a root lies, so rounds are few; forms must not
    come round again."""
    found = staged(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        unstage(found)
        found = moved
        if found.filter("moved").isEmpty():
            return found.select("word", "root")


def variant_forms(words: DataFrame, ratio: float = RATIO, crowd: int = CROWD) -> DataFrame:
    """One row per row of `words` (word, n): word, n, n_near (how many words are
    one edit away), form (of these the one of the largest n, ties by code-point
    order, if that is `ratio` times n or more), form_n and root (where the forms
    lead, the word itself without any).

    Defined cases: words are distinct; empty and null ones have no near word;
    an empty table gives an empty result.
    """
    words = staged(words.select("word", "n"), "spelling-words")
    best = near_pairs(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("below"), "near")).alias("top"))
    joined = words.join(best, "word", "left")
    kept = -F.col("top.below") >= F.col("n") * ratio
    judged = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(kept, F.col("top.near")).alias("form"), F.when(kept, -F.col("top.below")).alias("form_n")), "spelling-forms")
    found = roots(judged.filter("form IS NOT NULL"))
    unstage(words)
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, spelled=None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the letter runs of whole texts, A to Z lower-cased, of
    `least_length` code points and `least_count` occurrences or more. `spelled`
    (doc_id, run) may change each run before it counts.

    Defined cases: null and empty texts have no words; rows that repeat an id
    count each; a null id goes to `spelled` as an empty string; other columns
    are ignored, whatever their names.
    """
    runs = F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run")).filter(F.length("run") >= least_length)
    word = spelled(F.col("id"), F.col("run")) if spelled else F.col("run")
    counts = each.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least_count)


def planted_typos(doc_id: Column, run: Column, every: int = TYPO_EVERY) -> Column:
    """The run, or for one in `every` (document, run) without one code point."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_forms(word_counts(table(spark, sf_dir, "documents"), planted_typos))


_SQL_RUNS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')"
OP11_SQL = rf"""
WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest({_SQL_RUNS}) AS run FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT run, k, {sql_crc32("doc_id || ':' || run")} AS h FROM r),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
v AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS cut FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM w)),
p AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.cut = b.cut AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.cut = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.cut = w.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
t AS (SELECT word, n_near, top, min(near) AS near FROM b JOIN p USING (word) WHERE near_n = top GROUP BY ALL),
f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN near END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM w LEFT JOIN t USING (word)),
c AS (SELECT word, word AS last, 0 AS step FROM f UNION ALL SELECT c.word, f.form, step + 1 FROM c JOIN f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(last, step) AS root, n, n_near, form_n FROM f JOIN c ON c.word = f.word GROUP BY f.word, form, n, n_near, form_n
"""
