"""Mixing sources to target weights by exact word counts.

Each source gets a word budget. Whole copies of the source use it up as far as
they fit; the rest is a subset-sum problem over the counts of documents by
exact length: a proportional share of every length, then a bounded knapsack by
dynamic programming for what remains. Which documents of a length are taken is
decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import staged, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
RANK_BUCKET = 500
SALTS = 16


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def _source_key(source: Column) -> Column:
    """Tells a null source from every other by a value that joins can compare."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _source_of(key: str) -> str | None:
    return key[1:] if key else None


def source_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, copies: int = MAX_COPIES) -> dict:
    """Word targets by source: the budget is dealt by weight, a target stops at
    `copies` times its source, and what is cut off is dealt again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: float(copies * n) for s, n in order}
    left, free, target = share * sum(n for _, n in order), [s for s, _ in order], {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit >= cap[s]]
        for s in full or free:
            target[s] = cap[s] if full else weight[s] * unit
        if not full:
            break
        left -= sum(cap[s] for s in full)
        free = [s for s in free if s not in set(full)]
    return target


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take so that their words come as
    near to `budget` as the knapsack can get them."""
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), dtype=np.int64)
    usable = np.flatnonzero((lengths > 0) & (counts > 0))
    if not len(usable) or budget <= 0:
        return taken
    taken[usable] = np.minimum(np.floor(counts[usable] * (budget / total)).astype(np.int64), counts[usable])
    rest = budget - int((lengths * taken).sum())
    longest = int(lengths[usable].max())
    for i in usable[np.argsort(-lengths[usable])]:
        if rest < 2 * longest:
            break
        n = min(int(counts[i] - taken[i]), int((rest - longest) // lengths[i]))
        if n > 0:
            taken[i] += n
            rest -= n * int(lengths[i])
    width = int(max(rest, 0)) + longest + 1
    start = np.full(width, -1, dtype=np.int32)  # the item that first reached a sum
    start[0] = -2
    items: list[tuple[int, int]] = []
    goal = int(round(max(rest, 0)))
    for i in usable[np.argsort(lengths[usable])]:
        spare, chunk = int(counts[i] - taken[i]), 1
        while spare > 0 and start[goal] == -1:
            n = min(chunk, spare)
            step = n * int(lengths[i])
            if step >= width:
                break
            reached = np.flatnonzero((start[:-step] != -1) & (start[step:] == -1)) + step
            start[reached] = len(items)
            items.append((int(i), n))
            spare, chunk = spare - n, chunk * 2
        if start[goal] != -1:
            break
    sums = np.flatnonzero(start != -1)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at > 0:
        i, n = items[start[at]]
        taken[i] += n
        at -= n * int(lengths[i])
    return taken


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(rows["target"].iloc[0])
    whole = int(target // total) if total else 0
    rows["whole"] = whole
    rows["extra"] = fit_counts(lengths, counts, target - whole * total)
    return rows[["source", "size", "n", "target", "source_size", "whole", "extra"]]


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = MAX_COPIES, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and
    `row_col` where given, which tells rows that repeat an id apart.

    A length of a source may hold a third of all documents, so they meet its
    plan by salt, in a merge join whatever the plan's size: it grows with the
    sources, and its stored size says little of what it takes in memory.

    `taken` is the document's size times the copies the mix takes of it, 0 to
    `copies`. The catalogue of sources, one row each, passes through the driver.

    Defined cases: a null text has size 0; a null source is a source of its
    own, last in order; documents of size 0 are taken as often as whole copies
    of their source are, which adds nothing; rows that repeat an id are
    documents of their own; ids that tie in the seeded hash have equal sizes
    within a length, so the sums never depend on their order; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    row = [row_col] if row_col else []
    sized = staged(docs.select(*row, F.col(id_col).alias("doc_id"), _source_key(F.col(source_col)).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    lengths = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    totals = [(_source_of(r["source"]), int(r["words"])) for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    targets = source_targets(totals, weights, share, copies)
    catalogue = spark.createDataFrame([("" if s is None else f"={s}", n, float(targets[s])) for s, n in totals], "source string, source_size long, target double")
    plan = (
        lengths.join(catalogue.hint("merge"), "source")  # its partitions are those that the groups need
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, size long, n long, target double, source_size long, whole long, extra long")
    )
    plan = staged(plan.withColumn("buckets", F.ceil(F.col("n") / RANK_BUCKET)), "mix-plan")
    drawn = sized.withColumn("draw", F.xxhash64("doc_id", F.lit(seed))).withColumn("salt", F.pmod(F.xxhash64("doc_id", *row), F.lit(SALTS)).cast("int"))
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = drawn.join(salted.hint("merge"), ["source", "size", "salt"]).drop("salt")
    dealt = dealt.withColumn("bucket", F.pmod(F.call_function("shiftright", F.col("draw"), F.lit(20)), F.col("buckets")))
    # A length of a hot source may hold a third of all rows: it is ranked bucket
    # by bucket, after the sizes of the buckets before.
    key = ["source", "size", "bucket"]
    ahead = (
        dealt.filter("extra > 0 AND extra < n")
        .groupBy(*key)
        .agg(F.count("*").alias("in_bucket"))
        .withColumn("ahead", F.expr("sum(in_bucket) OVER (PARTITION BY source, size ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
        .select(*key, F.coalesce("ahead", F.lit(0)).alias("ahead"))
    )
    place = F.expr(f"row_number() OVER (PARTITION BY source, size, bucket ORDER BY {', '.join(['draw', 'doc_id', *row])})")
    ranked = dealt.withColumn("place", place).join(ahead.hint("merge"), key, "left")
    one_more = F.when(F.col("ahead").isNull(), F.col("extra") > 0).otherwise(F.col("ahead") + F.col("place") <= F.col("extra"))
    return ranked.select(*row, "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + one_more.cast("long"))).alias("taken"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
