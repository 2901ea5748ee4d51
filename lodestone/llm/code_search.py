"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into segments, each with an index of its values. A search looks
up all values within a radius of its own in every segment; a code within
m * (r + 1) - 1 bits is then certain to be met, as some segment differs in r
bits at most. The radius grows until the kth verified Hamming distance is
covered, and searches that are covered drop out. Equal codes are searched for
and indexed once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import staged, table

BITS = 64
TOP_K = 10
QUERY_STEP = 50
SALTS = 64


def sign_code(vector: Column) -> Column:
    """One bit per dimension, set where the value is above zero; 64 at most."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"codes have {BITS} bits at most")).cast("bigint")).otherwise(code)


# (codes, segments): up to so many codes a code is cut into so many segments. A
# search's probes for a radius depend on the widths alone, so they stay as they
# are over wide ranges of sizes; more codes only bring the kth one nearer.
SEGMENTS = [(1 << 8, 8), (1 << 20, 5), (1 << 27, 4), (1 << 40, 3)]


def segment_bounds(codes: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    parts = next((parts for most, parts in SEGMENTS if codes <= most), 2)
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _value(code: str, first: Column, width: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col(code), first).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), width) - 1)


def _segments(df: DataFrame, code: str, bounds: list[tuple[int, int]]) -> DataFrame:
    spots = F.array(*[F.struct(F.lit(i).alias("segment"), F.lit(a).alias("first"), F.lit(w).alias("width")) for i, (a, w) in enumerate(bounds)])
    return df.withColumn("spot", F.explode(spots)).withColumn("segment", F.col("spot.segment")).withColumn("value", _value(code, F.col("spot.first"), F.col("spot.width"))).drop("spot")


def nearest_codes(searches: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """(search, code, n, distance) for distinct `search` codes against distinct
    codes with their row counts (`code`, `n`): all codes as near as the kth
    nearest row, ties included."""
    bounds = segment_bounds(index.count())
    indexed = staged(_segments(index, "code", bounds), "code-index")
    schema = T.StructType([T.StructField("search", T.LongType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType()), T.StructField("distance", T.IntegerType())])
    spark = searches.sparkSession
    near, finished = spark.createDataFrame([], schema), []
    active = staged(searches.select("search", F.lit(BITS).alias("bound")), "code-searches")
    for radius in range(max(w for _, w in bounds) + 1):
        flips = F.array(*[F.lit([sum(1 << b for b in chosen) for chosen in combinations(range(w), radius)] or [-1]) for _, w in bounds])
        probes = _segments(active, "search", bounds).withColumn("flip", F.explode(F.element_at(flips, F.col("segment") + 1))).filter("flip >= 0").select("search", "bound", "segment", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
        distance = F.bit_count(F.col("search").bitwiseXOR(F.col("code")))
        met = probes.hint("shuffle_hash").join(indexed, (probes["segment"] == indexed["segment"]) & (probes["value"] == indexed["value"]) & (distance <= F.col("bound")))
        seen = near.unionByName(met.select("search", "code", "n", distance.alias("distance"))).distinct()
        kept = seen.withColumn("before", F.expr("sum(n) OVER (PARTITION BY search ORDER BY distance RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
        near = staged(kept.filter(f"coalesce(before, 0) < {k}").drop("before"), "code-near")
        covered = len(bounds) * (radius + 1) - 1
        bound = near.groupBy("search").agg(F.when(F.sum("n") >= k, F.max("distance")).otherwise(BITS).alias("bound"))
        ahead = staged(active.select("search").join(bound, "search", "left").select("search", F.coalesce("bound", F.lit(BITS)).alias("bound")), "code-searches")
        finished.append(near.join(ahead.filter(F.col("bound") <= covered), "search", "left_semi"))
        active = ahead.filter(F.col("bound") > covered)
        near = near.join(active, "search", "left_semi")
        if active.isEmpty():
            break
    else:
        finished.append(near)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def search_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of `vectors` to each row of `queries` by the Hamming
    distance of their sign codes: query_id, rank (from 1), vec_id, distance.
    Equal distances go by the smaller id; a query that is itself in the table
    finds itself.

    Defined cases: null vectors are neither found nor searched for; a null
    element counts as not above zero, as does an empty vector in every bit; a
    table of fewer than k rows gives them all; rows that repeat an id are found
    each; a null id comes first among equals; empty tables give empty results;
    other columns are ignored, whatever their names.
    """
    coded = staged(vectors.select(F.col(id_col).alias("vec_id"), sign_code(F.col(vector_col)).alias("code")).filter("code IS NOT NULL"), "codes")
    asked = staged(queries.select(F.col(id_col).alias("query_id"), sign_code(F.col(vector_col)).alias("search")).filter("search IS NOT NULL"), "code-queries")
    near = nearest_codes(asked.select("search").distinct(), coded.groupBy("code").agg(F.count("*").alias("n")), k)
    # A code may hold a third of all rows: its k smallest ids are found by salt first.
    lead = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("place", F.expr("row_number() OVER (PARTITION BY code, salt ORDER BY vec_id)")).filter(f"place <= {k}")
    lead = lead.withColumn("place", F.expr("row_number() OVER (PARTITION BY code ORDER BY vec_id)")).filter(f"place <= {k}").select("code", "vec_id")
    best = near.join(lead, "code").withColumn("rank", F.expr("row_number() OVER (PARTITION BY search ORDER BY distance, vec_id)")).filter(f"rank <= {k}")
    return asked.join(best, "search").select("query_id", "rank", "vec_id", "distance")


def op8_code_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search_top_k(vectors, vectors.filter(f"vec_id % {QUERY_STEP} = 0"))


OP8_SQL = f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (v.embedding[i] > 0) AS INTEGER))) AS INTEGER) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= {TOP_K}
"""
