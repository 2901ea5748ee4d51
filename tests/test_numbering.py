import random
import re

from pyspark.sql import functions as F

from lodestone.operators import sessions
from lodestone.operators.numbering import numbered, running_sums


def test_numbers_without_gaps(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200), rng.choice(["a", "b", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, s string, i int").repartition(7)
    found = numbered(df, [F.col("k").desc(), F.col("s"), F.col("i")]).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2]))  # nulls first
    assert [tuple(r)[:3] for r in sorted(found, key=lambda r: r["number"])] == want
    assert sorted(r["number"] for r in found) == list(range(500))
    assert numbered(df.filter("k < 0"), [F.col("k")]).collect() == []


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 5, 1 << 40])) for i in rng.sample(range(10_000), 300)]
    found = {r["k"]: r["before"] for r in running_sums(spark.createDataFrame(rows, "k int, n long"), [F.col("k").desc()], "n").collect()}
    total = 0
    for k, n in sorted(rows, reverse=True):
        assert found[k] == total
        total += n or 0


def test_a_relation_is_not_dealt_to_one_task(spark):
    edges = spark.range(2000).select(F.lit("R").alias("relation"), F.lit("a").alias("src_label"), F.col("id").alias("src"), F.lit("b").alias("dst_label"), (F.col("id") % 7).alias("dst"))
    nodes = spark.range(1999).select(F.lit("a").alias("label"), "id").unionByName(spark.range(7).select(F.lit("b").alias("label"), "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = sessions.import_batches(edges, nodes, edges.limit(0).withColumn("batch", F.lit(0)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[relation#\d+, src_label#\d+, dst_label#\d+\]", plan)
        assert sorted((r["batch"], r["edges"], r["lost"]) for r in found.collect()) == [(0, 500, 0), (1, 500, 0), (2, 500, 0), (3, 500, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
