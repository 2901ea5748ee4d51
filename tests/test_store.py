import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as K
from lodestone.operators import sessions as S
from lodestone.operators.graph_import import GraphImport
from lodestone.session import new_path
from lodestone.sources.keyed import DELETE, PATCH, PUT, KeyedTable

SCHEMA = "k int, a string, b string, m map<string,string>"


def apply(state, changes):
    for _, k, kind, a, b, m in sorted(changes):
        if kind == DELETE:
            state.pop(k, None)
            continue
        old = [None, None, {}] if kind == PUT or k not in state else state[k]
        state[k] = [a if a is not None else old[0], b if b is not None else old[1], {**old[2], **{x: y for x, y in (m or {}).items() if y is not None}}]


def random_changes(rng, n):
    pick = lambda: rng.choice([None, "x", "y", "z"])
    return [(i, rng.choice([0, 0, 0, rng.randrange(12)]), rng.choice([PUT, PATCH, PATCH, DELETE]), pick(), pick(), rng.choice([None, {}, {"p": pick()}, {"p": "1", rng.choice("qr"): pick()}])) for i in range(n)]


def test_changes_equal_a_plain_walk(spark):
    from pyspark.sql.types import StructType

    rng, want = random.Random(1), {}
    store = KeyedTable(spark, new_path(spark, "keyed"), StructType.fromDDL(SCHEMA), ["k"], buckets=4)
    assert store.read().collect() == []
    for batch in range(4):
        changes = random_changes(rng, 30)
        df = spark.createDataFrame(changes, "at int, k int, kind string, a string, b string, m map<string,string>")
        assert store.merge(f"b{batch}", df, F.col("kind"), "at")
        assert not store.merge(f"b{batch}", df, F.col("kind"), "at")  # a rerun does nothing
        apply(want, changes)
        if batch == 2:
            assert store.compact() and store.vacuum() == 3
        got = {r["k"]: [r["a"], r["b"], r["m"] or {}] for r in store.read().collect()}
        assert got == want


def test_a_point_read_opens_one_bucket(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    store = KeyedTable(spark, new_path(spark, "keyed"), rows.schema, ["k"], buckets=8)
    store.merge("all", rows, PUT)
    store.compact()
    found = store.get(rows.filter("k = 77"))
    assert [tuple(r) for r in found.collect()] == [(77, "77")]
    assert len(found.inputFiles()) == 1 + len(rows.inputFiles()) and len(store.read().inputFiles()) == 8
    store.merge("gone", rows.filter("k = 77"), DELETE)
    assert store.get(rows.filter("k = 77")).isEmpty() and store.read().count() == 999


def test_an_unfinished_write_does_not_count(spark, monkeypatch):
    rows = spark.range(10).select(F.col("id").alias("k"))
    store = KeyedTable(spark, new_path(spark, "keyed"), rows.schema, ["k"], buckets=2)
    monkeypatch.setattr(KeyedTable, "_commit", lambda self, **what: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.merge("one", rows, PUT)
    monkeypatch.undo()
    assert store.read().isEmpty() and store.vacuum() == 1
    assert store.merge("one", rows, PUT) and store.read().count() == 10


@pytest.mark.parametrize("killed_after", [0, 1, 3])
def test_import_goes_on_where_it_was_killed(spark, killed_after):
    nodes = spark.createDataFrame([("a", str(i), f"n{i}", {"x": str(i)}) for i in range(20)] + [("a", "3", "later", {"y": "1", "x": None})], "label string, id string, name string, attributes map<string,string>").coalesce(1)
    edges = spark.createDataFrame([("R", "a", str(i % 25), "a", str(i % 7)) for i in range(60)], "relation string, src_label string, src string, dst_label string, dst string")
    sink = GraphImport(spark, new_path(spark, "graph"), 2)
    first = sink.run(nodes, edges, 15, most=killed_after)
    assert first["batches"] == killed_after
    last = sink.run(nodes, edges, 15)
    linked = {(str(i % 25), str(i % 7)) for i in range(60) if i % 25 < 20}
    assert {(r["src"], r["dst"]) for r in sink.edges.read().collect()} == linked and sink.edges.read().count() == len(linked)
    got = {r["id"]: (r["name"], r["attributes"]) for r in sink.nodes.read().collect()}
    assert got["3"] == ("later", {"x": "3", "y": "1"}) and len(got) == 20
    again = sink.run(nodes, edges, 15)
    lost = sum(i % 25 >= 20 for i in range(60))
    assert again == {"nodes": 0, "edges": 0, "lost": lost, "skipped": 21 + 60 - lost, "batches": 0}
    assert first["nodes"] + last["nodes"] == 21 and last["lost"] == lost
    more = spark.createDataFrame([("a", str(i), None, None) for i in range(20, 25)], nodes.schema)
    assert sink.run(nodes.unionByName(more).coalesce(1), edges, 15)["lost"] == 0
    assert sink.edges.read().count() == len({(i % 25, i % 7) for i in range(60)})


def test_numbers_of_entities_and_repeated_nodes(spark):
    seen = [("h", "x", 5), ("h", "y", 2), ("f", "x", 9), ("h", "x", 1), ("f", "y", 2)]
    found = {(r["label"], r["name"]): r["entity"] for r in K.numbered_entities(spark.createDataFrame(seen, "label string, name string, seq int")).collect()}
    assert found == {("h", "x"): "E1", ("f", "y"): "E2", ("h", "y"): "E3", ("f", "x"): "E4"}
    edges = spark.createDataFrame([("R", "a", 1, "a", 2)], "relation string, src_label string, src long, dst_label string, dst long")
    nodes = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "label string, id long")
    one = S.import_batches(edges, nodes, edges.limit(0).withColumn("batch", F.lit(0))).collect()
    assert [(r["edges"], r["lost"]) for r in one] == [(1, 0)]
