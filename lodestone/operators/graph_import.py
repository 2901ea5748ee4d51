"""Batched import of a graph into keyed tables, with a checkpoint after each batch.

Nodes are (label, id, name, attributes), edges (relation, src_label, src,
dst_label, dst). A node is merged: a later name wins and attributes are united.
An edge is written if both its ends are in the node table; others are counted
as lost and not marked as done, so a later run tries them again.

The checkpoint is the committed table itself: a run imports the keys that it
lacks. All rows of a key are in one batch, so a key is imported wholly or not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as K
from lodestone.operators.numbering import numbered
from lodestone.session import staged, unstage
from lodestone.sources.keyed import PATCH, PUT, KeyedTable

NODE = "label string, id string, name string, attributes map<string,string>"
NODE_KEY = ["label", "id"]
EDGE_KEY = ["relation", "src_label", "src", "dst_label", "dst"]
EDGE = ", ".join(f"{c} string" for c in EDGE_KEY)


def batches_of(rows: DataFrame, key: list[str], size: int) -> tuple[DataFrame, int]:
    """`rows` with a batch number, `size` keys each in the order of keys, and how
    many batches there are. No task holds more than its range of the table."""
    keys = numbered(rows.select(*key).distinct(), [F.col(c) for c in key], "__place")
    keys = keys.withColumn("batch", F.floor(F.col("__place") / size).cast("int")).drop("__place")
    dealt = staged(rows.join(keys, key).repartitionByRange("batch").sortWithinPartitions("batch"), "import-batches")
    last = dealt.agg(F.max("batch")).first()[0]
    return dealt, 0 if last is None else last + 1


class GraphImport:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.nodes = KeyedTable(spark, f"{path}/nodes", NODE, NODE_KEY, buckets)
        self.edges = KeyedTable(spark, f"{path}/edges", EDGE, EDGE_KEY, buckets)

    def run(self, nodes: DataFrame, edges: DataFrame, size: int = 500, most: int | None = None) -> dict[str, int]:
        """Import what the tables lack, nodes first; stops after `most` batches
        where given. Counts the rows it wrote, skipped and lost. `size` bounds
        the keys that one commit writes, not what a task holds; a large import
        takes millions. Rows of one node are merged in the order in which Spark
        reads them.
        """
        stats = {"nodes": 0, "edges": 0, "lost": 0, "skipped": 0, "batches": 0}
        ordered = nodes.fillna("", "name").withColumn("__row", F.monotonically_increasing_id())
        for kind, sink, rows in (("nodes", self.nodes, ordered), ("edges", self.edges, edges.select(*EDGE_KEY))):
            rows = staged(rows, "import-rows")
            todo = rows.join(sink.read().select(*sink.key), sink.key, "left_anti")
            left = todo.count()
            stats["skipped"] += rows.count() - left
            if kind == "edges":
                todo = K.linked_edges(self.nodes.read(), todo)
                stats["lost"] = left - todo.count()
            dealt, batches = batches_of(todo, sink.key, size)
            for batch in range(batches):
                if most is not None and stats["batches"] >= most:
                    unstage(dealt, rows)
                    return stats
                own = dealt.filter(F.col("batch") == batch).drop("batch")
                if kind == "nodes":
                    sink.merge(f"nodes-{uuid.uuid4().hex}", own, PATCH, "__row")
                else:
                    sink.merge(f"edges-{uuid.uuid4().hex}", own, PUT)
                stats[kind] += own.count()
                stats["batches"] += 1
            unstage(dealt, rows)
        return stats
