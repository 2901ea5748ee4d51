"""Knowledge graph: merging, expanding and describing nodes and edges.

Nodes are (label, id, name), edges (relation, src_label, src, dst_label, dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.numbering import numbered


def expand(nodes: DataFrame, edges: DataFrame, starts: DataFrame, out: bool = True, limit: int = 20) -> DataFrame:
    """One hop from (label, id) starts: relation and neighbour, `limit` each by
    relation and id. Edges meet the starts before any node is looked up."""
    near, far = ("src", "dst") if out else ("dst", "src")
    hops = edges.join(starts.select(F.col("label").alias(f"{near}_label"), F.col("id").alias(near)), [f"{near}_label", near], "left_semi")
    hops = hops.select(F.col(f"{near}_label").alias("label"), F.col(near).alias("id"), "relation", F.col(f"{far}_label").alias("n_label"), F.col(far).alias("n_id"))
    named = hops.join(nodes.select(F.col("label").alias("n_label"), F.col("id").alias("n_id"), F.col("name").alias("n_name")), ["n_label", "n_id"])
    place = F.expr("row_number() OVER (PARTITION BY label, id ORDER BY relation, n_label, n_id)")
    return named.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def schema_pairs(edges: DataFrame, limit: int = 20) -> DataFrame:
    """Pairs of labels of each relation, with their counts."""
    pairs = edges.groupBy("relation", "src_label", "dst_label").agg(F.count("*").alias("n"))
    return pairs.withColumn("place", F.expr("row_number() OVER (PARTITION BY relation ORDER BY n DESC, src_label, dst_label)")).filter(F.col("place") <= limit).drop("place")


def linked_edges(nodes: DataFrame, edges: DataFrame, lost: bool = False) -> DataFrame:
    """Edges both of whose ends exist, or with `lost` those that lack one."""
    ends = nodes.select("label", "id").distinct()
    src = ends.select(F.col("label").alias("src_label"), F.col("id").alias("src"), F.lit(True).alias("has_src"))
    dst = ends.select(F.col("label").alias("dst_label"), F.col("id").alias("dst"), F.lit(True).alias("has_dst"))
    both = edges.join(src, ["src_label", "src"], "left").join(dst, ["dst_label", "dst"], "left")
    whole = F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()
    return both.filter(~whole if lost else whole).select(*edges.columns)


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["relation", "src_label", "src", "dst_label", "dst"])


def merge_attributes(rows: DataFrame) -> DataFrame:
    """Rows (label, name, key, value, seq): of each entity and key the first
    value by seq that isn't null."""
    return rows.filter("value IS NOT NULL").groupBy("label", "name", "key").agg(F.min_by("value", "seq").alias("value"))


def resolve_names(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relation ends (src_label, src_name) by id; unknown names stay."""
    ids = nodes.groupBy(F.col("label").alias("src_label"), F.col("name").alias("src_name")).agg(F.min("id").alias("found"))
    return relations.join(ids, ["src_label", "src_name"], "left").withColumn("src", F.coalesce(F.col("found").cast("string"), "src_name")).drop("found")


def repeated_keys(nodes: DataFrame) -> DataFrame:
    """Keys that break uniqueness of (label, id)."""
    return nodes.groupBy("label", "id").agg(F.count("*").alias("n")).filter("n > 1")


def entity_ids(nodes: DataFrame) -> DataFrame:
    """A stable id per (label, name): a hash, so no global order is needed."""
    return nodes.select("label", "name").distinct().withColumn("entity", F.concat(F.lit("E"), F.substring(F.md5(F.concat_ws(":", "label", "name").cast("binary")), 1, 12)))


def numbered_entities(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(label, name, entity): E1, E2 ... in the order in which `rows` (label,
    name, seq) first show each entity; ties by label and name. The order spans
    the whole table, but no task holds more than its range of it."""
    first = rows.groupBy("label", "name").agg(F.min(seq).alias("first"))
    placed = numbered(first, [F.col("first"), F.col("label"), F.col("name")])
    return placed.select("label", "name", F.concat(F.lit("E"), (F.col("number") + 1).cast("string")).alias("entity"))
