"""Rows as a service keeps and shows them: pages with totals, users, audit rows,
inserts, versions, lookups and batches of graph statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph as K
from lodestone.operators import tables as O
from lodestone.operators.sessions import PLACEHOLDER

MIME_TYPES = {".pdf": "application/pdf", ".txt": "text/plain; charset=utf-8", ".md": "text/plain; charset=utf-8"}
AUDIT_LENGTHS = {"action": 32, "subject": 128, "predicate": 128, "object_preview": 64, "detail": 255}  # fixed values: how much of each an audit row keeps
RECORDS_SHOWN = 20


def page_with_total(rows: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """A page of rows, each with how many there are in all. A page past the
    end has no rows and so no total: count for itself there."""
    total = rows.agg(F.count("*").alias("total"))
    return O.page(rows, order, number, size).crossJoin(F.broadcast(total))  # one row


def active_admins(users: DataFrame) -> DataFrame:
    return users.filter("role = 'admin' AND status = 'active'").agg(F.count("*").alias("n"))


def sign_in_rows(users: DataFrame, names: DataFrame) -> DataFrame:
    """Active users (username, status) of the wanted names (username); names in
    use twice give the user that was created first."""
    known = O.distinct_first(users, ["username"], "created_at")
    return known.filter("status = 'active'").join(names.select("username").distinct(), "username", "left_semi")


def mime_type(name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    out = F.lit("application/octet-stream")
    for end, kind in MIME_TYPES.items():
        out = F.when(suffix == end, kind).otherwise(out)
    return out


def audit_rows(rows: DataFrame) -> DataFrame:
    """Audit rows with texts cut to what the log keeps; nulls are empty."""
    return rows.select("user_id", *[F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c) for c, n in AUDIT_LENGTHS.items()])


def answers_by_query(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Items (query) with the answer (query, answer) to just that text, empty
    without one; of several answers the last by `at`."""
    last = answers.groupBy("query").agg(F.max_by("answer", "at").alias("answer"))
    return items.join(last, "query", "left").withColumn("answer", F.coalesce("answer", F.lit("")))


def api_rows(rows: DataFrame, names: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Columns under the names of an interface, nulls replaced by its defaults."""
    return rows.select(*[(F.coalesce(F.col(c), F.lit(defaults[n])) if n in defaults else F.col(c)).alias(n) for c, n in names.items()])


def entity_scan(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """(id, name, type) of all nodes (id, name, labels): the type is the first
    of a node's labels that is one of `labels`; nodes without are left out."""
    known = F.filter("labels", lambda x: x.isin(labels))
    return nodes.withColumn("type", F.element_at(F.when(F.size(known) > 0, known), 1)).filter("type IS NOT NULL").select("id", "name", "type")


def profile_maps(log: DataFrame) -> DataFrame:
    """(user_id, profile) of a log (user_id, k, v, at): each key's last value, as
    a map; keys whose last value is null are left out."""
    last = log.groupBy("user_id", "k").agg(F.max_by(F.struct("v"), "at").alias("r")).filter("r.v IS NOT NULL")
    return last.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "r.v")))).alias("profile"))


def insert_messages(conversations: DataFrame, messages: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) with `fresh` messages (conv_id, turn, role,
    text, at) added: conversations that are new get the title of unnamed ones,
    and updated_at moves to the newest message."""
    newest = fresh.groupBy("conv_id").agg(F.max("at").alias("at"))
    both = conversations.join(newest, "conv_id", "full")
    moved = both.select("conv_id", F.coalesce("title", F.lit(PLACEHOLDER)).alias("title"), F.greatest("updated_at", "at").alias("updated_at"))
    return moved, messages.unionByName(fresh, allowMissingColumns=True)


def archive_versions(docs: DataFrame, versions: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, versions) after new files (doc_id, file) came: the file that a
    document (doc_id, file, status) had becomes its next version (doc_id,
    version, file), and the document is pending with the new one."""
    last = versions.groupBy("doc_id").agg(F.max("version").alias("last"))
    new = fresh.select("doc_id", F.col("file").alias("new_file"))
    old = docs.join(new, "doc_id").join(last, "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "file")
    both = docs.join(new, "doc_id", "left")
    moved = both.withColumn("status", F.when(F.col("new_file").isNotNull(), "pending").otherwise(F.col("status"))).withColumn("file", F.coalesce("new_file", "file")).drop("new_file")
    return moved, versions.select("doc_id", "version", "file").unionByName(old)


def roll_back(docs: DataFrame, versions: DataFrame, chunks: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, versions, chunks) with documents put back to a version (doc_id,
    version): the present file is archived, the version's is pending, and the
    chunks go. Versions that don't exist change nothing."""
    target = wanted.select("doc_id", "version").join(versions, ["doc_id", "version"]).select("doc_id", "file")
    moved, kept = archive_versions(docs, versions, target)
    return moved, kept, O.without(chunks, target, "doc_id")


def version_list(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, version, file, current): archived versions and the present file,
    whose number follows the last."""
    last = versions.groupBy("doc_id").agg(F.max("version").alias("last"))
    now = docs.join(last, "doc_id", "left").select("doc_id", (F.coalesce("last", F.lit(0)) + 1).alias("version"), "file", F.lit(True).alias("current"))
    return now.unionByName(versions.select("doc_id", "version", "file", F.lit(False).alias("current")))


def property_keys(nodes: DataFrame, most: int = 500) -> DataFrame:
    """(label, keys): the distinct property names of each label's first nodes."""
    first = O.first_per(nodes, ["label"], ["id"], most)
    return first.select("label", F.explode(F.map_keys("attributes")).alias("k")).groupBy("label").agg(F.array_sort(F.collect_set("k")).alias("keys"))


def run_statements(nodes: DataFrame, edges: DataFrame, statements: DataFrame, limit: int = RECORDS_SHOWN) -> tuple[DataFrame, DataFrame]:
    """(results, records) of a batch of graph statements (statement, direction,
    label, id, relation), one hop from a node, all in two joins.

    Each statement has a result: ok with how many records it gives, or an
    error: `empty` without a label or id, `direction`, `label` or `relation`
    where the graph knows no such. A null relation means any. Records are
    (statement, relation, n_label, n_id, n_name), `limit` a statement.
    """
    labels = nodes.select("label").distinct().withColumn("__label", F.lit(True))
    relations = edges.select("relation").distinct().withColumn("__relation", F.lit(True))
    judged = statements.join(F.broadcast(labels), "label", "left").join(F.broadcast(relations), "relation", "left")  # one row a label and relation
    error = F.when(F.col("label").isNull() | F.col("id").isNull(), "empty").when(~F.coalesce(F.col("direction").isin("out", "in"), F.lit(False)), "direction").when(F.col("__label").isNull(), "label").when(F.col("relation").isNotNull() & F.col("__relation").isNull(), "relation")
    judged = judged.withColumn("error", error)
    sound = judged.filter("error IS NULL")
    found = None
    for direction in ("out", "in"):
        own = sound.filter(F.col("direction") == direction).select("statement", "label", "id", F.col("relation").alias("wanted"))
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        hops = edges.select(F.col(f"{near}_label").alias("label"), F.col(near).alias("id"), "relation", F.col(f"{far}_label").alias("n_label"), F.col(far).alias("n_id"))
        met = own.join(hops, ["label", "id"]).filter(F.col("wanted").isNull() | (F.col("wanted") == F.col("relation")))
        part = met.select("statement", "relation", "n_label", "n_id").distinct()
        found = part if found is None else found.unionByName(part)
    named = found.join(nodes.select(F.col("label").alias("n_label"), F.col("id").alias("n_id"), F.col("name").alias("n_name")), ["n_label", "n_id"])
    records = O.first_per(named, ["statement"], ["relation", "n_label", "n_id"], limit).drop("place")
    counts = records.groupBy("statement").agg(F.count("*").alias("n"))
    results = judged.join(counts, "statement", "left").select("statement", F.col("error").isNull().alias("ok"), "error", F.coalesce("n", F.lit(0)).alias("records"))
    return results, records.select("statement", "relation", "n_label", "n_id", "n_name")
