"""Queries of the table, history, graph, governance and evaluation operators and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation as E
from lodestone.operators import governance as G
from lodestone.operators import graph as K
from lodestone.operators import history as H
from lodestone.operators import tables as O
from lodestone.session import table

QUERIES, SQL = {}, {}
NOW = datetime(1998, 6, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Filters and access


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND props LIKE '%\"k\": 1%'")
def dynamic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = O.all_of(F.col("event_type") == "click", O.between("ts", datetime(2024, 1, 5), datetime(2024, 1, 20)), O.like_any("props", '"k": 1'), None)
    return table(spark, sf_dir, "events").filter(terms).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def audit_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return O.page(rows, [F.desc("ts"), F.asc("event_id")], 2, 20).select("event_id", "user_id", "event_type")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def audit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN true ELSE (doc_id % 3 = 0 OR source = 'src1') AND (doc_id % 5 = 0 OR list_contains(list_transform(string_split(lang || ' , ' || 'staff', ','), lambda x: trim(x)), 'en')) END AS ok FROM documents
""")
def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    dept = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    roles = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat("lang", F.lit(" , staff")))
    role = F.when(F.col("doc_id") % 11 == 0, "admin").otherwise("en")
    return table(spark, sf_dir, "documents").select("doc_id", O.acl_ok(dept, roles, F.lit("src1"), role).alias("ok"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def blocked_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.without(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


@query("""
SELECT lang, doc_id, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) d
WHERE r <= 40 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND source IN ('src1', 'src2', 'src3')
""")
def postfilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice 20 candidates are ranked first and filtered then, so fewer than 20 may stay."""
    top = O.first_per(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", "source"), ["lang"], ["n_chars DESC", "doc_id"], 40)
    return O.without(top.filter(F.col("source").isin("src1", "src2", "src3")), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id").select("lang", "doc_id", "place")


@query("SELECT event_id, user_id, value > 5 AS thumbs FROM events WHERE user_id = 7 AND value IS NOT NULL")
def owner_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("owner", F.col("user_id").cast("string"))
    return rows.filter(O.visible(F.col("owner"), "7", "user") & F.col("value").isNotNull()).select("event_id", "user_id", (F.col("value") > 5).alias("thumbs"))


# Folds and reports


@query("""
SELECT event_type AS tag, count(*) AS n, arg_max(props, (ts, event_id)) AS last_message FROM events GROUP BY event_type
""")
def degraded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n"), F.substring(F.max_by("props", F.struct("ts", "event_id")), 1, 500).alias("last_message"))


@query("""
SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND NOT value < 2
""")
def memory_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small values stand for deletions."""
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return O.latest(log, ["user_id", "event_type"], F.struct("ts", "event_id"), F.col("value") < 2).select("user_id", "event_type", "value")


@query("""
SELECT user_id, string_agg(event_type || '=' || CAST(k AS VARCHAR), ';' ORDER BY event_type) AS profile FROM (
  SELECT user_id, event_type, props ->> '$.k' AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id
""")
def profile_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), "ts", "event_id")
    last = O.latest(log, ["user_id", "event_type"], F.struct("ts", "event_id"))
    return last.groupBy("user_id").agg(F.expr("listagg(concat(event_type, '=', k), ';') WITHIN GROUP (ORDER BY event_type)").alias("profile"))


@query("""
WITH s(status) AS (VALUES ('F'), ('O'), ('P'), ('X')) SELECT status, count(o_orderkey) AS n FROM s LEFT JOIN orders ON o_orderstatus = status GROUP BY status
""")
def issue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


@query("""
SELECT count(*) AS documents, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS characters, count(quality) AS governed, round(count(quality) / count(*), 6) AS coverage,
  count(*) FILTER (quality = 0 OR toxic = 1) AS unresolved FROM documents LEFT JOIN labels USING (doc_id)
""")
def kb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return both.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("characters"), F.count("quality").alias("governed"), F.round(F.count("quality") / F.count("*"), 6).alias("coverage"), F.count(F.when(bad, 1)).alias("unresolved"))


@query("SELECT o_custkey AS doc, CAST(count(*) + 1 AS BIGINT) AS version, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)").cast("bigint").alias("v"))
    return numbered.groupBy(F.col("o_custkey").alias("doc")).agg((F.coalesce(F.max("v"), F.lit(0)) + 1).alias("version"), F.max_by("o_orderkey", "v").alias("newest"))


@query("""
SELECT fingerprint, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT sha1('late:' || o_custkey) AS fingerprint, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT sha1('late:' || o_custkey), count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) GROUP BY fingerprint
""")
def gov_scan_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", T.fingerprint(F.lit("late"), F.col("o_custkey").cast("string")).alias("fingerprint"))
    known = orders.filter("o_orderstatus = 'F'").groupBy("fingerprint").agg(F.count("*").alias("n"))
    return O.upsert_counts(known, orders.filter("o_orderstatus = 'P'"), "fingerprint")


@query("SELECT 'lineitem' AS part, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 10 <> 0")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), "lineitem": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))}
    left = O.cascade(tables, tables["orders"].filter("key % 10 = 0"), "key")
    counts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@query("SELECT l_orderkey AS parent, l_linenumber AS child, CASE WHEN l_orderkey % 4 = 0 AND l_linenumber <= 2 THEN 'new' ELSE 'old' END AS state FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_linenumber <= 2 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2)")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"))
    fresh = rows.filter("parent % 4 = 0 AND child <= 2").withColumn("state", F.lit("new"))
    return O.replace_children(rows.withColumn("state", F.lit("old")), fresh, "parent")


@query("SELECT c_mktsegment AS kind, c_custkey AS id, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= 5")
def per_type_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_per(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("id")), ["kind"], ["id"], 5)


@query("SELECT p_name AS name, p_type AS kind, min(p_partkey) AS id FROM part GROUP BY p_name, p_type")
def first_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.distinct_first(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("id")), ["name", "kind"], "id")


@query("""
SELECT event_id, round(user_id / 1e6 + value * 3 / 1e6, 9) AS cost, CASE WHEN value > 30 THEN 'slow' WHEN user_id % 10 = 0 THEN 'retry' WHEN event_type = 'error' THEN 'empty_answer' END AS reason FROM events
""")
def trace_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = O.force_sample(F.col("value") * 1000, (F.col("user_id") % 10 == 0).cast("int"), F.lit(True), F.lit("q"), F.when(F.col("event_type") == "error", "").otherwise("a"))
    return table(spark, sf_dir, "events").select("event_id", F.round(O.token_cost(F.col("user_id"), F.col("value")), 9).alias("cost"), reason.alias("reason"))


@query()
def trace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(O.sampled(F.col("event_id"), 0.1)).select("event_id", "event_type")


@query("SELECT b.item_id, b.text FROM benchmark b UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE text IS NULL OR text NOT IN (SELECT text FROM benchmark)")
def golden_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = table(spark, sf_dir, "benchmark").select("item_id", "text")
    more = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000).alias("item_id"), "text")
    return golden.unionByName(O.without(more, golden, "text").select("item_id", "text"))


# History


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.last_turns(table(spark, sf_dir, "conversations"), 6).select("conv_id", "turn", "role")


BACK = "sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, {BACK} AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE used <= 600 OR r = 1")
def token_budget_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.budget_suffix(table(spark, sf_dir, "conversations"), F.length("text"), 600).select("conv_id", "turn", "used")


@query(f"""
WITH f AS (SELECT *, CAST({BACK} AS BIGINT) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
k AS (SELECT * FROM f WHERE used <= 600 OR r = 1), d AS (SELECT conv_id, count(*) FILTER (used > 600 AND r > 1) AS older FROM f GROUP BY conv_id)
SELECT conv_id, turn, used + 50 AS used, older FROM k JOIN d USING (conv_id) WHERE used + 50 <= 600
""")
def summary_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older messages become a summary of 50; the rest must fit beside it, the newest too."""
    talk = table(spark, sf_dir, "conversations")
    recent = H.budget_suffix(talk, F.length("text"), 600).select("conv_id", "turn", "role", "text")
    sizes = talk.groupBy("conv_id").agg(F.count("*").alias("n")).join(recent.groupBy("conv_id").agg(F.count("*").alias("kept")), "conv_id")
    packed = H.budget_suffix(recent, F.length("text"), 600, keep_newest=False, spent=F.lit(50))
    return packed.join(sizes, "conv_id").select("conv_id", "turn", "used", (F.col("n") - F.col("kept")).alias("older"))


@query("""
SELECT conv_id, turn, CASE WHEN sum(length(text) + length(role) + 2) OVER (PARTITION BY conv_id) <= 1200 THEN 'all'
  WHEN sum(length(text) + length(role) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 1200 THEN 'older' ELSE 'recent' END AS part FROM conversations
""")
def memory_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.memory_split(table(spark, sf_dir, "conversations"), F.length("text") + F.length("role") + 2, 1200).select("conv_id", "turn", "part")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn <= 2 OR conv_id % 2 = 1")
def truncate_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    cuts = talk.filter("conv_id % 2 = 0").select("conv_id").distinct().withColumn("last_turn", F.lit(2))
    return H.cut_after(talk, cuts).select("conv_id", "turn", "role")


@query("""
WITH a AS (SELECT * FROM conversations WHERE role = 'assistant'), u AS (SELECT * FROM conversations WHERE role = 'user')
SELECT a.conv_id, a.turn, a.text AS answer, u.text AS question FROM a ASOF LEFT JOIN u ON a.conv_id = u.conv_id AND a.turn >= u.turn
""")
def asof_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.question_of(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("text").alias("answer"), "question")


@query(r"""
WITH a AS (SELECT * FROM conversations WHERE role = 'assistant'), u AS (SELECT * FROM conversations WHERE role = 'user'),
q AS (SELECT a.conv_id, a.turn, regexp_replace(a.text, '[\x09-\x0D\x20]+', '', 'g') AS x, regexp_replace(u.text, '[\x09-\x0D\x20]+', '', 'g') AS y FROM a ASOF LEFT JOIN u ON a.conv_id = u.conv_id AND a.turn >= u.turn),
g AS (SELECT conv_id, turn, CASE WHEN length(x) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(x) - 1, 1) + 1), lambda i: substring(x, i, 2))) END AS a,
  CASE WHEN length(y) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(y) - 1, 1) + 1), lambda i: substring(y, i, 2))) END AS b FROM q WHERE y IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(1, len(a)), 6) AS overlap, len(list_intersect(a, b)) / greatest(1, len(a)) >= 0.08 AS ok FROM g
""")
def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = H.question_of(table(spark, sf_dir, "conversations")).filter("question IS NOT NULL").select("conv_id", "turn", T.bigrams(F.col("text")).alias("a"), T.bigrams(F.col("question")).alias("b"))
    overlap = F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size("a"))
    return pairs.select("conv_id", "turn", F.round(overlap, 6).alias("overlap"), (overlap >= 0.08).alias("ok"))


@query("""
WITH a AS (SELECT * FROM conversations WHERE role = 'assistant'), u AS (SELECT * FROM conversations WHERE role = 'user'),
q AS (SELECT a.conv_id, a.turn, a.text AS x, u.text AS y FROM a ASOF JOIN u ON a.conv_id = u.conv_id AND a.turn >= u.turn),
g AS (SELECT *, list_distinct(string_split(x, '')) AS a, list_distinct(string_split(y, '')) AS b FROM q WHERE x <> '' AND y <> '')
SELECT conv_id, turn, contains(x, y) OR contains(y, x) OR len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))) >= 0.7 AS covers FROM g
""")
def char_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = H.question_of(table(spark, sf_dir, "conversations")).filter("text <> '' AND question <> ''")
    return pairs.select("conv_id", "turn", T.covers(F.col("text"), F.col("question")).alias("covers"))


@query("SELECT conv_id, count(*) AS messages, arg_min(text, turn) FILTER (role = 'user') AS first_question, bool_or(length(text) = 0) AS refused FROM conversations GROUP BY conv_id")
def feedback_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), first.alias("first_question"), F.bool_or(F.length("text") == 0).alias("refused"))


@query()
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    return H.rate_limited(attempts, 86_400, 3)


# Graph: nodes of the star schema, edges of its foreign keys


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: table(spark, sf_dir, name)
    node = lambda label, df, key, name: df.select(F.lit(label).alias("label"), F.col(key).cast("bigint").alias("id"), F.col(name).alias("name"))
    nodes = node("region", t("region"), "r_regionkey", "r_name").unionByName(node("nation", t("nation"), "n_nationkey", "n_name")).unionByName(node("supplier", t("supplier"), "s_suppkey", "s_name")).unionByName(node("customer", t("customer"), "c_custkey", "c_name"))

    def edge(relation, a, src, b, dst, df):
        return df.select(F.lit(relation).alias("relation"), F.lit(a).alias("src_label"), F.col(src).cast("bigint").alias("src"), F.lit(b).alias("dst_label"), F.col(dst).cast("bigint").alias("dst"))

    edges = edge("IN_REGION", "nation", "n_nationkey", "region", "n_regionkey", t("nation")).unionByName(edge("IN_NATION", "supplier", "s_suppkey", "nation", "s_nationkey", t("supplier")))
    edges = edges.unionByName(edge("IN_NATION", "customer", "c_custkey", "nation", "c_nationkey", t("customer"))).unionByName(edge("SUPPLIES", "supplier", "l_suppkey", "part", "l_partkey", t("lineitem")))
    return nodes, edges


GRAPH = """
nodes AS (SELECT 'region' AS label, CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL
  SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer),
edges AS (SELECT 'IN_REGION' AS relation, 'nation' AS src_label, CAST(n_nationkey AS BIGINT) AS src, 'region' AS dst_label, CAST(n_regionkey AS BIGINT) AS dst FROM nation UNION ALL
  SELECT 'IN_NATION', 'supplier', s_suppkey, 'nation', s_nationkey FROM supplier UNION ALL SELECT 'IN_NATION', 'customer', c_custkey, 'nation', c_nationkey FROM customer UNION ALL
  SELECT 'SUPPLIES', 'supplier', l_suppkey, 'part', l_partkey FROM lineitem)"""


@query(f"""
WITH {GRAPH}, h AS (SELECT e.dst_label AS label, e.dst AS id, relation, src_label AS n_label, src AS n_id, name AS n_name FROM edges e JOIN nodes n ON n.label = src_label AND n.id = src WHERE dst_label = 'nation')
SELECT label, id, relation, n_label, n_id, n_name FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY relation, n_label, n_id) AS r FROM h) WHERE r <= 20
""")
def kg_expand_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return K.expand(nodes, edges, nodes.filter("label = 'nation'"), out=False)


@query(f"""
WITH {GRAPH} SELECT e.src_label AS label, e.src AS id, relation, dst_label AS n_label, dst AS n_id, name AS n_name FROM edges e JOIN nodes n ON n.label = dst_label AND n.id = dst WHERE src_label IN ('supplier', 'nation')
""")
def kg_expand_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return K.expand(nodes, edges, nodes.filter("label IN ('supplier', 'nation')"))


@query(f"WITH {GRAPH} SELECT relation, src_label, dst_label, count(*) AS n FROM edges GROUP BY ALL")
def kg_schema_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.schema_pairs(_graph(spark, sf_dir)[1])


@query(f"WITH {GRAPH} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def kg_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0].groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH} SELECT DISTINCT relation, src, dst FROM edges WHERE dst_label = 'part'")
def kg_lost_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return K.linked_edges(nodes, K.distinct_edges(edges), lost=True).select("relation", "src", "dst")


@query("""
SELECT p_type AS label, p_name AS name, key, arg_min(value, seq) AS value FROM (
  SELECT p_type, p_name, 'brand' AS key, p_brand AS value, p_partkey AS seq FROM part UNION ALL SELECT p_type, p_name, 'size', CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END, p_partkey FROM part) WHERE value IS NOT NULL GROUP BY ALL
""")
def kg_merge_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    cell = lambda key, value: part.select(F.col("p_type").alias("label"), F.col("p_name").alias("name"), F.lit(key).alias("key"), value.alias("value"), F.col("p_partkey").alias("seq"))
    return K.merge_attributes(cell("brand", F.col("p_brand")).unionByName(cell("size", F.when(F.col("p_size") > 10, F.col("p_size").cast("string")))))


@query(f"""
WITH {GRAPH}, r AS (SELECT 'nation' AS src_label, n_name || CASE WHEN n_nationkey % 5 = 0 THEN '?' ELSE '' END AS src_name FROM nation)
SELECT r.src_label, src_name, coalesce(CAST(id AS VARCHAR), src_name) AS src FROM r LEFT JOIN nodes ON label = r.src_label AND name = src_name
""")
def kg_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _graph(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.lit("nation").alias("src_label"), F.concat("n_name", F.when(F.col("n_nationkey") % 5 == 0, "?").otherwise("")).alias("src_name"))
    return K.resolve_names(names, nodes)


@query(f"WITH {GRAPH} SELECT DISTINCT label, name, 'E' || md5(label || ':' || name)[1:12] AS entity FROM nodes")
def kg_entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.entity_ids(_graph(spark, sf_dir)[0])


# Governance: orders stand for documents with their governance rows


def _governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "F", "effective").when(F.col("o_orderkey") % 3 == 0, "withdrawn").when(F.col("o_orderkey") % 3 == 1, "draft").otherwise("effective")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 17 != 0).alias("has_meta"),
        F.when(F.col("o_custkey") % 7 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("owner"), F.col("o_orderpriority").alias("applicable_region"),
        F.when(F.col("o_orderkey") % 13 != 0, day).alias("effective_at"), F.when(F.col("o_orderkey") % 5 != 0, day + F.expr("INTERVAL 365 DAYS")).alias("expires_at"), (F.col("o_orderkey") % 4 == 0).alias("is_permanent"),
        F.when(F.col("o_orderkey") % 6 == 0, 30).alias("review_interval_days"), F.when(F.col("o_orderkey") % 9 == 0, day + F.expr("INTERVAL 90 DAYS")).alias("next_review_at"), F.lit("v1").alias("version_label"), status.alias("version_status"),
    )


GOVERNED = """
g AS (SELECT o_orderkey AS doc_id, o_orderkey % 17 <> 0 AS has_meta, o_custkey % 7 = 0 AS no_owner, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS effective_at,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 365 DAY END AS expires_at, o_orderkey % 4 = 0 AS permanent, o_orderkey % 6 = 0 AS has_interval, CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS next_review_at,
  CASE WHEN o_orderstatus = 'F' THEN 'effective' WHEN o_orderkey % 3 = 0 THEN 'withdrawn' WHEN o_orderkey % 3 = 1 THEN 'draft' ELSE 'effective' END AS status FROM orders),
s AS (SELECT *, CASE WHEN NOT has_meta THEN 'metadata_incomplete' WHEN status IN ('draft', 'withdrawn') THEN status WHEN effective_at IS NULL THEN 'metadata_incomplete' WHEN effective_at > TIMESTAMP '1998-06-01' THEN 'not_yet_effective'
  WHEN NOT permanent AND expires_at < TIMESTAMP '1998-06-01' THEN 'expired' ELSE 'active' END AS state,
  CASE WHEN NOT has_meta THEN 'owner,applicableRegion,effectiveAt,expiryPolicy,reviewPolicy,versionLabel,versionStatus' ELSE concat_ws(',', CASE WHEN no_owner THEN 'owner' END, CASE WHEN effective_at IS NULL THEN 'effectiveAt' END,
    CASE WHEN NOT permanent AND expires_at IS NULL THEN 'expiryPolicy' END, CASE WHEN NOT has_interval AND next_review_at IS NULL THEN 'reviewPolicy' END) END AS missing FROM g)"""


@query(f"WITH {GOVERNED} SELECT doc_id, state, state NOT IN ('withdrawn', 'not_yet_effective', 'expired') AS retrievable FROM s")
def gov_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = G.effective_state(NOW)
    return _governed(spark, sf_dir).select("doc_id", state.alias("state"), G.retrievable(state).alias("retrievable"))


@query(f"WITH {GOVERNED} SELECT doc_id, missing FROM s")
def gov_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _governed(spark, sf_dir).select("doc_id", F.array_join(G.missing_fields(), ",").alias("missing"))


@query(f"""
WITH {GOVERNED} SELECT doc_id, 'metadata_missing' AS issue_type, 'warning' AS severity FROM s WHERE missing <> '' UNION ALL SELECT doc_id, state, CASE state WHEN 'expired' THEN 'critical' ELSE 'info' END FROM s WHERE state IN ('expired', 'not_yet_effective')
UNION ALL SELECT doc_id, 'expiring', 'warning' FROM s WHERE state = 'active' AND NOT permanent AND expires_at <= TIMESTAMP '1998-07-01' UNION ALL SELECT doc_id, 'review_due', 'warning' FROM s WHERE has_meta AND next_review_at <= TIMESTAMP '1998-06-01'
""")
def gov_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.findings(_governed(spark, sf_dir), NOW)


# Evaluation


@query("SELECT count(*) AS n, round(avg(quality), 6) AS quality, count(quality) AS n_quality, round(avg(toxic), 6) AS toxic, count(toxic) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.means(table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left"), ["quality", "toxic"])


@query("""
WITH s AS (SELECT source, len(list_filter(['the', 'tion', 'los'], lambda k: contains(text, k))) / 3 AS score FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (score = 1) AS passed, count(*) FILTER (score < 1) AS failed, round(count(*) FILTER (score = 1) / count(*), 6) AS pass_rate FROM s GROUP BY source
""")
def golden_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "documents").select("source", E.keyword_score(F.col("text"), F.lit(["the", "tion", "los"])).alias("score"))
    passed = F.count(F.when(F.col("score") == 1, 1))
    return scored.groupBy("source").agg(F.count("*").alias("n"), passed.alias("passed"), F.count(F.when(F.col("score") < 1, 1)).alias("failed"), F.round(passed / F.count("*"), 6).alias("pass_rate"))


@query("""
WITH g AS (SELECT item_id, CASE WHEN item_id % 9 = 0 THEN ' ' ELSE text END AS q, item_id % 5 = 0 AS bare, count(*) OVER (PARTITION BY CASE WHEN item_id % 9 = 0 THEN ' ' ELSE text END) AS copies FROM benchmark)
SELECT item_id, concat_ws(',', CASE WHEN trim(q) = '' THEN 'empty_query' END, CASE WHEN bare THEN 'no_expectation' END, CASE WHEN copies > 1 THEN 'duplicate_query' END) AS errors FROM g
""")
def golden_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 9 == 0, " ").otherwise(F.col("text")).alias("query"), F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("expect"), F.lit("c").alias("category"))
    copies = rows.groupBy("query").agg(F.count("*").alias("copies"))
    return rows.join(copies, "query").select("item_id", F.array_join(E.golden_errors(), ",").alias("errors"))
