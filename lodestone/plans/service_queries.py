"""Queries of service rows, prompts and graph statements, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import prompts as P
from lodestone.functions import records as B
from lodestone.functions import text as T
from lodestone.functions import vectors as X
from lodestone.operators import graph as K
from lodestone.operators import retrieval as R
from lodestone.operators import services as V
from lodestone.operators import sessions as S
from lodestone.plans.table_queries import GRAPH, _graph
from lodestone.session import new_path, table
from lodestone.sources import documents as D

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return V.page_with_total(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 25)


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users: two names each, every fiftieth an admin, in debt disabled."""
    people = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("user"), (F.col("c_custkey") / 2).cast("int").cast("string"))
    return people.select(name.alias("username"), F.when(F.col("c_custkey") % 50 == 0, "admin").otherwise("user").alias("role"), F.when(F.col("c_acctbal") > 0, "active").otherwise("disabled").alias("status"), F.col("c_custkey").alias("created_at"))


USERS = "users AS (SELECT concat('user', c_custkey // 2) AS username, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'disabled' END AS status, c_custkey AS created_at FROM customer)"


@query(f"WITH {USERS} SELECT count(*) AS n FROM users WHERE role = 'admin' AND status = 'active'")
def active_admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.active_admins(_users(spark, sf_dir))


@query(f"WITH {USERS}, f AS (SELECT username, min(created_at) AS created_at FROM users GROUP BY 1) SELECT username, role, status, created_at FROM f JOIN users USING (username, created_at) WHERE status = 'active' AND username IN (SELECT concat('user', o_custkey) FROM orders)")
def sign_in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("username"))
    return V.sign_in_rows(_users(spark, sf_dir), names).select("username", "role", "status", "created_at")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 3 THEN 'application/octet-stream' ELSE 'text/plain; charset=utf-8' END AS mime FROM documents")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 4
    name = F.concat(F.lit("a.b/"), F.coalesce("source", F.lit("")), F.when(n == 0, ".PDF").when(n == 1, ".md").when(n == 2, ".tar.txt").otherwise(".md/x"))
    return table(spark, sf_dir, "documents").select("doc_id", V.mime_type(name).alias("mime"))


@query("SELECT doc_id AS user_id, substring(coalesce(source, ''), 1, 32) AS action, coalesce(substring(lang, 1, 128), '') AS subject, '' AS predicate, substring(coalesce(text, ''), 1, 64) AS object_preview, substring(coalesce(text, ''), 1, 255) AS detail FROM documents")
def audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id"), F.col("source").alias("action"), F.col("lang").alias("subject"), F.lit(None).cast("string").alias("predicate"), F.col("text").alias("object_preview"), F.col("text").alias("detail"))
    return V.audit_rows(rows)


@query("""
WITH a AS (SELECT text AS query, arg_max(concat('answer ', item_id), item_id) AS answer FROM benchmark WHERE item_id % 3 > 0 GROUP BY 1) SELECT item_id, coalesce(answer, '') AS answer FROM benchmark LEFT JOIN a ON query = text
""")
def answers_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    given = items.filter("item_id % 3 > 0").select("query", F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"), F.col("item_id").alias("at"))
    return V.answers_by_query(items, given).select("item_id", "answer")


@query("SELECT doc_id AS id, coalesce(lang, 'other') AS docType, coalesce(source, '') AS name, coalesce(n_chars, 0) AS fileSize FROM documents")
def api_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.api_rows(table(spark, sf_dir, "documents"), {"doc_id": "id", "lang": "docType", "source": "name", "n_chars": "fileSize"}, {"docType": "other", "name": "", "fileSize": 0})


@query("SELECT doc_id AS id, source AS name, CASE WHEN doc_id % 3 = 0 THEN 'fr' WHEN lang IN ('en', 'fr') THEN lang END AS type FROM documents WHERE doc_id % 3 = 0 OR lang IN ('en', 'fr')")
def entity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(F.lit("Node"), F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("x"), F.col("lang"))
    return V.entity_scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), labels.alias("labels")), ["en", "fr"])


@query("""
WITH l AS (SELECT user_id, event_type AS k, CASE WHEN arg_max(event_id, event_id) % 3 > 0 THEN CAST(max(event_id) AS VARCHAR) END AS v FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
SELECT user_id, string_agg(concat(k, '=', v), ',' ORDER BY k) AS profile FROM l WHERE v IS NOT NULL GROUP BY user_id
""")
def profile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string"))
    log = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select("user_id", F.col("event_type").alias("k"), value.alias("v"), F.col("event_id").alias("at"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("profile")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return V.profile_maps(log).select("user_id", shown.alias("profile"))


@query("""
WITH n AS (SELECT conv_id, max(turn) AS newest FROM conversations WHERE turn % 2 = 1 GROUP BY 1), c AS (SELECT DISTINCT conv_id, concat('Topic ', conv_id) AS title, 1 AS updated_at FROM conversations WHERE conv_id % 3 > 0)
SELECT coalesce(c.conv_id, n.conv_id) AS conv_id, coalesce(title, '新对话') AS title, greatest(updated_at, newest) AS updated_at FROM c FULL JOIN n ON n.conv_id = c.conv_id
""")
def inserted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    known = rows.filter("conv_id % 3 > 0").select("conv_id", F.concat(F.lit("Topic "), F.col("conv_id").cast("string")).alias("title"), F.lit(1).cast("long").alias("updated_at")).distinct()
    fresh = rows.filter("turn % 2 = 1").withColumn("at", F.col("turn"))
    return V.insert_messages(known, rows.filter("turn % 2 = 0"), fresh)[0]


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as documents with the lines as versions; a fifth gets a new file, and half of these go back to version 1."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("now"), F.col("o_orderkey").cast("string")).alias("file"), F.lit("parsed").alias("status"))
    versions = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("version")).distinct().withColumn("file", F.concat(F.lit("old"), F.col("version").cast("string")))
    docs, versions = V.archive_versions(docs, versions, docs.filter("doc_id % 5 = 0").select("doc_id", F.lit("fresh").alias("file")))
    wanted = docs.filter("doc_id % 10 = 0").select("doc_id", F.lit(1).alias("version"))
    return V.roll_back(docs, versions, lines.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber"), wanted)


VERSIONS = """
d AS (SELECT o_orderkey AS doc_id FROM orders), v0 AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS version, concat('old', l_linenumber) AS file FROM lineitem),
m0 AS (SELECT doc_id, max(version) AS last FROM v0 GROUP BY 1), v1 AS (SELECT * FROM v0 UNION ALL SELECT d.doc_id, coalesce(last, 0) + 1, concat('now', d.doc_id) FROM d LEFT JOIN m0 USING (doc_id) WHERE d.doc_id % 5 = 0),
m1 AS (SELECT doc_id, max(version) AS last FROM v1 GROUP BY 1), back AS (SELECT d.doc_id, file FROM d JOIN v1 USING (doc_id) WHERE d.doc_id % 10 = 0 AND version = 1),
v2 AS (SELECT * FROM v1 UNION ALL SELECT doc_id, last + 1, 'fresh' FROM back JOIN m1 USING (doc_id)),
f AS (SELECT d.doc_id, CASE WHEN b.file IS NOT NULL THEN b.file WHEN d.doc_id % 5 = 0 THEN 'fresh' ELSE concat('now', d.doc_id) END AS file, CASE WHEN d.doc_id % 5 = 0 THEN 'pending' ELSE 'parsed' END AS status FROM d LEFT JOIN back b USING (doc_id))"""


@query(f"WITH {VERSIONS}, m2 AS (SELECT doc_id, max(version) AS last FROM v2 GROUP BY 1) SELECT doc_id, version, file, false AS current FROM v2 UNION ALL SELECT f.doc_id, coalesce(last, 0) + 1, file, true FROM f LEFT JOIN m2 USING (doc_id)")
def version_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, versions, _ = _versions(spark, sf_dir)
    return V.version_list(docs, versions)


@query(f"WITH {VERSIONS} SELECT f.doc_id, status, f.file, (SELECT count(*) FROM lineitem WHERE l_orderkey = f.doc_id AND f.doc_id NOT IN (SELECT doc_id FROM back)) AS chunks FROM f")
def version_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, chunks = _versions(spark, sf_dir)
    return docs.join(chunks.groupBy("doc_id").agg(F.count("*").alias("chunks")), "doc_id", "left").select("doc_id", "status", "file", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"WITH {GRAPH}, k AS (SELECT label, unnest(CASE WHEN id % 2 = 0 THEN ['name', 'even'] ELSE ['name', concat(label, '_odd')] END) AS k FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM nodes) WHERE r <= 500) SELECT label, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM k GROUP BY label")
def kg_property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("id") % 2 == 0, F.array(F.lit("name"), F.lit("even"))).otherwise(F.array(F.lit("name"), F.concat("label", F.lit("_odd"))))
    nodes = _graph(spark, sf_dir)[0].withColumn("attributes", F.map_from_arrays(own, F.array(F.lit("x"), F.lit("y"))))
    return V.property_keys(nodes).select("label", F.array_join("keys", ",").alias("keys"))


STATEMENTS = f"""
{GRAPH}, st AS (SELECT event_id AS statement, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CASE event_id % 4 WHEN 0 THEN 'nation' WHEN 1 THEN 'customer' WHEN 2 THEN 'supplier' ELSE 'planet' END END AS label, user_id % 25 AS id,
  CASE WHEN event_id % 13 = 0 THEN 'up' WHEN event_id % 2 = 0 THEN 'out' ELSE 'in' END AS direction, CASE event_id % 5 WHEN 0 THEN 'IN_NATION' WHEN 1 THEN 'KNOWS' END AS relation FROM events),
j AS (SELECT *, CASE WHEN label IS NULL OR id IS NULL THEN 'empty' WHEN direction = 'up' THEN 'direction' WHEN label = 'planet' THEN 'label' WHEN relation = 'KNOWS' THEN 'relation' END AS error FROM st),
hop AS (SELECT 'out' AS direction, src_label AS label, src AS id, relation, dst_label AS n_label, dst AS n_id FROM edges UNION SELECT 'in', dst_label, dst, relation, src_label, src FROM edges),
rec AS (SELECT statement, hop.relation, n_label, n_id, name AS n_name FROM j JOIN hop ON hop.direction = j.direction AND hop.label = j.label AND hop.id = j.id AND (j.relation IS NULL OR j.relation = hop.relation) JOIN nodes n ON n.label = n_label AND n.id = n_id WHERE error IS NULL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY statement ORDER BY relation, n_label, n_id) AS r FROM rec) WHERE r <= 20)"""


def _statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("event_id")
    label = F.when(n % 11 == 0, None).when(n % 4 == 0, "nation").when(n % 4 == 1, "customer").when(n % 4 == 2, "supplier").otherwise("planet")
    direction = F.when(n % 13 == 0, "up").when(n % 2 == 0, "out").otherwise("in")
    rows = table(spark, sf_dir, "events").select(n.alias("statement"), label.alias("label"), (F.col("user_id") % 25).alias("id"), direction.alias("direction"), F.when(n % 5 == 0, "IN_NATION").when(n % 5 == 1, "KNOWS").alias("relation"))
    return V.run_statements(*_graph(spark, sf_dir), rows)


@query(f"WITH {STATEMENTS} SELECT statement, error IS NULL AS ok, error, (SELECT count(*) FROM top t WHERE t.statement = j.statement) AS records FROM j")
def statement_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a statement, some without a label or of unknown names."""
    return _statements(spark, sf_dir)[0]


@query(f"WITH {STATEMENTS} SELECT statement, relation, n_label, n_id, n_name FROM top")
def statement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir)[1]


@query("""
WITH t AS (SELECT conv_id, turn, text, trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS q, conv_id + turn AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n % 3 = 0 THEN 'asked again' ELSE q END AS standalone, CASE WHEN n % 4 = 0 THEN 'other' ELSE q END AS effective,
  concat(CASE WHEN turn > 0 THEN '## 对话历史' || chr(10) || 'before' || chr(10) || chr(10) ELSE '' END, '## 知识图谱查询结果', chr(10), CASE WHEN n % 2 = 0 THEN '(无图谱数据)' ELSE 'facts' END, chr(10), chr(10), '## 文献摘录', chr(10),
    CASE WHEN q = '' THEN '(无文献摘录)' ELSE q END, chr(10), chr(10), '## 当前问题', chr(10), coalesce(text, ''), chr(10), chr(10), '请基于以上图谱数据与文献摘录回答用户问题。不要使用未出现的依据。') AS prompt,
  CASE WHEN n % 5 = 0 THEN '  (无匹配实体)' ELSE concat('  herbs: h', n, '(id:', turn, '), x(id:9)', CASE WHEN n % 2 = 0 THEN chr(10) || '  books: b(id:1)' ELSE '' END) END AS matched FROM t
""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("conv_id") + F.col("turn"), F.col("text")
    entity = lambda kind, name, i: F.struct(F.lit(kind).alias("kind"), name.alias("name"), i.cast("string").alias("id"))
    none = F.array().cast("array<struct<kind:string,name:string,id:string>>")
    herbs = F.array(entity("herbs", F.concat(F.lit("h"), n.cast("string")), F.col("turn")), entity("herbs", F.lit("x"), F.lit(9)), entity("unknown", F.lit("u"), F.lit(0)))
    matched = F.when(n % 5 == 0, none).otherwise(F.concat(F.when(n % 2 == 0, F.array(entity("books", F.lit("b"), F.lit(1)))).otherwise(none), herbs))
    said = F.when(n % 3 == 0, " “asked again”\nsecond line").when(n % 3 == 1, ' "" ')
    prompt = P.answer_prompt(F.when(F.col("turn") > 0, "before"), F.when(n % 2 == 1, "facts").otherwise(""), q, q)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.standalone_question(q, said, F.lit(True)).alias("standalone"), P.effective_question(F.when(n % 4 == 0, " other "), q).alias("effective"), prompt.alias("prompt"), P.matched_summary(matched, ["herbs", "books"]).alias("matched"))


@query("SELECT conv_id, turn, role IS NOT DISTINCT FROM 'user' AS refused, role IS NOT DISTINCT FROM 'user' AS evidence_gap, CASE WHEN turn % 2 = 0 THEN 'correct' END AS grade, turn AS elapsed FROM conversations")
def assistant_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details written as JSON and read again."""
    text = P.details_json(refused=F.col("role").eqNullSafe("user"), crag_grade=F.when(F.col("turn") % 2 == 0, "correct"), elapsed_ms=F.col("turn"))
    back = F.from_json(text, "refused boolean, evidence_gap boolean, crag_grade string, elapsed_ms long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", back.alias("d")).select("conv_id", "turn", "d.refused", "d.evidence_gap", F.col("d.crag_grade").alias("grade"), F.col("d.elapsed_ms").alias("elapsed"))


@query("""
SELECT doc_id, concat('名称：', coalesce(source, ''), CASE WHEN lang <> '' THEN chr(10) || 'lang：' || lang ELSE '' END,
  CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), chr(10), '【功效】', chr(10), 'one') WHEN doc_id % 3 = 1 THEN concat(chr(10), chr(10), '用法：', chr(10), 'two', chr(10), 'three') ELSE '' END) AS body FROM documents
""")
def extraction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "struct<heading:string,children:array<struct<heading:string,blocks:array<string>>>,blocks:array<string>>"
    sections = [f"""named_struct('heading', '功效', 'children', array(), 'blocks', array('one', '', null))""", """named_struct('heading', '其他', 'children', array(named_struct('heading', '用法', 'blocks', array('two')), named_struct('heading', 'left out', 'blocks', array('no'))), 'blocks', array('three'))""", """named_struct('heading', '其他', 'children', array(), 'blocks', array('no'))"""]
    one = [F.expr(f"CAST({s} AS {kind})") for s in sections]
    own = F.array(F.when(F.col("doc_id") % 3 == 0, one[0]).when(F.col("doc_id") % 3 == 1, one[1]).otherwise(one[2]))
    meta = F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("none").alias("key"), F.lit("").alias("value")))
    return table(spark, sf_dir, "documents").select("doc_id", P.extraction_text(F.col("source"), meta, own).alias("body"))


@query("""
WITH v AS (SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'Herb' WHEN 1 THEN 'Effect' ELSE 'Source' END AS type, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
q AS (SELECT id AS name_id, id // 100 AS query_id, CASE id % 4 WHEN 0 THEN 'herbs' WHEN 1 THEN 'effects' WHEN 2 THEN 'sources' ELSE 'unknown' END AS category, CASE id % 4 WHEN 0 THEN 'Herb' WHEN 1 THEN 'Effect' WHEN 2 THEN 'Source' END AS type, vector FROM v WHERE id % 25 = 0),
p AS (SELECT name_id, query_id, category, v.id, round(list_dot_product(q.vector, v.vector), 6) AS score FROM q JOIN v USING (type)),
r AS (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY score DESC, id) AS r FROM p),
k AS (SELECT *, lag(score) OVER (PARTITION BY name_id ORDER BY r) AS before FROM r WHERE r <= 3 AND score >= 0.3),
c AS (SELECT *, max(CASE WHEN score / before < 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY name_id ORDER BY r) AS cut FROM k),
b AS (SELECT query_id, category, id, max(score) AS score FROM c WHERE cut = 0 GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id, category ORDER BY score DESC, id) AS INTEGER) AS rank FROM b
""")
def typed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as entities of three types and, at ids that 25 divides, as names
    of four categories, one of which has no type."""
    rows, n = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 4
    kind = F.when(F.col("label") % 3 == 0, "Herb").when(F.col("label") % 3 == 1, "Effect").otherwise("Source")
    category = F.when(n == 0, "herbs").when(n == 1, "effects").when(n == 2, "sources").otherwise("unknown")
    named = rows.filter("vec_id % 25 = 0").select(F.expr("vec_id div 100").alias("query_id"), category.alias("category"), F.col("embedding").alias("vector"))
    kinds = {"herbs": "Herb", "effects": "Effect", "sources": "Source"}
    return S.typed_entities(rows.select(F.col("vec_id").alias("id"), kind.alias("type"), F.col("embedding").alias("vector")), named, kinds, 3, 0.3, 0.8)


@query("""
SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 AND turn % 4 = 0 THEN '未查到相关内容' WHEN turn % 2 = 0 THEN '（仅供参考）' || text ELSE text END AS answer FROM conversations
""")
def final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    answer = R.final_answer(F.col("text"), F.when(turn % 2 == 0, "medium").otherwise("high"), turn % 3 == 0, (turn % 4).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"))


@query("""
SELECT vec_id, label % 2 = 0 AS short, CASE WHEN label % 2 = 0 THEN 80 ELSE 80 END AS width, round(list_sum(CAST(embedding[1:CASE WHEN label % 2 = 0 THEN 80 ELSE 64 END] AS DOUBLE[])), 6) AS total, round(CAST(embedding[64] AS DOUBLE), 6) AS last, 0.0::DOUBLE AS pad FROM embeddings
""")
def fitted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a store of 80 dimensions takes them, padded with zeros."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2 == 0).alias("short"), X.fit_width(F.col("embedding"), 80).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", "short", F.size("v").alias("width"), F.round(total, 6).alias("total"), F.round(F.element_at("v", 64), 6).alias("last"), F.element_at("v", 80).alias("pad"))


@query("SELECT lang AS label, source AS id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.repeated_keys(table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.col("source").alias("id")))


@query("""
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN trim(concat('Title ', source)) ELSE '' END AS title FROM documents WHERE source IS NOT NULL
UNION ALL SELECT doc_id, '' FROM documents WHERE source IS NULL
""")
def first_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, source = F.col("doc_id") % 3, F.col("source")
    text = F.when(n == 0, F.concat(F.lit("## no title\n"), source)).when(n == 1, F.concat(F.lit("x\n# Title "), source, F.lit(" （note）\n# other"))).otherwise(F.concat(F.lit("# Title "), source, F.lit(" (note)")))
    return table(spark, sf_dir, "documents").select("doc_id", D.first_heading(F.coalesce(text, F.lit(""))).alias("title"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS n, CASE WHEN event_id % 4 = 0 THEN concat('a', event_id) WHEN event_id % 4 = 1 THEN 'b' END AS first, concat(event_type, ' of ', user_id) AS triple FROM events")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that are the whole text, stand within it, are empty or no lists."""
    n, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = F.when(n == 0, F.concat(F.lit('["a'), i, F.lit('", "c"]'))).when(n == 1, 'Here: ["b"] as asked').when(n == 2, "[]").otherwise("none")
    found = T.json_array(text, "array<string>")
    triple = B.triple_text(F.col("event_type"), F.lit("of"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.when(found.isNotNull(), F.size(found)).alias("n"), F.try_element_at(found, F.lit(1)).alias("first"), triple.alias("triple"))


@query("""
WITH s AS (SELECT concat('kind=', coalesce(source, 'none')) AS doc_type, string_agg(concat(doc_id, ': ', coalesce(substring(replace(replace(text, chr(10), ' '), chr(13), ' '), 1, 40), '')), chr(10) ORDER BY doc_id) || chr(10) AS text FROM documents GROUP BY 1)
SELECT doc_type, length(text) AS size, md5(text) AS digest FROM s
""")
def folder_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each source, written below a folder and read again."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.coalesce(F.substring(F.translate("text", "\n\r", "  "), 1, 40), F.lit("")))
    lines, path = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("kind"), "doc_id", line.alias("value")), new_path(spark, "texts")
    lines.repartition("kind").sortWithinPartitions("kind", "doc_id").select("kind", "value").write.partitionBy("kind").text(path)
    return D.read_documents(spark, path).select("doc_type", F.length("text").cast("bigint").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def tagged_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest fifty traces with a tag, as a report shows them."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")
