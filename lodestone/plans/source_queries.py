"""Queries of the document sources and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import new_path, table
from lodestone.sources import documents as D
from lodestone.sources import drifting as J
from lodestone.sources import index_pages as X
from lodestone.sources import spreadsheets as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pages_to_markdown(table(spark, sf_dir, "pages"))


@query()
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the pages' Markdown with the titles above each."""
    pages = D.pages_to_markdown(table(spark, sf_dir, "pages"))
    return pages.select("page_id", F.posexplode(D.section_paths(D.sections(F.col("markdown")))).alias("place", "s")).select("page_id", "place", F.array_join("s.path", " / ").alias("path"), "s.body")


@query(r"""
SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), lambda p: length(p) > 120) AS long_ones,
  CAST(length(text) > 0 AS INTEGER) AS some FROM documents
""")
def long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.split("text", "\n"), lambda p: D.T.strip(p))
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(parts, lambda p: F.length(p) > 120).alias("long_ones"), (F.length("text") > 0).cast("int").alias("some"))


@query()
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(D.pack_paragraphs(text)).alias("place", "chunk"))


@query("""
SELECT page_id, concat_ws(',', CASE WHEN n LIKE '%..%' OR n = '' THEN 'unsafe_name' END, CASE WHEN page_id % 3 = 0 THEN 'suffix' END, CASE WHEN page_id % 5 = 0 THEN 'empty' END) AS errors
FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '..' ELSE 'page' || page_id END AS n FROM pages)
""")
def upload_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    name = F.concat(F.when(key % 7 == 0, "..").otherwise(F.concat(F.lit("page"), key.cast("string"))), F.when(key % 3 == 0, ".exe").otherwise(".md"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(D.upload_errors(name, F.when(key % 5 == 0, 0).otherwise(10)), ",").alias("errors"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE '其他' END AS kind FROM documents WHERE source IN ('src1', 'src2') AND doc_id % 4 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def whitelist_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 != 0, F.col("doc_id").cast("string")).otherwise(" ").alias("id"), "source", F.col("lang").alias("kind"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return D.still_to_do(D.whitelist(rows, ["src1", "src2"], ["en", "fr"]), done).select("id", "source", "kind")


@query("""
SELECT page_id, '---' || chr(10) || 'id: "' || page_id || '"' || chr(10) || 'url: "' || replace(replace(url, '\\', '\\\\'), '"', '\\"') || '"' || chr(10) || '---' || chr(10) AS head FROM pages WHERE url IS NOT NULL
""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", D.front_matter({"id": F.col("page_id"), "url": F.col("url")}).alias("head"))


DRIFTING = """
bodies AS (SELECT event_id AS id, event_id % 7 AS kind, props, CASE event_id % 7 WHEN 0 THEN concat('[', props, ',', props, ']') WHEN 1 THEN concat('{"entities": [', props, '], "n": 1}') WHEN 2 THEN props WHEN 3 THEN substring(props, 1, 4) WHEN 4 THEN ' '
  WHEN 5 THEN '5' ELSE '{"relations": [{"k": "x"}, 7]}' END AS body FROM events WHERE props IS NOT NULL),
found AS (SELECT id, CAST(place AS INTEGER) AS place, CAST(props->>'$.k' AS BIGINT) AS k FROM bodies, range(0, 2) r(place) WHERE kind = 0 OR (kind IN (1, 2) AND place = 0)),
bad AS (SELECT id, CAST(NULL AS INTEGER) AS place, CASE kind WHEN 3 THEN 'not_json' WHEN 4 THEN 'empty' ELSE 'not_an_object' END AS reason FROM bodies WHERE kind IN (3, 4, 5)
  UNION ALL SELECT id, place, CASE place WHEN 0 THEN 'wrong_kind: k' ELSE 'not_an_object' END FROM bodies, range(0, 2) r(place) WHERE kind = 6)"""


@query(f"WITH {DRIFTING} SELECT id, place, k, CAST(NULL AS VARCHAR) AS reason FROM found UNION ALL SELECT id, place, NULL, reason FROM bad")
def drifting_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as lists, wrapped lists, objects and what is none of these."""
    n, props = F.col("event_id") % 7, F.col("props")
    cases = [F.concat(F.lit("["), props, F.lit(","), props, F.lit("]")), F.concat(F.lit('{"entities": ['), props, F.lit('], "n": 1}')), props, F.substring(props, 1, 4), F.lit(" "), F.lit("5"), F.lit('{"relations": [{"k": "x"}, 7]}')]
    body = reduce(lambda out, i: F.when(n == i, cases[i]).otherwise(out), range(7), F.lit(None))
    texts = table(spark, sf_dir, "events").filter("props IS NOT NULL").select(F.col("event_id").alias("id"), body.alias("body"))
    records, unread = J.split_records(texts, ["entities", "relations"])
    rows, odd = J.fields(records, {"k": "long"})
    kept = unread.unionByName(odd).select("id", "place", F.lit(None).cast("long").alias("k"), "reason")
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(kept)


@query("""
SELECT doc_id, coalesce(trim(source), '') AS title, CASE WHEN doc_id % 5 <> 0 AND error IS NULL THEN body END AS text, CASE WHEN doc_id % 5 = 0 THEN 'login' ELSE error END AS error
FROM (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda p: trim(p)), lambda p: p <> ''), chr(10) || chr(10)) AS body, CASE WHEN coalesce(trim(replace(text, chr(10), ' ')), '') = '' THEN 'no_text' END AS error FROM documents)
""")
def archive_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an archive's answers: lines as paragraphs, every fifth refused."""
    refused = F.when(F.col("doc_id") % 5 == 0, "ERR_REQUIRES_AUTHENTICATION")
    answer = F.to_json(F.struct(F.col("source").alias("title"), F.split("text", "\n").alias("fulltext"), refused.alias("error")))
    return table(spark, sf_dir, "documents").select("doc_id", J.archive_text(answer).alias("a")).select("doc_id", "a.*")


INDEXED = """
links AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', 2)) AS name, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', 2), 1) AS place FROM pages),
entries AS (SELECT page_id, place, concat('Class ', page_id % 7) AS major, CASE WHEN page_id % 2 = 1 THEN concat('cat ', page_id % 3) ELSE '' END AS category, trim(replace(replace(replace(name, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS name, '/' || replace(href, '&amp;', '&') AS href FROM links)"""


@query(f"WITH {INDEXED} SELECT major, category, name, href FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id, place) AS r FROM entries WHERE name <> '') WHERE r = 1")
def index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all pages under a heading each, on odd pages in a numbered
    list with a category; each name where it comes first."""
    pages, odd = table(spark, sf_dir, "pages"), F.col("page_id") % 2 == 1
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    html = text('<div id="content"><h2>Class ', F.col("page_id") % 7, "</h2>", F.when(odd, text("<ol><li><strong>cat ", F.col("page_id") % 3, "</strong>")).otherwise(""), F.col("html"), F.when(odd, "</li></ol>").otherwise(""), "</div>")
    return X.first_entries(X.index_entries(pages.select("page_id", html.alias("html")), prefix="/")).select("major", "category", "name", "href")


@query("""
SELECT trim(p_name) AS name, CAST(p_partkey AS VARCHAR) AS url, concat_ws(',', CASE WHEN p_brand <> '' THEN 'brand=' || p_brand END, CASE WHEN p_size % 2 = 0 THEN concat('size=', p_size) END) AS meta FROM part WHERE p_partkey % 10 <> 3 AND trim(p_name) <> ''
""")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as workbooks and read back; every tenth has no name."""
    part, path = table(spark, sf_dir, "part"), new_path(spark, "workbooks")
    spark.dataSource.register(S.Workbooks)
    name = F.when(F.col("p_partkey") % 10 == 3, " ").otherwise(F.col("p_name"))
    part.select(name.alias("name"), F.col("p_partkey").alias("url"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size")).write.format("workbooks").mode("append").save(path)
    rows = S.named_rows(spark.read.format("workbooks").load(path), "name", "url")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("name", "url", shown.alias("meta"))
