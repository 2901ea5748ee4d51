"""Queries of the text functions and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.session import spread, table

TERMS = ["the", "tion", "ment", "ein", "los", "example", "zzz"]
SYNONYMS = [("感冒", ["伤风", "風寒"]), ("头痛", ["頭疼"]), ("失眠", ["不寐"])]
SAMPLES = ["感冒吃什么药", "头痛与失眠", "伤寒论 桂枝汤", "plain text", ""]

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STRIPPED = r"regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')"
FLAT = r"trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'))"


@query(f"""
WITH b AS (SELECT doc_id, {STRIPPED} AS body FROM documents),
w AS (SELECT doc_id, body, unnest(range(0, greatest(1, CAST(ceil((length(body) - 80) / 320.0) AS BIGINT)))) AS i FROM b WHERE length(body) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_idx, substring(body, i * 320 + 1, 400) AS chunk FROM w
""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("chunk_idx", "chunk"))


@query(f"""
WITH b AS (SELECT doc_id, source, {STRIPPED} AS body FROM documents)
SELECT source, count(*) AS documents, CAST(sum(CASE WHEN length(body) = 0 THEN 0 ELSE greatest(1, CAST(ceil((length(body) - 80) / 320.0) AS BIGINT)) END) AS BIGINT) AS chunks FROM b GROUP BY source
""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", F.size(T.windows(F.col("text"))).cast("bigint").alias("n"))
    return chunked.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("chunks"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\r\n', chr(10), 'g'), '(?s)\A---\n.*?\n---\n', ''), '\n{3,}', chr(10) || chr(10), 'g'), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS body
FROM (SELECT doc_id, concat('---', chr(10), 'lang: ', lang, chr(10), '---', chr(10), replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10))) AS x FROM documents)
""")
def markdown_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("---\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\n---\n"), F.replace("text", F.lit(". "), F.lit(".\r\n\n\n\n")))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_markdown(raw).alias("body"))


@query(rf"""
SELECT doc_id, regexp_replace(text, '{T.EMAIL}', '{T.REDACTED}', 'g') AS redacted FROM documents
""")
def pii_email_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.regexp_replace("text", T.EMAIL, T.REDACTED).alias("redacted"))


def _numbers_redacted(text: str, number: str) -> str:
    """SQL without look-around: what stands beside a number is kept, and a
    second pass takes numbers that share it."""
    once = lambda t: rf"regexp_replace({t}, '(^|[^0-9]){number}([^0-9]|$)', '\\1[REDACTED]\\2', 'g')"
    return once(once(text))


_PHONES = _numbers_redacted("text", "1[3-9][0-9]{9}")
_IDENTITIES = _numbers_redacted(_PHONES, "[0-9]{15}(?:[0-9]{2}[0-9Xx])?")
REDACTED_SQL = rf"regexp_replace({_IDENTITIES}, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, {REDACTED_SQL} AS redacted FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query(f"""
SELECT conv_id, turn,
  CASE WHEN length({FLAT}) > 80 THEN substring({FLAT}, 1, 80) || '…' ELSE {FLAT} END AS clipped,
  CASE WHEN {FLAT} = '' THEN '新对话' WHEN length({FLAT}) > 20 THEN substring({FLAT}, 1, 20) || '…' ELSE {FLAT} END AS title,
  CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...[truncated]' ELSE text END AS cut
FROM conversations
""")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clip(text).alias("clipped"), T.title_of(text).alias("title"), T.truncate(text, 200).alias("cut"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn after one of five questions, as the table's own texts have no such words."""
    question = F.element_at(F.array(*[F.lit(q) for q in SAMPLES]), F.pmod(F.col("turn"), F.lit(len(SAMPLES))).cast("int") + 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(question, F.lit(" "), F.coalesce("text", F.lit(""))).alias("q"))


_ASKED = f"c AS (SELECT conv_id, turn, {SAMPLES}[CAST(turn % {len(SAMPLES)} AS INTEGER) + 1] || ' ' || coalesce(text, '') AS q FROM conversations)"
_VARIANTS = f"list_distinct([q, translate(q, '{T.TRADITIONAL}', '{T.SIMPLIFIED}'), translate(q, '{T.SIMPLIFIED}', '{T.TRADITIONAL}')])"


@query(f"WITH {_ASKED} SELECT conv_id, turn, unnest({_VARIANTS}) AS variant FROM c")
def script_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", F.explode(T.script_variants(F.col("q"))).alias("variant"))


_REPLACED = [f"list_transform(list_filter(v, lambda x: contains(x, '{n}')), lambda x: replace(x, '{n}', '{o}'))" for n, others in SYNONYMS for o in others]


@query(f"""
WITH {_ASKED}, w AS (SELECT conv_id, turn, {_VARIANTS} AS v FROM c)
SELECT conv_id, turn, unnest(list_distinct(flatten([v, {', '.join(_REPLACED)}]))) AS variant FROM w
""")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", F.explode(T.expand_synonyms(F.col("q"), SYNONYMS)).alias("variant"))


@query(r"""
SELECT page_id, replace(replace(replace(url, '\', '\\'), '%', '\%'), '_', '\_') AS escaped,
  CASE WHEN n IN ('', '.', '..') THEN 'unnamed' ELSE substring(n, 1, 80) END AS file_name,
  n <> '' AND NOT contains(url, '/') AND NOT contains(url, '\') AND NOT contains(url, '..') AS safe
FROM (SELECT page_id, url, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[<>:"|?*\x00-\x1f]', '_', 'g') AS n FROM pages)
""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.escape_like(url).alias("escaped"), T.safe_file_name(url).alias("file_name"), T.is_safe_name(url).alias("safe"))


@query(f"""
SELECT doc_id, array_to_string(list_filter({TERMS}, lambda t: contains(text, t)), ',') AS terms,
  round(len(list_filter({TERMS}, lambda t: contains(text, t))) / {len(TERMS)}.0, 6) AS ratio,
  CASE WHEN strpos(text, 'the') > 0 THEN substring(text, greatest(1, strpos(text, 'the') - 24), strpos(text, 'the') + 160 - greatest(1, strpos(text, 'the') - 24)) ELSE substring(text, 1, 160) END AS span
FROM documents
""")
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.present(text, TERMS), ",").alias("terms"), F.round(T.hit_ratio(text, TERMS), 6).alias("ratio"), T.reference_span(text, "the").alias("span"))


@query("""
WITH c AS (SELECT doc_id, CAST(unicode(unnest(string_split(text, ''))) % 64 AS INTEGER) AS bucket FROM documents WHERE text <> '')
SELECT doc_id, bucket, count(*) AS n FROM c GROUP BY doc_id, bucket
""")
def hash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.character_counts("text")).alias("bucket", "n")).filter("n > 0")


@query(r"""
SELECT doc_id, list_aggregate(regexp_extract_all(lower(text), '\w+'), 'count') AS tokens, length(text) AS characters,
  'd' || doc_id || '#' || md5(source || ' / ' || lang)[1:10] AS parent_id, sha1('doc:' || CAST(doc_id AS VARCHAR) || ':' || source) AS fingerprint
FROM documents
""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.tokens(F.col("text"))).cast("bigint").alias("tokens"), F.length("text").cast("bigint").alias("characters"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("#"), F.substring(F.md5(F.concat_ws(" / ", "source", "lang").cast("binary")), 1, 10)).alias("parent_id"),
        T.fingerprint(F.lit("doc"), F.col("doc_id").cast("string"), F.col("source")).alias("fingerprint"),
    )


@query("""
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户：' WHEN 'assistant' THEN '助手：' ELSE '' END || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id
""")
def history_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("role") == "user", "用户：").when(F.col("role") == "assistant", "助手：").otherwise("")
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(who, "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY turn)").alias("history"))


@query("""
SELECT r_regionkey AS region, '| key | nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS grid
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey
""")
def records_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = rows.select("r_regionkey", "n_nationkey", F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |")).alias("line"))
    return lines.groupBy(F.col("r_regionkey").alias("region")).agg(F.concat(F.lit("| key | nation |\n| --- | --- |\n"), F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY n_nationkey)")).alias("grid"))


@query(r"""
SELECT p_name AS name, count(*) AS parts, array_to_string(list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4)), '_') AS terms FROM part GROUP BY p_name
HAVING len(list_distinct(list_filter(string_split(p_name, ' '), lambda x: length(x) >= 4))) = 1
""")
def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_distinct(F.filter(F.split("p_name", " "), lambda x: F.length(x) >= 4))
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name"), terms.alias("t")).agg(F.count("*").alias("parts")).filter(F.size("t") == 1).select("name", "parts", F.array_join("t", "_").alias("terms"))


@query("""
SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CASE WHEN json_valid(CASE WHEN event_id % 7 = 0 THEN props[:-2] ELSE props END) THEN props ->> '$.k' END AS lenient FROM events WHERE CAST(props ->> '$.k' AS BIGINT) >= 50
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 7 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    lenient = F.try_variant_get(F.try_parse_json(broken), "$.k", "string")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").filter(k >= 50).select("event_id", k.alias("k"), lenient.alias("lenient"))
