"""Queries of the retrieval operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.functions.segment import segmenter
from lodestone.operators import containment as C
from lodestone.operators import evaluation as E
from lodestone.operators import hybrid as Y
from lodestone.operators import retrieval as R
from lodestone.session import spread, staged, table

QUERIES, SQL = {}, {}
K = 10
EACH = 50  # queries are the rows whose id this divides


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dense(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.dense_search(vectors, vectors.filter(f"id % {EACH} = 0").withColumnRenamed("id", "query_id"), k)


DENSE = f"""
p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings q, embeddings v WHERE q.vec_id % {EACH} = 0),
dense AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) WHERE rank <= {K})"""


@query(f"WITH {DENSE} SELECT * FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@query(f"WITH {DENSE} SELECT * FROM dense WHERE score >= 0.35")
def dense_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).filter("score >= 0.35")


@query(f"""
WITH {DENSE}, k AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM dense WHERE score >= 0.3),
c AS (SELECT *, max(CASE WHEN score / before < 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS cut FROM k)
SELECT query_id, id, score, rank FROM c WHERE cut = 0
""")
def dropoff_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dropoff_cut(_dense(spark, sf_dir), 0.3, 0.9)


@query(f"""
WITH {DENSE}, other AS (SELECT * FROM dense WHERE id <> query_id), t AS (SELECT query_id, max(score) AS top_score, count(*) AS hits FROM other GROUP BY query_id)
SELECT o.query_id, o.id, o.score, o.rank, CASE WHEN top_score >= 0.72 THEN 'correct' WHEN top_score < 0.3 THEN 'incorrect' ELSE 'ambiguous' END AS grade
FROM other o JOIN t USING (query_id)
""")
def crag_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _dense(spark, sf_dir).filter("id <> query_id")
    top = F.expr("max(score) OVER (PARTITION BY query_id)")
    return hits.withColumn("grade", R.grade(top, F.lit(1)))


@query(f"""
WITH {DENSE}, other AS (SELECT * FROM dense WHERE id <> query_id AND score >= 0.35),
t AS (SELECT v.vec_id AS query_id, max(score) AS top_score, count(score) AS hits FROM embeddings v LEFT JOIN other o ON o.query_id = v.vec_id WHERE v.vec_id % {EACH} = 0 GROUP BY v.vec_id),
g AS (SELECT *, CASE WHEN hits = 0 THEN 'incorrect' WHEN top_score >= 0.72 THEN 'correct' WHEN top_score < 0.3 THEN 'incorrect' ELSE 'ambiguous' END AS grade FROM t)
SELECT query_id, hits, grade, CASE WHEN grade = 'correct' AND query_id % 100 <> 0 THEN 'high' WHEN grade = 'incorrect' AND query_id % 100 = 0 THEN 'refused' ELSE 'medium' END AS confidence,
  CASE WHEN query_id % 150 = 0 THEN false WHEN grade = 'incorrect' THEN true ELSE hits = 0 END AS refuse FROM g
""")
def crag_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _dense(spark, sf_dir).filter("id <> query_id AND score >= 0.35")
    asked = table(spark, sf_dir, "embeddings").filter(f"vec_id % {EACH} = 0").select(F.col("vec_id").alias("query_id"))
    top = asked.join(hits, "query_id", "left").groupBy("query_id").agg(F.max("score").alias("top_score"), F.count("score").alias("hits"))
    graded = top.withColumn("grade", R.grade(F.col("top_score"), F.col("hits")))
    rewritten, facts = F.col("query_id") % 100 == 0, F.when(F.col("query_id") % 150 == 0, 1).otherwise(0)
    return graded.select("query_id", "hits", "grade", R.confidence(F.col("grade"), rewritten).alias("confidence"), R.refuses(F.col("grade"), F.col("top_score"), F.col("hits"), facts, F.lit(False)).alias("refuse"))


@query("""
WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label)
SELECT m.label, CAST(i - 1 AS INTEGER) AS dim, round(x / greatest(size, 1e-12), 6) AS centre FROM m JOIN n USING (label)
""")
def doc_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(table(spark, sf_dir, "embeddings")).select("label", F.posexplode("centre").alias("dim", "centre")).withColumn("centre", F.round("centre", 6))


def _centroids(vectors: DataFrame) -> DataFrame:
    cells = vectors.select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    return whole.select("label", V.normalise(F.col("mean")).alias("centre"))


@query("""
WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label),
c AS (SELECT m.label, list(x / size ORDER BY i) AS centre FROM m JOIN n USING (label) GROUP BY m.label),
s AS (SELECT e.label, vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), centre), 6) AS centrality FROM embeddings e JOIN c USING (label))
SELECT label, vec_id, centrality FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY centrality DESC, vec_id) AS r FROM s) WHERE r = 1
""")
def centrality_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    scored = vectors.join(_centroids(vectors), "label").select("label", "vec_id", F.round(V.dot(F.col("embedding"), F.col("centre")), 6).alias("centrality"))
    return scored.groupBy("label").agg(F.max_by(F.struct("vec_id", "centrality"), F.struct("centrality", -F.col("vec_id"))).alias("s")).select("label", "s.*")


WIDE, REFERENCES = 50, 3  # a query's references: the first of its own label among the wide hits


@query(f"""
WITH {DENSE}, wide AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p) WHERE rank <= {WIDE} AND id <> query_id),
hits AS (SELECT w.*, e.embedding, e.label = q.label AS same FROM wide w JOIN embeddings e ON e.vec_id = w.id JOIN embeddings q ON q.vec_id = w.query_id),
refs AS (SELECT query_id, id AS ref, embedding AS a FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hits WHERE same) WHERE r <= {REFERENCES}),
ret AS (SELECT query_id, id, embedding AS b FROM hits WHERE rank <= {K} AND score >= 0.35),
pairs AS (SELECT query_id, ref, id, round(list_dot_product(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])), 6) >= 0.35 AS near FROM refs JOIN ret USING (query_id)),
x AS (SELECT query_id, round(avg(CAST(h AS INTEGER)), 6) AS pre FROM (SELECT query_id, id, bool_or(near) AS h FROM pairs GROUP BY ALL) GROUP BY query_id),
y AS (SELECT query_id, round(avg(CAST(h AS INTEGER)), 6) AS rec FROM (SELECT query_id, ref, bool_or(near) AS h FROM pairs GROUP BY ALL) GROUP BY query_id)
SELECT v.vec_id AS query_id, CASE WHEN known THEN coalesce(pre, 0.0) END AS context_precision, CASE WHEN known THEN coalesce(rec, 0.0) END AS context_recall
FROM embeddings v LEFT JOIN (SELECT DISTINCT query_id, true AS known FROM refs) r ON r.query_id = v.vec_id LEFT JOIN x ON x.query_id = v.vec_id LEFT JOIN y ON y.query_id = v.vec_id
WHERE v.vec_id % {EACH} = 0
""")
def context_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query finds over all vectors against its nearest ones of its own label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    asked = vectors.filter(f"vec_id % {EACH} = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked_label"))
    hits = _dense(spark, sf_dir, WIDE).filter("id <> query_id").withColumnRenamed("id", "vec_id").join(vectors, "vec_id").join(asked, "query_id")
    retrieved = F.when((F.col("rank") <= K) & (F.col("score") >= 0.35), F.col("vector"))
    same = F.array_sort(F.collect_list(F.when(F.col("label") == F.col("asked_label"), F.struct("rank", "vector"))))
    lists = hits.groupBy("query_id").agg(F.collect_list(retrieved).alias("ret"), F.slice(same, 1, REFERENCES)["vector"].alias("refs"))
    return E.precision_recall(asked.join(lists, "query_id", "left")).select("query_id", "context_precision", "context_recall")


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.col("doc_id").alias("id"), "source", T.tokens(F.col("text")).alias("words"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("asked"))
    return docs, asked


SPARSE = r"""
w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM documents),
posted AS (SELECT id, term, count(*) AS tf FROM w GROUP BY id, term),
sizes AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '\w+')) AS length FROM documents),
df AS (SELECT term, count(*) AS df, ln((SELECT count(*) FROM sizes) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM posted GROUP BY term),
idf AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM benchmark) GROUP BY query_id, term),
scored AS (SELECT query_id, posted.id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (SELECT avg(length) FROM sizes)))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN posted USING (term) JOIN sizes ON sizes.id = posted.id GROUP BY query_id, posted.id),
sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score > 0) WHERE rank <= 20)"""


def _sparse(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    docs, asked = _corpus(spark, sf_dir)
    return R.bm25_search(docs, asked, F.col("words"), F.col("asked"), k)


@query(f"WITH {SPARSE} SELECT * FROM sparse")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse(spark, sf_dir)


@query(f"WITH {SPARSE} SELECT term, df, round(idf, 6) AS idf FROM (SELECT df.term, df.df, idf.idf FROM df JOIN idf USING (term))")
def bm25_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _corpus(spark, sf_dir)
    return R.term_weights(docs, F.col("words")).select("term", "df", F.round("idf", 6).alias("idf"))


HELD = r"""
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\w+')) AS term FROM benchmark),
held AS (SELECT query_id, doc_id AS id, CAST(count(*) AS DOUBLE) AS score FROM qt JOIN documents ON contains(lower(text), term) WHERE length(term) >= 2 GROUP BY ALL)"""


@query(f"WITH {HELD} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM held) WHERE rank <= {K}")
def term_contains_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By substrings, so a term also counts inside a longer word."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("terms"))
    return C.contained_search(docs, asked, K)


VARIED = SPARSE.replace("asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\\w+')) AS term FROM benchmark) GROUP BY query_id, term)", r"""
variants AS (SELECT item_id AS query_id, item_id * 2 AS v, CASE WHEN item_id % 7 = 0 THEN [text[5:12]] ELSE regexp_extract_all(lower(text), '\w+') END AS asked FROM benchmark UNION ALL
  SELECT item_id, item_id * 2 + 1, CASE WHEN item_id % 7 = 0 THEN [] ELSE regexp_extract_all(lower(text), '\w+')[1:5] END FROM benchmark),
asked AS (SELECT v AS query_id, term, count(*) AS times FROM (SELECT v, unnest(asked) AS term FROM variants) GROUP BY ALL)""")


@query(f"""
WITH {VARIED}, best AS (SELECT v.query_id, id, max(score) AS score FROM scored JOIN variants v ON v.v = scored.query_id WHERE score > 0 GROUP BY ALL UNION ALL
  SELECT item_id, doc_id, 1.0::DOUBLE FROM benchmark b JOIN documents d ON contains(d.text, b.text[5:12]) WHERE item_id % 7 = 0)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM best) WHERE rank <= {K}
""")
def sparse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item as a whole and by its first five words; every seventh has a
    part that is no word, and so only what contains it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), "text")
    items, words = table(spark, sf_dir, "benchmark"), T.tokens(F.col("text"))
    odd = F.array(F.array(F.substring("text", 5, 8)), F.array().cast("array<string>"))
    variants = F.when(F.col("item_id") % 7 == 0, odd).otherwise(F.array(words, F.slice(words, 1, 5)))
    return C.sparse_search(docs, items.select(F.col("item_id").alias("query_id"), variants.alias("variants")), words, K)


TERMS = """terms AS (SELECT term, min(item_id) AS place FROM (SELECT item_id, unnest(list_concat([text[1:24]], regexp_extract_all(text, '[a-z]{6,}'))) AS term FROM benchmark) WHERE term <> '' GROUP BY term),
found AS (SELECT doc_id AS id, place, term, CAST(instr(text, term) - 1 AS BIGINT) AS first FROM documents JOIN terms ON contains(text, term))"""


def _terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts, and the beginnings and longer words of all items as terms."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    words = F.concat(F.array(F.substring("text", 1, 24)), F.regexp_extract_all("text", F.lit("([a-z]{6,})"), F.lit(1)))
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), F.explode(words).alias("term"))


@query(f"WITH {TERMS} SELECT * FROM found")
def terms_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contained_terms(*_terms(spark, sf_dir)).drop("n")


@query(f"WITH {TERMS} SELECT id, place, term, first FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place, term) AS r FROM found) WHERE r <= {C.MOST_TERMS}")
def first_terms_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.contained_terms(*_terms(spark, sf_dir), C.MOST_TERMS).drop("n")


@query()
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose spaces are gone, cut again by the words that the table has
    three times or more."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")))
    counts = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    cut = segmenter(counts, ascii_words=False)
    pieces = docs.select("doc_id", cut(F.regexp_replace("text", r"[^\p{L}\n]", "")).alias("pieces"))
    return pieces.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.md5(F.array_join("pieces", " ").cast("binary")).alias("digest"))


def _hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), V.character_vector("text").alias("vector"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), V.character_vector("text").alias("vector"))
    return docs, asked


HASHED = """
hc AS (SELECT 'd' AS kind, doc_id AS id, CAST(unicode(unnest(string_split(text, ''))) % 64 AS INTEGER) AS b FROM documents WHERE text <> '' UNION ALL
       SELECT 'q', item_id, CAST(unicode(unnest(string_split(text, ''))) % 64 AS INTEGER) FROM benchmark WHERE text <> ''),
hn AS (SELECT kind, id, b, CAST(count(*) AS DOUBLE) AS x FROM hc GROUP BY ALL),
hs AS (SELECT kind, id, sqrt(sum(x * x)) AS size FROM hn GROUP BY ALL),
hv AS (SELECT hn.kind, hn.id, b, x / size AS x FROM hn JOIN hs ON hn.kind = hs.kind AND hn.id = hs.id),
hp AS (SELECT q.id AS query_id, d.id, round(sum(q.x * d.x), 6) AS score FROM hv q JOIN hv d ON q.b = d.b WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY q.id, d.id),
hashed AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM hp) WHERE rank <= 20),
fused AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS w FROM (SELECT query_id, id, rank FROM hashed UNION ALL SELECT query_id, id, rank FROM sparse) GROUP BY query_id, id),
fr AS (SELECT query_id, id, round(w, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, id) AS INTEGER) AS rank FROM fused)"""


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, asked = _hashed(spark, sf_dir)
    dense = staged(R.dense_search(docs, asked, 20), "dense-hits")
    sparse = staged(_sparse(spark, sf_dir), "sparse-hits")
    fused = R.rrf([dense, sparse]).withColumn("order", F.round("rrf_score", 9)).withColumn("rrf_score", F.round("rrf_score", 6))
    return R.ranked(fused, order="`order` DESC, id").drop("order"), dense, sparse


@query(f"WITH {SPARSE}, {HASHED} SELECT query_id, id, rrf_score, rank FROM fr")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)[0]


HYBRID = f"""WITH {SPARSE}, {HASHED},
base AS (SELECT fr.query_id, fr.id, fr.rank AS rank_before, coalesce(hashed.score, 0.45) AS base_score FROM fr LEFT JOIN hashed ON hashed.query_id = fr.query_id AND hashed.id = fr.id),
bh AS (SELECT base.query_id, base.id, count(*) AS body_hits FROM base JOIN asked ON asked.query_id = base.query_id JOIN posted ON posted.id = base.id AND posted.term = asked.term WHERE length(asked.term) >= 6 GROUP BY base.query_id, base.id),
sc AS (SELECT base.*, round(least(0.28, (CASE WHEN doc.source = 'src1' THEN 1 ELSE 0 END) * 0.12 + coalesce(body_hits, 0) * 0.03), 6) AS rule_score
  FROM base LEFT JOIN bh ON bh.query_id = base.query_id AND bh.id = base.id JOIN documents doc ON doc.doc_id = base.id),
rr AS (SELECT *, round(base_score + rule_score, 6) AS rerank_score FROM sc),
rk AS (SELECT query_id, id, rule_score, rerank_score, least(1.0, rerank_score) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rule_score DESC, rank_before) AS INTEGER) AS rank FROM rr)"""


def _reranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The reranked hits and the sparse ones among them."""
    fused, dense, sparse = _fused(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    full = R.restore_scores(fused, dense).join(texts, "id").join(_corpus(spark, sf_dir)[1], "query_id")
    body = F.size(F.array_intersect(F.filter("asked", lambda t: F.length(t) >= 6), T.tokens(F.col("text"))))  # of the hits alone
    return R.rule_rerank(full.withColumn("body_hits", body), (F.col("source") == "src1").cast("int"), F.col("body_hits")), sparse


@query(f"{HYBRID} SELECT query_id, id, CAST(rule_score AS DOUBLE) AS rule_score, rerank_score, score, rank FROM rk")
def rule_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir)[0].select("query_id", "id", "rule_score", "rerank_score", "score", "rank")


@query(f"{HYBRID} SELECT query_id, id, score, rank FROM rk WHERE rank <= {K} AND (score >= 0.35 OR (query_id, id) IN (SELECT (query_id, id) FROM sparse))")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, sparse = _reranked(spark, sf_dir)
    kept = ranked.filter(F.col("rank") <= K).join(sparse.select("query_id", "id", F.lit(True).alias("sparse")), ["query_id", "id"], "left")
    return kept.filter("score >= 0.35 OR sparse").select("query_id", "id", "score", "rank")


SERVED = VARIED.replace("scored AS (", "scored0 AS (").replace("sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored WHERE score > 0) WHERE rank <= 20)", """
best AS (SELECT v.query_id, id, max(score) AS score FROM scored0 JOIN variants v ON v.v = scored0.query_id WHERE score > 0 GROUP BY ALL UNION ALL
  SELECT item_id, doc_id, 1.0::DOUBLE FROM benchmark b JOIN documents d ON contains(d.text, b.text[5:12]) WHERE item_id % 7 = 0),
sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM best) WHERE rank <= 32)""")
SERVED = f"""WITH {SERVED}, {HASHED.replace('rank <= 20', 'rank <= 32')},
terms AS (SELECT DISTINCT item_id AS query_id, unnest(list_concat([text[1:12]], regexp_extract_all(lower(text), '[a-z]{{5,}}'))) AS term FROM benchmark),
cand AS (SELECT fr.query_id, fr.id, CAST(row_number() OVER (PARTITION BY fr.query_id ORDER BY round(w, 9) DESC, fr.id) AS INTEGER) AS rank_before, coalesce(hashed.score, 0.45) AS base_score, source, text FROM fused fr LEFT JOIN hashed ON hashed.query_id = fr.query_id AND hashed.id = fr.id JOIN documents ON doc_id = fr.id),
th AS (SELECT query_id, id, rank_before, base_score, count(*) FILTER (contains(coalesce(source, ''), term)) AS title_hits, count(*) FILTER (contains(coalesce(text, ''), term)) AS body_hits FROM cand LEFT JOIN terms USING (query_id) WHERE length(term) >= 2 OR term IS NULL GROUP BY ALL),
rs AS (SELECT *, round(least(0.28, title_hits * 0.12 + body_hits * 0.03), 6) AS rule_score FROM th),
rr AS (SELECT *, round(base_score + rule_score, 6) AS rerank_score FROM rs),
rk AS (SELECT query_id, id, least(1.0, rerank_score) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rule_score DESC, rank_before) AS INTEGER) AS rank FROM rr),
mixed AS (SELECT * FROM rk WHERE rank <= 8 AND (score >= 0.35 OR (query_id, id) IN (SELECT (query_id, id) FROM sparse))),
seen AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM mixed m JOIN documents d ON d.doc_id = m.id
  WHERE id % 17 <> 5 AND (query_id % 5 = 0 OR ((id % 3 > 0 OR coalesce(source, '') = '' OR source = concat('src', query_id % 4)) AND (id % 4 > 0 OR coalesce(lang, '') = '' OR lang = CASE WHEN query_id % 2 = 0 THEN 'en' ELSE 'fr' END))))
SELECT query_id, id, score, CAST(r AS INTEGER) AS rank FROM seen WHERE r <= 4"""


def _served(spark: SparkSession, sf_dir: str, lam: float | None) -> DataFrame:
    """Items ask as a whole, by their first words and by an odd part; departments
    and roles come from sources and languages, every seventeenth id is blocked."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    dept, roles = F.when(F.col("doc_id") % 3 == 0, F.col("source")), F.when(F.col("doc_id") % 4 == 0, F.col("lang"))
    docs = docs.select(F.col("doc_id").alias("id"), "doc_id", dept.alias("dept"), roles.alias("roles"), F.col("source").alias("title"), "text", V.character_vector("text").alias("vector"))
    n, words = F.col("item_id"), T.tokens(F.col("text"))
    odd = F.array(F.array(F.substring("text", 5, 8)), F.array().cast("array<string>"))
    terms = F.concat(F.array(F.substring("text", 1, 12)), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))
    role = F.when(n % 5 == 0, "admin").when(n % 2 == 0, "en").otherwise("fr")
    asked = table(spark, sf_dir, "benchmark").select(n.alias("query_id"), V.character_vector("text").alias("vector"), F.when(n % 7 == 0, odd).otherwise(F.array(words, F.slice(words, 1, 5))).alias("variants"), terms.alias("terms"), F.concat(F.lit("src"), (n % 4).cast("string")).alias("user_dept"), role.alias("user_role"))
    return Y.served_search(docs, asked, words, docs.filter("doc_id % 17 = 5").select("doc_id"), lam=lam)


@query(SERVED)
def served_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir, None)


@query()
def served_search_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir, 0.5)


@query()
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = staged(_sparse(spark, sf_dir), "sparse-hits").withColumn("score", R.minmax("score"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    words = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 2))  # of the hits alone
    return R.mmr(hits.join(texts, "id").withColumn("words", words), 5)


def _scaled(score: str) -> str:
    low, high = f"min({score}) OVER (PARTITION BY query_id)", f"max({score}) OVER (PARTITION BY query_id)"
    return f"CASE WHEN {high} = {low} THEN 0.5 ELSE ({score} - {low}) / ({high} - {low}) END"


@query(f"""
WITH {SPARSE}, s AS (SELECT query_id, id, {_scaled('score')} AS score FROM sparse), r AS (SELECT query_id, id, score, ln(1 + length(text)) AS raw FROM s JOIN documents ON doc_id = id)
SELECT query_id, id, round(raw, 6) AS raw_score, round(least(1.0, score + 0.25 * {_scaled('raw')}), 6) AS cross_score FROM r
""")
def cross_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked with a stand-in for the injected model: length of the text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.log1p(F.length("text")).alias("raw"))
    hits = R.cross_rerank(_sparse(spark, sf_dir).withColumn("score", R.minmax("score")).join(docs, "id"), F.col("raw"))
    return hits.select("query_id", "id", F.round("raw_score", 6).alias("raw_score"), F.round("cross_score", 6).alias("cross_score"))


@query(f"""
WITH {DENSE},
a AS (SELECT query_id, max(score) AS top_score, count(*) AS hits FROM dense WHERE id <> query_id AND score >= 0.6 GROUP BY query_id),
f AS (SELECT v.vec_id AS query_id, coalesce(hits, 0) AS hits, CASE WHEN hits IS NULL THEN 'incorrect' WHEN top_score >= 0.72 THEN 'correct' ELSE 'ambiguous' END AS grade FROM embeddings v LEFT JOIN a ON a.query_id = v.vec_id WHERE v.vec_id % {EACH} = 0),
b AS (SELECT query_id, max(score) AS top_score, count(*) AS hits FROM dense WHERE id <> query_id AND query_id % 100 = 0 GROUP BY query_id),
s AS (SELECT query_id, hits AS hits2, CASE WHEN top_score >= 0.72 THEN 'correct' WHEN top_score < 0.3 THEN 'incorrect' ELSE 'ambiguous' END AS grade2 FROM b),
j AS (SELECT f.*, hits2, grade2, grade = 'incorrect' AND grade2 IS NOT NULL AS rewritten FROM f LEFT JOIN s USING (query_id)),
g AS (SELECT *, CASE WHEN rewritten AND hits2 > 0 THEN grade2 ELSE grade END AS final_grade FROM j)
SELECT query_id, rewritten, final_grade, CAST(CASE WHEN final_grade = 'incorrect' THEN 0 WHEN rewritten AND hits2 > 0 THEN hits2 ELSE hits END AS BIGINT) AS hits,
  CASE WHEN final_grade = 'correct' AND NOT rewritten THEN 'high' WHEN final_grade = 'incorrect' AND rewritten THEN 'refused' ELSE 'medium' END AS confidence FROM g
""")
def crag_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in for a rewrite drops the score limit, for every second query."""
    asked = table(spark, sf_dir, "embeddings").filter(f"vec_id % {EACH} = 0").select(F.col("vec_id").alias("query_id"))
    hits = _dense(spark, sf_dir).filter("id <> query_id")

    def graded(found: DataFrame, base: DataFrame) -> DataFrame:
        top = base.join(found, "query_id", "left").groupBy("query_id").agg(F.max("score").alias("top"), F.count("score").alias("hits"))
        return top.select("query_id", "hits", R.grade(F.col("top"), F.col("hits")).alias("grade"))

    return R.corrective(graded(hits.filter("score >= 0.6"), asked), graded(hits, asked.filter("query_id % 100 = 0")))
