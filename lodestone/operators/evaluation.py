"""Offline evaluation: keyword scores, golden set checks, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import records as D
from lodestone.functions import text as T
from lodestone.functions import vectors as V

# The categories of golden items, and what a refusal says.
CATEGORIES = ["方剂", "本草", "证候", "文献", "典籍", "医案", "其他", "拒答", "用户反馈"]
REFUSED = "未查到"
FROM_FEEDBACK = "feedback"
NEAR = 0.35


def keyword_score(answer: Column, expected: Column) -> Column:
    """Share of expected keywords in the answer; 0 for an empty list."""
    hits = F.size(F.filter(expected, lambda k: F.contains(answer, k)))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(0.0)


def golden_errors() -> Column:
    """Errors of golden rows (query, expect, category, copies)."""
    rules = {
        "empty_query": F.trim(F.coalesce("query", F.lit(""))) == "",
        "no_expectation": F.coalesce(F.size("expect"), F.lit(0)) == 0,
        "no_category": F.col("category").isNull(),
        "duplicate_query": F.col("copies") > 1,
    }
    return F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))


def means(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Rounded means of metrics, nulls left out, with how many there were."""
    parts = [x for c in columns for x in (F.round(F.avg(c), 6).alias(c), F.count(c).alias(f"n_{c}"))]
    return scores.agg(F.count("*").alias("n"), *parts)


def precision_recall(samples: DataFrame, tau: float = NEAR, digits: int = 6) -> DataFrame:
    """Adds to samples (refs, ret: lists of unit vectors, as long as the search
    before allows) context_precision, the share of retrieved vectors near some
    reference, and context_recall, the share of references near some retrieved
    one. With nothing retrieved both are 0; without references both are null."""
    hit = lambda one, others: F.exists(others, lambda o: F.round(V.dot(o, one), digits) >= tau)
    share = lambda of, others: F.round(F.size(F.filter(of, lambda x: hit(x, others))) / F.size(of), digits)
    none = F.array().cast("array<array<double>>")
    refs, ret = F.coalesce("refs", none), F.coalesce("ret", none)
    either = lambda of, others: F.when(F.size(refs) == 0, None).when(F.size(ret) == 0, 0.0).otherwise(share(of, others))
    return samples.withColumns({"context_precision": either(ret, refs), "context_recall": either(refs, ret)})


def golden_findings(golden: DataFrame) -> DataFrame:
    """(id, errors) of golden items (id, query, category, source, and as JSON
    text expect and relevant_docs). Of items that ask the same, white space
    around aside, all but the one of the smallest id are duplicates. Text that
    isn't JSON counts as no list."""
    asked = T.strip(F.coalesce("query", F.lit("")))
    first = golden.select("id", asked.alias("asked")).filter("asked <> ''").groupBy("asked").agg(F.min("id").alias("first_id"))
    kind = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)), F.lit(""))
    items = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    texts = lambda c: kind(c).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(items(c), lambda x: x.isNull())
    listed = kind("expect").startswith("ARRAY<")
    category = T.strip(F.coalesce("category", F.lit("")))
    rules = {
        "empty_query": F.col("asked") == "",
        "duplicate_query": F.col("id") > F.col("first_id"),
        "expect_not_list": ~listed,
        "expect_blank_item": listed & (~texts("expect") | F.exists(items("expect"), lambda x: T.strip(x) == "")),
        "empty_category": category == "",
        "unknown_category": (category != "") & ~category.isin(CATEGORIES),
        "no_expectation": (T.strip(F.coalesce("source", F.lit(""))) != FROM_FEEDBACK) & (~listed | (kind("expect") == "ARRAY<VOID>") & (F.size(items("expect")) == 0)),
        "docs_not_strings": F.col("relevant_docs").isNotNull() & ~texts("relevant_docs"),
    }
    rows = golden.withColumn("asked", asked).join(first, "asked", "left")
    return rows.select("id", F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()])).alias("errors"))


def six_metrics(samples: DataFrame, tau: float = NEAR) -> DataFrame:
    """(id and six metrics) of answered samples: id, answer, reference, expect,
    category, refs and ret (texts that belong to it, and texts that were found)
    with the unit vectors of the question, the answer, the reference and all
    found texts together (q, a, r, joined) and of each text (ref_vectors,
    ret_vectors), from any encoder.

    A found text is right, and a reference found, if it is `tau` near to one of
    the other side or covers it. To refuse is right where the sample says so.
    Without references, precision is the mean nearness to the question and
    recall is null, or 0 where it should have refused. A sample's lists are as
    long as the search before it allows.
    """
    none = F.array().cast("array<string>")
    answer, reference, expect = F.coalesce("answer", F.lit("")), F.coalesce("reference", F.lit("")), F.coalesce("expect", none)
    refuse, said, blank = D.is_refusal_item(F.col("category"), expect), F.contains(answer, F.lit(REFUSED)), T.strip(answer) == ""
    found, known = F.size("ret"), F.size("refs")
    near = lambda a, b: V.clip01(V.dot(F.col(a), F.col(b)))

    def share(texts: str, vectors: str, others: str, other_vectors: str) -> Column:
        one = lambda t, v: (F.array_max(F.transform(other_vectors, lambda o: V.dot(o, v))) >= tau) | F.exists(others, lambda o: T.covers(t, o))
        return F.size(F.filter(F.zip_with(texts, vectors, one), lambda x: x)) / F.size(texts)

    to_question = V.clip01(F.aggregate("ret_vectors", F.lit(0.0), lambda s, v: s + V.dot(v, F.col("q"))) / found)
    empty = F.when(refuse, 1.0).otherwise(0.0)
    semantic = F.when(refuse, F.when(said, 1.0).otherwise(near("a", "r"))).when(reference != "", near("a", "r")).otherwise(0.0)
    out = samples.select(
        "id",
        F.when(refuse, F.when(said | (found == 0), 1.0).otherwise(0.0)).when((found == 0) | blank, 0.0).otherwise(near("a", "joined")).alias("faithfulness"),
        F.when(refuse & said, 1.0).when(~refuse & blank, 0.0).otherwise(near("a", "q")).alias("answer_relevancy"),
        F.when(found == 0, empty).when(known == 0, to_question).otherwise(share("ret", "ret_vectors", "refs", "ref_vectors")).alias("context_precision"),
        F.when(found == 0, empty).when(known == 0, F.when(refuse, 0.0)).otherwise(share("refs", "ref_vectors", "ret", "ret_vectors")).alias("context_recall"),
        semantic.alias("answer_semantic_similarity"),
        F.when(F.size(expect) > 0, (keyword_score(answer, expect) + semantic) / 2).otherwise(semantic).alias("answer_correctness"),
    )
    return out.select("id", *[F.round(c, 4).alias(c) for c in out.columns[1:]])
