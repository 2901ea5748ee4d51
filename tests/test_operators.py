import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import records
from lodestone.functions import text as T
from lodestone.operators import containment, evaluation, history, retrieval, tables
from lodestone.operators import retrieval as R
from lodestone.plans import registry
from lodestone.sources import documents as D
from lodestone.sources.documents import sections
from lodestone.streaming import memory


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def test_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    found = one(spark, T.windows(F.col("t"), 400, 80), t=f"  {text}\n")
    assert found[0] == text[:400] and found[1] == text[320:720] and found[-1] == text[640:1000]
    assert one(spark, T.windows(F.col("t")), t=" \n") == []
    with pytest.raises(ValueError):
        T.windows(F.col("t"), 0)


def test_redaction_order(spark):
    text = "call 13812345678, id 11010519491231002X, mail a.b@c.org, no 12345"
    assert one(spark, T.redact(F.col("t")), t=text) == "call [REDACTED], id [REDACTED], mail [REDACTED], no 12345"


def test_front_matter_is_removed(spark):
    assert one(spark, T.clean_markdown(F.col("t")), t="---\na: 1\n---\n# T\r\n\n\n\nx ") == "# T\n\nx"


def test_sections_keep_their_path(spark):
    text = "lost\n# A\none\n## B\n## C\ntwo\n# D\nthree"
    found = one(spark, D.section_paths(D.sections(F.col("t"))), t=text)
    assert [(r["path"], r["body"]) for r in found] == [(["A"], "one"), (["A", "C"], "two"), (["D"], "three")]
    assert [(r["path"], r["body"]) for r in one(spark, D.section_paths(D.sections(F.col("t"))), t="plain")] == [([""], "plain")]


def test_paragraphs_are_packed(spark):
    assert one(spark, D.pack_paragraphs(F.col("t"), 9), t="aa\n\nbbb\n\nccc\n\n" + "d" * 12 + "\n\ne") == ["aa\n\nbbb", "ccc", "d" * 12, "e"]


def test_html_noise_is_dropped():
    page = "<html><table class='infobox x'><tr><td><p>box</p></table><h2>T</h2><p>a <b>b</b></p><ul><li>c<li>d</ul><sup>up</sup><p>e<sup class=reference>[1]</sup> f</p><script>x</script><blockquote>q</blockquote></html>"
    assert D.html_to_markdown(page) == "## T\n\na b\n\n- c d\ne f\n\nq"


def test_broken_html_hides_no_more_than_its_noise():
    assert D.html_to_markdown("<div><div class=toc><ul><li>x</div><p>after</p></div>") == "after"
    assert D.html_to_markdown("<div id='toc'><p>never closed") == ""
    assert D.html_to_markdown("<p>one<p>two</p></p><li>three</i></b>") == "one two\n\n- three"
    wiki = '<p>menu</p><div class="x mw-parser-output"><span class="mw-editsection">[e]</span><h2><span>H</span></h2><p>body<br/>more</p></div><p>foot</p>'
    assert D.html_to_markdown(wiki) == "## H\n\nbody more" and D.html_to_markdown(None) == ""


def test_mmr_keeps_the_diverse_hit(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1, ["a", "b"]), (1, 2, 0.89, 2, ["a", "b"]), (1, 3, 0.6, 3, ["c"])], "query_id long, id long, score double, rank int, words array<string>")
    assert [r["id"] for r in retrieval.mmr(hits, 2).orderBy("rank").collect()] == [1, 3]
    assert retrieval.mmr(hits, 3).count() == 3


def test_shared_key_ranks_first(spark):
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 3, 1), (1, 2, 2)], "query_id long, id long, rank int")
    assert retrieval.rrf([a, b]).orderBy(F.desc("rrf_score")).first()["id"] == 2


def test_search_of_nothing(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    none = spark.createDataFrame([], "query_id long, vector array<double>")
    assert retrieval.dense_search(index, none, 3).collect() == []
    asked = spark.createDataFrame([(7, [0.5, 1.0])], "query_id long, vector array<double>")
    assert [tuple(r) for r in retrieval.dense_search(index, asked, 3).collect()] == [(7, 1, 0.5, 1)]


@pytest.mark.parametrize("dept, roles, user_dept, role, ok", [("", "", None, "user", True), ("d", "", "d", "user", True), ("d", "", "e", "user", False), ("", "a, b", None, "b", True), ("", "a,b", None, "c", False), ("d", "a", None, "admin", True), (None, None, None, None, True), ("", "a", None, None, False)])
def test_access(spark, dept, roles, user_dept, role, ok):
    frame = spark.createDataFrame([(dept, roles, user_dept, role)], "d string, r string, ud string, ur string")
    assert frame.select(tables.acl_ok(F.col("d"), F.col("r"), F.col("ud"), F.col("ur")).alias("x")).first()["x"] is ok


def test_latest_drops_tombstones(spark):
    log = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "c", 1, False), (2, "d", 2, True)], "k int, v string, t int, gone boolean")
    assert [(r["k"], r["v"]) for r in tables.latest(log, ["k"], F.col("t"), F.col("gone")).collect()] == [(1, "b")]


def attempts(spark):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, start + timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 59, 60, 61, 62])], "id long, key long, ts timestamp")


EXPECTED = {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False}


def test_rejected_attempts_do_not_count(spark):
    assert {r["id"]: r["accepted"] for r in history.rate_limited(attempts(spark), 60, 2).collect()} == EXPECTED


def test_streaming_limiter_equals_the_batch_one(spark, tmp_path):
    attempts(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, key long, ts timestamp").parquet(str(tmp_path / "in"))
    run = memory.accepted_attempts(stream, 60, 2).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert {r["id"]: r["accepted"] for r in spark.table("limited").collect()} == EXPECTED


def test_facts_are_folded_by_batch(spark, tmp_path):
    schema = "user_id long, subject string, predicate string, object string, ts long, action string"
    spark.createDataFrame([(1, "u", "likes", "tea", 1, "set"), (1, "u", "likes", "milk", 2, "set"), (1, "u", "age", "3", 1, "set"), (1, "u", "age", "", 5, "delete")], schema).write.parquet(str(tmp_path / "in"))
    memory.latest_facts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    log = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert [r["object"] for r in tables.latest(log, ["user_id", "subject", "predicate"], F.col("ts"), F.col("action") == "delete").collect()] == ["milk"]


def test_a_large_key_is_walked_in_batches(spark):
    start, most = datetime(2024, 1, 1), 2
    rows = [(i, None if i % 5 == 4 else 1 if i % 5 else i % 3, start + timedelta(seconds=i * 7919 % 3000)) for i in range(3000)]
    expected, recent = {}, {}
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        times = recent[key] = [t for t in recent.get(key, []) if (ts - t).total_seconds() < 60]
        expected[i] = len(times) < most
        if expected[i]:
            times.append(ts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        limited = history.rate_limited(spark.createDataFrame(rows, "id long, key long, ts timestamp"), 60, most)
        assert {r["id"]: r["accepted"] for r in limited.collect()} == expected
        assert "FlatMapGroupsInPandas" not in limited._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("size, overlap", [(400, 80), (10, 3), (10, 9), (7, 0), (1, 0)])
def test_windows_equal_slices(spark, size, overlap):
    step = size - overlap
    for text in ["", "  ", "ab", "x" * 10, "é中😀 y\nz" * 40, " " + "word " * 300]:
        body = text.strip(" \t\n\r\x0b\x0c")
        count = max(1, -(-(len(body) - overlap) // step)) if body else 0
        assert _one(spark, T.windows(F.col("t"), size, overlap), t=text) == [body[i * step : i * step + size] for i in range(count)]


def test_bigrams_of_odd_and_long_texts(spark):
    texts = ["ab c", "", " \n", None, "x", "a\U00020000b\U00020000b", "aaaa", "a\n\x85z"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.bigrams(F.col("t"))).collect()]
    assert found == [["ab", "bc"], [], [], [], ["x"], ["a\U00020000", "\U00020000b", "b\U00020000"], ["aa"], ["a\x85", "\x85z"]]
    long, begun = "".join(chr(97 + i * i * (i // 26) % 26) for i in range(150_000)), time.monotonic()
    assert set(one(spark, T.bigrams(F.col("t")), t=long)) == {long[i : i + 2] for i in range(len(long) - 1)}
    assert time.monotonic() - begun < 30  # time grew with the square of the length


def test_records(spark):
    assert _one(spark, records.json_flag(F.col("t"), "ok"), t='so: {"ok": "是"} then') is True
    assert _one(spark, records.json_flag(F.col("t"), "ok"), t="nothing") is None
    assert _one(spark, records.flat_content(F.col("t")), t='["a", {"text": "b"}, {"kind": 1}]') == "a\nb"
    assert _one(spark, records.distinct_names(F.col("t")), t=["A", "a ", "", "x" * 21, "b"]) == ["A", "b"]
    assert _one(spark, records.is_refusal_item(F.lit(None), F.col("t")), t=[" 未查到 "]) is True
    assert _one(spark, records.front_matter_split(F.col("t")), t="---\nlicense: 'CC'\n---\n\nbody") == ("body", "CC")
    assert str(_one(spark, records.log_bound(F.col("t"), end=True).cast("string"), t="2024-01-05")) == "2024-01-05 15:59:59.999999"
    assert _one(spark, records.iso_instant(F.col("t")), t="never") is None


def test_sections_keep_control_characters_from_cutting(spark):
    found = _one(spark, sections(F.col("t")), t="# a\none \u0001 two\n# b\nx")
    assert [(s["title"], s["body"]) for s in found] == [("a", "one  two"), ("b", "x")]


@pytest.mark.parametrize("at_once", [2, 1000])
def test_sparse_search_equals_brute_force(spark, monkeypatch, at_once):
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(R, "SPARSE_QUERIES_AT_ONCE", at_once)
    rng = random.Random(1)
    word = lambda: rng.choice("a b c d e f g h i j k l".split())
    docs = {i: [word() for _ in range(rng.randint(0, 12))] for i in range(60)}
    asked = {i: [word() for _ in range(3)] + ["zz"] for i in range(7)}
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean, size = sum(idf.values()) / len(idf), sum(map(len, docs.values())) / len(docs)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in idf.items()}
    want = set()
    for q, terms in asked.items():
        scores = [(-round(sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / size)) for t in terms), 6), i) for i, d in docs.items()]
        want |= {(q, i, n + 1) for n, (s, i) in enumerate(sorted(scores)[:5]) if s < 0}
    frame = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, words array<string>")
    found = R.bm25_search(frame(docs, "id").repartition(3), frame(asked, "query_id"), F.col("words"), F.col("words"), 5)
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.collect()} == want


def test_variants_take_the_best_score_and_fall_back_on_contained_terms(spark):
    docs = spark.createDataFrame([(1, ["red", "fox"]), (2, ["red", "dog"]), (3, ["cat"]), (4, ["owl", "owl"])], "id long, words array<string>").withColumn("text", F.array_join("words", " "))
    asked = spark.createDataFrame([(7, [["cat"], ["dog", "owl"]]), (8, [["red"]]), (9, [["none"]]), (10, [[]])], "query_id long, variants array<array<string>>")
    found = {(r["query_id"], r["id"]): r["score"] for r in containment.sparse_search(docs, asked, F.col("words"), 10).collect()}
    single = spark.createDataFrame([(1, ["cat"]), (2, ["dog", "owl"])], "query_id long, asked array<string>")
    scores = {r["id"]: r["score"] for r in retrieval.bm25_search(docs, single, F.col("words"), F.col("asked"), 10).collect()}
    assert {i: s for (q, i), s in found.items() if q == 7} == scores and set(scores) == {2, 3, 4}
    assert {i: s for (q, i), s in found.items() if q == 8} == {1: 1.0, 2: 1.0}  # in half of all documents, so its weight is 0
    assert not {q for q, _ in found} & {9, 10}


def test_golden_findings_of_odd_items(spark):
    rows = [
        (1, " a ", '["x"]', "方剂", None, None), (2, "a", None, " ", "feedback", "[]"), (3, None, "not json", "方剂", "feedback", '["d", null]'),
        (4, " ", "[]", "no", "seed", '{"a": 1}'), (5, "b", "[null]", "拒答", "feedback", "null"), (6, "b\t", "[]", "其他", " feedback", '["d"]'),
    ]
    items = spark.createDataFrame(rows, "id long, query string, expect string, category string, source string, relevant_docs string")
    found = {r["id"]: r["errors"] for r in evaluation.golden_findings(items).collect()}
    assert found == {
        1: [], 2: ["duplicate_query", "expect_not_list", "empty_category"], 3: ["empty_query", "expect_not_list", "docs_not_strings"],
        4: ["empty_query", "unknown_category", "no_expectation", "docs_not_strings"], 5: ["expect_blank_item", "docs_not_strings"], 6: ["duplicate_query"],
    }
    assert evaluation.golden_findings(items.limit(0)).count() == 0


def test_precision_recall_counts_near_vectors_and_keeps_samples_with_an_empty_side(spark):
    x, y = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, [x, y], [x, x, y]), (2, [x, y], [x, x]), (3, [x], [y]), (4, [x], None), (5, [], [x]), (6, None, None)]
    samples = spark.createDataFrame(rows, "sample int, refs array<array<double>>, ret array<array<double>>")
    found = {r["sample"]: (r["context_precision"], r["context_recall"]) for r in evaluation.precision_recall(samples).collect()}
    assert found == {1: (1.0, 1.0), 2: (1.0, 0.5), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (None, None), 6: (None, None)}


def test_a_text_of_lists_is_read_once_and_on_all_cores(spark):
    lists = records.json_lists(F.col("t"), ["a", "b"])
    told = [('```json\n{"a": ["x", "X"]}\n```', "x", ""), ('so {"a": ["x"], "b": ["y"]} it is', "x", "y"), ('[{"b": ["y"]}]', "", "y"), ('{"a": ["x"]} {"b": ["y"]}', "x", ""), ('{"a": "x"', "", ""), (None, "", "")]
    df = spark.createDataFrame(told, "t string, a string, b string")
    found = df.select("a", "b", F.array_join(lists["a"], ",").alias("x"), F.array_join(lists["b"], ",").alias("y"))
    assert all((r["a"], r["b"]) == (r["x"], r["y"]) for r in found.collect())
    plan = df.select(lists.alias("found"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json") == 1
    assert registry.QUERIES["json_records"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_bm25_of_documents_that_hold_no_term(spark):
    docs = spark.createDataFrame([(i, ["z"] * (i % 3)) for i in range(600)] + [(600, None), (601, ["a", "z", "a"]), (602, ["a"])], "id long, words array<string>").coalesce(1)
    asked = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["b"])], "query_id long, asked array<string>")
    found = [(r["query_id"], r["id"], r["rank"]) for r in R.bm25_search(docs, asked, F.col("words"), F.col("asked"), 5).collect()]
    assert sorted(found) == [(1, 601, 2), (1, 602, 1)]


def test_mmr_select_cuts_the_texts_of_hits_alone(spark):
    plan = registry.QUERIES["mmr_select"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan[: plan.index("Join")] and "regexp_extract_all" not in plan[plan.index("Join") :]


def test_section_chunks_runs_on_all_cores(spark):
    found = registry.QUERIES["section_chunks"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
