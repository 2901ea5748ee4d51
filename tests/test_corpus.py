from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.operators import answers as A
from lodestone.sources import chapters as C
from lodestone.sources import detail_pages as P


@given(st.text("ab é漢😀\n#", max_size=60), st.integers(4, 20))
@settings(max_examples=200, deadline=None)
def test_byte_pieces_are_whole_and_fit(text, most):
    pieces = C.byte_pieces(text, most)
    assert "".join(pieces) == text and all(0 < C.size_of(p) <= most for p in pieces)


def test_chapters_fit_the_budget():
    text = "intro\n\n## A\n\none\n\ntwo\n\n## B\n\n" + "漢" * 10
    assert C.chapter_parts("t", text, 1000) == [("t", text)]
    assert C.chapter_parts("t", text, 20) == [("A", "intro\n\n## A\n\none"), ("A_2", "two"), ("B", "## B"), ("B_2", "漢" * 6), ("B_3", "漢" * 4)]
    assert C.chapter_parts("t", "aaaa\n\nbbbb\n\ncc", 8) == [("t", "aaaa"), ("t_2", "bbbb\n\ncc")]
    assert C.chapter_parts("t", None, 8) == C.chapter_parts("t", " \n", 8) == []


@given(st.text("abc ", max_size=25), st.lists(st.sampled_from(["a", "b", "ca", "bb"]), min_size=1, max_size=3, unique=True))
@settings(max_examples=200, deadline=None)
def test_covering_span_is_the_shortest(text, needles):
    places = [[i for i in range(len(text)) if text.startswith(n, i)] for n in needles]
    spans = [max(p + len(n) for p, n in zip(at, needles, strict=True)) - min(at) for at in product(*places)]
    found = C.covering_span(text, needles)
    assert (found is None) == (not spans) and (not spans or found[1] - found[0] == min(spans))


def test_excerpts():
    body = "x" * 3000 + "\nalpha " + "y" * 300 + " beta\n" + "z" * 3000
    found = C.excerpt(body, ["alpha", "beta"])
    assert "alpha" in found and "beta" in found and 400 <= len(found) <= 1800
    assert C.excerpt(body, ["alpha", "missing"]) is None and C.excerpt("alpha", ["alpha"]) is None and C.excerpt(None, []) is None
    far = "alpha" + "x" * 5000 + "beta" + "y" * 50 + "gamma" + "z" * 2000
    assert "beta" in C.excerpt(far, ["alpha", "beta", "gamma"]) and "alpha" not in C.excerpt(far, ["alpha", "beta", "gamma"])


def test_chunks_of_sections(spark):
    docs = spark.createDataFrame([(1, "d", "lost\n# A\none\n\ntwo\n## B\n" + "k" * 25), (2, "e", None), (3, "f", "")], "doc_id long, doc_name string, text string")
    rows = C.build_chunks(docs, 10, 2).orderBy("doc_id", "chunk_idx").collect()
    assert [(r["chunk_idx"], r["section_path"], r["text"]) for r in rows] == [(0, ["A"], "A\none\n\ntwo"), (1, ["A", "B"], "B\n" + "k" * 10), (2, ["A", "B"], "B\n" + "k" * 10), (3, ["A", "B"], "B\n" + "k" * 9)]
    assert len({r["parent_id"] for r in rows}) == 2


PAGE = """<div id="content"><p>12 #</p><h2>药</h2><p>top</p><h3>组成</h3><ul><li><a href="/wiki/a">麻黄</a></li><li><a href="/x">no</a></li></ul>
<h3>归经</h3><p><a href="/wiki/b">肺经</a><a href="/wiki/c">肺</a><script>bad</script></p><h2>性味</h2><p>辛苦，温。</p></div>"""


def test_detail_pages_become_edges(spark):
    found = P.parse_detail(PAGE)
    assert [s["heading"] for s in found] == ["药", "性味"] and [c["heading"] for c in found[0]["children"]] == ["组成", "归经"]
    assert found[0]["blocks"][0]["text"] == "top" and found[0]["children"][1]["blocks"][0]["entities"] == ["肺经", "肺"]
    pages = P.detail_sections(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string"))
    named = pages.select(F.col("page_id").cast("string").alias("name"), F.lit("Herb").alias("type"), F.when(F.col("page_id") == 1, F.create_map(F.lit("功效分类"), F.lit("解表"), F.lit("大类"), F.lit(""))).alias("meta"), "sections")
    edges = {(r["relation"], r["subject"], r["object"], r["object_type"]) for r in P.rule_edges(named).collect()}
    assert edges == {("BELONGS_TO", "1", "解表", "SubClass"), ("HAS_INGREDIENT", "1", "麻黄", "Herb"), ("HAS_MERIDIAN", "1", "肺经", "Meridian")}
    assert [tuple(r) for r in P.rule_attributes(named, ["苦", "辛"], ["寒", "温"]).collect()] == [("1", "Herb", "苦、辛", "温")]
    assert P.rule_entities(named).count() == 5


def test_routes(spark):
    rows = spark.createDataFrame([("what is lorem", None), ("lorem", True), ("a classic", False), ("the cat", None), ("cat", None), ("the cat", False), (None, None)], "q string, f boolean")
    found = rows.select(A.route(F.col("q"), F.col("f"), ["lorem"], "what", ["classic"], ["the "]).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in found] == [(True, "title"), (True, "model"), (True, "classic"), (True, "hint"), (False, "no_hint"), (False, "model"), (False, "no_hint")]


def test_lifecycle_of_unknown_and_pending_documents(spark):
    docs = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "vectorized"), (None, "pending")], "doc_id long, status string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    found = {r["doc_id"]: (r["status"], r["error"]) for r in A.advance(docs, ids(1, 1, 3), ids(1, 2, 9)).collect()}
    assert found == {1: ("vectorized", None), 2: ("pending", "not_parsed"), 3: ("parsed", None), None: ("pending", None)}
