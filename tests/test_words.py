import random
import re
import sys
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import segment
from lodestone.functions.segment import PackedGraph, PackedWords, WordGraph, cohesive_words, segmenter
from lodestone.operators import containment as C
from lodestone.operators import retrieval as R
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
COUNTS = {"桂枝": 30, "桂枝湯": 20, "枝湯": 1, "湯": 9, "主": 8, "治": 8, "主治": 12, "太陽": 15, "中風": 15, "發熱": 6, "汗出": 6, "惡風": 4, "麻黃": 10, "麻黃湯": 8, "a1": 3}


def test_paths_are_the_most_probable(spark):
    graph = WordGraph(COUNTS)
    rng = random.Random(2)
    for _ in range(200):
        run = "".join(rng.choice("桂枝湯主治太陽中風X") for _ in range(rng.randint(1, 9)))
        best = None
        for k in range(len(run)):
            for cuts in combinations(range(1, len(run)), k):
                words = [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)), strict=True)]
                starts = [0, *cuts]
                known = [any(run[s:e] in graph.score for e in range(s + 1, len(run) + 1)) for s in starts]
                if all(w in graph.score or (len(w) == 1 and not k_) for w, k_ in zip(words, known, strict=True)):
                    score = sum(graph.score.get(w, graph.alone) for w in words)
                    if best is None or score > best + 1e-9:
                        best = score
        if best is not None:
            assert sum(graph.score.get(w, graph.alone) for w in graph.path(run)) == pytest.approx(best), run
    assert graph.words("桂枝湯主治太陽中風，ABC a1!") == ["桂枝湯", "主治", "太陽", "中風", "abc", "a1"]
    assert graph.words(None) == graph.words("，。 ") == []
    assert "".join(graph.path("未見之詞" * 5)) == "未見之詞" * 5


def test_search_and_diversity_take_segmented_words(spark):
    cut = segmenter(spark.createDataFrame(list(COUNTS.items()), "word string, n long"))
    docs = spark.createDataFrame([(1, "太陽中風，桂枝湯主治之"), (2, "麻黃湯主治發熱"), (3, "桂枝湯主治汗出惡風"), (4, None), (5, "桂枝")], "id long, text string")
    asked = spark.createDataFrame([(1, "桂枝湯")], "query_id long, text string")
    hits = R.bm25_search(docs, asked, cut(docs["text"]), cut(asked["text"]), 5)
    assert {r["id"] for r in hits.collect()} == {1, 3}
    words = docs.select("id", cut(docs["text"]).alias("words"))
    picked = R.mmr(hits.join(words, "id"), 1).collect()
    assert len(picked) == 1
    with pytest.raises(ValueError):
        segmenter(spark.createDataFrame(list(COUNTS.items()), "word string, n long"), most=3)


@pytest.mark.parametrize("ascii_words", [True, False])
def test_packed_words_give_the_same_paths(ascii_words):
    rng = random.Random(4)
    for counts in (COUNTS, {}, {"".join(rng.choice("abc𠀀湯") for _ in range(rng.randint(1, 7))): rng.randint(1, 3) for _ in range(300)}):
        plain = WordGraph(counts, ascii_words)
        packed = PackedGraph(PackedWords(pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())), ascii_words)
        for _ in range(100):
            text = "".join(rng.choice("abcX𠀀湯桂枝主治 ,\n1") for _ in range(rng.randrange(80)))
            assert packed.words(text) == plain.words(text), text
        assert packed.words(None) == packed.words("") == packed.path("") == []


def packed_graph(counts, ascii_words):
    return PackedGraph(PackedWords(pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())), ascii_words)


@pytest.mark.parametrize("ascii_words", [True, False])
@pytest.mark.parametrize(("characters", "few"), [(1 << 19, 8), (64, 3), (16, 1), (64, 1000)])
def test_many_texts_at_once_give_the_same_words(monkeypatch, ascii_words, characters, few):
    monkeypatch.setattr(segment, "RUN_CHARACTERS", characters)
    monkeypatch.setattr(segment, "FEW_RUNS", few)
    rng = random.Random(6)
    for letters in ("abc", "abé湯𠀀", "".join(map(chr, range(0x4E00, 0x4E40)))):  # few and many characters: tables and keys
        counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))): rng.randint(1, 4) for _ in range(400)}
        plain, packed = WordGraph(counts, ascii_words), packed_graph(counts, ascii_words)
        texts = [rng.choice([None, "", "，"])] + ["".join(rng.choice(letters + "x \n") for _ in range(int(rng.paretovariate(0.5)) % 900)) for _ in range(60)]
        found = packed.split(pa.array([None, *texts], pa.string())[1:])
        found.validate(full=True)
        assert found.to_pylist() == [plain.words(t) for t in texts]
    assert packed.split(pa.array([], pa.string())).to_pylist() == []


def test_python_takes_no_step_for_each_character():
    rng = random.Random(8)
    counts = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(3000)}
    graph = packed_graph(counts, False)
    text = "\n".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(50, 150))) for _ in range(400))
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line" and frame.f_code.co_filename == segment.__file__
        return count

    sys.settrace(count)
    try:
        words = graph.words(text)
    finally:
        sys.settrace(None)
    assert "".join(words) == text.replace("\n", "")
    assert lines < len(text) / 4


def test_a_dictionary_of_over_a_million_words(spark):
    words = spark.range(1_100_000).select(F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("word"), F.lit(3).alias("n"))
    cut = segmenter(words, ascii_words=False)
    found = spark.createDataFrame([("w0000007w1099999\nw1100000",)], "text string").select(cut(F.col("text")).alias("w")).first()["w"]
    assert found == ["w0000007", "w1099999", *"w1100000"]


def test_cohesive_words(spark):
    rng = random.Random(9)
    text = "，".join("".join(rng.sample(["甘草", "人參", "白朮", "茯苓", "之", "與"], 4)) for _ in range(400))
    found = {r["word"]: r["n"] for r in cohesive_words(spark.createDataFrame([(text,), (None,), ("no",)], "text string"), least_cohesion=5.0).collect()}
    assert {w for w in found if len(w) == 2} == {"甘草", "人參", "白朮", "茯苓"}
    assert found["之"] == text.count("之")


def test_segmented_query_equals_a_plain_path(spark):
    docs = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter(w for t in docs.values() for w in re.findall(r"[^\W\d_]+", t))
    graph = WordGraph({w: n for w, n in counts.items() if n >= 3}, ascii_words=False)
    found = {r["doc_id"]: r["n_pieces"] for r in registry.QUERIES["segmented_words"](spark, SF).collect()}
    for i, text in docs.items():
        runs = ["".join(re.findall(r"[^\W\d_]", line)) for line in text.split("\n")]
        score = 0.0
        total = 0
        for run in runs:
            best, size = [0.0] * (len(run) + 1), [0] * (len(run) + 1)
            for at in range(len(run) - 1, -1, -1):
                ways = [(graph.score[run[at:e]] + best[e], e) for e in range(at + 1, min(len(run), at + 40) + 1) if run[at:e] in graph.score]
                best[at], e = max(ways, default=(graph.alone + best[at + 1], at + 1))
                size[at] = 1 + size[e]
            score, total = score + best[0], total + size[0]
        assert found[i] == total, i


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contained_terms_equal_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(60)))) for i in range(40)] + [(90, None), (91, "")]
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    rows = [(i % 7, t) for i, t in enumerate(terms)] + [(99, terms[0]), (3, ""), (4, None)]
    place = {t: i % 7 for i, t in enumerate(terms)}
    df, listed = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(rows, "place long, term string")
    want = {(i, place[t], t, sum(x.startswith(t, j) for j in range(len(x))), x.find(t)) for i, x in texts if x for t in terms if t in x}
    assert {tuple(r) for r in C.contained_terms(df, listed).collect()} == want
    few = C.contained_terms(df, listed, 3).collect()
    for i, _ in texts:
        assert sorted((r["place"], r["term"]) for r in few if r["id"] == i) == sorted((w[1], w[2]) for w in want if w[0] == i)[:3]


def test_a_hundred_thousand_titles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    titles = spark.range(100_000).select(F.col("id").alias("place"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term")).unionByName(spark.createDataFrame([(7, "the"), (8, "tion")], "place long, term string"))
    found = C.contained_terms(docs, titles).groupBy("term").agg(F.sum("n").alias("n")).collect()
    texts = [r["text"] or "" for r in docs.collect()]
    assert {r["term"]: r["n"] for r in found if r["term"] in ("the", "tion")} == {"the": sum(t.count("the") for t in texts), "tion": sum(t.count("tion") for t in texts)}
