import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import piece_codec
from lodestone.llm.piece_codec import MODEL_FILE, PieceLattice, decode_documents, encode_documents, load_pieces, log_probabilities, nbest_ids, normalised


@pytest.fixture(scope="module")
def pieces():
    return load_pieces()


@pytest.fixture(scope="module")
def lattice(pieces):
    return PieceLattice(pieces)


def all_scores(lattice, word):
    """Scores of every segmentation, by plain recursion."""
    out = []

    def go(at, total):
        if at == len(word):
            out.append(total)
            return
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece in lattice.ids:
                go(end, total + lattice.reach[piece])
            elif end == at + 1:
                go(end, total + lattice.rare)

    go(0, 0.0)
    return out


@pytest.mark.parametrize("word", ["▁thing", "▁their", "▁ça", "▁中xé", "abc", "▁áb"])
def test_n_best_of_a_word_equals_enumeration(lattice, word):
    want = heapq.nlargest(6, all_scores(lattice, word))
    got = [s for s, _ in lattice.n_best(word, 6)]
    assert np.allclose(got, want)
    ids, best, gap = lattice.best(word)
    assert np.isclose(best, want[0])
    assert np.frombuffer(ids, dtype=np.int32).tolist() == list(lattice.n_best(word, 1)[0][1]) or np.isclose(gap, 0)
    if len(want) > 1:
        assert np.isclose(best - gap, want[1])


def test_n_best_of_a_text_equals_enumeration(lattice):
    for text in ["to a", "is it\nso", "a  b", " x y", "the é"]:
        want = heapq.nlargest(4, all_scores(lattice, "▁" + text.replace(" ", "▁")))
        assert np.allclose(lattice.encode(text, 4)[1], want), text


def test_changed_words_have_the_score_they_claim(lattice):
    text = "the thing there was this"
    _, scores, changes = lattice.encode(text, 4)
    words = lattice.words(text)
    for score, changed in zip(scores[1:], changes, strict=True):
        total = sum(lattice.best(w)[1] for i, w in enumerate(words) if i not in dict(changed))
        for i, ids in changed:
            total += next(s for s, way in lattice.n_best(words[i], 4) if way == ids)
        assert np.isclose(total, score)


def test_round_trip_of_odd_texts(lattice):
    rng = random.Random(5)
    alphabet = "ab th\n\t é中😀▁́\x00.,"
    for n in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(n % 40))
        ids = np.frombuffer(lattice.encode(text)[0], dtype=np.int32).tolist()
        assert lattice.decode(ids) == normalised(text)


def test_common_words_stay_whole_and_pieces_are_near_the_model_s(spark, lattice, pieces):
    import sentencepiece

    for word in "▁there ▁thing ▁international ▁committee ▁would ▁française ▁Bundes".split():
        assert lattice.n_best(word, 1)[0][1] == (lattice.ids[word],)
    assert np.isclose(sum(np.exp(p[1]) for p in pieces if p[2] == "normal"), 1)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL_FILE)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) between 1 and 5000").collect()]
    own, ours = sum(len(model.encode(t)) for t in texts), sum(len(lattice.encode(t)[0]) // 4 for t in texts)
    assert 0.95 < ours / own < 1.03
    assert log_probabilities([("a", -1.5, "normal"), ("<s>", 0.0, "other")]) == [("a", -1.5, "normal"), ("<s>", 0.0, "other")]


def test_known_words_are_bounded_by_bytes(pieces, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_BYTES", 20_000)
    lattice = PieceLattice(pieces)
    for n in range(500):
        lattice.encode(f"word{n} other{n}", 3)
        assert lattice.held <= 20_000 and len(lattice.seen) < 60


def test_text_ids_keep_their_type(spark, pieces):
    out = encode_documents(spark.createDataFrame([("a1", "hello")], "doc_id string, text string"), pieces)
    assert [r["doc_id"] for r in out.collect()] == ["a1"] and [r["text"] for r in decode_documents(out, pieces).collect()] == ["hello"]


def all_ways(lattice, word):
    """(score, ids) of every segmentation, by plain recursion."""
    if not word:
        return [(0.0, ())]
    out = []
    for end in range(1, len(word) + 1):
        piece = word[:end]
        if piece in lattice.ids or end == 1:
            score = lattice.reach.get(piece, lattice.rare)
            out += [(score + s, (*lattice.edge_ids(piece), *ids)) for s, ids in all_ways(lattice, word[end:])]
    return out


def test_n_best_ids_equal_enumeration(spark, pieces, lattice):
    texts = ["to a", "is it\nso", "a  b", " x y", "the é", "aaaa", "a", "zz zz", "", None]
    out = encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces, 4)
    rows = {r["doc_id"]: r for r in out.withColumn("all", nbest_ids(F.col("ids"), F.col("nbest_changes"))).collect()}
    for n, text in enumerate(texts):
        got = [tuple(ids) for ids in rows[n]["all"]]
        if not text:
            assert got == [] and rows[n]["nbest_changes"] == []
            continue
        ways = {ids: score for score, ids in all_ways(lattice, "▁" + text.replace(" ", "▁"))}
        assert len(set(got)) == len(got) == len(rows[n]["nbest_scores"]) == min(4, len(ways)) and list(got[0]) == rows[n]["ids"]
        assert np.allclose([ways[ids] for ids in got], rows[n]["nbest_scores"])
        assert np.allclose(rows[n]["nbest_scores"], heapq.nlargest(4, ways.values()))
        assert {lattice.decode(ids) for ids in got} == {normalised(text)}


def test_documents(spark, pieces):
    rows = [(1, "hello there", "x"), (1, "hello there", "x"), (None, None, "y"), (3, "", None), (4, "x" * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("score", F.lit(1))
    out = encode_documents(docs, pieces)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 5 and all(r["round_trip"] for r in got.values())
    assert got[None]["n_tokens"] == 0 and got[3]["nbest_scores"] == [] and got[1]["n_tokens"] == len(got[1]["ids"])
    back = {r["doc_id"]: r["text"] for r in decode_documents(out, pieces).collect()}
    assert back == {1: "hello there", None: "", 3: "", 4: "x" * 100_000}
    assert encode_documents(docs.limit(0), pieces).count() == 0
