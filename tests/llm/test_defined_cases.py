"""Odd tables through every stage of the pipeline, ties and long texts of the
language model, and the mix's fit beside an exact subset sum."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, mixing
from lodestone.session import staged

SF = "/root/testdata/sf0.001"
CLASHING = ["p", "d", "group", "first", "node", "key", "fp", "size", "taken", "digest", "mix_copies", "component_id", "keep_id", "lang_pred", "score", "ids", "n_tokens", "held_out", "salt"]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in any column, empty, blank and long texts, rows
    that repeat, and columns whose names the stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.filter("length(text) > 200").orderBy("doc_id").first()["text"]
    more = [(None, None), (None, text), (None, text), (-1, ""), (-2, " \t\n"), (-3, None), (-4, (text + " ") * 400), (-5, text), (-5, text), (-6, "12 !?")]
    rows = spark.createDataFrame(more, "doc_id long, text string")
    table = docs.unionByName(rows, allowMissingColumns=True)
    return staged(table.withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)}), "odd-documents")


@pytest.mark.parametrize("number", range(5))
def test_every_stage_takes_odd_tables(spark, odd, number):
    import corpus_pipeline as P

    name, stage = P.STAGES[number]
    out = staged(stage(spark, odd, SF), f"odd-{name}")
    rows = out.collect()
    if name != "sentencepiece":
        assert out.columns == odd.columns
        assert all(tuple(r[c] for c in CLASHING) == tuple(range(len(CLASHING))) for r in rows)
        given = Counter((r["doc_id"], r["text"]) for r in odd.collect())
        kept = Counter((r["doc_id"], r["text"]) for r in rows)
        assert set(kept) <= set(given)
    if name == "language_id":
        assert all(any(c.isalpha() for c in r["text"]) for r in rows) and all(kept[k] == given[k] for k in kept)
        assert len(rows) > 0.9 * sum(1 for r in odd.collect() if r["text"] and any(c.isalpha() for c in r["text"]))
    elif name == "exact_dedup":
        texts = {re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in kept}
        assert texts == {re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in given} and len(texts) == len(rows)
    elif name == "simhash_near_dedup":
        assert sum(not (t or "").strip() for _, t in kept) == 1 and (None, None) not in kept and len(rows) < odd.count()
    elif name == "source_mix":
        assert all(kept[k] <= 2 * given[k] for k in kept) and not any(not (t or "").strip() for _, t in kept)
    else:
        assert len(rows) == odd.count() and all((r["n_tokens"] or 0) == len(r["ids"] or []) for r in rows)
    nothing = stage(spark, odd.limit(0), SF)
    assert nothing.columns == out.columns and nothing.collect() == []


def test_languages_of_repeated_rows_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    best = {r["lang"]: r["text"] for r in docs.filter("length(text) > 500 AND lang IS NOT NULL").orderBy("doc_id").collect()}
    rows = [(n, (text + " ") * times) for n, text in enumerate(best.values()) for times in (1, 1, 3000)]
    found = language_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert Counter(r["doc_id"] for r in found) == dict.fromkeys(range(len(best)), 3)
    assert all(len({r["lang_pred"] for r in found if r["doc_id"] == n}) == 1 for n in range(len(best)))


def test_tied_votes_go_to_the_first_name():
    flat = lambda shift: (np.zeros(language_id.FEATURES), shift)
    families = {"a": ["a"], "b": ["b"], "c": ["c"]}
    for shifts in ((1.0, -1.0, 1.0), (-1.0, 1.0, -1.0)):  # each wins once by as much as it loses
        pairs = dict(zip([("a", "b"), ("a", "c"), ("b", "c")], map(flat, shifts), strict=True))
        langs, scores = language_id.LanguageModel(families, pairs).predict(["word", "x", None, "1"])
        assert langs == ["a", "a", "und", "und"] and 0 < scores[0] == scores[1] < 0.5 and scores[2:] == [0.0, 0.0]


def nearest(lengths, counts, budget):
    """The least distance of any subset's sum from the budget, by plain sets."""
    sums = {0}
    for length, n in zip(lengths, counts, strict=True):
        sums = {s + k * length for s in sums for k in range(n + 1)}
    return min(abs(s - budget) for s in sums)


def test_fit_beside_an_exact_subset_sum():
    rng = random.Random(4)
    for _ in range(400):
        lengths = np.array(sorted(rng.sample(range(0, 60), rng.randint(1, 6))), dtype=np.int64)
        counts = np.array([rng.randint(0, 6) for _ in lengths], dtype=np.int64)
        total = int((lengths * counts).sum())
        budget = rng.uniform(0, total)
        taken = mixing.fit_counts(lengths, counts, budget)
        assert ((0 <= taken) & (taken <= counts)).all()
        off = abs(int((lengths * taken).sum()) - budget)
        assert off <= nearest(lengths.tolist(), counts.tolist(), budget) + lengths.max() / 2, (lengths, counts, budget, taken)
