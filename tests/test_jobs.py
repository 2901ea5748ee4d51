import random
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators.outcomes import DONE, FAILED, Outcomes
from lodestone.operators.testset import EXHAUSTIVE, cover_candidates, make_test_set, smallest_cover
from lodestone.session import new_path
from lodestone.streaming.sessions import newest_messages, run_session_windows


def test_outcomes_are_kept_and_reruns_take_what_is_left(spark):
    outcomes = Outcomes(spark, new_path(spark, "outcomes"), 4)
    rows = spark.createDataFrame([(i, str(i)) for i in range(30)] + [(3, "3"), (None, "x"), (100, None)], "id long, input string").repartition(3)

    def task(text):
        if text is not None and int(text) % 7 == 0:
            raise RuntimeError("boom " * 500)
        return text and text * 2

    assert outcomes.run(rows, task) == {DONE: 26, FAILED: 5}
    assert outcomes.run(rows, task) == {DONE: 0, FAILED: 5}
    assert outcomes.run(rows.unionByName(spark.createDataFrame([(31, "31")], rows.schema)), task) == {DONE: 1, FAILED: 5}
    assert outcomes.run(rows, task) == {DONE: 0, FAILED: 0}  # three tries are all
    got = {r["id"]: r for r in outcomes.read().collect()}
    assert len(got) == outcomes.read().count() == 32
    assert {i for i, r in got.items() if r["status"] == FAILED} == {"0", "7", "14", "21", "28"}
    assert got["7"]["attempts"] == 3 and len(got["7"]["error"]) == 500 and got["7"]["output"] is None
    assert got["8"]["output"] == "88" and got["8"]["attempts"] == 1 and got["100"]["output"] is None
    items = spark.createDataFrame([(8, "88"), (9, "9"), (7, "77"), (500, "")], "id long, expected string")
    scored = {r["id"]: r["score"] for r in outcomes.scored(items, (F.col("output") == F.col("expected")).cast("double")).collect()}
    assert scored == {"8": 1.0, "9": 0.0, "7": None, "500": None}


def test_smallest_cover_equals_exhaustive_search():
    rng = random.Random(3)
    for _ in range(300):
        wanted = set(range(rng.randrange(5)))
        held = [{e for e in range(5) if rng.random() < 0.35} for _ in range(rng.randrange(EXHAUSTIVE + 1))]
        sizes = [n for n in range(len(held) + 1) for c in combinations(range(len(held)), n) if wanted <= set().union(*(held[i] for i in c))]
        got = smallest_cover(held, wanted)
        assert (got is None) == (not sizes)
        if sizes:
            assert len(got) == min(sizes) and wanted <= set().union(*(held[i] for i in got))
    many = [{i} for i in range(30)] + [{0, 1, 2}]
    assert set().union(*(many[i] for i in smallest_cover(many, set(range(5))))) >= set(range(5))


def test_test_set_covers_or_fails(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    texts = [(i, f"d{i % 3}", " ".join(rng.sample(words[:4], rng.randint(1, 2)))) for i in range(40)] + [(90, "d1", None), (91, "d1", "")]
    asked = [(1, ["alpha", "beta"], None, False), (2, ["alpha", "beta", "gamma", "delta"], None, False), (3, [" ", ""], None, False), (4, ["omega", "alpha"], None, False), (5, ["alpha"], ["d2"], False), (6, ["alpha"], None, True), (7, None, None, None), (8, ["alpha"], ["none"], False)]
    chunks = spark.createDataFrame(texts, "id long, doc string, text string").withColumn("vector", V.character_vector("text"))
    items = spark.createDataFrame(asked, "query_id long, expect array<string>, docs array<string>, refuse boolean").withColumn("vector", V.character_vector(F.concat_ws(" ", "expect")))
    made = {r["query_id"]: r for r in make_test_set(items, chunks, 3).collect()}
    assert set(made) == {a[0] for a in asked}
    one, four = made[1], made[2]
    assert len(one["contexts"]) == 3 and {"alpha", "beta"} <= set(one["contexts"][0].split())
    assert {"alpha", "beta", "gamma", "delta"} <= set(" ".join(four["contexts"]).split()) and "alpha" in four["reference"] + " ".join(four["contexts"])
    assert len(made[3]["contexts"]) == len(made[7]["contexts"]) == 3 and made[3]["error"] is None
    assert made[4]["error"] == "not covered: omega" and made[4]["contexts"] == [] and made[8]["error"] == "not covered: alpha"
    assert made[6]["contexts"] == [] and made[6]["error"] is None and made[6]["reference"] == ""
    in_d2 = {t for _, d, t in texts if d == "d2"}
    assert set(made[5]["contexts"]) <= in_d2 and all("alpha" in t for t in made[5]["contexts"])
    rows = cover_candidates(items.filter("query_id IN (1, 2)").withColumn("expect", F.array_distinct("expect")), chunks, 2).collect()
    kept = {}
    for r in rows:
        kept.setdefault((r["query_id"], tuple(r["held"])), []).append(r["score"])
    assert all(len(s) <= 2 for s in kept.values())
    scores = {r["id"]: r for r in chunks.collect()}
    vectors = {r["query_id"]: r for r in items.collect()}
    for q in (1, 2):
        expect = vectors[q]["expect"]
        for mask in {tuple(i for i, e in enumerate(expect) if e in (t or "")) for _, _, t in texts} - {()}:
            own = sorted((round(sum(a * b for a, b in zip(scores[i]["vector"], vectors[q]["vector"], strict=True)), 6) for i, _, t in texts if tuple(j for j, e in enumerate(expect) if e in (t or "")) == mask), reverse=True)[:2]
            assert sorted(kept[q, mask], reverse=True) == own


def _messages(spark, folder, files):
    for n, rows in enumerate(files):
        pd.DataFrame(rows, columns=["user_id", "session_id", "ts", "turn", "role", "text"]).astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/{n}.parquet")
    return spark.readStream.schema("user_id string, session_id string, ts timestamp_ntz, turn long, role string, text string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def _at(minutes):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minutes)


def test_sessions_keep_the_newest_and_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice("xyz"), _at(i), i, rng.choice(["user", "assistant"]), rng.choice(["mail a@b.com", "call 13912345678", None, "plain"])) for i in range(120)]
    stream = _messages(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]])
    found = run_session_windows(spark, stream, new_path(spark, "sessions"), 5)
    whole = newest_messages(spark.createDataFrame(pd.DataFrame(rows, columns=["user_id", "session_id", "ts", "turn", "role", "text"])), 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert {r["text"] for r in found.collect()} <= {"mail [REDACTED]", "call [REDACTED]", None, "plain"}


def test_sessions_are_forgotten_by_the_time_of_the_messages(spark, tmp_path):
    """The clock is the watermark, which the messages move by hand."""
    files = [
        [("a", "old", _at(0), 1, "user", "one"), ("a", "kept", _at(0), 1, "user", "two")],
        [("a", "kept", _at(50), 2, "user", "still here")],  # its life begins anew
        [("b", "new", _at(90), 1, "user", "moves the clock past the first session's end")],
        [("b", "new", _at(91), 2, "user", "by now it is gone")],
        [("b", "new", _at(92), 3, "user", "and one batch more")],
    ]
    found = run_session_windows(spark, _messages(spark, tmp_path, files), new_path(spark, "sessions"), 5, life_seconds=3600, late="1 minute")
    assert {(r["session_id"], r["turn"]) for r in found.collect()} == {("kept", 1), ("kept", 2), ("new", 1), ("new", 2), ("new", 3)}
