import random
import re
import zlib
from collections import Counter

import pytest
from oracle import compare, database

from lodestone.llm import spelling

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def judged(counts, ratio=2):
    out, form = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        top = min(near, key=lambda x: (-counts[x], x), default=None)
        if top is not None and counts[top] >= ratio * n:
            form[w] = top
        out[w] = (n, len(near))
    found = set()
    for w, (n, k) in out.items():
        root = w
        while root in form:
            root = form[root]
        found.add((w, form.get(w), root, n, k, counts[form[w]] if w in form else None))
    return found


@pytest.mark.parametrize("crowd", [50_000, 12, 5])
def test_forms_equal_brute_force(spark, crowd):
    rng = random.Random(7)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 9))) for _ in range(250)}
    words |= {"".join(rng.choice("ab") for _ in range(60)) for _ in range(3)} | {"aaaaa" * 3 + c for c in "abcdefgh"} | {"z" * 400, "z" * 401, "z" * 200 + "y" + "z" * 199, "日本語", "日本", "日語", "😀a", "😀b"}
    counts = {w: rng.choice([1, 1, 2, 3, 5, 9, 20]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in spelling.variant_forms(df, crowd=crowd).collect()} == judged(counts)
    pairs = [tuple(r)[:2] for r in spelling.near_pairs(df, crowd).collect()]
    assert len(pairs) == len(set(pairs))


def test_long_chains_of_forms(spark):
    chain = ["aaaaaaaaaaaa"[: 12 - i] + "b" * i for i in range(13)]
    df = spark.createDataFrame([(w, 2**i) for i, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in spelling.variant_forms(df).collect()} == {"b" * 12}


def test_words_of_texts(spark):
    rows = [(1, "Straße straße STRASSE Àé"), (2, None), (3, ""), (None, "x-ray's Hello,hello"), (1, "Straße")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    found = {r["word"]: r["n"] for r in spelling.word_counts(docs, least_length=2, least_count=1).collect()}
    assert found == {"straße": 3, "strasse": 1, "Àé": 1, "ray": 1, "hello": 2}
    none = docs.filter("doc_id > 9")
    assert spelling.variant_forms(spelling.word_counts(none)).collect() == []


def test_planted_typos(spark):
    rows = [(i, w) for i in range(60) for w in ("hello", "straße", "a", "ÀÿÀÿÀÿ")]
    df = spark.createDataFrame([(str(i), w) for i, w in rows], "id string, run string")
    found = Counter(r[0] for r in df.select(spelling.planted_typos(df["id"], df["run"], 7)).collect())
    want = Counter()
    for i, w in rows:
        h = zlib.crc32(f"{i}:{w}".encode())
        want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 7 == 0 else w] += 1
    assert found == want


def test_query_equals_its_sql_and_brute_force(spark):
    found = spelling.op11_spelling(spark, SF)
    compare(found, database(SF), spelling.OP11_SQL)
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall(spelling.RUN, (r["text"] or "").translate(lower)):
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert {(r["word"], r["n"]) for r in found.collect()} == {(w, n) for w, n in counts.items() if len(w) >= 5 and n >= 3}
